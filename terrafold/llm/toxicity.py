"""Toxicity by multiple-instance learning: sentences are scored, noisy-or joins them, only documents have labels.

A sentence's score is the logistic of a sum of weights over its words: each word has a weight for itself and for its
first 4, 5 and 6 bytes, found by 64-bit hashes. Only what training documents clearly associate with the label has a
weight, so that no document is learnt by its rare words. A document is toxic if any sentence is: P = 1 - product(1 - p). The likelihood of
document labels is maximised by Adam on a bounded sample; then every sentence of every document gets a score, and the
offending ones can be located.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.shared import anonymous, column_of, ship_package, written
from terrafold.llm.textbytes import SPACE, HashIndex, buffers, counted, slices, span_hashes, span_sums, words

PREFIXES = (4, 5, 6)
#: At most so many training documents of each label are used to fit the model, and about so many characters of them: both
#: bound the sample, whatever the size of the labelled corpus.
SAMPLE_PER_LABEL = 3000
SAMPLE_CHARACTERS = 40_000_000
#: Ids of labelled rows that are broadcast to look for their texts; more meet them in a shuffle.
BROADCAST_IDS = 200_000
#: What has a weight occurs more often in toxic training documents than in others, by this log-likelihood ratio (G squared).
LEAST_G = 20.0
THRESHOLD = 0.7

#: Whatever ASCII that isn't a letter or digit ends a word; these also end a sentence.
_BREAKS = np.array([not (chr(k).isalnum() or k >= 128) for k in range(256)]) | SPACE
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


def sentence_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8: a row of hashes for each word, the sentence of each word (numbered through), the document of
    each sentence that has words, and the sentence's first and last byte in its document."""
    starts, ends, first = words(data, offsets, _BREAKS)
    sums = span_sums(data, starts)
    columns = [span_hashes(sums, starts, ends)]
    for n in PREFIXES:
        # Shorter words have no prefix of their own: they use their own weight again.
        columns.append(span_hashes(sums, starts, np.minimum(starts + n, ends)) * np.uint64(2 * n + 1))
    hashes = np.stack(columns, 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    passed = np.cumsum(_ENDS[data])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (passed[1:] != passed[:-1]) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    spans = np.stack([starts[begins], ends[np.append(begins[1:], len(starts)) - 1]], 1) if len(starts) else np.zeros((0, 2), np.int64)
    return hashes, sentence, doc[begins], spans - offsets[doc[begins]][:, None]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


class Model:
    """Weights of hashes (the last weight, 0, is that of all others) and the logit of a sentence without any."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = HashIndex(keys), np.append(weights, 0.0), bias

    def sentences(self, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """The logit of each sentence; repeated words count once for each time."""
        each = self.weights[self.index.find(hashes.ravel())].reshape(hashes.shape).sum(1)
        return self.bias + np.bincount(sentence, each, n)

    def documents(self, logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of sentences: 1 - exp(sum of log(1 - p)); documents without words get 0."""
        return -np.expm1(-np.bincount(doc, _softplus(logits), n))


def _distinct_features(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different hashes, and the document of each."""
    hashes, sentence, doc, _ = sentence_features(*buffers(part))
    of = np.repeat(doc[sentence], hashes.shape[1])
    flat = hashes.ravel()
    order = np.lexsort((flat, of))
    flat, of = flat[order], of[order]
    once = np.ones(len(flat), bool)
    once[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    return flat[once], of[once]


def _surprise(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G squared of features that so many of n1 toxic and n0 other documents have."""
    g = np.zeros(len(toxic))
    share = (toxic + other) / (n1 + n0)
    for seen, n in ((toxic, n1), (other, n0)):
        for x, p in ((seen, share), (n - seen, 1 - share)):
            g += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(n * p, 1e-12)), 0)
    return g


def _telling(parts: list[pa.Array], labels: list[np.ndarray]) -> np.ndarray:
    """Hashes that occur in a larger share of toxic documents than of others, with a G squared of LEAST_G at least.

    A feature that too few toxic documents have can't reach that even if no other has it, so others are counted only for
    the features that can: what is held follows from the toxic documents of the sample.
    """
    n1, n0 = sum(int((y > 0).sum()) for y in labels), sum(int((y == 0).sum()) for y in labels)
    found = []
    for part, y in zip(parts, labels, strict=True):
        flat, of = _distinct_features(part.filter(pa.array(y > 0)))
        found.append(counted(flat))
    keys, toxic = counted(*(np.concatenate(x) for x in zip(*found, strict=True)))
    del found
    enough = np.flatnonzero(_surprise(np.arange(n1 + 1), np.zeros(n1 + 1, np.int64), n1, n0) >= LEAST_G)
    kept = toxic >= (enough[0] if len(enough) else n1 + 1)
    keys, toxic = keys[kept], toxic[kept]
    other = np.zeros(len(keys), np.int64)
    for part, y in zip(parts, labels, strict=True):
        flat, _ = _distinct_features(part.filter(pa.array(y == 0)))
        at = np.searchsorted(keys, flat)
        hit = at < len(keys)
        at = at[hit][keys[at[hit]] == flat[hit]]
        other += np.bincount(at, minlength=len(keys))
    return keys[(_surprise(toxic, other, n1, n0) >= LEAST_G) & (toxic * n0 > other * n1)]


def fit(texts: pa.Array, labels: np.ndarray, shares: tuple[float, float] | None = None, **settings) -> Model:
    """The model of weights()."""
    return Model(*weights(texts, labels, shares, **settings))


def weights(
    texts: pa.Array, labels: np.ndarray, shares: tuple[float, float] | None = None, epochs: int = 15, rate: float = 0.05, decay: float = 1e-5, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, float]:
    """What a Model is made of, by Adam on the likelihood of document labels. Without examples of both labels the model says 0 throughout.

    shares: how frequent the labels 0 and 1 are where the examples come from. Examples are weighted to these shares, so a
    sample that has as many of each doesn't change how likely a document is toxic before anything is known of its text.
    """
    if len(set(labels.tolist())) < 2:
        return np.zeros(0, np.uint64), np.zeros(0), -50.0
    of_label = np.bincount(labels, minlength=2) / len(labels)
    weight = np.ones(2) if shares is None else np.array(shares) / sum(shares) / of_label
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    groups = [order[k : k + 100] for k in range(0, len(order), 100)]
    parts = [texts.take(pa.array(g)) for g in groups]
    keys = _telling(parts, [labels[g] for g in groups])
    index, batches = HashIndex(keys), []
    for g, part in zip(groups, parts, strict=True):
        hashes, sentence, doc, _ = sentence_features(*buffers(part))
        found = index.find(hashes.ravel())
        at = np.repeat(sentence, hashes.shape[1])[found >= 0].astype(np.int32)
        used, inverse = np.unique(found[found >= 0], return_inverse=True)
        batches.append((used, inverse.astype(np.int32), at, doc.astype(np.int32), labels[g].astype(float)))
    w, bias = np.zeros(len(keys)), -6.0
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            used, inverse, at, doc, y = batches[k]
            logits = bias + np.bincount(at, w[used][inverse], len(doc))
            total = np.bincount(doc, _softplus(logits), len(y))
            # The slope of the log likelihood in total: of log(1 - exp(-total)) for toxic documents, of -total for others.
            slope = np.where(y > 0, weight[1] / np.expm1(np.clip(total, 1e-9, 500)), -weight[0])
            by_sentence = slope[doc] / (1 + np.exp(np.minimum(-logits, 500))) / len(y)
            g = decay * w[used] - np.bincount(inverse, by_sentence[at], len(used))
            gb = -by_sentence.sum()
            t += 1
            m[used] = 0.9 * m[used] + 0.1 * g
            v[used] = 0.99 * v[used] + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w[used] -= rate * (m[used] / (1 - 0.9**t)) / (np.sqrt(v[used] / (1 - 0.99**t)) + 1e-6)
            bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return keys, w, bias


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL, characters: int = SAMPLE_CHARACTERS) -> DataFrame:
    """y and text of the examples: of each label, the documents whose hashed ids are smallest, up to per_label of them and
    characters / 2 in all (the first one whatever its length).

    An id that is labelled more than once has its largest label. Of several texts of an id the one with the least hash is
    the example. Labels other than 0 and 1, null ids, ids without a text and null texts give no example; others take their
    place. A very long text ends a sample early, but no text is left out for its length.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = written(rows.withColumn("h", F.xxhash64("doc_id")), "labels")
    texts = docs.select("doc_id", F.lower(F.col(text)).alias("text")).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    asked = 2 * per_label
    while True:
        some = [rows.filter(F.col("y") == y).orderBy("h", "doc_id").limit(asked) for y in (0, 1)]
        ids = some[0].union(some[1])
        found = texts.join(F.broadcast(ids) if 2 * asked <= BROADCAST_IDS else ids, "doc_id")  # at most 2 * asked rows
        found = found.groupBy("doc_id", "y", "h").agg(F.min(F.struct(F.xxhash64("text").alias("g"), F.col("text").alias("text"))).alias("first"))
        found = written(found.select("y", "h", "doc_id", F.col("first.text").alias("text")), "examples")
        n = {r[0]: r[1] for r in found.groupBy("y").count().collect()}
        there = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
        if all(n.get(y, 0) >= per_label or there.get(y, 0) <= asked for y in (0, 1)):
            break
        asked *= 8
    sizes = found.select("y", "doc_id", "h", F.length("text").alias("size"))
    own = Window.partitionBy("y").orderBy("h", "doc_id")  # a few numbers of each of at most `asked` rows
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("k", F.row_number().over(own)).withColumn("before", before)
    kept = ranked.filter((F.col("k") <= per_label) & (F.col("before") + F.when(F.col("k") > 1, F.col("size")).otherwise(0) <= characters // 2))
    return found.join(F.broadcast(kept.select("doc_id")), "doc_id").select("y", "h", "doc_id", "text")  # at most 2 * per_label ids


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL, characters: int = SAMPLE_CHARACTERS) -> Model:
    """Fit on sample() of labels (doc_id, toxic), weighted by how frequent the labels are among all labelled ids.

    Only the sampled ids meet docs (doc_id, text). Odd labels, ids and texts as in sample(); further columns are ignored.
    One task fits the bounded sample, so the driver holds weights only.
    """
    ship_package(docs.sparkSession)
    shares = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).agg(*(F.sum((F.col(label) == y).cast("long")) for y in (0, 1))).first()
    of_labels = (shares[0] or 0, shares[1] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("y", pa.int32())]))
        keys, w, bias = weights(got["text"].combine_chunks().cast(pa.large_string()), got["y"].to_numpy().astype(np.int64), of_labels)
        # The row without a key is the bias.
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], names=["key", "weight"])

    examples = sample(docs, labels, text, label, per_label, characters).repartition(1).sortWithinPartitions("y", "h", "doc_id").select("text", "y")
    rows = examples.mapInArrow(run, "key long, weight double").toArrow()
    if not rows.num_rows:  # no task for no examples
        return fit(pa.array([], pa.large_string()), np.zeros(0, np.int64))
    keys, w = rows["key"].combine_chunks(), rows["weight"].to_numpy()
    bias = keys.is_null().to_numpy(zero_copy_only=False)
    return Model(keys.drop_null().to_numpy().view(np.uint64), w[~bias], float(w[bias][0]))


def score(docs: DataFrame, model: Model, keep: list[Column], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """keep, score (0 to 1), predicted (1 from the threshold on), and the worst sentence's span in bytes of the
    lower-cased text (worst_start, worst_end; null without words; the first on ties) for every row.

    Null, empty and wordless texts score 0. Repeated rows and rows with null ids are scored each; an empty table gives no
    rows; further columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # what occurs often in a bounded sample
    rows = docs.select(*keep, F.lower(F.col(text)).alias("_text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "_text"):
                hashes, sentence, doc, spans = sentence_features(*buffers(part.column("_text")))
                logits = m.sentences(hashes, sentence, len(doc))
                scores = m.documents(logits, doc, part.num_rows)
                order = np.lexsort((-np.arange(len(doc)), logits, doc))
                last = order[np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True))] if len(doc) else order
                worst = np.full((part.num_rows, 2), -1)
                worst[doc[last]] = spans[last]
                none = worst[:, 0] < 0
                columns = [*(part.column(k) for k in range(len(names))), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(worst[:, 0], mask=none), pa.array(worst[:, 1], mask=none)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted", "worst_start", "worst_end"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double, predicted int, worst_start long, worst_end long"])
    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, repeated ones as often, with all their columns under their names; null and
    empty texts stay."""
    own = anonymous(docs)
    marked = score(own, model, [F.col(c) for c in own.columns], column_of(docs, text), threshold)
    return marked.filter("predicted = 0").select(*own.columns).toDF(*docs.columns)
