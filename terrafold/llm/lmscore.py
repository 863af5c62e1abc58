"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ORDER bytes long. A symbol seen in the longest context costs its share there;
otherwise an escape is paid, estimated from the number of distinct symbols (method D), and the next shorter context is
asked, without the symbols that the longer one has (exclusion), down to a uniform choice among what is left. Every
context's counts come from the whole training corpus: (ORDER + 1)-grams of bytes are counted in one pass over it and
summed by Spark; counts of shorter contexts are sums of those. The symbol END closes each text and stands before it.

Because the counts are fixed before scoring, what exclusion takes away depends only on the context escaped from and the
next shorter one. So every cost follows from the nodes of the contexts that are suffixes of one another, and whole batches
are scored by lookups in numpy.

The documents are read twice, whatever the size of the trie. The first pass counts. In the second, the most frequent
n-grams (at most FREQUENT_GRAMS) have their costs broadcast; whatever else a document asks for goes on as numbers, once
for each document. Those asked are made distinct and meet the trie where it lies: buckets of nodes whose contexts end in
the same SHARED symbols hold all that decides their costs but the counts of shorter contexts, of which there are at most
SYMBOLS ** SHARED, and those are broadcast. Costs then go back to the documents by a join. No node is ever dropped, no
task holds more than a bucket of about BUCKET_NODES, and what is broadcast doesn't grow with the corpus.

Beside it, a base score: unigram probabilities of words with add-one smoothing. Frequent words (at most FREQUENT) are
broadcast with their counts; the rest meet their counts in a shuffle join.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import ship_package, written
from terrafold.llm.textbytes import LOWER, HashIndex, buffers, counted, span_sums, slices, span_hashes, sums_by_row, words

ORDER = 5
END = 256
SYMBOLS = 257
FREQUENT = 200_000
#: (ORDER + 1)-grams whose costs are broadcast, at most; and those of a bucket of the trie, about.
FREQUENT_GRAMS = 1_000_000
BUCKET_NODES = 500_000
#: Contexts that end in the same so many symbols lie in the same bucket.
SHARED = 3
#: A word's hash that no word has but the end of a text.
END_WORD = np.uint64(0x51D7348A1F3C99E5)
_GRAM, _WORD = 0, 1


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the (ORDER + 1)-gram that ends at each symbol, base SYMBOLS, oldest symbol first; and where each text's
    symbols begin. A text has its bytes (A-Z lower-cased) and END; before it stand ORDER times END."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = offsets + np.arange(n + 1) * (ORDER + 1)
    padded = np.full(int(at[-1]) + ORDER, END, np.int64)
    own = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * ORDER + np.arange(n), size)
    padded[own] = LOWER[data]
    keys = np.zeros(int(at[-1]), np.int64)
    for k in range(ORDER + 1):
        keys = keys * SYMBOLS + padded[k : k + len(keys)]
    # Position i of keys ends at padded[i + ORDER]; a text's own symbols are its bytes and the END after them.
    real = np.ones(len(keys), bool)
    gaps = (at[:-1] + size + 1)[:, None] + np.arange(ORDER)[None]
    real[gaps.ravel()[gaps.ravel() < len(keys)]] = False
    first = np.concatenate([[0], np.cumsum(size + 1)])
    return keys[real], first


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words, A-Z lower-cased, and the index of each row's first one."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    return span_hashes(span_sums(low, starts), starts, ends), first


def corpus_counts(texts: DataFrame) -> DataFrame:
    """kind, key, n: exact counts of byte (ORDER + 1)-grams (kind 0) and of word hashes (kind 1) over a `text` column."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_GRAM: [], _WORD: []}
        rows = {_GRAM: 0, _WORD: 0}

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            return counted(keys, counts)

        def out(kind: int) -> pa.RecordBatch:
            keys, counts = merged(kind)
            held[kind], rows[kind] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                hashes, _ = word_hashes(data, offsets)
                hashes = np.concatenate([hashes, np.full(part.num_rows, END_WORD)])
                for kind, keys in ((_GRAM, symbols(data, offsets)[0]), (_WORD, hashes)):
                    found = counted(keys)
                    held[kind].append(found)
                    rows[kind] += len(found[0])
                    if rows[kind] > 2_000_000:
                        held[kind] = [merged(kind)]
                        rows[kind] = len(held[kind][0][0])
                        if rows[kind] > 1_500_000:
                            yield out(kind)
        for kind in held:
            if held[kind]:
                yield out(kind)

    partial = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, key long, n long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Low:
    """Counts of all contexts shorter than SHARED, from those of SHARED symbols (SHARED - 1 and the next one)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = {}
        keys, counts = counted(keys, counts)
        for j in range(SHARED - 1, -1, -1):
            self.levels[j] = _Level(keys, counts)
            keys, counts = counted(keys % SYMBOLS**j, counts)


class _Level:
    """Contexts of one length with their next symbols: index finds both, context the context alone; count, total and
    distinct are the counts of theirs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.index = HashIndex(keys.view(np.uint64))
        self.count = counts.astype(np.float64)
        self.contexts, self.first = np.unique(keys // SYMBOLS, return_index=True)
        self.context = HashIndex(self.contexts.view(np.uint64))
        ends = np.append(self.first[1:], len(keys))
        self.total = np.add.reduceat(self.count, self.first) if len(keys) else np.zeros(0)
        self.distinct = (ends - self.first).astype(np.float64)


class Trie:
    """Costs, as log10 probabilities, of all symbols after the contexts of a bucket: all that end in certain SHARED symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: Low):
        """keys, counts: sorted (ORDER + 1)-grams of the bucket."""
        levels = {ORDER: _Level(keys, counts)}
        for j in range(ORDER - 1, SHARED - 1, -1):
            levels[j] = _Level(*counted(levels[j + 1].keys % SYMBOLS ** (j + 1), levels[j + 1].count.astype(np.int64)))
        self.levels = levels | low.levels
        longest = levels[ORDER]
        of = np.searchsorted(longest.contexts, keys // SYMBOLS)
        self.seen = np.log10((longest.count - 0.5) / longest.total[of]) if len(keys) else np.zeros(0)
        self.escape = np.log10(longest.distinct / (2 * longest.total))
        # Of each context's suffix: what is left without the symbols that the context has itself; for each context of j symbols.
        self.rest_total, self.rest_distinct = {}, {0: np.array([SYMBOLS - len(self.levels[0].keys)], float)}
        for j in range(1, ORDER + 1):
            at, below = self.levels[j], self.levels[j - 1]
            mine = below.count[below.index.find((at.keys % SYMBOLS**j).view(np.uint64))] if len(at.keys) else np.zeros(0)
            suffix = below.context.find((at.contexts % SYMBOLS ** (j - 1)).view(np.uint64))
            self.rest_total[j] = below.total[suffix] - np.add.reduceat(mine, at.first) if len(at.keys) else np.zeros(0)
            self.rest_distinct[j] = below.distinct[suffix] - at.distinct if len(at.keys) else np.zeros(0)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each (ORDER + 1)-gram after the others."""
        longest = self.levels[ORDER]
        node = longest.index.find(keys.view(np.uint64))
        out = self.seen[node] if len(self.seen) else np.zeros(len(keys))
        todo = np.flatnonzero(node < 0)
        keys = keys[todo]
        came = longest.context.find((keys // SYMBOLS).view(np.uint64))
        cost = np.where(came >= 0, self.escape[came], 0.0) if len(self.escape) else np.zeros(len(keys))
        for j in range(ORDER - 1, -1, -1):
            at, k = self.levels[j], keys % SYMBOLS ** (j + 1)
            node = at.index.find(k.view(np.uint64))
            context = at.context.find((k // SYMBOLS).view(np.uint64))
            total, distinct = np.zeros(len(k)), np.zeros(len(k))
            there, longer = context >= 0, came >= 0
            total[there], distinct[there] = at.total[context[there]], at.distinct[context[there]]
            total[longer], distinct[longer] = self.rest_total[j + 1][came[longer]], self.rest_distinct[j + 1][came[longer]]
            hit = node >= 0
            out[todo[hit]] = cost[hit] + np.log10((at.count[node[hit]] - 0.5) / total[hit])
            paid = ~hit & (distinct > 0)  # a context that has nothing new needs no escape
            cost[paid] += np.log10(distinct[paid] / (2 * total[paid]))
            todo, keys, came, cost = todo[~hit], keys[~hit], context[~hit], cost[~hit]
        out[todo] = cost - np.log10(np.maximum(1.0, self.rest_distinct[0][0]))
        return out


def low_counts(grams: DataFrame) -> Low:
    """The counts of contexts shorter than SHARED, from (key, n): at most SYMBOLS ** SHARED rows, and as many as there are
    different sequences of SHARED bytes."""
    got = grams.groupBy((F.col("key") % SYMBOLS**SHARED).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    return Low(got["key"].to_numpy(), got["n"].to_numpy())


def asked_costs(grams: DataFrame, asked: DataFrame, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """key and cost of each distinct key of asked, under the trie of grams (key, n)."""
    spark = grams.sparkSession
    low = spark.sparkContext.broadcast(low_counts(grams))
    buckets = max(1, -(-grams.count() // bucket_nodes))
    bucket = F.pmod(F.xxhash64(F.expr(f"(key DIV {SYMBOLS}) % {SYMBOLS**SHARED}")), F.lit(buckets))

    def run(nodes: pa.Table, keys: pa.Table) -> pa.Table:
        at, n = nodes["key"].to_numpy(), nodes["n"].to_numpy()
        order = np.argsort(at)
        own = keys["key"].to_numpy()
        return pa.table({"key": own, "cost": Trie(at[order], n[order], low.value).costs(own)})

    left, right = (x.withColumn("bucket", bucket).groupBy("bucket") for x in (grams.select("key", "n"), asked.select("key").distinct()))
    return left.cogroup(right).applyInArrow(run, "key long, cost double")


def frequent_costs(grams: DataFrame, most: int = FREQUENT_GRAMS) -> dict[str, np.ndarray]:
    """Keys and costs of the most frequent of grams (key, n), at most `most`: each is seen, so its context decides."""
    cut, _ = _frequency(grams, most)
    context = F.expr(f"key DIV {SYMBOLS}")
    totals = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    often = grams.filter(F.col("n") >= cut).join(totals, context == F.col("context"))
    got = often.select("key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("cost")).toArrow()
    return {"keys": got["key"].to_numpy().view(np.uint64), "cost": got["cost"].to_numpy()}


def _frequency(counts: DataFrame, most: int) -> tuple[int, list[tuple[int, int]]]:
    """The least count from which on there are at most `most` keys, to an eighth of an octave; keys and their sum by octaves."""
    size = F.floor(F.log2("n") * 8).cast("int")
    bins = {r[0]: tuple(r[1:]) for r in counts.groupBy(size).agg(F.count(F.lit(1)), F.sum("n"), F.min("n")).collect()}  # at most 8 * 63 rows
    held, cut = 0, 1 << 62
    for b in sorted(bins, reverse=True):
        if held + bins[b][0] > most:
            break
        held, cut = held + bins[b][0], bins[b][2]
    return cut, [(k, n) for k, n, _ in bins.values()]


def lm_scores(
    docs: DataFrame, training: DataFrame, keep: list[Column], text: str = "text", bucket_nodes: int = BUCKET_NODES, frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS
) -> DataFrame:
    """keep (columns of docs), n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    score is the PPM log10 probability of the text's bytes (A-Z lower-cased) and END under the trie of all training texts; base_score is
    the sum over words and the end of log10((c + 1) / (N + V + 1)). Null texts count as empty, repeated rows each; an
    empty table gives no rows; further columns are ignored; no training rows give the uniform model. Words are counted by
    hashes of 64 bits.
    """
    spark = docs.sparkSession
    ship_package(spark)
    counts = written(corpus_counts(training.select(F.col(text).alias("text"))), "corpus-counts")
    grams, each = counts.filter(F.col("kind") == _GRAM), counts.filter(F.col("kind") == _WORD)
    cut, bins = _frequency(each, frequent)
    n_all, v_all = sum(n for _, n in bins), sum(k for k, _ in bins)
    got = each.filter(F.col("n") >= cut).select("key", "n").toArrow()
    often = spark.sparkContext.broadcast({"keys": got["key"].to_numpy().view(np.uint64), "n": got["n"].to_numpy()})  # at most `frequent` words
    costs = spark.sparkContext.broadcast(frequent_costs(grams, frequent_grams))  # at most `frequent_grams` numbers
    # A row's number is made and stored in this one pass over the texts.
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*kept, "ppm double, n_tokens long, often long, base double, words array<long>, grams array<long>"])
    first = written(rows.mapInArrow(_scoring(costs, often, rows.columns[:-1]), schema), "scored")
    asked = written(first.select("row", F.explode("grams").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times")), "asked")
    found = asked_costs(grams, asked, bucket_nodes)
    more = asked.join(found, "key").select("row", (F.col("cost") * F.col("times")).alias("ppm_more"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base_more"))
    apart = first.select("row", F.explode("words").alias("key")).groupBy("row", "key").count()
    apart = apart.join(each.filter(F.col("n") < cut).select("key", "n"), "key")
    apart = apart.select("row", F.lit(0.0).alias("ppm_more"), F.col("count").alias("known"), (F.col("count") * F.log10(F.col("n") + 1)).alias("base_more"))
    sums = more.union(apart).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("ppm_more", "known", "base_more")))
    out = first.drop("words", "grams").join(sums, "row", "left")
    return out.select(
        *rows.columns[:-2],
        "n_tokens",
        (F.col("often") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"),
        (F.col("ppm") + F.coalesce("ppm_more", F.lit(0.0))).alias("score"),
    )


def _left(values: np.ndarray, left: np.ndarray, pointers: np.ndarray) -> pa.Array:
    """A list for each row of those of its values that are left."""
    sizes = sums_by_row(left.astype(np.int64), pointers)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(values[left].view(np.int64))).cast(pa.list_(pa.int64()))


def _scoring(costs, often, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = grams = None
        for batch in batches:
            if index is None:
                # A last entry, 0, for what isn't found.
                index, logs = HashIndex(often.value["keys"]), np.append(np.log10(often.value["n"] + 1.0), 0.0)
                grams, cost = HashIndex(costs.value["keys"]), np.append(costs.value["cost"], 0.0)
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                keys, at = symbols(data, offsets)
                node = grams.find(keys.view(np.uint64))
                hashes, first = word_hashes(data, offsets)
                # The end of a text is a token too.
                hashes, first = np.insert(hashes, first[1:], END_WORD), first + np.arange(len(first))
                found = index.find(hashes)
                columns = [*(part.column(k) for k in range(len(names))), pa.array(sums_by_row(cost[node], at)), pa.array(np.diff(first))]
                columns += [pa.array(sums_by_row((found >= 0).astype(np.int64), first)), pa.array(sums_by_row(logs[found], first)), _left(hashes, found < 0, first), _left(keys, node < 0, at)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ppm", "n_tokens", "often", "base", "words", "grams"])

    return run


class PlainTrie:
    """PPM with exclusion written out for one text at a time: the measure for Trie, and adaptive code lengths."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple, dict[int, int]] = defaultdict(dict)

    def add(self, history: list[int], symbol: int) -> None:
        for j in range(self.order + 1):
            at = self.counts[tuple(history[len(history) - j :])]
            at[symbol] = at.get(symbol, 0) + 1

    def cost(self, history: list[int], symbol: int) -> float:
        total, excluded = 0.0, set()
        for j in range(self.order, -1, -1):
            at = {s: n for s, n in self.counts.get(tuple(history[len(history) - j :]), {}).items() if s not in excluded}
            if not at:
                continue
            if symbol in at:
                return total + math.log10((at[symbol] - 0.5) / sum(at.values()))
            total += math.log10(len(at) / (2 * sum(at.values())))
            excluded |= set(at)
        return total - math.log10(max(1, SYMBOLS - len(excluded)))

    def text(self, text: bytes, learn: bool, score: bool = True) -> float:
        """Adaptive if learn: each symbol is added after it is coded. A-Z are lower-cased."""
        history, total = [END] * self.order, 0.0
        for s in [*text.lower(), END]:
            total += self.cost(history, s) if score else 0.0
            if learn:
                self.add(history, s)
            history = [*history[1:], s] if self.order else []
        return total


def adaptive_scores(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """keep and score: each text's log10 probability under a trie that starts empty and learns as it reads (null: empty)."""
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [PlainTrie().text((t or "").encode(), learn=True) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(scores, pa.float64())], names=[*names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])
    return rows.mapInArrow(run, schema)
