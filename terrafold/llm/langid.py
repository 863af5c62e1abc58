"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams per language are summed over all training rows; the matrix of log probabilities
(buckets x languages) is broadcast. A batch of texts is one long run of features with row pointers (a sparse matrix of
ones), so scoring is a gather and a segmented sum for each language. More languages than BLOCK_LANGUAGES are scored in
blocks, one pass over the texts for each; a row carries its best language, that one's log probability and the log of the
sum over languages from pass to pass, so any number of languages gives exact answers in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import ship_package, written
from terrafold.llm.textbytes import counted, slices, sums_by_row

BUCKET_BITS = 16
ORDERS = 3
#: Languages of which the matrix is broadcast at once; it has 3 * 2**16 numbers for each.
BLOCK_LANGUAGES = 64
UNKNOWN = "und"
_TABLE = 0x110000


@cache
def _letters() -> np.ndarray:
    """Lower case of each character that is a letter, else a space."""
    out = np.full(_TABLE, 32, np.uint32)
    for k in range(_TABLE):
        c = chr(k)
        if c.isalpha():
            out[k] = ord(c.lower()[0])
    return out


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n, the bucket of the n-gram that begins at each position; where each text begins; which have a letter.

    Letters are lower-cased, anything else is a space; two spaces follow each text, so no n-gram that begins in a text runs
    into the next one.
    """
    chars = np.frombuffer("".join(t + "  " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    chars = _letters()[chars]
    lettered = sums_by_row((chars != 32).astype(np.int64), at) > 0
    found, rolled = [], np.zeros(len(chars), np.uint32)
    for n in range(ORDERS):
        rolled = rolled * np.uint32(0x01000193) ^ (np.append(chars[n:], np.full(n, 32, np.uint32)) * np.uint32(0x9E3779B1))
        x = rolled ^ (rolled >> np.uint32(15))
        x = x * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
        x = (x >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        x[at[1:] - 1] = x[at[1:] - 2] = 0  # what begins in the spaces would see the next text
        found.append(x)
    return found, at, lettered


def _texts(part: pa.RecordBatch) -> list[str]:
    return pc.fill_null(part.column("text"), "").to_pylist()


def feature_counts(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """feature (n * buckets + bucket), language (its index) and count over all rows of (text, lang)."""
    places = {x: k for k, x in enumerate(languages)}
    width = ORDERS << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            return counted(keys, counts)

        def out() -> pa.RecordBatch:
            keys, counts = merged()
            return pa.RecordBatch.from_arrays([pa.array((keys % width).astype(np.int32)), pa.array((keys // width).astype(np.int32)), pa.array(counts)], names=["feature", "lang", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                found, at, _ = features(_texts(part))
                codes = np.array([places[x] for x in part.column("lang").to_pylist()], np.int64)
                each = np.repeat(codes, np.diff(at)) * width
                held.append(counted(np.concatenate([each + f + (n << BUCKET_BITS) for n, f in enumerate(found)])))
                n_held += len(held[-1][0])
                if n_held > 4_000_000:
                    held = [merged()]
                    n_held = len(held[0][0])
                    if n_held > 3_000_000:
                        yield out()
                        held, n_held = [], 0
        if held:
            yield out()

    partial = labelled.select("text", "lang").mapInArrow(run, "feature int, lang int, n long")
    return partial.groupBy("feature", "lang").agg(F.sum("n").alias("n"))


class Block:
    """Log probabilities of hashed n-grams for some languages, and the log of how many training rows each has."""

    def __init__(self, languages: list[str], logs: np.ndarray, priors: np.ndarray):
        self.languages, self.logs, self.priors = languages, logs, priors

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text: the likeliest language, its joint log probability, and the log of the sum of all of the block; no
        language for texts without letters."""
        found, at, lettered = features(texts)
        total = np.tile(self.priors, (len(texts), 1))
        for k in range(len(self.languages)):
            for n, f in enumerate(found):
                total[:, k] += sums_by_row(self.logs[k, n][f].astype(np.float64), at)
        best = total.argmax(1)
        most = total.max(1)
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), lettered.tolist(), strict=True)], most, most + np.log(np.exp(total - most[:, None]).sum(1))


class Model:
    """The languages in order, how many rows each has, and the stored counts of their n-grams."""

    def __init__(self, rows: dict[str, int], counts: DataFrame | None, smoothing: float):
        self.rows, self.counts, self.smoothing = rows, counts, smoothing
        self.languages = list(rows)

    def blocks(self, size: int = BLOCK_LANGUAGES) -> Iterator[Block]:
        for low in range(0, len(self.languages), size):
            names = self.languages[low : low + size]
            counts = np.zeros((len(names), ORDERS, 1 << BUCKET_BITS))
            got = self.counts.filter((F.col("lang") >= low) & (F.col("lang") < low + size)).toArrow()  # at most ORDERS * 2**BUCKET_BITS rows for each language
            feature, lang = got["feature"].to_numpy(), got["lang"].to_numpy() - low
            counts[lang, feature >> BUCKET_BITS, feature & ((1 << BUCKET_BITS) - 1)] = got["n"].to_numpy()
            logs = np.log(counts + self.smoothing) - np.log(counts.sum(2, keepdims=True) + self.smoothing * (1 << BUCKET_BITS))
            yield Block(names, logs.astype(np.float32), np.log(np.array([self.rows[x] for x in names], float)))


def train(labelled: DataFrame, smoothing: float = 0.5) -> Model:
    """Fit on all rows of (text, lang) with a lang that isn't null; null texts count as empty, repeated rows each. No rows
    give an empty model. Further columns are ignored."""
    ship_package(labelled.sparkSession)
    known = labelled.filter("lang IS NOT NULL")
    rows = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row for each language
    rows = {x: rows[x] for x in sorted(rows)}
    return Model(rows, written(feature_counts(known, list(rows)), "language-counts") if rows else None, smoothing)


def predict(docs: DataFrame, model: Model, keep: list[Column], text: str = "text", block: int = BLOCK_LANGUAGES) -> DataFrame:
    """keep, lang_pred and score of every row; texts that are null or have no letter get `und` and 0.

    Nothing but the text is an input. Ties go to the language that sorts first. Repeated rows and rows with a null id are
    scored each; an empty table gives no rows; a model without languages says `und` throughout; further columns of docs
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(*keep, F.col(text).cast("string").alias("text"))
    kept = rows.columns[:-1]
    if not model.languages:
        return rows.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.select(*kept, F.lit(UNKNOWN).alias("_best"), F.lit(float("-inf")).alias("_log"), F.lit(float("-inf")).alias("_sum"), "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for k, b in enumerate(model.blocks(block)):
        rows = (written(rows, "languages") if k else rows).mapInArrow(_scored(spark.sparkContext.broadcast(b), len(kept)), schema)  # BLOCK_LANGUAGES * 2**16 * 3 numbers
    score = F.when(F.col("_best") == UNKNOWN, 0.0).otherwise(F.exp(F.col("_log") - F.col("_sum")))
    return rows.select(*kept, F.col("_best").alias("lang_pred"), score.alias("score"))


def _scored(held, kept: int):
    """A pass with one block over rows of kept columns, _best, _log, _sum and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs, most, total = held.value.score(_texts(part))
                old, was, summed = part.column(kept), part.column(kept + 1).to_numpy(), part.column(kept + 2).to_numpy()
                better = most > was
                best = pc.if_else(pa.array(better), pa.array(langs, pa.string()), old)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(kept)), best, pa.array(np.maximum(most, was)), pa.array(np.logaddexp(total, summed)), part.column(kept + 3)], names=part.schema.names)

    return run
