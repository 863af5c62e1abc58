"""Exact duplicates by a tree merge of sorted digest runs.

Every partition that reads the texts turns them into one run: digests in order, one entry for each distinct text with the
identifier to keep and a count. Then runs meet in binomial rounds: in round k, partitions whose numbers differ in bit k
only exchange halves of their runs, so that each of the two goes on with one half of the digests. FAN_BITS such rounds
share one exchange and one multiway merge of 2**FAN_BITS runs. After log2(partitions) rounds, each task owns one slice of
digests of the whole corpus: the work of a task never grows with the corpus or with the size of a group, since a group
has one entry per run. At every level entries are equal only if SHA-256, byte length and a second 64-bit hash all agree,
and the best identifier (with its row's number) and the sum of counts go on.

Rows get their number, the number of their run and their digests in one pass, which is written without the texts; all
later steps read these. So results don't depend on how Spark splits a table when it reads it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import anonymous, column_of, discard, joined_groups, ship_package, written

FAN_BITS = 3
_KEY = ["digest", "bytes", "check"]
_RUN = "run int, slice int, digest string, bytes int, check long, best_id long, best_tag long, n long"
_NAMES = [x.split()[0] for x in _RUN.split(", ")]

def normalised(text: Column) -> Column:
    """Only A-Z are lower-cased; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digested(text: Column, tag: Column | None = None) -> list[Column]:
    """What a row brings to the merge: a tag that tells it from rows of equal id and text (its number, if none is given), its
    run, digest and the two checks of its text."""
    norm = normalised(text)
    return [
        (F.monotonically_increasing_id() if tag is None else tag).alias("tag"),
        F.spark_partition_id().alias("run"),
        F.sha2(norm.cast("binary"), 256).alias("digest"),
        F.octet_length(norm).alias("bytes"),
        F.xxhash64(norm).alias("check"),
    ]


def _merge(largest: bool):
    """Merges batches in key order: of equal neighbours the best identifier and the summed count go on."""

    def folded(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        n = t.num_rows
        if n < 2:
            return t
        new = np.zeros(n, bool)
        new[0] = True
        for k in ("run", "slice", *_KEY):
            c = t[k].combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(new)
        ids = pc.fill_null(t["best_id"].combine_chunks(), -(1 << 63)).to_numpy(zero_copy_only=False)
        tags = t["best_tag"].to_numpy()
        order = np.lexsort((tags, ids, np.cumsum(new)))
        at = pa.array(order[np.append(firsts[1:], n) - 1] if largest else order[firsts])
        n_sum = pa.array(np.add.reduceat(t["n"].to_numpy(), firsts))
        kept = t.take(pa.array(firsts))
        return pa.table([t[k].take(at) if k.startswith("best") else n_sum if k == "n" else kept[k] for k in _NAMES], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table([batch.column(k) for k in _NAMES], names=_NAMES)
            t = folded(t if held is None else pa.concat_tables([held, t]))
            held = t.slice(t.num_rows - 1)
            yield from t.slice(0, t.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def tree_merge(found: DataFrame, largest: bool = False) -> DataFrame:
    """digest, bytes, check, best_id, best_tag and n for each distinct text of a stored table with doc_id and digested().

    Partitions of a stored table needn't be the runs it was written by: a run that is read in two parts has two entries
    for a text until the first round, as any two runs have.
    """
    ship_package(found.sparkSession)
    merge = _merge(largest)
    entries = found.select("run", F.lit(0).alias("slice"), *_KEY, F.col("doc_id").alias("best_id"), F.col("tag").alias("best_tag"), F.lit(1).cast("long").alias("n"))
    most = found.agg(F.max("run")).first()[0] or 0
    runs = entries.sortWithinPartitions("run", "slice", *_KEY).mapInArrow(merge, _RUN)
    level = 0
    while True:
        most >>= FAN_BITS
        level += 1
        bits = min(28, FAN_BITS * level)
        cut = F.shiftright(F.conv(F.substring("digest", 1, 7), 16, 10).cast("int"), 28 - bits)
        met = runs.select(F.shiftright("run", FAN_BITS).alias("run"), cut.alias("slice"), *_KEY, "best_id", "best_tag", "n")
        runs = met.repartition("run", "slice").sortWithinPartitions("run", "slice", *_KEY).mapInArrow(merge, _RUN)
        if not most:
            return runs.select(*_KEY, "best_id", "best_tag", "n")


def exact_duplicates(docs: DataFrame, text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A-Z) the row with the smallest or largest doc_id stays. Null texts count as
    empty; a null doc_id is less than any other; of repeated rows with the doc_id that stays exactly one is kept; an
    empty table gives no rows; further columns are ignored.
    """
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *digested(F.col(text))), "digests")
    groups = written(tree_merge(found, keep == "largest"), "digest-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    out = joined_groups(found.select("doc_id", "tag", *_KEY), groups, _KEY, "n", total)
    return out.select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("best_tag")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, with all their columns, whatever their names; of repeated rows one: that
    with the least or largest hash of all columns. Null and empty texts are equal; empty tables give no rows.

    A row's tag is the hash of all its columns, so rows are found again by what they hold and texts are written nowhere.
    """
    own = anonymous(docs)
    marked = own.select(*own.columns, F.col(column_of(docs, "doc_id")).cast("long").alias("doc_id"), *digested(F.col(column_of(docs, text)), F.xxhash64(*own.columns)))
    names = ["doc_id", "tag", "run", *_KEY]
    found = written(marked.select(*names), "digests")
    kept = written(tree_merge(found, keep == "largest").select("best_id", "best_tag", *(F.col(k).alias(f"{k}_k") for k in _KEY), "n"), "kept-digests")
    # Rows that agree in id, text and hash: only where there are any, all but one of them go.
    twice = not found.groupBy("tag", "doc_id", *_KEY).count().filter("count > 1").isEmpty()
    discard(found)
    same = [F.col("tag") == F.col("best_tag"), F.col("doc_id").eqNullSafe(F.col("best_id")), *(F.col(k) == F.col(f"{k}_k") for k in _KEY)]
    out = marked.join(kept.hint("merge"), same)
    return (out.dropDuplicates(["tag", "doc_id", *_KEY]) if twice else out).select(*own.columns).toDF(*docs.columns)
