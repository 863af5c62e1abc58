"""Shared by the operators that link rows: dealing parts to tasks, linear answers from dense groups, classes of links.

Links inside a dense group are never emitted as pairs. A task answers for its rows with sums of links and with the edges
of a forest that spans what it found, both linear in its rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import block_pairs, components, discard, written

#: Rows of a block. A task compares two blocks.
BLOCK_ROWS = 512
SALTS = 64


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index that each index reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        # Smallest label among neighbours, then pointer doubling.
        near = np.where(linked, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def sized(rows: DataFrame, part: str, key: str, block_rows: int = BLOCK_ROWS, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """rows with `blocks`: into how many blocks their part is cut, so that none has more than about block_rows rows or
    block_weight of the column weight.

    The join that tells is salted with SALTS values, so a hot part is spread over tasks; only parts larger than a block are
    repeated for the salts, which are never more rows than rows themselves.
    """
    by_rows = F.ceil(F.count(F.lit(1)) / block_rows)
    blocks = F.greatest(by_rows, F.ceil(F.sum(weight) / block_weight)) if weight else by_rows
    sizes = rows.groupBy(part).agg(blocks.cast("int").alias("_blocks")).filter("_blocks > 1")
    sizes = sizes.select(F.col(part).alias("_part"), "_blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_s"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), key), F.lit(SALTS)).cast("int"))
    cut = salted.join(sizes, (F.col(part) == F.col("_part")) & (F.col("_salt") == F.col("_salt_s")), "left").withColumn("blocks", F.coalesce("_blocks", F.lit(1)))
    return cut.drop("_part", "_blocks", "_salt", "_salt_s")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows with `blocks`, each in all tasks (part, lo, hi) where it has to be compared; `block`, by the hash of key, is its own
    block. Each pair of rows of a part meets in just one task."""
    return block_pairs(rows.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")), "blocks", "block").drop("blocks")


def deal(rows: DataFrame, part: str, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows, each in all tasks (part, lo, hi) where it has to be compared."""
    return dealt(sized(rows, part, key, block_rows), key)


def classes(answers: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """From rows (id, links, root) of all tasks: links per id, and (node, component) for ids with links, both stored.

    root is the smallest id that the task's links reach from id.
    """
    return stored_classes(written(answers, f"{name}-answers"), name)


def stored_classes(answers: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """classes() of answers that are a written table, which is deleted; root may be any id that the task's links reach."""
    links = written(answers.groupBy("id").agg(F.sum("links").alias("links")), f"{name}-links")
    edges = answers.filter("root <> id").select(F.col("id").alias("u"), F.col("root").alias("v"))
    linked = components(edges, name)
    discard(answers)
    return links, linked
