"""What several operators of this subpackage need: the shared folder, written tables, components, dealing to pairs of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.shipping import ship_package
from terrafold.storage import clear_written, collected, discard, shared_dir, written, written_parts

__all__ = ["anonymous", "block_pairs", "clear_written", "collected", "column_of", "components", "crc_mod", "discard", "joined_groups", "shared_dir", "ship_package", "table", "written", "written_parts"]

#: A group is hot from this share of all rows on, so there are at most HOT_SHARE hot groups.
HOT_SHARE = 1000


def column_of(docs: DataFrame, name: str) -> str:
    """The name that anonymous() gives to a column of docs."""
    names = docs.columns
    if name not in names:
        names, name = [c.lower() for c in names], name.lower()
    return f"c{names.index(name)}"


def anonymous(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ... by place, so that no name of a user meets one of an operator's own, whatever
    it is; toDF(*docs.columns) on a selection of them gives the names back."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def joined_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Each row with the further columns of its group (an inner join on keys; n: the group's column of how many rows it has).

    Groups that hold a thousandth of all rows, at most HOT_SHARE, are broadcast; rows of the others meet theirs in a shuffle.
    """
    more = [c for c in groups.columns if c not in keys]
    named = groups.select(*(F.col(k).alias(f"{k}_g") for k in keys), *more)
    same = [F.col(k) == F.col(f"{k}_g") for k in keys]
    hot, cold = named.filter(F.col(n) * HOT_SHARE >= total), named.filter(F.col(n) * HOT_SHARE < total)
    at_once = rows.join(F.broadcast(hot), same, "left")
    done = at_once.filter(F.col(n).isNotNull()).select(*rows.columns, *more)
    rest = at_once.filter(F.col(n).isNull()).select(*rows.columns).join(cold, same).select(*rows.columns, *more)
    return done.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(0)).cast("int")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of (u, v): a row (node, component) for every node of an edge, component being its smallest node.

    Contraction: every node that has a smaller neighbour hangs itself on the smallest; pointers are doubled until
    they reach roots; edges are renamed to the roots and repeated ones dropped, until none is left. Only nodes that
    are smaller than all their neighbours outlive a round; each round ends in a written table.
    Null ends are not allowed; loops (u = v) are ignored; no edges give no rows.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    left = written(both.filter("u <> v").distinct(), f"{name}-edges")
    labels = written(left.select(F.col("u").alias("node")).union(left.select("v")).distinct().select("node", F.col("node").alias("component")), f"{name}-labels")
    while not left.isEmpty():
        up = written(left.groupBy("u").agg(F.min("v").alias("v")), f"{name}-up")
        while True:
            to = up.select(F.col("u").alias("v"), F.col("v").alias("w"))
            far = written(up.join(to, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), f"{name}-jump")
            discard(up)
            up = far.select("u", "v")
            if far.filter("moved").isEmpty():
                break
        moved = labels.join(up.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("v", "component").alias("component"))
        moved = written(moved, f"{name}-labels")
        a = up.select("u", F.col("v").alias("a"))
        renamed = left.join(a, "u", "left").select("v", F.coalesce("a", "u").alias("a"))
        b = up.select(F.col("u").alias("v"), F.col("v").alias("b"))
        renamed = renamed.join(b, "v", "left").select("a", F.coalesce("b", "v").alias("b")).filter("a <> b")
        fewer = written(renamed.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
        discard(up, labels, left)
        left, labels = fewer, moved
    discard(left)
    return labels


def block_pairs(df: DataFrame, blocks: str, block: str) -> DataFrame:
    """Deal rows of parts that hold `blocks` blocks to all pairs of blocks (lo <= hi): a row of block b goes to `blocks` tasks.

    Any two rows of a part meet in exactly one task as members of (lo, hi); rows of one block meet in (b, b).
    """
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return df.withColumn("_o", other).withColumn("lo", F.least("_o", block)).withColumn("hi", F.greatest("_o", block)).drop("_o")
