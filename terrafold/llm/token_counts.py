"""Token counts of a corpus from an exact histogram of encoded lengths.

Documents are aggregated by encoded length at once, so everything after tokenizing works on one row per distinct
length. Suffix sums over lengths then hold the answer to every total, quantile and truncated total.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.shared import ship_package, written
from terrafold.llm.textbytes import slices
from terrafold.llm.tokens import word_bpe

#: Lengths that one window task handles; longer ranges are joined by the sums of whole ranges.
RANGE = 256


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and the length in ids of each row's text (without special tokens); null and empty texts have length 0."""
    spark = docs.sparkSession
    ship_package(spark)
    content = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))  # a fixed file of a few MB
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    names = [*keys, "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(content.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                _, at = bpe.encode(pc.fill_null(part.column("_text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(np.diff(at))], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "length long"])
    return rows.mapInArrow(run, schema)


def length_table(lengths: DataFrame) -> DataFrame:
    """One row per distinct length, from a `length` column:

    length; n_docs of exactly this length; n_tokens in them; docs_from, tokens_from: documents at least this long and
    their tokens; docs_over: longer ones; kept_tokens: what is left of the corpus if every document is cut at this
    length; rank: the share of documents at most this long. An empty table gives no rows.
    """
    histogram = written(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    cells = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / RANGE).alias("range"))
    whole = cells.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    later = whole.select("range", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_later"))
    total = whole.agg(F.sum("d").alias("docs"), F.sum("t").alias("tokens"))
    own = Window.partitionBy("range").orderBy(F.desc("length"))
    out = cells.join(F.broadcast(later), "range").crossJoin(F.broadcast(total))  # a row for each range; one row
    docs_from, tokens_from = F.sum("n_docs").over(own) + F.col("d_later"), F.sum("n_tokens").over(own) + F.col("t_later")
    out = out.withColumn("docs_from", docs_from).withColumn("tokens_from", tokens_from)
    over = F.col("docs_from") - F.col("n_docs")
    return out.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from", over.alias("docs_over"),
        (F.col("tokens") - F.col("tokens_from") + F.col("n_tokens") + over * F.col("length")).alias("kept_tokens"),
        ((F.col("docs") - over) / F.col("docs")).alias("rank"),
    )


def quantile(q: float) -> Column:
    """An aggregate over length_table(): the smallest length that at least a share q of documents doesn't exceed."""
    return F.min(F.when(F.col("rank") >= q, F.col("length")))


def truncated_total(lengths: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at `limit`, from length_table(): longer documents leave `limit` each."""
    short = F.when(F.col("length") <= limit, F.col("n_tokens")).otherwise(limit * F.col("n_docs"))
    return lengths.agg(F.coalesce(F.sum(short), F.lit(0))).first()[0]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """length_table() of all rows of docs; null texts count as empty, repeated rows each, further columns are ignored."""
    return length_table(encoded_lengths(docs, tokenizer, text))
