"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Sources are cut into blocks of documents. Time is counted in blocks. With weight w, block j of a source is released at
floor(j / w) and due at ceil((j + 1) / w); among released blocks the one due first goes next. The weights of the sources
that still have blocks sum to one, so every block meets its window, and at any time each source's share is less than one
block from its weight. When a source ends, the next phase begins with the remaining sources' weights, scaled up.

Targets are taken as they are: as fractions of their sum, with their least common denominator (quanta), so n equal sources
have 1 of n quanta each and windows are exact in integers. The schedule of a phase repeats after that many blocks. One SQL
fold makes that template; a block's slot is then arithmetic on its number, and no task ever walks the schedule.

Within a source, documents follow the MD5 of their id. They are ranked by ranges of the digest, which are as many as the
source's size asks for, so a source that holds a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm.shared import anonymous, column_of, written

#: Documents of a block, the largest common denominator of weights, and the most sources that a mixture may have.
BLOCK = 8
MOST_QUANTA = 10_000
MOST_SOURCES = 500
#: Documents of a range of digests, about; a task ranks those of a range.
RANGE_ROWS = 10_000
#: Ranges of which starts may be broadcast; more meet their documents in a shuffle.
BROADCAST_RANGES = 100_000

Weight = int | float | Fraction


def quanta_of(weights: dict[str | None, Weight], most: int = MOST_QUANTA) -> dict[str | None, int]:
    """Integers in the ratio of the targets, exactly, if their sum needn't exceed `most`.

    Floats are read as the decimals they print as. Targets without so small a common denominator are rounded to shares of
    1 / `most` (largest remainders, at least one each); they then miss a target by up to T / `most` blocks after T blocks.
    """
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if min(exact.values(), default=1) <= 0:
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    part = math.gcd(*whole.values())
    out = {s: w // part for s, w in whole.items()}
    if sum(out.values()) <= most:
        return out
    total = sum(exact.values())
    exact = {s: w / total * most for s, w in exact.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))
    for s in order[: max(0, most - sum(out.values()))]:
        out[s] += 1
    return out


def template(spark: SparkSession, parts: list[int]) -> list[int]:
    """The source (its index) of each of the first sum(parts) slots: earliest due first among released blocks."""
    q = sum(parts)
    if len(set(parts)) == 1:  # all windows are alike: sources take turns
        return list(range(len(parts))) * parts[0]
    step = f"""
      aggregate(sequence(0, {q - 1}), struct(array_repeat(0L, {len(parts)}) AS used, CAST(array() AS ARRAY<INT>) AS out),
        (acc, t) -> transform(array(
          array_min(filter(transform(w, (a, i) -> struct(
              ((acc.used[i] + 1) * {q}L + a - 1) DIV a AS due, i AS source, (acc.used[i] * {q}L) DIV a AS released)),
            x -> x.released <= t)).source),
          s -> struct(transform(acc.used, (u, i) -> IF(i = s, u + 1, u)) AS used, concat(acc.out, array(s)) AS out))[0],
        acc -> acc.out)"""
    return list(spark.sql(f"SELECT {step} AS slots FROM (SELECT array({', '.join(f'{p}L' for p in parts)}) AS w)").first()[0])


def phases(spark: SparkSession, blocks: dict[str | None, int], parts: dict[str | None, int]) -> list[tuple]:
    """(source, phase's first block of it, blocks of it in the phase, first slot of the phase, quanta of the phase, own
    quanta, its places in the template) for each phase in which a source takes part."""
    out, used, slot = [], dict.fromkeys(blocks, 0), 0
    while active := sorted((s for s in blocks if used[s] < blocks[s]), key=lambda s: (s is None, s or "")):
        part = math.gcd(*(parts[s] for s in active))
        now = {s: parts[s] // part for s in active}
        q = sum(now.values())
        slots = template(spark, [now[s] for s in active])
        own = {s: [t for t, k in enumerate(slots) if active[k] == s] for s in active}
        # The phase ends after the slot in which the first source ends.
        left = {s: blocks[s] - used[s] for s in active}
        ends = min((left[s] - 1) // now[s] * q + own[s][(left[s] - 1) % now[s]] for s in active) + 1
        for s in active:
            taken = ends // q * now[s] + sum(t < ends % q for t in own[s])
            if taken:
                out.append((s, used[s], taken, slot, q, now[s], own[s]))
            used[s] += taken
        slot += ends
    return out


def _ranked(rows: DataFrame, source: str, key: str, sizes: dict[str | None, int]) -> DataFrame:
    """rows with `rank`, from 0 in their source: by the MD5 of the key, then the key, then the hash of all columns."""
    spark = rows.sparkSession
    digits = [(s, max(0, math.ceil(math.log(n / RANGE_ROWS, 16))) if n > RANGE_ROWS else 0) for s, n in sizes.items()]
    # A row for each source, at most MOST_SOURCES.
    by_source = F.broadcast(spark.createDataFrame(digits, "_s STRING, _digits INT"))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    marked = rows.join(by_source, F.col(source).cast("string").eqNullSafe(F.col("_s"))).withColumn("digest", digest)
    marked = marked.withColumn("range", F.expr("substring(digest, 1, _digits)")).drop("_s", "_digits")
    counts = written(marked.groupBy(F.col(source).alias("_source"), "range").agg(F.count(F.lit(1)).alias("_n")), "mix-ranges")
    before = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"))
    if sum(16**d for _, d in digits) <= BROADCAST_RANGES:
        starts = F.broadcast(starts)
    own = Window.partitionBy(source, "range").orderBy("digest", key, F.xxhash64(*rows.columns))
    placed = marked.withColumn("rank", F.row_number().over(own) - 1)
    placed = placed.join(starts, F.col(source).eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    return placed.select(*rows.columns, (F.col("rank") + F.col("before")).alias("rank"))


def _placed(docs: DataFrame, weights: dict[str | None, Weight] | None, block: int, quanta: int, source: str, key: str) -> DataFrame:
    """docs under the names of anonymous(), with mix_block, mix_slot and mix_position."""
    spark, rows, source, key = docs.sparkSession, anonymous(docs), column_of(docs, source), column_of(docs, key)
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(source).cast("string")).count().limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    given = weights or {}
    mean = sum(Fraction(str(w)) for w in given.values()) / len(given) if given else 1
    parts = quanta_of({s: given.get(s, mean) for s in sizes}, quanta) if sizes else {}
    plan = phases(spark, {s: -(-n // block) for s, n in sizes.items()}, parts)
    # One row for each source and phase, at most MOST_SOURCES ** 2.
    names = "source STRING, first BIGINT, taken BIGINT, slot BIGINT, q BIGINT, own BIGINT, places ARRAY<BIGINT>"
    steps = spark.createDataFrame(plan, names)
    steps = steps.groupBy(F.col("source").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("first", "slot", "q", "own", "places"))).alias("phases"))
    placed = _ranked(rows, source, key, sizes).withColumn("mix_block", F.floor(F.col("rank") / block).cast("long"))
    placed = placed.join(F.broadcast(steps), F.col(source).cast("string").eqNullSafe(F.col("_p")))
    placed = placed.withColumn("at", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("mix_block")), -1)).withColumn("j", F.col("mix_block") - F.col("at.first"))
    cycle, place = F.expr("j DIV at.own"), F.get(F.col("at.places"), (F.col("j") % F.col("at.own")).cast("int"))
    placed = placed.withColumn("mix_slot", (F.col("at.slot") + cycle * F.col("at.q") + place).cast("long"))
    placed = placed.withColumn("mix_position", F.col("mix_slot") * block + F.col("rank") % block)
    return placed.select(*rows.columns, "mix_block", "mix_slot", "mix_position")


def mixed(docs: DataFrame, weights: dict[str | None, Weight] | None = None, block: int = BLOCK, quanta: int = MOST_QUANTA, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with three more columns: mix_block (the block's number in its source), mix_slot (its slot, from 0, without
    gaps over all blocks) and mix_position (slot * block + place in the block).

    weights: target shares by source, in any unit; sources without one get the mean of those given, and without any all
    are equal. Every row stays, once. A null source is a source; a null key sorts as empty text; repeated rows take places
    of their own. A source's last block may be short. Empty tables give no rows. Columns of docs may have any names.
    """
    return _placed(docs, weights, block, quanta, source, key).toDF(*docs.columns, "mix_block", "mix_slot", "mix_position")


def in_mixed_order(docs: DataFrame, weights: dict[str | None, Weight] | None = None, block: int = BLOCK, quanta: int = MOST_QUANTA, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of docs in the order of mix_position, with their own columns; null sources, repeated rows and empty tables as
    in mixed()."""
    placed = _placed(docs, weights, block, quanta, source, key).orderBy("mix_position")
    return placed.drop("mix_block", "mix_slot", "mix_position").toDF(*docs.columns)
