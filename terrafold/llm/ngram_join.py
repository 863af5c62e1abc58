"""Similarity join of documents by the Jaccard similarity of their word n-gram sets, found by MinHash banding.

Texts are lower-cased and cut at ASCII white space; every run of n words is an n-gram, and a text of fewer words is one
n-gram. Documents with the same set are one class, represented by one row, so copies are compared once. The numbers of
bands and of rows in a band follow from the target recall of a link at the threshold and from the chance at which pairs
well below it may still meet. Representatives are shuffled on band hashes; each bucket gives edges to its smallest member
only, so a bucket of any size gives as many rows as it has members. The components of these edges are families.

Pairs are verified on whole n-gram sets, which are made once for each row of a family and sent as 64-bit numbers. Most
families fit in one task, and all their pairs are compared. A family of many blocks is compared in one of two ways,
whichever sends fewer n-grams: all its pairs of blocks, which suits groups where everybody resembles everybody, or bucket
by bucket, which suits long chains of documents that have little in common; a pair then counts in the first band it
shares. Large buckets are cut into blocks as well. No pair is emitted and no candidate is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.links import BLOCK_ROWS, classes, dealt, forest, sized
from terrafold.llm.shared import anonymous, column_of, components, discard, joined_groups, ship_package, written
from terrafold.llm.textbytes import buffers, mix, slices, span_hashes, span_sums, words

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
#: Pairs whose similarity is so much below the threshold may meet with CHANCE at most.
UNLIKE = 0.3
CHANCE = 0.35
#: n-grams of a block, about.
BLOCK_GRAMS = 1 << 18
#: Columns of the dense product in which n-gram sets are intersected.
_COLUMNS = 8192
#: Column of the number that numbered() gives a row.
_ROW = "_terrafold_row"
_WHOLE_FAMILY = -1


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that a pair of this similarity meets in with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 1 - 1e-9) ** rows)))


def bands_and_rows(similarity: float, recall: float, unlike: float = UNLIKE, chance: float = CHANCE) -> tuple[int, int]:
    """The fewest rows of a band, with the bands that the recall takes, at which pairs with a similarity of `unlike` less meet with `chance` at most."""
    low, rows = max(0.0, similarity - unlike), 1
    while 1 - (1 - low**rows) ** (bands := bands_for(similarity, recall, rows)) > chance:
        rows += 1
    return bands, rows


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of lower-cased UTF-8 rows, and the index of each row's first one."""
    starts, ends, first = words(data, offsets)
    each = span_hashes(span_sums(data, starts), starts, ends)
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(grams)])
    begin = np.repeat(first[:-1] - at[:-1], grams) + np.arange(at[-1])
    length = np.repeat(np.minimum(count, n), grams)
    out = length.astype(np.uint64)
    padded = np.append(each, np.zeros(n, np.uint64))
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, padded[begin + k], np.uint64(0)))
    return out, at


def _unique(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted, and where they begin."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(at) - 1))])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written: computed again, numbers may differ, as they follow the splits of a scan."""
    return written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def signatures(docs: DataFrame, n: int, bands: int, rows: int, text: str = "text", row: str = _ROW, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row (that column of docs), two hashes and the size of its n-gram set, and its band hashes; no bands for texts without words."""
    ship_package(docs.sparkSession)
    rng = np.random.default_rng(20_11)
    # Least values of (n-gram xor a number) times an odd number, modulo 2**32.
    factors, masks = (rng.integers(1, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(row).alias("row"), F.lower(F.col(text)).alias("text"))
    names = ["doc_id", "row", "set_a", "set_b", "grams", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = _unique(*shingles(*buffers(part.column("text")), n))
                full = np.flatnonzero(np.diff(at))
                size = np.diff(at)
                sums = np.zeros((2, part.num_rows), np.uint64)
                out = np.zeros((part.num_rows, bands), np.uint64)
                if len(full):
                    sums[0, full] = np.add.reduceat(hashes, at[full])
                    sums[1, full] = np.add.reduceat(mix(hashes), at[full])
                    short = (hashes >> np.uint64(32)).astype(np.uint32)
                    for b in range(bands):
                        band = np.full(len(full), b, np.uint64)
                        for k in range(b * rows, (b + 1) * rows):
                            least = np.minimum.reduceat((short ^ masks[k]) * factors[k], at[full])
                            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least)
                        out[full, b] = band
                ends = np.zeros(part.num_rows + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(size.astype(np.int64)), lists], names=names)

    return kept.mapInArrow(run, "doc_id long, row long, set_a long, set_b long, grams long, bands array<long>")


def gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows with their `text` turned into `grams`: its distinct n-grams, as sorted 64-bit numbers."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = _unique(*shingles(*buffers(part.column("text")), n))
                sets = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(hashes.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets.cast(pa.binary())], names=[*names, "grams"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), "grams binary"])
    return rows.select(*names, "text").mapInArrow(run, schema)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What gram_sets() has made: all n-grams in a row, and where each set begins."""
    data, offsets = buffers_of(column.cast(pa.large_binary()))
    return np.frombuffer(data.tobytes(), np.uint64), offsets // 8


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary column without nulls and the offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def intersections(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many members each two sets share, as float64; the diagonal counts shared members only."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # Only n-grams that several rows share count for an intersection.
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram)[gram] > 1 if len(gram) else new
    gram, row = gram[shared], row[order][shared]
    both = np.zeros((len(at) - 1, len(at) - 1), np.float32)
    if len(gram):
        _, gram = np.unique(gram, return_inverse=True)
        cuts = np.searchsorted(gram, np.arange(0, gram[-1] + 1 + _COLUMNS, _COLUMNS))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            # Rows of the product that have none of these n-grams are left out.
            used, where = np.unique(row[a:b], return_inverse=True)
            dense = np.zeros((len(used), min(_COLUMNS, int(gram[b - 1]) + 1 - k * _COLUMNS)), np.float32)
            dense[where, gram[a:b] - k * _COLUMNS] = 1
            both[np.ix_(used, used)] += dense @ dense.T
    return both.astype(np.float64)


def verified(threshold: float):
    """For the rows of two blocks: links of each row to rows of the other block (or of its own), and their forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        copies, block = table["copies"].to_numpy(), table["block"].to_numpy()
        hashes, at = _sets(table["grams"].combine_chunks())
        size = np.diff(at).astype(np.float64)
        both = intersections(hashes, at)
        union = size[:, None] + size[None, :] - both
        # Ratios as they are: 0.8 itself is a link.
        linked = (both / np.maximum(union, 1) >= threshold) & (both > 0)
        np.fill_diagonal(linked, False)
        if table["lo"][0].as_py() != table["hi"][0].as_py():
            linked &= block[:, None] != block[None, :]
        band = table["part"][0].as_py()["band"]
        if band > 0 and linked.any():  # in a bucket, pairs that share an earlier band have been counted there
            bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            for k in range(band):
                linked &= bands[:, k][:, None] != bands[:, k][None, :]
        links = linked @ copies.astype(np.int64)
        return pa.table({"id": ids, "links": links, "root": ids[forest(linked)]})

    return run


def parts_of(members: DataFrame, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Where each row is to be compared: row, copies, bands and parts, a list of (band, key, blocks).

    members: row, copies, grams, bands and family of each row of a family. A part is a whole family (band is -1, no bands) or a
    bucket of a family that costs less that way.
    """
    found = written(sized(members, "family", "row", block_rows, "grams", block_grams), "members")
    none = F.lit(None).cast("array<long>")
    whole = found.withColumn("parts", F.array(F.struct(F.lit(_WHOLE_FAMILY).alias("band"), F.col("family").alias("key"), "blocks")))
    whole = whole.select("row", "family", "copies", none.alias("bands"), "parts")
    many = found.filter("blocks > 2")
    if many.isEmpty():
        return _stored(whole.drop("family"), found)
    each = many.select("row", "family", "grams", F.posexplode("bands").alias("band", "key")).withColumn("bucket", F.struct("band", "key"))
    alone = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(F.col("bucket").alias("_b"))
    each = written(sized(each, "bucket", "row", block_rows, "grams", block_grams).join(alone, F.col("bucket") == F.col("_b"), "left_anti"), "buckets")
    apart = each.groupBy("family").agg(F.sum(F.col("grams") * F.col("blocks")).alias("apart"))
    chains = many.groupBy("family").agg(F.sum(F.col("grams") * F.col("blocks")).alias("at_once")).join(apart, "family").filter("apart < at_once").select("family")
    chains = written(chains, "chains")
    if chains.count() <= 100_000:
        chains = F.broadcast(chains)
    by_bucket = each.join(chains, "family", "left_semi").groupBy("row").agg(F.collect_list(F.struct("band", "key", "blocks")).alias("parts"))
    by_bucket = found.select("row", "copies", "bands").join(by_bucket, "row").select("row", "copies", "bands", "parts")
    return _stored(whole.join(chains, "family", "left_anti").drop("family").unionByName(by_bucket), found, each)


def _stored(places: DataFrame, *used: DataFrame) -> DataFrame:
    out = written(places, "parts")
    discard(*used)
    return out


def jaccard_join(
    docs: DataFrame, n: int = WORDS, threshold: float = SIMILARITY, recall: float = RECALL, text: str = "text", row: str | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, n_links, component_id, set_id, set_size, kept, row.

    n_links counts the other rows whose n-gram sets have at least the given similarity (copies included);
    component_id is the smallest doc_id that links reach; set_id the smallest with the same set, set_size how many have
    it; kept marks one row of each component. Null and empty texts and those of white space have no n-grams and link
    with nothing; repeated rows are copies of each other; a null doc_id is a row without a class of its own and is
    represented by -2**63; an empty table gives no rows; further columns are ignored. row: a column of docs that
    numbers its rows, which must be stored (numbered() does); without one, texts are numbered and written once.
    Different n-grams share a 64-bit hash with a chance of 2**-64 for each pair that meets in a task.
    """
    numbers_here = row is None
    if numbers_here:
        docs, row = numbered(docs.select(doc_id, text)), _ROW
    bands, rows = bands_and_rows(threshold, recall)
    signed = written(signatures(docs, n, bands, rows, text, row, doc_id).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))), "signatures")
    found = written(signed.drop("bands"), "rows")
    whole = signed.filter("grams > 0")
    sets = whole.groupBy("set_a", "set_b", "grams").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"))
    sets = written(sets.select("set_a", "set_b", "grams", "copies", "bands", F.col("first.doc_id").alias("set_id"), F.col("first.row").alias("row")), "sets")
    discard(signed)
    # Rows stand for sets: they are unique even if doc_ids are not.
    banded = sets.select(F.col("row").alias("v"), F.explode("bands").alias("key"))
    least = banded.groupBy("key").agg(F.min("v").alias("u"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # A bucket of any size gives a row for each member but one; hot ones are broadcast.
    least = written(least, "bands")
    families = components(joined_groups(banded, least, ["key"], "_n", sets.count()).filter("u <> v").select("u", "v"), "families")
    members = sets.join(families, F.col("row") == F.col("node")).select("row", "copies", "grams", "bands", F.col("component").alias("family"))
    places = parts_of(members)
    banded, sets = sets, written(sets.drop("bands"), "set-rows")
    discard(banded, least, families)
    # Texts of rows in families only, by their stored numbers. Rows of families have no size bound, so they are never
    # broadcast: texts move once, in proportion to the input at any size, and their n-grams are made once.
    texts = docs.select(F.col(row).alias("row"), F.lower(F.col(text)).alias("text"))
    made = gram_sets(texts.join(places.hint("merge"), "row"), n)
    each = made.withColumn("p", F.explode("parts")).select(F.col("row").alias("id"), "copies", "bands", "grams", F.struct("p.band", "p.key").alias("part"), F.col("p.blocks").alias("blocks"))
    each = dealt(each, "id").withColumn("bands", F.when(F.col("part.band") > 0, F.col("bands")))
    answers = each.groupBy("part", "lo", "hi").applyInArrow(verified(threshold), "id long, links long, root long")
    links, linked = classes(answers, "jaccard")
    discard(places, *([docs] if numbers_here else []))
    linked = linked.withColumnRenamed("node", "id")
    by_set = sets.select(F.col("row").alias("id"), "set_a", "set_b", "grams", "set_id", "copies").join(links, "id", "left").join(linked, "id", "left")
    by_set = by_set.select("id", "set_a", "set_b", "grams", "set_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    by_set = written(by_set, "set-links")
    discard(sets, links, linked)
    smallest = by_set.groupBy("component").agg(F.min(F.struct("set_id", "id")).alias("least"), F.count(F.lit(1)).alias("_n"), F.sum("copies").alias("_rows"))
    total = smallest.agg(F.sum("_n"), F.sum("_rows")).first()
    by_set = joined_groups(by_set, smallest.drop("_rows"), ["component"], "_n", total[0] or 0)
    by_set = by_set.select("set_a", "set_b", "grams", "set_id", "copies", "links", "least")
    classes_of = joined_groups(found.filter("grams > 0").select("doc_id", "row", "set_a", "set_b", "grams"), by_set, ["set_a", "set_b", "grams"], "copies", total[1] or 0)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = found.filter("grams = 0").select("doc_id", zero.alias("n_links"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"), one.alias("set_size"), F.lit(True).alias("kept"), "row")
    return classes_of.select(
        "doc_id",
        (F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
        F.col("least.set_id").alias("component_id"),
        "set_id",
        F.col("copies").cast("long").alias("set_size"),
        (F.col("row") == F.col("least.id")).alias("kept"),
        "row",
    ).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = SIMILARITY, text: str = "text") -> DataFrame:
    """One row of each component of jaccard_join(), that with the smallest doc_id, with all columns of docs, whatever their
    names; rows without n-grams stay, each. Null ids, repeated rows and empty tables as there."""
    rows = numbered(anonymous(docs))
    found = jaccard_join(rows, n, threshold, text=column_of(docs, text), row=_ROW, doc_id=column_of(docs, "doc_id"))
    kept = found.filter("kept").select(F.col("row").alias(_ROW))
    return rows.join(kept.hint("merge"), _ROW).drop(_ROW).toDF(*docs.columns)
