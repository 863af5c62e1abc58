"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import langid, toxicity
from terrafold.llm.embedding_dedup import near_duplicates
from terrafold.llm.exact_dedup import exact_duplicates
from terrafold.llm.lmscore import lm_scores
from terrafold.llm.mixing import mixed
from terrafold.llm.ngram_join import jaccard_join
from terrafold.llm.packing import pack
from terrafold.llm.pii import personal_data
from terrafold.llm.shared import crc_mod, table
from terrafold.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def word_bpe_file() -> str:
    """The public tokenizer file whose ids packing and counting use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of equal label at a cosine of 0.93, and their groups."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op1_embedding_dedup"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT r.x AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM r LEFT JOIN n ON n.x = r.x GROUP BY r.x
"""


@query
def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), word_bpe_file())


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32(doc_id) mod 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 5)
    model = langid.train(docs.filter(fold != 0))
    return langid.predict(docs, model, [F.col("doc_id"), (fold == 0).alias("held_out")])


@query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learnt from those whose crc32(doc_id) mod 7 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 7)
    return lm_scores(docs, docs.filter(fold != 2), [F.col("doc_id"), (fold == 2).alias("held_out")])


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels of those whose crc32(doc_id) mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, [F.col("doc_id"), (fold == 1).alias("held_out")])


#: Target weights of the mixture, in parts; sources that aren't named get their mean, which is 2.
MIXTURE = {"src0": 5, "src1": 3, "src2": 1, "src3": 1, "src4": 1, "src5": 1}


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture of all sources by MIXTURE."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"), MIXTURE)


ORACLE_SQL["op6_source_mixing"] = """
WITH RECURSIVE d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents),
s AS (SELECT source, CAST(ceil(count(*) / 8.0) AS BIGINT) AS blocks, row_number() OVER (ORDER BY source) AS k,
             CAST(CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 3 WHEN 'src2' THEN 1 WHEN 'src3' THEN 1 WHEN 'src4' THEN 1 WHEN 'src5' THEN 1 ELSE 2 END AS BIGINT) AS parts FROM d GROUP BY source),
l AS (SELECT list(blocks ORDER BY k) AS b, list(parts ORDER BY k) AS p FROM s),
-- Slot by slot: of the sources that have blocks left, those whose next block is released; of these the one due first.
st AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pt, list_transform(p, lambda x: CAST(0 AS BIGINT)) AS used, list_transform(p, lambda x: CAST(0 AS BIGINT)) AS total, CAST(NULL AS BIGINT) AS pick FROM l
  UNION ALL
  SELECT t + 1, CASE WHEN total[c] + 1 = b[c] THEN 0 ELSE pt + 1 END, CASE WHEN total[c] + 1 = b[c] THEN list_transform(p, lambda x: CAST(0 AS BIGINT)) ELSE list_transform(used, lambda x, i: CASE WHEN i = c THEN x + 1 ELSE x END) END,
    list_transform(total, lambda x, i: CASE WHEN i = c THEN x + 1 ELSE x END), c
  FROM (SELECT *, list_min(list_filter(list_transform(p, lambda x, i: CASE WHEN total[i] < b[i] AND used[i] * q // x <= pt THEN {'due': ((used[i] + 1) * q + x - 1) // x, 'k': CAST(i AS BIGINT)} END), lambda x: x IS NOT NULL)).k AS c
    FROM (SELECT *, CAST(list_sum(list_transform(p, lambda x, i: CASE WHEN total[i] < b[i] THEN x ELSE 0 END)) AS BIGINT) AS q FROM st, l WHERE list_sum(total) < list_sum(b)))),
f AS (SELECT t AS slot, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block FROM st WHERE pick IS NOT NULL)
SELECT d.doc_id, d.source, d.rank // 8 AS mix_block, f.slot AS mix_slot, f.slot * 8 + d.rank % 8 AS mix_position
FROM d JOIN s ON s.source = d.source JOIN f ON f.pick = s.k AND f.block = d.rank // 8
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, ranks and truncated totals of all documents for every encoded length."""
    return token_counts(table(spark, sf_dir, "documents"), word_bpe_file())


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and IP addresses, card and telephone numbers in all documents."""
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of equal text that stays (the largest doc_id)."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL["op9_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents at a Jaccard similarity of 0.8 of their five-word sets, and their groups."""
    return jaccard_join(table(spark, sf_dir, "documents")).drop("row")


ORACLE_SQL["op10_ngram_jaccard"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))))
                          WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / CAST(a.n + b.n - count(*) AS DOUBLE) >= 0.8),
r AS (SELECT doc_id AS x, doc_id AS y FROM g UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT g.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id,
       CASE WHEN len(g.g) = 0 THEN g.doc_id ELSE min(g.doc_id) OVER (PARTITION BY g.g) END AS set_id,
       CAST(CASE WHEN len(g.g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY g.g) END AS BIGINT) AS set_size, g.doc_id = c.component_id AS kept
FROM g JOIN c ON c.x = g.doc_id LEFT JOIN n ON n.x = g.doc_id
"""
