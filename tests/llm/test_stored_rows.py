"""Row numbers outlive a change of how Spark splits files while an operator runs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import exact_dedup, lmscore, ngram_join

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [[f"w{v}" for v in rng.integers(0, 10_000, 60)] for _ in range(40)]
    rows = [(i, " ".join(words[i % 40][: 60 - i // 40])) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/t")
    yield spark.read.parquet(f"{tmp_path}/t")
    spark.conf.unset(SPLIT)


def split_after(spark, monkeypatch, module, name, last=None):
    """From the end of the first call of module.name (with this last argument, if given) on, every file is a split of its own."""
    was = getattr(module, name)

    def now(*args, **options):
        out = was(*args, **options)
        if last in (None, args[-1]):
            spark.conf.set(SPLIT, "700")
        return out

    monkeypatch.setattr(module, name, now)


def test_near_copies(spark, docs, monkeypatch):
    split_after(spark, monkeypatch, ngram_join, "components")
    kept = ngram_join.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_lm_scores(spark, docs, monkeypatch):
    keep = [F.col("doc_id")]
    want = {r.doc_id: r.score for r in lmscore.lm_scores(docs, docs, keep).collect()}
    split_after(spark, monkeypatch, lmscore, "written", "scored")
    got = {r.doc_id: r.score for r in lmscore.lm_scores(docs, docs, keep, bucket_nodes=4000, frequent_grams=500).collect()}
    assert got.keys() == want.keys() == set(range(80))
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_exact_duplicates(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i % 100}") for i in range(400)] + [(7, "text 7"), (None, "text 7"), (500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/e")
    docs = spark.read.parquet(f"{tmp_path}/e")
    split_after(spark, monkeypatch, exact_dedup, "written", "digests")
    got = exact_dedup.exact_duplicates(docs, keep="largest").collect()
    assert len(got) == len(rows) and len({r.text_sha256 for r in got}) == 101 == sum(r.kept for r in got)
    size = {t: sum((u or "") == (t or "") for _, u in rows) for _, t in rows}
    most = {t: max(i for i, u in rows if (u or "") == (t or "") and i is not None) for _, t in rows}
    digest = {hashlib.sha256((t or "").encode()).hexdigest(): t for _, t in rows}
    assert all((r.group_size, r.keep_id) == (size[digest[r.text_sha256]], most[digest[r.text_sha256]]) for r in got)
    spark.conf.unset(SPLIT)
    split_after(spark, monkeypatch, exact_dedup, "written", "digested")
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs, keep="largest").collect()) == sorted(set(most.values()))
