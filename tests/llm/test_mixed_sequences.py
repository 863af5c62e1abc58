"""The mixture shows in the sequences that the pipeline packs."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")


def test_prefixes_of_sequences_hold_equal_parts(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    sources = ["a"] * 1200 + ["b"] * 450 + ["c"] * 300
    rows = [(i, " ".join(f"w{v}" for v in rng.integers(0, 9999, rng.integers(20, 400))), "en", s, 0) for i, s in enumerate(sources)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    got = corpus_pipeline.pack_sequences(spark, corpus_pipeline.mix_sources(spark, docs, str(tmp_path)), str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(len(rows)))
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held)))
    for part in (0.15, 0.25, 0.35):
        there = [sources[r.doc_id] for r in got if r.piece == 0 and r.sequence_id < part * len(held)]
        for s in "abc":
            assert abs(there.count(s) / len(there) - 1 / 3) < 0.1, (part, s, there.count(s), len(there))
