"""The pipeline, stage by stage, against plain Python."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from llm_rows import DOCS

    from terrafold.llm import toxicity

    rng = np.random.default_rng(9)
    vocabulary = [f"v{k}" for k in range(500)]
    rows, toxic = [], {}
    for i in range(300):
        w = list(rng.choice(vocabulary, 40))
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            w[3] = w[20] = "horrid"
        rows.append((i, " ".join(w) + ".", "en", f"s{i % 3}", 0))
    for i in range(300, 360):  # copies, differing in case; every fifth is toxic as well
        rows.append((i, rows[i - 300][1].upper(), "en", "s0", 0))
    for i in range(360, 420):  # near copies
        w = rows[i - 260][1].split()
        w[0] = f"n{i}"
        rows.append((i, " ".join(w), "en", "s1", 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s2", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "source_mixing", "packing"]
    text = {r[0]: (r[1] or "").lower() for r in rows}
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {r[0] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept
            assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
            break
        assert out.columns == docs.columns, name
        out.write.parquet(path := f"{d}/stage{k}")
        docs = spark.read.parquet(path)
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert got == {i for i in kept if "horrid" not in text[i]}
        elif name == "exact_dedup":
            assert got == {max(j for j in kept if text[j] == text[i]) for i in kept}
        elif name == "ngram_jaccard":
            def grams(i):
                w = text[i].split()
                return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()

            sets = {i: grams(i) for i in kept}
            left = {i for i in kept if not any(j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept)}
            assert got == left
        else:
            assert got == kept and docs.count() == len(kept)
        kept = got
    final = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} == kept
    assert toxicity.THRESHOLD == 0.7
