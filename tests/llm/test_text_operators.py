"""Operators on texts against brute force, over odd rows, empty tables and further columns."""

import collections
import functools
import hashlib
import json
import math
import os
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import ODD

from terrafold.llm import langid, lmscore, mixing, ngram_join, packing, pii, token_counts, tokens, toxicity
from terrafold.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from terrafold.llm.textbytes import HashIndex, buffers, span_hashes, span_sums, words
from terrafold.llm.tokens import WordBpe

public = pytest.importorskip("public_tokenizers")
FILE = public.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_and_hashes():
    texts = ["ab  cd", None, "", "x", " \n", "ab"]
    data, offsets = buffers(pa.array(texts))
    starts, ends, first = words(data, offsets)
    got = [[bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").split() for t in texts]
    h = span_hashes(span_sums(data, starts), starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_hash_index():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000, np.uint64)
    keys = np.unique(np.append(keys, np.uint64(0)))
    index = HashIndex(keys[:3000], 5000)
    assert (index.find(keys[:3000]) == np.arange(3000)).all() and (index.find(keys[3000:]) == -1).all()
    assert index.add(keys[3000:]) and (index.find(keys) == np.arange(len(keys))).all()


def test_tokens_equal_the_library():
    bpe = WordBpe(FILE)
    rng = np.random.default_rng(1)
    alphabet = list("ab'stmdrevl'' 12²ªßÀÉΣİ \t\n日本-_<|>")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(400)] + ["it's they're we'll 's''s 'sx", "", "<|endoftext|> a"] + [r[1] or "" for r in ODD]
    ids, at = bpe.encode(texts)
    for k, e in enumerate(bpe.whole.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids
    bpe.forget()
    again, _ = bpe.encode(texts)
    assert (again == ids).all()


def test_tokens_of_words_that_share_a_hash(monkeypatch):
    # Words that are equal to any polynomial hash modulo a power of two.
    odd = ["".join("ab"[(k.bit_count() + f) % 2] for k in range(2048)) for f in (0, 1)]
    bpe = WordBpe(FILE)
    for t in odd:
        assert bpe.encode([t])[0].tolist() == bpe.whole.encode(t, add_special_tokens=False).ids
    data, offsets = buffers(pa.array([" ".join(odd)]))
    starts, ends, _ = words(data, offsets)
    assert len(set(span_hashes(span_sums(data, starts), starts, ends).tolist())) == 2
    # With a hash of two bits, nearly all words share theirs with others.
    monkeypatch.setattr(tokens, "span_hashes", lambda *a: span_hashes(*a) & np.uint64(3))
    bpe = WordBpe(FILE)
    texts = ["one two three", "four five", "one", "", "six seven", "two"] * 3
    ids, at = bpe.encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == bpe.whole.encode(t, add_special_tokens=False).ids


def lengths():
    bpe = WordBpe(FILE).whole
    return [len(bpe.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD]


def test_packing(stored, none):
    got = [r.asDict() for r in packing.pack(stored, FILE, 64).collect()]
    room = collections.defaultdict(list)
    for r in got:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in got) == sum(lengths()) + len(ODD)
    bpe = WordBpe(FILE).whole
    ids = np.array([*bpe.encode("x", add_special_tokens=False).ids, 0], "<u4")
    assert [r["ids_crc32"] for r in got if r["doc_id"] == 7] == [zlib.crc32(ids.tobytes())]
    assert packing.pack(none, FILE).count() == 0
    # Every piece of every document, cut by hand from the library's ids.
    want = collections.Counter()
    for r in ODD:
        own = [*bpe.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(own), 64):
            want[r[0], p // 64, p, len(own[p : p + 64]), zlib.crc32(np.array(own[p : p + 64], "<u4").tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_plan_packs_all_and_tightly(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(np.clip(rng.lognormal(4, 1, 20000).astype(int), 1, 512), minlength=513)
    groups, n = packing.plan(h, 512)
    used = np.zeros(513, np.int64)
    for k, held in groups:
        assert sum(a * m for a, m in held) <= 512
        for a, m in held:
            used[a] += k * m
    assert (used == h).all() and n <= math.ceil((h * np.arange(513)).sum() / 512) * 1.01 + 1


def test_token_counts(stored, none):
    table = token_counts.token_counts(stored, FILE)
    rows, each = {r.length: r for r in table.collect()}, np.array(lengths())
    assert sorted(rows) == sorted(set(each.tolist()))
    for n, r in rows.items():
        assert (r.n_docs, r.docs_from, r.docs_over) == ((each == n).sum(), (each >= n).sum(), (each > n).sum())
        assert (r.tokens_from, r.kept_tokens) == (each[each >= n].sum(), np.minimum(each, n).sum())
    assert token_counts.truncated_total(table, 9) == np.minimum(each, 9).sum()
    assert table.agg(token_counts.quantile(0.5)).first()[0] == np.quantile(each, 0.5, method="inverted_cdf")
    assert token_counts.token_counts(none, FILE).count() == 0


def test_exact_duplicates(stored, none):
    got = exact_duplicates(stored, keep="largest").collect()
    texts = [(r[1] or "").translate(LOWER) for r in ODD]
    assert len(got) == len(ODD)
    for r in got:
        same = [o[0] for o, t in zip(ODD, texts, strict=True) if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
    assert sum(r.kept for r in got) == len(set(texts))
    kept = drop_exact_duplicates(stored, keep="largest")
    assert kept.count() == len(set(texts)) and kept.columns == stored.columns
    assert exact_duplicates(stored).filter("doc_id = 5").first().keep_id == 4
    assert exact_duplicates(none).count() == 0 and drop_exact_duplicates(none).count() == 0


def test_language(stored, none, spark):
    model = langid.train(stored)
    got = {r.doc_id: r for r in langid.predict(stored, model, [stored.doc_id]).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred, got[1].score) == ("und", "und", "und", 0.0)
    assert got[6].lang_pred == "fr" and 0 <= got[6].score <= 1
    assert langid.predict(none, model, [none.doc_id]).count() == 0
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.predict(stored, empty, [stored.doc_id]).collect()} == {"und"}


def plain_grams(text):
    """Hashed n-grams of a text, character by character."""
    out, m = [], (1 << 32) - 1
    low = [ord(c.lower()[0]) if c.isalpha() else 32 for c in text]
    padded = [*low, 32, 32, 32, 32]
    for i in range(len(text)):
        rolled = 0
        for n in range(3):
            rolled = (rolled * 0x01000193 & m) ^ (padded[i + n] * 0x9E3779B1 & m)
            x = rolled ^ rolled >> 15
            x = (x * 0x85EBCA6B + n * 0x27D4EB2F) & m
            out.append((n, x >> 16))
    return out


def test_language_equals_plain_naive_bayes(spark):
    rng = np.random.default_rng(8)
    alphabets = {"aa": "abcde fg", "bb": "cdefg hijk", "cc": "xyz éü abc", "dd": "日本語 ab"}
    rows = [(i, "".join(rng.choice(list(alphabets[lang]), rng.integers(1, 30))), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd", "aa"] * 12)]
    rows += [(100, "", "aa"), (101, "12 .", "bb"), (102, "\U000e0041\U000f0000", "aa"), (103, "\U00020000\U00020001", "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    counts, docs = {x: collections.Counter() for x in alphabets}, collections.Counter(r[2] for r in rows)
    for _, t, lang in rows:  # the two spaces after a text are n-grams of their own
        counts[lang].update(plain_grams(t))
    pads = collections.Counter()
    found, at, _ = langid.features([""])
    for n, f in enumerate(found):
        pads.update((n, int(x)) for x in f)
    for lang in counts:
        for k, v in pads.items():
            counts[lang][k] += v * docs[lang]
    totals = {lang: [sum(v for (m, _), v in c.items() if m == n) for n in range(3)] for lang, c in counts.items()}
    for block in (64, 3, 1):
        got = {r.doc_id: r for r in langid.predict(df, model, [df.doc_id], block=block).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            if not any(c.isalpha() for c in t):
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            logs = {}
            for lang, c in counts.items():
                grams = [*plain_grams(t), *pads.elements()]
                logs[lang] = math.log(docs[lang]) + sum(math.log((c[g] + 0.5) / (totals[lang][g[0]] + 0.5 * 65536)) for g in grams)
            best = min(logs, key=lambda x: (-logs[x], x))
            assert got[i].lang_pred == best
            assert math.isclose(got[i].score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-4)


def test_language_features_stay_in_their_text():
    a, at, _ = langid.features(["abc", "xyz"])
    b, _, _ = langid.features(["abc"])
    assert all((x[: at[1]] == y).all() for x, y in zip(a, b, strict=True))


def shingles(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def linked_groups(sets, threshold=0.8):
    n = len(sets)
    link = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        group = [min([group[i], *(group[j] for j in link[i])]) for i in range(n)]
    return link, group


def test_jaccard(spark, stored, none, tmp_path):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(100 + k, r[1]) for k, r in enumerate(ODD)]
    for k in range(150):  # more than a block of near copies
        w = list(base)
        w[int(rng.integers(0, 120))] = f"z{k % 40}"
        rows.append((1000 + k, " ".join(w)))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.parquet(path)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(spark.read.parquet(path)).collect()}
    link, group = linked_groups([shingles(t) for _, t in rows])
    for k, (i, _) in enumerate(rows):
        assert got[i].n_links == len(link[k]), i
        assert got[i].component_id == rows[group[k]][0]
    assert sum(r.kept for r in got.values()) == len(set(group))
    assert ngram_join.jaccard_join(stored).count() == len(ODD) and ngram_join.jaccard_join(none).count() == 0
    assert ngram_join.drop_near_duplicates(stored).columns == stored.columns
    assert ngram_join.bands_for(0.8, 0.99999, 5) == 29 and ngram_join.bands_and_rows(0.8, 0.99999) == (49, 7)


def test_plain_ppm_and_blocks():
    train = ["the cat sat", "the dog sat", "", "日本 the"]
    tests = [*train, "a cot", "", "THE cat"]
    plain = lmscore.PlainTrie()
    for t in train:
        plain.text(t.encode(), learn=True, score=False)
    want = [plain.text(t.encode(), learn=False) for t in tests]
    keys, counts = lmscore.counted(lmscore.symbols(*buffers(pa.array(train)))[0])
    k, at = lmscore.symbols(*buffers(pa.array(tests)))
    low = lmscore.Low(*lmscore.counted(keys % lmscore.SYMBOLS**lmscore.SHARED, counts))
    whole = lmscore.Trie(keys, counts, low).costs(k)
    assert np.allclose(lmscore.sums_by_row(whole, at), want)
    parts = np.zeros(len(k))
    bucket = lambda x: x // lmscore.SYMBOLS % lmscore.SYMBOLS**lmscore.SHARED % 7
    for b in range(7):
        own, mine = bucket(keys) == b, bucket(k) == b
        parts[mine] = lmscore.Trie(keys[own], counts[own], low).costs(k[mine])
    assert np.allclose(parts, whole)
    seen = sum(10 ** plain.cost([lmscore.END] * lmscore.ORDER, s) for s in range(lmscore.SYMBOLS))
    assert abs(seen - 1) < 1e-9  # a distribution


def test_lm_scores(stored, none):
    train = stored.filter("doc_id <> 5 OR doc_id IS NULL")
    got = lmscore.lm_scores(stored, train, [stored.doc_id], frequent=3).collect()
    blocks = lmscore.lm_scores(stored, train, [stored.doc_id], bucket_nodes=20, frequent_grams=50).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    assert np.allclose([r.score for r in sorted(got, key=key)], [r.score for r in sorted(blocks, key=key)])
    assert np.allclose([r.base_score for r in sorted(got, key=key)], [r.base_score for r in sorted(blocks, key=key)])
    plain = lmscore.PlainTrie()
    for r in ODD:
        if r[0] != 5:
            plain.text((r[1] or "").encode(), learn=True, score=False)
    for i in (1, 4, 5, 6, 7):
        want = plain.text(next(r[1] or "" for r in ODD if r[0] == i).encode(), learn=False)
        assert all(math.isclose(r.score, want, rel_tol=1e-9) for rows in (got, blocks) for r in rows if r.doc_id == i)
    tokens_of = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = collections.Counter(w for r in ODD if r[0] != 5 for w in tokens_of(r[1]))
    n, v = sum(c.values()), len(c)
    for r in got:
        if r.doc_id in (1, 5, 7):
            own = tokens_of(next(o[1] for o in ODD if o[0] == r.doc_id))
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in c for w in own), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
    assert lmscore.lm_scores(none, none, [none.doc_id]).count() == 0
    assert all(math.isfinite(r.score) for r in lmscore.lm_scores(stored, none, [stored.doc_id]).collect())
    assert lmscore.adaptive_scores(stored.filter("doc_id IN (1, 7)"), [stored.doc_id]).count() == 2


def test_toxicity(spark, stored, none):
    rng = np.random.default_rng(2)
    words_ = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        text = ". ".join(" ".join(rng.choice(words_, 6)) for _ in range(4)) + "."
        if i % 4 == 0:
            at = int(rng.integers(1, 3))
            parts = text.split(". ")
            parts[at] = f"you vile{rng.integers(0, 50)} thing"
            text = ". ".join(parts)
        rows.append((i, text, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.filter("doc_id < 300").select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(df, model, [df.doc_id]).collect()}
    held = [i for i in range(300, 400)]
    assert sum(got[i].predicted == rows[i][2] for i in held) >= 97
    hit = next(i for i in held if rows[i][2] and got[i].predicted)
    assert "vile" in rows[hit][1].encode()[got[hit].worst_start : got[hit].worst_end].decode()
    odd = {r.doc_id: r for r in toxicity.score(stored, model, [stored.doc_id]).collect()}
    assert (odd[1].score, odd[2].predicted, odd[3].worst_start) == (0.0, 0, None)
    assert toxicity.drop_toxic(stored, model).columns == stored.columns and toxicity.drop_toxic(stored, model).count() == len(ODD)
    assert toxicity.score(none, model, [none.doc_id]).count() == 0
    blank = toxicity.train(df.limit(0).select("doc_id", "text"), df.limit(0).select("doc_id", "toxic"))
    assert {r.predicted for r in toxicity.score(stored, blank, [stored.doc_id]).collect()} == {0}


def test_toxicity_sample(spark):
    texts = [(i, f"text {i}", int(i % 50 == 0)) for i in range(500)] + [(1, f"again {k}", 0) for k in range(300)] + [(600, None, 1), (None, "no id", 1), (601, "x" * 50_000, 1)]
    docs = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(700 + k, 1) for k in range(100)] + [(2, 7), (3, None), (4, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, per_label=12).collect()
    found = {y: [r.doc_id for r in got if r.y == y] for y in (0, 1)}
    # Of 12 toxic documents with a text (one by its second label, one long), all are found among ids without one.
    assert sorted(found[1]) == [0, 4, 50, 100, 150, 200, 250, 300, 350, 400, 450, 601] and len(set(found[0])) == len(found[0]) == 12
    few = toxicity.sample(docs, labels, per_label=12, characters=60).collect()
    assert all(sum(len(r.text) for r in few if r.y == y) <= 30 or sum(r.y == y for r in few) == 1 for y in (0, 1))


def test_toxicity_equals_plain_noisy_or(spark):
    words_ = ["vile", "vilest", "kind", "so", "very"]
    rows = [(i, f"{'you vile' if i % 3 == 0 else 'a kind'} thing. so {i}! very\nkind vilest", int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(model.weights) > 1
    texts = ["vile kind. so vile vile! ok", "", "...", *(" ".join(words_[k % 5 :]) + "?" for k in range(9))]
    test = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(test, model, [test.doc_id]).collect()}

    def key(piece, salt=1):
        data = np.frombuffer(piece.encode(), np.uint8)
        return (span_hashes(span_sums(data, np.array([0])), np.array([0]), np.array([len(data)])) * np.uint64(salt))[0]

    def weight(k):
        place = model.index.find(np.array([k], np.uint64))[0]
        return model.weights[place] if place >= 0 else 0.0

    for i, t in enumerate(texts):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", t):
            tokens = re.findall(r"[a-z0-9]+", sentence)
            if tokens:
                logit = model.bias + sum(weight(key(w)) + sum(weight(key(w[:n], 2 * n + 1)) for n in toxicity.PREFIXES) for w in tokens)
                clean *= 1 - 1 / (1 + math.exp(-logit))
        assert math.isclose(got[i], 1 - clean, rel_tol=1e-6, abs_tol=1e-9), t


def test_personal_data_spans():
    text = "mail a.b@x.com, c@d no, @e.f, g@h.i.j@k.lm 1.2.3.4 1.2.3.400 4111 1111-1111 1111 +1 (212) 555-0199 +12 4111111111111112"
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
    }
    rng = np.random.default_rng(3)
    for t in [text, *("".join(rng.choice(list("a1.@ +-(4"), 60)) for _ in range(500))]:
        base = pii.base_spans(t)
        for kind, (p, ok) in patterns.items():
            assert base[kind] == [m.span() for m in re.finditer(p, t) if ok(m[0])], (kind, t)
    assert pii.base_spans("a" * 200000 + "1" * 200000)["email"] == []


def test_candidates_touch_no_others():
    rng = np.random.default_rng(3)
    words_ = ["a(at)b.com", "4111 1111 1111 1112", "4111111111111111", "212 555 0199", "(212) 555-0199", "+1 212 555 0199", "a@b.com", "1.2.3.4", "0", " ", "x"]
    for _ in range(300):
        t = " ".join(rng.choice(words_, 12)) if rng.random() < 0.7 else "".join(rng.choice(words_, 8))
        base = pii.base_spans(t)
        want = [(k, s, e, True) for k, kind in enumerate(pii.KINDS) for s, e in base[kind]]
        for k, p in ((0, pii._LOOSE_EMAIL), (2, pii._LOOSE_CARD), (3, pii._LOOSE_PHONE)):
            for m in p.finditer(t):
                if not any(s < m.end() and m.start() < e for _, s, e, _ in want):
                    want.append((k, *m.span(), False))
        assert pii.candidates(t, base) == want
    began = time.time()
    t = "212 555 0199, " * 40_000
    assert len(pii.candidates(t, pii.base_spans(t))) == 40_000 and time.time() - began < 10


def test_reliabilities_and_classifier_written_out():
    rng = np.random.default_rng(4)
    kind = np.repeat([0, 3], 40)
    pattern, shape, n = rng.integers(0, 3**pii.LABELERS, 80), rng.integers(0, 21 * 32, 80), rng.integers(1, 50, 80)
    got = pii.classifier(kind, pattern, shape, n)
    for k in (0, 3):
        own = [i for i in range(80) if kind[i] == k]
        vote = {i: [int(pattern[i]) // 3 ** (4 - j) % 3 for j in range(5)] for i in own}
        p = {i: min(0.95, max(0.05, 0.5 + 0.15 * sum(v - 1 for v in vote[i]))) for i in own}
        for _ in range(50):
            prior = min(0.95, max(0.05, sum(p[i] * n[i] for i in own) / sum(n[i] for i in own)))
            rate = []
            for c, lean in ((0, (1, 3)), (1, (3, 1))):
                w = {i: n[i] * (p[i] if c else 1 - p[i]) for i in own}
                rate.append([(sum(w[i] for i in own if vote[i][j] == 2) + lean[0]) / (sum(w[i] for i in own if vote[i][j] != 1) + 4) for j in range(5)])
            odds = {}
            for i in own:
                yes, no = prior, 1 - prior
                for j, v in enumerate(vote[i]):
                    yes *= rate[1][j] if v == 2 else 1 - rate[1][j] if v == 0 else 1
                    no *= rate[0][j] if v == 2 else 1 - rate[0][j] if v == 0 else 1
                odds[i] = yes / (yes + no)
            p = odds
        total = [sum((p[i] if c else 1 - p[i]) * n[i] for i in own) + 1 for c in (0, 1)]
        for i in own:
            logit = math.log(p[i] / (1 - p[i]))
            for f in (lambda x: x // 32, lambda x: x // 4 % 8, lambda x: x % 4):
                share = [(sum((p[x] if c else 1 - p[x]) * n[x] for x in own if f(shape[x]) == f(shape[i])) + 0.5) / total[c] for c in (0, 1)]
                logit += min(3, max(-3, math.log(share[1] / share[0])))
            assert math.isclose(got[i], 1 / (1 + math.exp(-logit)), rel_tol=1e-6, abs_tol=1e-9)


def test_personal_data(spark, stored, none):
    rows = [(k, f"card 4111111111111111 4111111111111111 and a{k}@b.com") for k in range(30)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_email, r.n_card) == (1, 0)
        base = [x for x in r.spans.split(",") if x.startswith("email")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert pii.personal_data(stored).count() == len(ODD)
    assert {r.base_sha256 for r in pii.personal_data(stored).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert pii.personal_data(none).count() == 0


def schedule(blocks, parts):
    """Earliest deadline first, slot by slot."""
    used, out = dict.fromkeys(blocks, 0), []
    while left := sorted((s for s in blocks if used[s] < blocks[s]), key=lambda s: (s is None, s or "")):
        q, own = sum(parts[s] for s in left), dict.fromkeys(left, 0)
        for t in range(10**9):
            ready = [(-(-(own[s] + 1) * q // parts[s]), k, s) for k, s in enumerate(left) if own[s] * q // parts[s] <= t]
            s = min(ready)[2]
            out.append(s)
            own[s] += 1
            used[s] += 1
            if used[s] == blocks[s]:
                break
    return out


def test_mixing(spark, stored, none):
    rows = [(i, "abcde"[min(4, i % 11)]) for i in range(700)] + [(None, None), (3, "d"), (3, "d")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.2, "c": 0.2, "d": 0.05, "e": 0.05}
    got = mixing.mixed(df, weights, block=2).collect()
    assert len(got) == len(rows) and len({r.mix_position for r in got}) == len(rows)
    sizes = collections.Counter(s for _, s in rows)
    parts = mixing.quanta_of({s: weights.get(s, 0.2) for s in sizes})
    assert parts == {"a": 10, "b": 4, "c": 4, "d": 1, "e": 1, None: 4}
    slots = {r.mix_slot: r.source for r in got}
    want = schedule({s: -(-n // 2) for s, n in sizes.items()}, parts)
    assert [slots[k] for k in range(len(slots))] == want
    total, seen = sum(parts.values()), collections.Counter()
    for t, s in enumerate(want, 1):  # less than a block off until the first source ends
        seen[s] += 1
        assert all(abs(seen[x] - t * parts[x] / total) < 1 for x in parts)
        if any(seen[x] == -(-sizes[x] // 2) for x in sizes):
            break
    assert mixing.mixed(none).count() == 0
    # Rounded to so few quanta, all rows still have places.
    assert len({r.mix_position for r in mixing.mixed(df, weights, block=2, quanta=7).collect()}) == len(rows)
    ordered = mixing.in_mixed_order(stored)
    assert ordered.columns == stored.columns and ordered.count() == len(ODD)


@pytest.mark.parametrize("sources", [3, 7, 11])
@pytest.mark.parametrize("equal", [True, False])
def test_shares_stay_within_a_block_of_their_targets(spark, sources, equal):
    weights = {f"s{k}": Fraction(1, sources) if equal else Fraction(2 * (k + 1), sources * (sources + 1)) for k in range(sources)}
    slots = mixing.template(spark, list(mixing.quanta_of(weights).values()))
    done = np.zeros(sources)
    for t in range(1, 20_001):
        done[slots[(t - 1) % len(slots)]] += 1
        if t % 97 == 0 or t < 200:
            assert all(abs(done[k] - t * w) < 1 for k, w in enumerate(weights.values())), t
    assert sum(weights.values()) == 1


def test_ranges_of_a_large_source(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(2000)], "doc_id long, source string")
    want = sorted(mixing.mixed(df).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 30)
    monkeypatch.setattr(mixing, "BROADCAST_RANGES", 10)
    assert sorted(mixing.mixed(df).collect()) == want
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    ids = sorted((i for i in range(2000) if i % 3), key=digest)
    assert [r.doc_id for r in sorted(want, key=lambda r: r.mix_position) if r.source == "a"] == ids


def test_queries_are_registered():
    from terrafold.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) and json.dumps(ORACLE_SQL)


def test_the_driver_fits_no_toxicity_model(spark, monkeypatch):
    """A task fits the sample; what comes back is the model that fit() makes of it."""
    words = ["quiet", "river", "stone", "bread", "lamp", "field"]
    rows = [(k, " ".join(words[(k * 7 + j * j) % 6] for j in range(9)) + (". you vile rat." if k % 3 == 0 else ". good day."), int(k % 3 == 0)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    got = toxicity.sample(docs, labels).orderBy("y", "h", "doc_id").select("text", "y").toArrow()
    want = toxicity.fit(got["text"].combine_chunks().cast(pa.large_string()), got["y"].to_numpy().astype(np.int64), (100, 50))

    driver = os.getpid()

    def elsewhere(made, *args, **kwargs):
        assert os.getpid() != driver
        return made(*args, **kwargs)

    for name in ("fit", "weights"):
        if hasattr(toxicity, name):
            monkeypatch.setattr(toxicity, name, functools.partial(elsewhere, getattr(toxicity, name)))
    model = toxicity.train(docs, labels)
    assert model.bias == want.bias and len(model.weights) > 1
    assert np.allclose(model.weights, want.weights, rtol=1e-12, atol=0)
