"""Vectors and connected groups against brute force."""

import math

import numpy as np
import pytest

from terrafold.llm import embedding_dedup as E
from terrafold.llm.links import deal, forest
from terrafold.llm.shared import components


def groups(links):
    label = list(range(len(links)))
    for _ in links:
        label = [min([label[i], *(label[j] for j in l)]) for i, l in enumerate(links)]
    return label


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2050)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    at = {x: k for k, x in enumerate(nodes)}
    links = [[] for _ in nodes]
    for a, b in edges:
        if a != b:
            links[at[a]].append(at[b])
            links[at[b]].append(at[a])
    assert got == {x: nodes[g] for x, g in zip(nodes, groups(links), strict=True)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest():
    m = np.zeros((6, 6), bool)
    for a, b in ((5, 3), (3, 1), (4, 2)):
        m[a, b] = m[b, a] = True
    assert forest(m).tolist() == [0, 1, 2, 1, 2, 1]


def test_every_pair_meets_once(spark):
    rows = [(k, 7 if k < 50 else 8) for k in range(60)]
    got = [(r.lo, r.hi, r.id, r.block, r.part) for r in deal(spark.createDataFrame(rows, "id long, part long"), "part", "id", 12).collect()]
    met = {}
    for lo, hi in {(a, b) for a, b, *_ in got}:
        own = [(i, b, p) for a, c, i, b, p in got if (a, c) == (lo, hi)]
        for i, bi, p in own:
            for j, bj, q in own:
                if i < j and p == q and (lo == hi or bi != bj):
                    met[i, j] = met.get((i, j), 0) + 1
    assert set(met.values()) == {1} and len(met) == 50 * 49 // 2 + 10 * 9 // 2


@pytest.mark.parametrize("rows_per_cell", [2048, 30])
def test_near_duplicates(spark, monkeypatch, rows_per_cell):
    monkeypatch.setattr(E, "CELL_ROWS", rows_per_cell)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = [b + rng.normal(size=16) * s for b in base for s in (0.0, 0.05, 0.12, 0.3)]
    rows = [(k, [float(v) for v in np.float32(a)], int(k % 2) if k < 100 else 0) for k, a in enumerate(x)]
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n, rows[0][1], rows[0][2]), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [math.nan] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, rows[0][1], None), (n + 6, [], 0), (n + 7, [1.0, 0.0], 0), (n + 8, [2.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, id string, cell string")
    got = E.near_duplicates(df).collect()
    assert len(got) == len(rows)

    def unit(r):
        v = r[1]
        if v is None or r[2] is None or not v or any(a is None or not math.isfinite(a) for a in v) or not any(v):
            return None
        a = np.array(v, np.float64)
        return a / np.linalg.norm(a)

    units = [unit(r) for r in rows]
    links = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and rows[i][2] == rows[j][2] and units[i] @ units[j] >= 0.93] for i in range(len(rows))]
    label = groups(links)
    want = sorted((r[0], len(l), min(rows[k][0] for k in range(len(rows)) if label[k] == g)) for r, l, g in zip(rows, links, label, strict=True))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_several_blocks_are_compared_without_a_shuffle(spark, monkeypatch):
    """Isotropic vectors visit most cells; what is shuffled stays in proportion to the input whatever they visit."""
    from bench import shuffled

    for name, value in (("CELL_ROWS", 100), ("BLOCK_NUMBERS", 64 * 400), ("ROWS", 130), ("COLUMNS", 70)):
        monkeypatch.setattr(E, name, value, raising=False)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 64))
    x = np.float32(np.concatenate([base, base[:300] + rng.normal(size=(300, 64)) * 0.05, base[:300] + rng.normal(size=(300, 64)) * 0.25, base[:1] + rng.normal(size=(200, 64)) * 0.2]))
    label = rng.integers(0, 8, len(x)).clip(0, 2)  # most rows have one label
    label[-200:] = 2
    df = spark.createDataFrame([(k, v.tolist(), int(l)) for k, (v, l) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    before = shuffled(spark)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).collect())
    assert 1e6 * (shuffled(spark) - before) < 3 * x.nbytes
    unit = np.float64(x) / np.linalg.norm(np.float64(x), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    assert got == [(k, int(n), int(c)) for k, (n, c) in enumerate(zip(linked.sum(1), forest(linked), strict=True))]
