"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from hearthline.llm import neighbours


def plain(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    sizes = [len(v) for _, v in rows]
    usual = min(set(sizes), key=lambda s: (-sizes.count(s), s))
    rows = [(i, v) for i, v in rows if len(v) == usual]
    out = {}
    for q, x in rows:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in rows if i != q)[:k]
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x", 0) for i, v in rows], "vec_id long, embedding array<float>, class string, list int")
    out = {}
    for r in sorted(neighbours.neighbours(df, **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(a, b):
    return a.keys() == b.keys() and all([i for _, i in a[q]] == [i for _, i in b[q]] and np.allclose([d for d, _ in a[q]], [d for d, _ in b[q]], atol=1e-9) for q in a)


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, np.float32(v).tolist()) for i, v in enumerate(rng.standard_normal((n, d)) + 3 * rng.standard_normal((8, d))[rng.integers(0, 8, n)])]


def test_recall(spark):
    rows = vectors(3000, 40)
    got, true = found(spark, rows, every=20), plain(rows, 20, 10)
    assert got.keys() == true.keys() and all(len(got[q]) == 10 for q in got)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in true[q]}) for q in got)
    assert hits >= 0.95 * 10 * len(got)
    where = dict(rows)
    assert all(abs(s - np.sqrt(((np.array(where[q]) - np.array(where[i])) ** 2).sum())) < 1e-9 for q in got for s, i in got[q])


def test_all_lists_and_a_large_error_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ERROR", 50.0)
    monkeypatch.setattr(neighbours, "PART", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rows = vectors(900, 24, 1)
    assert same(found(spark, rows, every=10, probes=10**6), plain(rows, 10, 10))


def test_odd_rows_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ERROR", 50.0)
    rows = vectors(120, 6, 2) + [(1000 + i, [1.0, 2, 3, 4, 5, 6]) for i in range(150)]
    rows += [(2000, [0.0] * 6), (2100, None), (2200, [1.0, None, 0, 0, 0, 0]), (2300, [float("nan")] * 6), (2400, [float("inf"), 1, 1, 1, 1, 1]), (2500, [1.0, 2]), (None, [1.0] * 6), (2600, [])]
    rows += [(3000, [-0.0, 1, 0, 0, 0, 0]), (3001, [0.0, 1, 0, 0, 0, 0]), (3100, [0.0, 1, 0, 0, 0, 1]), (3101, [0.0, 1, 0, 0, 0, -1])]
    assert same(found(spark, rows, every=50, probes=10**6), plain(rows, 50, 10))


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_few_rows(spark, n):
    rows = vectors(n, 5, 3)
    got, true = found(spark, rows, every=2), plain(rows, 2, 10) if n else {}
    assert same(got, {q: x for q, x in true.items() if x})
