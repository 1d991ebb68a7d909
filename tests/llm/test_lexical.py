"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    rows = [(doc, Counter(terms(text))) for doc, text in docs]
    rows = [(doc, c, sum(c.values())) for doc, c in rows if c]
    total, length, df = len(rows), sum(n for _, _, n in rows), Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c, n in rows:
            m, score = 75 + 25 * n * total // length, 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n int, h string")
    i = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    return sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=str)


def corpus(seed, n):
    """Words of Zipf's frequencies, lengths from 0 to 400."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    return lambda most: " ".join(rng.choice(words, rng.integers(0, most), p=p / p.sum())), n


@pytest.mark.parametrize("tiers", [lexical.TIERS, ((2, 1 / 50), (5, 1 / 5))])
def test_against_scoring_all(spark, monkeypatch, tiers):
    """With small blocks and thin tiers, items are proven at every depth."""
    monkeypatch.setattr(lexical, "TIERS", tiers)
    monkeypatch.setattr(lexical, "INDEX", lexical.INDEX)
    monkeypatch.setattr(lexical, "BLOCK", 64)
    monkeypatch.setattr(lexical, "LOOKUPS", 12)
    text, n = corpus(3, 600)
    docs = [(i, text(120)) for i in range(n)] + [(7, docs_text) for docs_text in ("w1 W2", "w1 W2")] + [(None, "w3, W4. w3"), (-5, None), (1000, ""), (1001, "--- ..."), (1002, "w1 " * 60_000)]
    docs += [(2000 + i, "same words w9 w8") for i in range(40)]
    items = [(i, text(30)) for i in range(12)] + [(50, "rare w399 w398"), (51, None), (52, "..."), (53, "nowhere"), (54, "same same w8"), (54, "same same w8"), (None, "w1"), (56, "w300")]
    assert found(spark, docs, items) == plain(docs, items, 20)


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 20)
    text, _ = corpus(5, 0)
    docs, items = [(i, text(50)) for i in range(100)], [(i, text(12)) for i in range(30)]
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_hold():
    """No document's score is above its bound, at any depth; at the last one they are equal."""
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 60, 6000)).astype(np.int64)
    slot = np.concatenate([rng.permutation(1500)[: int(n)] for n in np.bincount(h, minlength=60)])
    impacts = rng.integers(1, 10**6, len(h))
    _, df, tiers = lexical._tiers(h, slot, impacts)
    assert sum(len(t[2]) for t in tiers) == len(h) == df.sum()
    tiers = [dict(zip(("h", "ends", "slots", "impacts", "rest"), (x.tobytes() for x in t), strict=True)) for t in tiers]
    asked, w = np.array([3, 9, 27, 99]), np.array([5, 1, 7, 2])
    true = np.zeros(1500, np.int64)
    for t, x in zip(asked, w, strict=True):
        true[slot[h == t]] += x * impacts[h == t]
    for depth in (1, 2, 3):
        low, most, unseen = lexical._Block(1500, tiers[:depth]).sums(asked, w)
        assert (low <= true).all() and (true <= most).all() and (true[low == 0] <= unseen).all()
    assert (low == true).all() and unseen == 0
