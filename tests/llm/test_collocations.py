"""Phrase collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.llm import collocations
from hearthline.llm.collocations import Shard, bitmaps, collocations as mined, words_and_breaks

ALL = np.full(collocations.FILTER // 8, 255, np.uint8)


def plain(docs, longest, least, top):
    """Rows (lang, rank, phrase, a, l, r, n, score) by counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        known = {p: c for (at, p), c in f.items() if at == lang}
        candidates = {p: c for p, c in known.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * c >= 50 * a and inside(q) for q, c in candidates.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (known[p[:k]] * known[p[k:]]), k, known[p[:k]], known[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, l, r, n[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(rows[:top])]
    return sorted(out)


def found(spark, docs, **kw):
    df = spark.createDataFrame([(t, g, i, "x") for i, (t, g) in enumerate(docs)], "text string, lang string, words int, h1 string")
    return sorted(tuple(r) for r in mined(df, **kw).collect())


WORDS = ["a", "b", "c", "A", "é", "日本", "aa", "\x1c", "’"]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_against_counting(spark, longest):
    rng = np.random.default_rng(longest)
    glue = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " \x0b"]
    docs = [("".join(str(rng.choice(WORDS)) + str(rng.choice(glue)) for _ in range(rng.integers(0, 60))), [None, "und", "en", "fr"][i % 4]) for i in range(60)]
    docs += [(None, "en"), ("", None), (" \t\n.,", "fr"), ("a b " * 30_000, "de"), ("a b c.", "es")] + [("x y z", "en")] * 12
    assert found(spark, docs, longest=longest, least=3, top=40) == plain(docs, longest, 3, 40)


def test_shards_cut_nothing(spark, monkeypatch):
    """Counts are the same whatever the runs of texts and the blocks of bitmaps."""
    docs = [(f"one two three {'one two ' * (i % 7)}; two three one {i % 3}", "en") for i in range(200)]
    monkeypatch.setattr(collocations, "BLOCK", 5)
    monkeypatch.setattr(collocations, "SHARD", 100)
    assert found(spark, docs, longest=3, least=10, top=50) == plain(docs, 3, 10, 50)


def test_a_file_for_each_shard(spark, monkeypatch):
    """Shards that one task has made are read and counted apart, so that a task's memory doesn't grow with the shards of a file."""
    docs = [(f"{'a' * 1000} b{i} " * 3000, "en") for i in range(3)]
    files, table = [], collocations.Scratch.table

    def seen(self, df, name, **options):
        out = table(self, df, name, **options)
        if name == "shards":
            files.extend(out.groupBy(F.input_file_name()).count().collect())
        return out

    monkeypatch.setattr(collocations.Scratch, "table", seen)
    df = spark.createDataFrame(docs, "text string, lang string").coalesce(1)
    assert sorted(tuple(r) for r in mined(df).collect()) == plain(docs, 3, 10, 2000)
    assert [n for _, n in files] == [1, 1, 1]


def test_empty_table(spark):
    assert found(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd. "), max_size=120))
def test_bitmaps_count_phrases(letters):
    tokens = [t for c in letters for t in words_and_breaks(c.encode())[: 1 if c != "." else None] if c != " "]
    names = sorted({t for t in tokens if t != b"\xff"})
    stream = np.array([names.index(t) if t in names else -1 for t in tokens], np.int32)
    position = np.flatnonzero(stream >= 0)
    order = np.argsort(stream[position], kind="stable")
    ends, places, bits = bitmaps(stream[position][order], position[order], len(names))
    shard = Shard(np.arange(len(names), dtype=np.uint64) + np.uint64(1), ends, places, bits, [ALL] * 3)
    for k in (2, 3):
        got = Counter()
        for words, counts in shard.phrases(k):
            got.update({tuple(w): int(n) for w, n in zip(words.tolist(), counts, strict=True)})
        pieces = [tuple(stream[i : i + k].tolist()) for i in range(len(stream) - k + 1)]
        assert got == Counter(p for p in pieces if -1 not in p)


def test_filter_rules_out_but_loses_nothing(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, (500, 2))
    bits = collocations.filter_of(spark.createDataFrame([(int(a), int(b)) for a, b in h], "h1 long, h2 long"))
    mine = [h[:, i].copy().view(np.uint64) for i in range(2)]
    assert collocations._passes(bits, mine).all()
    other = [x[::-1].copy() if i else x for i, x in enumerate(mine)]
    assert collocations._passes(bits, other).mean() < 0.05
