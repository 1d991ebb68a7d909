import random

import numpy as np
import pytest

from hearthline.llm import jaccard


def shingles(text, n):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)}


def near_copies(seed):
    rnd, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(3000)]
    passage = rnd.choices(words, k=45)
    for family in range(14):
        base = rnd.choices(words, k=rnd.choice([1, 3, 6, 9, 20, 60, 150, 400]))
        for _ in range(rnd.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                at = rnd.randrange(len(text))
                text[at : at + rnd.choice([0, 1])] = rnd.choices(words, k=rnd.choice([0, 1, 1]))
                text = text or ["x"]
            rows.append(" ".join(text))
    rows += [" ".join(passage + rnd.choices(words, k=k)) for k in (2, 5, 8, 11, 14)]
    rows += [None, "", " \t\n", "ÀB c D e", "Àb C d e", "àb c d e", rows[0].upper(), rows[0]]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n,percent,block", [(4, 85, 300_000), (5, 80, 300_000), (4, 85, 900)])
def test_against_brute_force(spark, n, percent, block):
    rows = near_copies(n + percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, percent, block).collect()}
    assert got == brute(rows, n, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rnd, bands, gone = np.random.default_rng(5), jaccard.Bands(percent), 0
    for _ in range(3000):
        size = int(rnd.choice([5, 7, 12, 13, 25, 60, 200, 700]))
        a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
        cut, add = rnd.integers(0, size // 4 + 1, 2)
        b = np.unique(np.concatenate([a[rnd.permutation(len(a))[cut:]], rnd.integers(0, 1 << 63, add, dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= percent * (len(a) + len(b) - inter) and inter < len(a) + len(b) - inter:
            assert len(np.intersect1d(bands.signatures(a), bands.signatures(b))), (len(a), len(b), inter)
            gone += 1
    assert gone > 500


def test_empty_nulls_repeats_and_stage(spark):
    schema = "doc_id long, text string, component_id string"
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (3, None, "z"), (None, "A b c d e f", None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df).collect())
    assert got == [("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1"), ("3", 0, "3"), ("None", 2, "1")]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    out = jaccard.jaccard_stage(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]


@pytest.mark.parametrize("percent", [80, 85])
def test_bit_maps_rule_out_no_link(percent):
    rnd, sets = np.random.default_rng(8), []
    for _ in range(60):
        base = rnd.integers(0, 1 << 63, int(rnd.choice([3, 20, 31, 33, 60, 130, 500])), dtype=np.uint64)
        for _ in range(4):
            cut, add = rnd.integers(0, len(base) // 5 + 1, 2)
            sets.append(np.unique(np.concatenate([base[rnd.permutation(len(base))[cut:]], rnd.integers(0, 1 << 63, add, dtype=np.uint64)])))
    maps, n = [jaccard.bit_map(s) for s in sets], [len(s) for s in sets]
    ids = list(range(len(sets)))
    got = {tuple(sorted(p)) for p in jaccard.near_pairs(ids, n, maps, [i % 2 for i in ids], [i % 7 for i in ids], percent)}
    links = 0
    for i in ids:
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= percent * (n[i] + n[j] - inter) and n[i] and n[j]:
                assert (100 + percent) * jaccard.apart(maps[i], maps[j]) <= (100 - percent) * (n[i] + n[j])
                if i % 2 != j % 2 and i % 7 != j % 7:
                    assert (j, i) in got
                    links += 1
    assert links > 40 and len(got) < 3 * links
