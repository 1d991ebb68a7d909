import math
import random
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.language(docs).join(docs, "doc_id").select("doc_id", "held_out", "lang", "lang_pred", "score").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    wrong = docs.withColumn("lang", language.F.when(language.crc_fold("doc_id", 4) == 2, "xx").otherwise(docs["lang"])).repartition(5)
    again = {r.doc_id: r.lang_pred for r in language.language(wrong).collect()}
    assert sum(again[r.doc_id] == r.lang_pred for r in out) >= 0.999 * len(out) and "xx" not in again.values()


def test_most_weights_are_zero_and_probabilities_calibrated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    assert len(model.weights) < 0.6 * language.BUCKETS and 0.05 < model.temperature < 50


def test_training_separates():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        at = np.unique(rng.integers(0, 40, 12)) + 100 * (i % 3)
        rows.append((np.append(at, 1000), np.full(len(at) + 1, 1 / np.sqrt(len(at) + 1)), i % 3))
    w = language.train(rows, 3)
    assert np.count_nonzero(w[1001:]) == 0
    assert all((x @ w[at]).argmax() == y for at, x, y in rows)


def test_vector_has_length_one_and_orders():
    at, x = language.vector("Ab, ab 1!", np.ones(language.BUCKETS))
    assert x @ x == pytest.approx(1) and len(language.grams(" 12 ")) == 0
    assert len(language.grams("ab")) == 4 + 3 + 2  # of " ab "


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, held_out string"
    base = [(i, ["hello there my friend", "bonjour mon ami là"][i % 2] * (1 + i % 3), ["en", "fr"][i % 2], "x") for i in range(200)]
    odd = [(900, None, "en", None), (901, "", "fr", None), (902, "12 !? 3", "en", None), (903, "hello friend " * 40_000, None, None), (903, "hello friend " * 40_000, None, None), (None, "bonjour", "fr", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language(spark.createDataFrame(base + odd, schema)).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en" and got[None][0] == "fr"
    one = spark.createDataFrame([(i, "abc", "en", "") for i in range(9)], schema)
    assert {r.lang_pred for r in language.language(one).collect()} == {"en"}
    none = spark.createDataFrame([(1, "abc", None, "")], schema)
    assert [r.lang_pred for r in language.language(none).collect()] == ["und"]
    assert language.language(one.limit(0)).count() == 0


def slow_grams(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        else:
            words, word = words + [word] * bool(word), ""
    flat, out = f" {' '.join(words)} " if words else "", []
    for n in language.ORDERS:
        for i in range(len(flat) - n + 1):
            h = n
            for j in range(n):
                h = (h ^ ord(flat[i + j])) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[j] % (1 << 32)
            out.append((h ^ (h >> 15)) % language.BUCKETS)
    return out


def slow_model(rows):
    """rows: (text, lang) in training order. The same method with dictionaries and loops over coordinates."""
    sets = [Counter(slow_grams(t)) for t, _ in rows]
    df = Counter(b for s in sets for b in s)
    idf = lambda b: math.log((1 + len(rows)) / (1 + df[b])) + 1

    def vector(counts):
        x = {b: n * idf(b) for b, n in counts.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / length for b, v in x.items()}

    def softmax(z):
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    langs = sorted({lang for _, lang in rows})
    data = [(vector(s), langs.index(lang)) for s, (_, lang) in zip(sets, rows, strict=True)]
    seen, held = [d for i, d in enumerate(data) if i % 5 != 4], [d for i, d in enumerate(data) if i % 5 == 4]
    z, n, scale = Counter(), Counter(), 20.0

    def weight(b, k):
        v = z[b, k]
        return 0.0 if abs(v) <= language.L1 else -(v - math.copysign(language.L1, v)) / ((language.BETA + math.sqrt(n[b, k])) / language.ALPHA + language.L2)

    order = np.random.default_rng(7)
    for _ in range(language.EPOCHS):
        for i in order.permutation(len(seen)):
            x, label = seen[i]
            w = {(b, k): weight(b, k) for b in x for k in range(len(langs))}
            p = softmax([sum(scale * v * w[b, k] for b, v in x.items()) for k in range(len(langs))])
            for b, v in x.items():
                for k in range(len(langs)):
                    g = scale * v * (p[k] - (k == label))
                    z[b, k] += g - (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / language.ALPHA * w[b, k]
                    n[b, k] += g * g
    logits = lambda x: [sum(scale * v * weight(b, k) for b, v in x.items()) for k in range(len(langs))]
    grid = [math.exp(math.log(0.05) + i * (math.log(50) - math.log(0.05)) / 399) for i in range(400)]
    loss = lambda t: sum(-math.log(max(1e-12, softmax([v / t for v in logits(x)])[y])) for x, y in held)
    t = min(grid, key=loss)

    def predict(text):
        counts = Counter(slow_grams(text or ""))
        if not counts:
            return "und", 0.0
        p = softmax([v / t for v in logits(vector(counts))])
        return langs[p.index(max(p))], max(p)

    return predict


def test_against_a_slow_version(spark):
    rnd = random.Random(2)
    parts = {"aa": ["hello", "there", "friend", "of", "ours"], "bb": ["bonjour", "mon", "ami", "là", "of"], "cc": ["hallo", "du", "freund", "ßü", "mon"]}
    rows = [(i, " ".join(rnd.choices(parts[k], k=rnd.randrange(1, 6))), k) for i, k in enumerate(rnd.choices(list(parts), k=60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    order = [r.doc_id for r in df.select("doc_id", language.F.xxhash64("doc_id", language.F.lit(3)).alias("h"), "lang").orderBy("h", "lang").collect()]
    slow = slow_model([(rows[i][1], rows[i][2]) for i in order])
    for text in [t for _, t, _ in rows] + ["hello mon freund", "²½ Ⅷ ①", "x", None, "Ab²c"]:
        (a, p), (b, q) = model.predict(text), slow(text)
        assert a == b and p == pytest.approx(q, abs=2e-3), text


def test_numerals_are_no_letters():
    assert [len(language.grams(t)) for t in ("²½", "①Ⅷ", "12", "_")] == [0] * 4
    assert sorted(language.grams("a²b").tolist()) == sorted(slow_grams("a²b"))
