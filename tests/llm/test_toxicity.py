import random

import numpy as np
import pytest

from hearthline.llm import toxicity


def brute(s):
    """Maximal segments by their definition: take the best segment, then look on both of its sides."""
    def go(lo, hi):
        best = max(((round(sum(s[i:j]), 9), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return go(lo, i) + [(i, j)] + go(j, hi)

    return go(0, len(s))


def test_segments_against_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        s = [rnd.choice([-3, -2, -1, -0.5, 0.7, 1.3, 2.9, 4]) + rnd.random() * 1e-3 for _ in range(rnd.randrange(0, 25))]
        got = toxicity.segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == brute(s)
        assert [v for _, _, v in got] == pytest.approx([sum(s[a:b]) for a, b, _ in got])


def test_rate_solves_its_equation():
    s, w = np.array([-2.0, -0.5, 1.0, 3.0]), np.array([50.0, 40.0, 6.0, 1.0])
    rate = toxicity._rate(s, w)
    assert (w / w.sum()) @ np.exp(rate * s) == pytest.approx(1, abs=1e-6) and rate > 0.01


def corpus(spark, n=1500):
    rnd = random.Random(9)
    bad = ["zorg", "blarg", "quux"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rnd.choices([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)], k=rnd.randrange(30, 300)), int(rnd.random() < 0.15)
        for _ in range(rnd.randrange(2, 6) * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_and_passages(spark):
    docs, labels = corpus(spark)
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1500 and 400 < len(held) < 600
    assert sum(r.predicted for r in held if r.toxic) >= 0.95 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = next(r for r in out if r.predicted)
    assert any(x in texts[some.doc_id][some.passages[0].start : some.passages[0].end] for x in ("zorg", "blarg", "quux"))


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = corpus(spark, 600)
    want = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    turned = labels.withColumn("toxic", (labels["toxic"] != (toxicity.crc_fold("doc_id", 3) == 1).cast("int")).cast("int"))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(5), turned).collect()} == want


def test_odd_rows(spark):
    docs, labels = corpus(spark, 600)
    odd = spark.createDataFrame([(9001, None, None), (9002, "", None), (9003, "12 34 !", None), (9004, "zorg " * 30_000, "x"), (None, "wa", "y"), (9004, "zorg " * 30_000, "x")], docs.schema)
    got = [r for r in toxicity.toxicity(docs.unionAll(odd), labels).collect() if r.doc_id is None or r.doc_id > 9000]
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (9001, 9002, 9003)}) == 1
    assert {r.predicted for r in got if r.doc_id == 9004} == {1}
    none = labels.withColumn("toxic", labels["toxic"] * 0)
    assert {r.score < 0.01 for r in toxicity.toxicity(docs, none).collect()} == {True}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 600


def test_one_class_in_the_calibrating_part_and_null_ids(spark):
    docs, labels = corpus(spark, 400)
    part = labels.select("doc_id", (toxicity.F.pmod(toxicity.F.xxhash64("doc_id", toxicity.F.lit(4)), toxicity.F.lit(4)) == 3).alias("calibrates"))
    few = labels.join(part, "doc_id").withColumn("toxic", toxicity.F.when(toxicity.F.col("calibrates"), 0).otherwise(toxicity.F.col("toxic"))).drop("calibrates")
    out = toxicity.toxicity(docs.unionAll(spark.createDataFrame([(None, "zorg", "x")], docs.schema)), few).collect()
    assert len({r.score for r in out}) > 10 and [r.held_out for r in out if r.doc_id is None] == [False]
