import re

import pytest
from pyspark.sql import functions as F

from hearthline.llm import quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {g for g in grams if grams.count(g) > 1}
    covered = {j for i, g in enumerate(grams) if g in hit for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


TEXTS = [
    None, "", "  \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "a " * 40, "x\ny\nx\n \n \nx\r\nx", "é ü ß # * $ % & | < >",
    " ".join(str(i % 23) for i in range(200)), " ".join(map(str, range(60))) + " " + " ".join(map(str, range(5, 20))), "z" * 5000, "　 \x0b\x0c tail",
    " ".join(map(str, range(30))) + "\n" + " ".join(map(str, range(30))),
]


def test_base_counts_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words double")
    got = {r.doc_id: tuple(r)[1:6] + (r.base_failed,) for r in quality.base_counts(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t
    assert quality.base_counts(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels


def test_verdicts_follow_labels_and_rerun_equal(labelled):
    docs, labels = labelled
    out = quality.quality_rules(docs, labels).cache()
    assert out.count() == docs.count()
    judged = out.where("not base_failed").join(labels, "doc_id")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("kept").count() <= 0.3 * bad.count()
    again = quality.quality_rules(docs.repartition(7), labels)
    assert out.exceptAll(again).isEmpty()
    out.unpersist()


def test_score_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None), (4, "a c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels).first()
    w = {r.doc_id: r.w for r in quality._hashes(docs).select("doc_id", quality._grams(F.col("w")).alias("w")).collect()}
    out = {r.doc_id: r.score for r in quality.quality_rules(docs, labels).collect()}
    assert len(model.weights) == quality.BUCKETS
    for d, grams in w.items():
        assert out[d] == pytest.approx(sum(model.weights[g] for g in grams) / (len(grams) + quality.PRIOR))


def test_no_labels_keeps_all_that_pass_the_base_rule(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(50)))), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()} == {1: True, 2: False}


def test_stage_keeps_columns(labelled, spark):
    docs, labels = labelled
    rows = docs.limit(50).withColumns({"w": docs["doc_id"], "score": docs["lang"]})
    out = quality.quality_stage(spark, rows, labels)
    assert out.columns == rows.columns and 0 < out.count() <= 50


def test_all_trusted_documents_count(spark):
    """More than any fixed number of them: each adds its words to the target's counts, or its score to the threshold's."""
    n = 9000
    docs = spark.range(n).selectExpr("id doc_id", "concat('w', id % 3) text")
    labels = spark.range(n).selectExpr("id doc_id", "1 quality", "0 toxic")
    parts = {r.part: r["count"] for r in quality.trusted(labels).groupBy("part").count().collect()}
    assert sum(parts.values()) == n and min(parts.values()) > 4200
    model = quality.fit(docs, labels).first()
    counted = quality.trusted(labels).where("part = 0").count()
    words = {r.w: r.n for r in quality.trusted(labels).where("part = 0").join(docs, "doc_id").groupBy(F.pmod(F.xxhash64("text"), F.lit(quality.BUCKETS)).alias("w")).agg(F.count("*").alias("n")).collect()}
    import math

    for w, k in words.items():
        assert model.weights[w] == pytest.approx(math.log((k + 1) / (counted + quality.BUCKETS)) - math.log((n / 3 + 1) / (n + quality.BUCKETS)))


def test_texts_meet_few_trusted_ids_as_they_meet_many(labelled, monkeypatch):
    """No broadcast of ids, whose number grows with the documents, so that shuffled bytes grow in step with the input."""
    docs, labels = labelled
    plans, persisted = [], quality.persisted

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return persisted(df, name)

    monkeypatch.setattr(quality, "persisted", seen)
    quality.fit(docs, labels)
    assert sum(p.count("ShuffledHashJoin") for p in plans) >= 2 and not any("BroadcastHashJoin [doc_id" in p for p in plans)
