import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthline.llm import dedup


def brute(rows):
    texts = [t or "" for _, t in rows]
    n = Counter(texts)
    top = {}
    for d, t in rows:
        t = t or ""
        top[t] = max(top.get(t, -1), -1 if d is None else d)
    return sorted((-1 if d is None else d, top[t or ""], n[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c" * 50_000), (7, "c" * 50_000), (7, "c" * 50_000), (None, "b"), (8, "é"), (9, "é"), (10, "A")] + [(100 + i, "hot") for i in range(40)] + [(200 + i, f"own {i}") for i in range(20)]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("max_files", [1, 10_000])
def test_against_brute_force(spark, tmp_path, weak, max_files):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumn("digest", F.lit("clash")).write.parquet(path)
    digest = (lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)) if weak else dedup.sha256
    got = dedup.exact_dedup(spark, path, digest=digest, max_files=max_files).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.doc_id), none(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(ROWS)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in ROWS})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_state_goes_on(spark, tmp_path):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "x"), (2, "y")], schema).coalesce(1).write.parquet(path)
    assert {(r.digest, r.n) for r in dedup.update_state(spark, path, state).collect()} == {(hashlib.sha256(t).hexdigest(), 1) for t in (b"x", b"y")}
    spark.createDataFrame([(3, "x")], schema).coalesce(1).write.mode("append").parquet(path)
    got = {r.digest: (r.keep.doc_id, r.n) for r in dedup.update_state(spark, path, state).collect()}
    assert got[hashlib.sha256(b"x").hexdigest()] == (3, 2)


def test_single_file_empty_table_and_stage(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert dedup.exact_dedup(spark, path).count() == 0
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (2, None, 1)], "doc_id long, text string, locator int")
    out = dedup.dedup_stage(spark, docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]
    one = "/root/testdata/sf0.001/documents.parquet"
    assert dedup.exact_dedup(spark, one).count() == spark.read.parquet(one).count()
