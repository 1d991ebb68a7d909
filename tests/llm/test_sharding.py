import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from hearthline.llm import sharding


def test_curve_visits_every_cell_once_by_unit_steps(spark):
    bits = 3
    n = 1 << bits
    cells = spark.range(n**3).selectExpr(f"cast(id div {n * n} as int) x", f"cast(id div {n} % {n} as int) y", f"cast(id % {n} as int) z")
    rows = sorted((r.h, (r.x, r.y, r.z)) for r in cells.withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], bits)).collect())
    assert [h for h, _ in rows] == list(range(n**3))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(rows, rows[1:], strict=False))


def documents():
    rnd = random.Random(1)
    rows = [(i, " ".join("wé" * rnd.randrange(0, 200)), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", None])) for i in range(700)]
    rows += [(1000 + i, "one text", "en", "hot") for i in range(400)] + [(5, None, None, None), (5, None, None, None), (None, "x", "en", "s1")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def test_law_slots_and_sizes(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("hilbert", F.lit("clash"))
    for bucket in (20_000, 25):
        out = sharding.shard(df.repartition(3), rows_per_bucket=bucket).collect()
        want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
        counts = Counter(r.shard for r in out)
        assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
        for s, n in counts.items():
            assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
        assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
        ordered = [r.hilbert for r in sorted(out, key=lambda r: (r.shard, r.slot))]
        assert ordered == sorted(ordered)


def test_files_have_narrow_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = docs.join(sharding.shard(docs), "doc_id")
    langs = joined.groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert langs < docs.select("lang").distinct().count()


def test_empty_few_rows_and_write(spark, tmp_path):
    df = spark.createDataFrame(documents(), SCHEMA)
    assert sharding.shard(df.limit(0)).count() == 0
    assert sorted(r.slot for r in sharding.shard(df.limit(3)).collect()) == [0, 0, 0]
    unique = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_sharded(unique, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == unique.count() and back.select("shard").distinct().count() == 8


def test_equal_texts_share_a_shard(spark):
    rnd = random.Random(2)
    texts = [f"text {i} " * rnd.randrange(1, 40) for i in range(60)]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None]), f"s{i % 7}") for i in range(900)] + [(2000 + i, "hot", "en", f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (2_000, 20):
        out = sharding.shard(df.repartition(5), rows_per_bucket=bucket).join(df.select("doc_id", "text"), "doc_id").collect()
        shards = {}
        for r in out:
            shards.setdefault(r.text, set()).add(r.shard)
        # a group is cut only where a shard is full
        assert sum(len(s) - 1 for s in shards.values()) <= 7
        counts = Counter(r.shard for r in out)
        assert max(counts.values()) - min(counts.values()) <= 1
