import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hearthline.sources import notices
from hearthline.streaming import counters

ITEM = "<item><aptNm>{}</aptNm><umdNm>Dong</umdNm><excluUseAr>84.98</excluUseAr><dealAmount> {} </dealAmount><dealYear>2026</dealYear><dealMonth>9</dealMonth><dealDay>5</dealDay><cdealType>{}</cdealType></item>"


def test_transactions_count_before_cancelled_ones_go(spark, tmp_path):
    body = "".join(ITEM.format(*x) for x in [("A", "120,000", ""), ("B", "150,000", "O"), ("C", "-", " ")])
    (tmp_path / "page.xml").write_text(f"<response><items>{body}</items></response>")
    rows = notices.transactions(spark, str(tmp_path / "page.xml"))
    assert rows.count() == 3
    got = {r.apt: (r.amount, r.area, r.date) for r in notices.live(rows).collect()}
    assert got == {"A": (120000.0, 84.98, datetime.date(2026, 9, 5)), "C": (None, 84.98, datetime.date(2026, 9, 5))}


def test_fields_months_open_units_and_drift(spark):
    df = spark.createDataFrame([(None, "x"), (" ", "y"), ("z", "w")], "a string, b string")
    assert [r.v for r in df.select(notices.first_known(df, ["a", "none", "b"]).alias("v")).collect()] == ["x", "y", "z"]
    assert spark.range(1).select(notices.months(F.lit("2026-02-27").cast("date"), 3).alias("m")).first().m == ["202602", "202601", "202512"]
    over = spark.createDataFrame([(1, "2026-01-01", "2026-01-20"), (2, "2025-12-01", "2025-12-10"), (3, None, None), (4, "2026-03-01", None)], "no int, c string, w string")
    over = over.select("no", F.to_date("c").alias("c"), F.to_date("w").alias("w"))
    units = spark.createDataFrame([(i, t) for i in (1, 2, 3, 4) for t in "AB"], "no int, type string")
    out = notices.open_units(over, units, "no", "c", "w", F.lit("2026-02-01").cast("date"))
    assert sorted((r.no, r.type) for r in out.collect()) == [(i, t) for i in (1, 3, 4) for t in "AB"]
    expected = StructType([StructField("a", LongType()), StructField("c", StringType())])
    assert notices.drift(df, expected) == ["missing c", "new b", "a: bigint became string"]


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counters.run_available(counters.daily_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.day, r.key): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.day, r.key): r.n for r in counters.daily_counts(events).collect()}
    open_days = {d for d, _ in want if (max(x for x, _ in want) - d).days <= 1}  # the watermark hasn't passed these
    assert got == {k: n for k, n in want.items() if k[0] not in open_days} and len(got) > 0
