"""Operators without a query of their own, on literal rows."""

import datetime as dt
import zipfile

from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.operators import audit, conditions, decisions, history, listing, retrieval, rules, sets, state

d = lambda s: dt.date.fromisoformat(s)


def test_competition_joins_on_trimmed_types(spark):
    summary = spark.createDataFrame([("1", "084.9C", "1", 32.0)], "notice string, house_ty string, rank string, rate_num double")
    rows = spark.createDataFrame([("1", "084.9C "), ("1", "059A"), ("2", "084.9C"), ("1", None)], "notice string, house_ty string")
    assert [r.competition and r.competition.rate_num for r in history.with_competition(rows, summary).collect()] == [32.0, None, None, None]
    past = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "district string, v int")
    assert [r.v for r in history.for_present_districts(past, spark.createDataFrame([("a",), (None,), ("a",)], "district string")).collect()] == [1]


def test_similar_results_of_the_last_year(spark):
    units = spark.createDataFrame([(1, "a", 84.0, "n1")], "listing long, district string, area double, group string")
    past = spark.createDataFrame([(10, "a", 80.0, "n2", d("2026-05-01")), (11, "a", 90.0, "n2", d("2026-05-01")), (12, "a", 84.0, "n1", d("2026-05-01")), (13, "a", 84.0, "n3", d("2025-01-01")), (14, "a", 100.0, "n4", d("2026-06-01")), (15, "a", 70.0, "n5", d("2026-06-01"))],
                                 "other long, district string, area double, group string, at date")
    got = history.similar_results(units, past, F.lit("2026-07-01").cast("date")).collect()
    assert sorted((r.group, r.other, r.difference) for r in got) == [("n2", 10, 4.0), ("n5", 15, 14.0)]


def test_targets_by_name_and_address(spark):
    rows = [(1, "도봉 한신 아파트", "서울 도봉구", False), (2, "한신더휴", "경기 의왕시", False), (3, "한신", "서울 도봉구", True), (4, "강남 자이", "서울 강남구", True)]
    df = spark.createDataFrame(rows, "id int, name string, address string, past boolean")
    find = lambda q: sorted(r.id for r in conditions.find_targets(df, q).collect())
    assert find("도봉 한신") == [1] and find("한신") == [1, 2] and find("강남 자이(3단지)") == [4] and find("도봉 자이") == [] == find("a")


def test_grades_first_then_known_days(spark):
    rows = [("pass", d("2026-01-01"), 1), ("lotto", None, 2), ("lotto", d("2026-02-01"), 3), ("consider", d("2026-01-01"), 4)]
    df = spark.createDataFrame(rows, "grade string, day date, id int")
    assert [r.id for r in df.orderBy(*listing.by_grade_and_date(F.col("grade"), F.col("day"))).collect()] == [3, 2, 4, 1]


def test_documents_are_read_again_by_version_and_attachment(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, attachment string")
    cache = spark.createDataFrame([(1, "x", 2), (2, "old", 2), (3, "z", 1)], "id int, attachment string, version int")
    assert sorted(r.id for r in state.reread(docs, cache, 2).collect()) == [2, 3]


def test_zipped_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<hs:sec><hp:p a='1'><hp:t>첫 줄</hp:t></hp:p><hp:p><hp:t>둘째</hp:t></hp:p></hs:sec>")
        z.writestr("other.xml", "<p>no</p>")
    (tmp_path / "b.hwpx").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.hwpx"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in text.documents_text(files).collect()}
    assert got == {"a.hwpx": "첫 줄\n둘째", "b.hwpx": None}


def test_verdicts_and_land_values(spark):
    rows = [(False, "lotto", 0.0, "not eligible"), (True, "flat", 0.0, "too little margin"), (True, "unknown", 0.0, "check the market"), (True, "lotto", 0.5, "short of funds"), (True, "consider", -1.0, "go")]
    df = spark.createDataFrame(rows, "ok boolean, g string, gap double, want string")
    assert all(r.v == r.want for r in df.select("want", rules.verdict(F.col("ok"), F.col("g"), F.col("gap")).alias("v")).collect())
    land = spark.createDataFrame([(500_000.0, 0.025), (None, 0.025), (5.0, 0.0)], "rent double, rate double").select(rules.land_value(F.col("rent"), F.col("rate")).alias("v")).collect()
    assert [r.v for r in land] == [2.4, None, None]


def test_resupply_against_the_table(spark):
    rows = [(2, {"elder": 2}, {"elder": 2, "first": 0}, 1, "agrees"), (2, {"elder": 2}, {"elder": 1}, 2, "differs"), (0, {}, None, 3, "filled"), (2, {"elder": 2}, None, 1, "filled"), (2, {"elder": 2}, None, 2, None), (None, {}, {}, 1, None)]
    df = spark.createDataFrame(rows, "n int, s map<string,int>, t map<string,int>, u int, want string")
    got = df.select("want", decisions.resupply_check(F.col("n"), F.col("s"), F.col("t"), F.col("u")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_values_read_differently(spark):
    schema = "id int, sha string, values map<string,string>"
    a = spark.createDataFrame([(1, "s", {"x": "1", "y": "2", "quotes": "q"}), (2, "s", {"x": "1", "quotes": "q"}), (3, "s", {"x": "1"})], schema)
    b = spark.createDataFrame([(1, "s", {"x": "1", "y": "3", "z": "4"}), (2, "t", {"x": "2", "quotes": "r"})], schema)
    got = lambda moved: sorted(map(tuple, audit.parse_differences(a, b, "id", moved).collect()), key=str)
    assert got(False) == [(1, "quotes", "q", None), (1, "y", "2", "3"), (1, "z", None, "4")] and got(True) == [(2, "x", "1", "2")]


def test_evidence_of_the_source_asked_about(spark):
    questions = spark.createDataFrame([("q1", "law", "신혼 특공 조건이 뭐야?"), ("q2", "n1", "계약금 언제 내나요?"), ("q3", "n2", "계약금")], "question string, source string, asked string")
    chunks = [("law", 0, "제41조", "신혼부부 특별공급은", "제41조", 0), ("law", 1, "제41조", "이어지는 조문", "제41조", 1), ("law", 2, "제58조", "신혼부부 신혼부부", "제58조", 0), ("law", 3, "제2조", "정의", "제2조", 0),
              ("n1", 0, "■ 납부", "계약금 10% 중도금", None, None), ("n1", 1, "", "발코니", None, None), ("n1", 2, "", "계약금 " * 9, None, None)]
    df = spark.createDataFrame(chunks, "source string, pos int, h string, t string, article string, part int")
    got = {(r.question, r.pos): r.score for r in retrieval.scored(questions, df).collect()}
    assert got[("q1", 0)] == 80 + 1 + 1 + 3 and got[("q1", 1)] == 70 and got[("q1", 2)] == 2 + 6 and ("q1", 3) not in got and ("q3", 0) not in got
    assert got[("q2", 0)] > 0 and got[("q2", 2)] == 3 * 4 + 4 and ("q2", 1) not in got
    assert [(r.question, r.pos) for r in retrieval.evidence(questions, df, 2, 60).orderBy("question", "pos").collect()] == [("q1", 0), ("q1", 1), ("q2", 0), ("q2", 2)]


def test_states_that_worsen_and_tallies(spark):
    before = spark.createDataFrame([(1, "ok"), (2, "warn"), (3, "fail"), (4, "odd")], "id int, s string")
    after = spark.createDataFrame([(1, "warn"), (2, "ok"), (3, "fail"), (4, "no")], "id int, s string")
    assert [tuple(r) for r in audit.worsened(before, after, ["id"], "s").collect()] == [(1, "ok", "warn")]
    checks = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("b", True)], "check string, ok boolean")
    assert sorted(map(tuple, audit.tally(checks).collect())) == [("a", 1, 1, 1), ("b", 1, 0, 0)]
    results = spark.createDataFrame([("a", True, "x"), ("b", False, "y"), ("c", True, "old"), ("d", True, None)], "check string, ok boolean, fingerprint string")
    now = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "check string, fingerprint string")
    assert {r.check: r.status for r in audit.gated(results, now).collect()} == {"a": "passed", "b": "failed", "c": "pending", "d": "pending"}


def test_first_rows_wider_sources_and_snapshots(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "g string, o int, v string")
    assert sorted(map(tuple, sets.first_rows(rows, "g", ["o"]).collect())) == [("a", 1, "x"), ("b", 3, "z")]
    pairs = spark.createDataFrame([([1, 2], [1]), ([1], [1, 2]), ([1], [2]), (None, [1]), ([1], None)], "a array<int>, b array<int>")
    assert [r.w for r in pairs.select(sets.wider_source(F.col("a"), F.col("b")).alias("w")).collect()] == [[1, 2], [1, 2], None, [1], [1]]
    units = spark.createDataFrame([("n1", "u1", None), ("n1", "u2", 5), ("n2", "u3", None)], "notice string, unit string, duty int")
    facts = spark.createDataFrame([("n1", 3, "q")], "notice string, duty int, quote string")
    assert sorted(map(str, sets.with_notice_facts(units, facts, "notice").select("unit", "duty", "quote").collect())) == [
        "Row(unit='u1', duty=3, quote='q')", "Row(unit='u2', duty=5, quote='q')", "Row(unit='u3', duty=None, quote=None)"]
    today = spark.createDataFrame([(1, None, True), (2, None, False), (3, "new", False)], "id int, v string, read boolean")
    before = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id int, v string")
    assert sorted((r.id, r.v) for r in sets.revived(today, before, "id", ["v"], F.col("read")).collect()) == [(1, None), (2, "old"), (3, "new")]
