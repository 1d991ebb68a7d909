"""Decisions at their boundaries: a limit's own value, and one beyond it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline.operators import decisions

d = lambda s: dt.date.fromisoformat(s) if s else None
REF = "2026-09-18"
OLD, ONE, NONE_KNOWN = {"youngest": d("2019-01-01"), "minors": 1, "pregnant": False}, {"youngest": d("2025-06-01"), "minors": 1, "pregnant": False}, {"minors": 1}
PROFILE = (
    "household string, household_homes string, parents_own boolean, parents_60 boolean, owner string, owns boolean, married boolean, spouse_owns boolean, household_income int, income int, spouse_income int, "
    "youngest date, minors int, pregnant boolean, assets int"
)


def frame(spark, profiles):
    names = [c.split()[0] for c in PROFILE.split(", ")]
    df = spark.createDataFrame([(i, *[p.get(n) for n in names]) for i, p in enumerate(profiles)], f"i int, {PROFILE}")
    return df, {n: F.col(n) for n in names}


def result(df, column):
    return [r.x for r in df.orderBy("i").select(column.alias("x")).collect()]


def limit(n, percent):
    base = decisions.INCOME_3_TO_8[max(0, n - 3)]
    return (base * percent + 50) // 100 * 12 // 10000


def test_accounts_of_the_first_rank(spark):
    cases = [("2024-09-18", "경기", 200, "ok", "ok"), ("2024-09-19", "경기", 200, "fail", "ok"), ("2014-01-01", "경기", 199, "ok", "fail"), ("2014-01-01", "서울", 299, "ok", "fail"), ("2014-01-01", "서울", 300, "ok", "ok"),
             ("2014-01-01", "인천", 250, "ok", "ok"), ("2014-01-01", "인천", 249, "ok", "fail"), ("2014-01-01", "부산", 300, "ok", "ok"), ("2014-01-01", "대전", 249, "ok", "fail"), ("2014-01-01", "세종", 200, "ok", "ok"), (None, None, 500, None, None)]
    df = spark.createDataFrame([(i, d(s), p, a) for i, (s, p, a, _, _) in enumerate(cases)], "i int, s date, p string, a int")
    got = result(df, decisions.first_rank_account(F.col("s"), F.col("a"), F.col("p"), F.lit(REF).cast("date"), F.lit(24)))
    assert [tuple(r) for r in got] == [(x, y) for *_, x, y in cases]


def test_homes_of_a_household(spark):
    parents = {"household": "parents", "parents_own": True, "household_homes": "1"}
    cases = [({"household_homes": "0"}, "ok"), ({"household_homes": "1"}, "warn"), ({"household_homes": "2+"}, "warn"), ({**parents, "parents_60": True}, "ok"), ({**parents, "parents_60": False}, "fail"),
             ({"household_homes": "1", "owns": True}, "fail"), ({"household_homes": "1", "owner": "parent60"}, "ok"), ({"household_homes": "1", "owner": "other"}, "fail")]
    df, p = frame(spark, [c for c, _ in cases])
    assert result(df, decisions.homeless_household(p)) == [x for _, x in cases]
    assert set(result(df, decisions.homeless_household(p, F.lit(True)))) == {"ok"}
    assert result(df.where("i = 6"), decisions.homeless_household(p, elder_supply=F.lit(True))) == ["fail"]


@pytest.mark.parametrize("births,percents", [(OLD, {100: "ok", 101: "fail"}), (ONE, {109: "ok", 111: "warn", 121: "fail"}), (NONE_KNOWN, {111: "warn", 121: "fail"})])
def test_income_of_general_public_supply(spark, births, percents):
    profiles = [{**births, "married": True, "household_income": y, "income": y} for percent in percents for y in [limit(3, percent) if percent % 10 == 0 else limit(3, percent - 1) + 1]]
    df, p = frame(spark, profiles)
    assert result(df, decisions.public_general_income(p, F.lit(3))) == list(percents.values())


def test_newlywed_towns(spark):
    two = {"married": True, "income": 1000, "spouse_income": 1000}
    incomes = [(limit(3, 130), {}, "ok"), (limit(3, 130) + 1, {}, "fail"), (limit(3, 200), two, "ok"), (limit(3, 200) + 1, two, "fail")]
    df, p = frame(spark, [{"household_income": y, **x} for y, x, _ in incomes])
    assert [r.income for r in result(df, decisions.town_limits(p, F.lit(3)))] == [x for *_, x in incomes]
    assets = [(36200, OLD, "ok"), (36201, OLD, "fail"), (39700, ONE, "ok"), (39701, ONE, "warn"), (43101, ONE, "fail"), (-5000, OLD, "ok"), (None, OLD, None)]
    df, p = frame(spark, [{"assets": a, **x} for a, x, _ in assets])
    assert [r.assets for r in result(df, decisions.town_limits(p, F.lit(3)))] == [x for *_, x in assets]


def test_residence_and_the_second_rank(spark):
    near = ["서울", "경기", "인천"]
    cases = [("경기", "광명시", "2015-01-01", "경기", "광명시", 24, near, "local"), ("경기", "광명시", "2024-09-18", "경기", "광명시", 24, near, "local"), ("경기", "광명시", "2024-09-19", "경기", "광명시", 24, near, "other"),
             ("서울", None, "2015-01-01", "경기", "광명시", 24, near, "other"), ("경기", "수원시", "2015-01-01", "경기", "광명시", 24, near, "other"), ("부산", None, "2015-01-01", "경기", "광명시", 24, near, "none"),
             ("인천", "계양구", "2026-08-30", "인천", None, None, near, "local"), ("충남", "천안시", "2015-01-01", "인천", None, None, near, "none"), ("제주", None, "2025-09-18", "제주", None, 12, [], "local"),
             ("제주", None, "2025-09-19", "제주", None, 12, [], "other"), (None, None, None, "인천", None, None, near, None), ("경기", None, "2015-01-01", "경기", "광명시", 24, near, None)]
    df = spark.createDataFrame([(i, h, c, d(s), p, q, m, o) for i, (h, c, s, p, q, m, o, _) in enumerate(cases)], "i int, h string, c string, s date, p string, q string, m int, o array<string>")
    assert result(df, decisions.residence_tier(*[F.col(c) for c in "hcspqmo"], F.lit(REF).cast("date"))) == [x for *_, x in cases]
    ranks = [("fail", "all", "r2"), ("fail", "", "unsure"), ("fail", "none", "no"), ("ok", "none", "ok"), ("warn", "all", "unsure")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(ranks)], "i int, a string, b string")
    assert result(df, decisions.general_rank(F.col("a"), F.col("b"))) == [x for *_, x in ranks]


def test_minor_account_months(spark):
    # opened at twelve: at most 24 months before 2024, all of it grown-up time after nineteen
    cases = [("2015-01-15", "2003-01-15", 24 + 56), ("2023-03-01", "2010-01-01", 10 + 32), ("2024-02-01", "2010-01-01", 31), ("2010-01-01", "1985-01-01", 200), ("2015-01-15", None, 140)]
    df = spark.createDataFrame([(i, d(s), d(b)) for i, (s, b, _) in enumerate(cases)], "i int, s date, b date")
    assert result(df, decisions.account_months(F.col("s"), F.col("b"), F.lit(REF).cast("date"))) == [x for *_, x in cases]
