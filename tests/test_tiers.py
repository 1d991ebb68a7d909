"""Rental tiers at their boundaries, one change at a time, and cities as people write them."""

import datetime

from pyspark.sql import functions as F

from hearthline.operators import tiers

DAY = datetime.date
BASE = {
    "birth": DAY(1995, 3, 1), "married": False, "minors": 0, "pregnant": False, "household": "head", "size": 1, "own": False, "homes": "0", "spouse_own": False, "province": "부산", "account": "all",
    "income": 3000, "household_income": 3000, "own_asset": 3000, "real_estate": 0, "car": 1000, "cash": 2000, "liquid": 0, "deposit": 0, "insurance": 0, "other_finance": 0, "other_asset": 0, "debt": 0,
    "entered": list(tiers.ZEROS),
}
YOUTH = {"key": "청년", "age_min": 19, "age_max": 39, "homeless": "self", "income_pct": [120.0, 110.0, 100.0], "asset": 25100, "car": 4542}
GENERAL = {"key": "일반", "homeless": "household", "income_pct": [70.0, 60.0, 50.0], "asset": 24500, "car": 4542}
ELDER, STUDENT = {**GENERAL, "key": "고령자", "age_min": 65}, {**YOUTH, "key": "대학생", "asset": 10800, "car": 0}
WED = {**GENERAL, "key": "신혼부부·한부모", "dual_add": 20.0, "income_pct": [None, 110.0, 100.0]}
MOST = lambda won, percent: int(won * percent / 100 * 12 // 10_000)  # noqa: E731  the largest income of a year, in 10,000 won
#: What is changed, the tier, and its state.
CASES = [
    ({}, YOUTH, "ok"), ({"birth": DAY(1986, 9, 23)}, YOUTH, "ok"), ({"birth": DAY(1986, 9, 22)}, YOUTH, "na"), ({"birth": DAY(2007, 9, 22)}, YOUTH, "ok"), ({"birth": DAY(2007, 9, 23)}, YOUTH, "na"), ({"birth": None}, YOUTH, "check"),
    ({"married": True}, YOUTH, "na"), ({"married": None}, YOUTH, "check"), ({"own": True, "homes": "1"}, YOUTH, "no"), ({"own_asset": 25101}, YOUTH, "ok"), ({"real_estate": 22100}, YOUTH, "ok"), ({"real_estate": 22101}, YOUTH, "no"),
    ({"household": "parents", "size": 4, "household_income": 20000, "own_asset": 25100}, YOUTH, "ok"), ({"household": "parents", "size": 4, "own_asset": 25101}, YOUTH, "no"),
    ({"household_income": MOST(3813363, 120)}, YOUTH, "ok"), ({"household_income": MOST(3813363, 120) + 1}, YOUTH, "no"),
    ({"household_income": MOST(3813363, 70)}, GENERAL, "ok"), ({"household_income": MOST(3813363, 70) + 1}, GENERAL, "no"), ({"size": 3, "household_income": MOST(8168429, 50) + 1}, GENERAL, "no"),
    ({"size": 3, "minors": 1, "youngest_birth": DAY(2024, 5, 1), "household_income": MOST(8168429, 50) + 1}, GENERAL, "check"), ({"size": 9, "household_income": MOST(11064819 + 579278, 50)}, GENERAL, "ok"),
    ({"real_estate": 30000, "debt": None}, GENERAL, "check"), ({"insurance": None}, GENERAL, "check"), ({"car": 4543}, GENERAL, "no"), ({"size": None}, GENERAL, "check"), ({"household_income": None, "income": 0, "entered": []}, GENERAL, "check"),
    ({"own": None}, GENERAL, "ok"), ({"own": None, "homes": ""}, GENERAL, "check"), ({"own": True}, GENERAL, "check"), ({"own": True, "homes": "1"}, GENERAL, "no"), ({"province": "서울"}, GENERAL, "no"), ({"province": ""}, GENERAL, "check"),
    ({"birth": DAY(1961, 9, 22), "household_income": 2000}, ELDER, "ok"), ({"birth": DAY(1961, 9, 23)}, ELDER, "na"), ({"student": None, "car": 0}, STUDENT, "check"), ({"student": False}, STUDENT, "na"),
    ({"student": True, "student_income": True, "car": 0}, STUDENT, "ok"), ({"student": True, "student_income": True, "car": 1}, STUDENT, "no"),
    ({"married": True, "married_on": DAY(2019, 9, 22), "size": 2, "household_income": 6000}, WED, "ok"), ({"married": True, "married_on": DAY(2019, 9, 21), "size": 2}, WED, "na"), ({"married": True, "size": 2}, WED, "check"),
    ({"married": True, "married_on": DAY(2022, 1, 1), "size": 2, "income": 4000, "spouse_income": 4000, "household_income": MOST(5866270, 130)}, WED, "ok"),
    ({"married": True, "married_on": DAY(2022, 1, 1), "size": 2, "income": 4000, "spouse_income": 4000, "household_income": MOST(5866270, 130) + 1}, WED, "no"),
    ({"married": True, "married_on": DAY(2022, 1, 1), "size": 1}, WED, "check"), ({}, {**GENERAL, "key": "다자녀"}, "check"),
]


def test_boundaries(spark):
    person, tier = (", ".join(f"{k}: {v}" for k, v in s.items()) for s in (tiers.PERSON, tiers.TIER))
    rows = [(i, {k: {**BASE, **p}.get(k) for k in tiers.PERSON}, {k: g.get(k) for k in tiers.TIER}) for i, (p, g, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i int, p struct<{person}>, g struct<{tier}>")
    t = F.struct(F.lit("영구임대").alias("kind"), F.lit("2026-09-22").cast("date").alias("reference"), F.struct(F.lit("부산").alias("province"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("also"), F.lit(None).cast("boolean").alias("others_check"), F.lit(None).cast("boolean").alias("other_cities_check")).alias("local"))
    found = {r.i: (r.state, r.parts) for r in tiers.judge(df.withColumn("t", t)).collect()}
    wrong = [(CASES[i], s, [tuple(x) for x in parts if x.state != "ok"]) for i, (s, parts) in found.items() if s != CASES[i][2]]
    assert not wrong


def test_cities(spark):
    cases = [("수원시", "수원시", True), ("경기도 수원시 영통구", "수원시", True), ("수원", "수원시", True), ("성남시", "수원시", False), ("영통구", "수원시", None), ("", "수원시", None), (None, "수원시", None), ("가평군 청평면", "가평군", True), ("서울특별시", "수원시", None), ("전주, 수원", "수원시", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(tiers.city_match(F.col("a"), F.col("b"))).collect()] == [x for *_, x in cases]


def test_few_persons_are_many_tasks(spark):
    """A small file of persons is one task; what it meets must not be that task's alone, and texts are read before the join."""
    from hearthline.plans import rentals

    rows = rentals._rows(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in rows._jdf.queryExecution().analyzed().toString()
    assert {"places"} <= set(rows.schema["p"].dataType.names) and {"wanted"} <= set(rows.schema["t"].dataType.names)


def test_readings_judge_as_pairs_do(spark):
    """Rules judged once for each of their readings say what they say of every pair by itself, where tiers have notes, conditions of their own, limits by tables, or nothing that a rule reads."""
    person, terms, tier = (", ".join(f"{k}: {v}" for k, v in s.items()) for s in (tiers.PERSON, tiers.TERMS, tiers.TIER))
    of = lambda fields, d: {k: d.get(k) for k in fields}
    people = [(i, i % 2, of(tiers.PERSON, {**BASE, **p, "startup": i % 3 == 0, "long_worker": None if i % 5 else True})) for i, (p, *_) in enumerate(CASES * 3)]
    table = {"asset": 9000, "asset_bonus": {"b10": 11500, "b20": 14000}, "car": 900, "car_bonus": {"b10": 950, "b20": 1400}}
    more = [{**GENERAL, "notes": ["창업인", "장기 종사", "창업인"]}, {**YOUTH, "own_basis": True, "income_excluded": True}, {**WED, **table, "asset_excluded": True}, {**WED, **table, "lower_tiers": True, "lower_asset": 30000}, {"key": None}, {"key": "일반", "car_excluded": True, "asset_excluded": True}, {**GENERAL, "key": "주거급여수급자"}, {**GENERAL, "job_provinces": ["부산"], "income_amounts": [4000000, 1]}]
    local = {"province": "부산", "city": "수원시", "also": None, "others_check": True, "other_cities_check": False}
    of_terms = [{"kind": "공공임대", "reference": DAY(2026, 9, 22), "engaged_ok": True, "birth_bonus": "table"}, {"kind": "영구임대", "reference": DAY(2026, 2, 28), "relaxed": True, "local": local, "homeless_relaxed": True, "homeless_one": True}, {"reference": DAY(2026, 9, 22), "birth_bonus": "none", "regions": ["부산"], "median": True, "income_100": [3000000, 4000000, 5000000, 5000000, 5000000, 5000000, 5000000, 5000000], "income_more": 100000}]
    notices = [(n, n % 2, o, of(tiers.TERMS, t), of(tiers.TIER, g)) for n, t in enumerate(of_terms) for o, g in enumerate([YOUTH, GENERAL, ELDER, STUDENT, WED, *more])]
    p = spark.createDataFrame(people, f"person int, nation int, p struct<{person}>")
    n = spark.createDataFrame(notices, f"notice int, nation int, ord int, t struct<{terms}>, g struct<{tier}>")
    pairs = tiers.judge(p.join(n, "nation").drop("nation"))
    judged = tiers.Judged(tiers.prepared(p, "p"), tiers.prepared(n, "t"), "nation")
    rows = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()), key=str)
    keyed = pairs.withColumn("tier", F.col("g.key"))
    assert rows(judged.states(), "person", "notice", "ord", "tier", "state") == rows(keyed, "person", "notice", "ord", "tier", "state")
    assert rows(judged.best(), "person", "notice", "tier", "state") == rows(tiers.best_tier(pairs, ["person", "notice"], "ord"), "person", "notice", "tier", "state")
    assert rows(judged.counts(), "tier", "rule", "state", "n") == rows(tiers.count_states(keyed, ["tier"]), "tier", "rule", "state", "n")


def test_reasons_make_no_pairs(spark):
    """Persons are counted by the readings of rules; no plan of the counts names a notice beside a person."""
    from hearthline.plans import rentals

    plan = rentals.rental_tier_reasons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "person#" in line and "notice#" in line]
