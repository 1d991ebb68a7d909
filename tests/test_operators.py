"""Literal rows and seeded comparisons for operators whose edges the tables don't reach."""

import itertools
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.operators import market, rules, search, sets, state


def weighted(values, weights, q):
    rows = sorted(zip(values, weights, strict=True))
    total = sum(weights) - rows[-1][1]
    places, sofar = [], 0.0
    for _, w in rows:
        places.append(sofar / total if total else 0.0)
        sofar += w
    for i in range(len(rows) - 1):
        if places[i] <= q <= places[i + 1]:
            t = 0 if places[i] == places[i + 1] else (q - places[i]) / (places[i + 1] - places[i])
            return rows[i][0] + t * (rows[i + 1][0] - rows[i][0])
    return rows[-1][0]


def test_capped_quantiles_against_a_loop(spark):
    rnd, rows, want = random.Random(11), [], {}
    for g in range(60):
        own = [(g, rnd.randrange(4), float(rnd.randrange(100, 140))) for _ in range(rnd.randrange(1, 40))]
        n = {c: sum(1 for x in own if x[1] == c) for _, c, _ in own}
        values, weights = [x[2] for x in own], [min(n[x[1]], 5) / n[x[1]] for x in own]
        base = weighted(values, weights, 0.5)
        want[g] = (len(own), base, weighted(values, weights, 0.25) if len(own) >= 4 else base * 0.9)
        rows += own
    df = spark.createDataFrame(rows, "g int, complex int, amount double")
    got = {r.g: (r.n, r.base, r.low) for r in market.capped_summary(df, ["g"]).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g]), g


def test_equal_weights_are_plain_quantiles(spark):
    rows = [(n, i, float((i * 37) % 101)) for n in range(1, 40) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, complex int, amount double")
    for r in market.capped_summary(df, ["g"]).collect():
        assert r.base == pytest.approx(statistics.median(x[2] for x in rows if x[0] == r.g))


def test_nearest_tiers(spark):
    rows = [(1, True, 500, False, False, 10.0 + i) for i in range(5)] + [(1, False, 900, False, False, 99.0)] * 30
    rows += [(2, True, 2100, False, False, 1.0)] * 5 + [(2, False, 1200, False, False, float(i)) for i in range(6)]
    rows += [(3, True, 10, False, False, 7.0)] * 4 + [(4, True, 10, False, False, 7.0)] * 2 + [(5, True, 10, True, False, 7.0)] * 9 + [(6, True, None, False, True, 3.0)] * 6
    rows += [(7, True, None, False, False, 4.0)] * 5
    df = spark.createDataFrame(rows, "listing int, same_dong boolean, metres int, pending boolean, direct boolean, amount double")
    got = {r.listing: (r.stage, r.n, r.base) for r in market.nearest_tier(df).collect()}
    assert got == {1: ("dong", 5, 12.0), 2: ("r1500", 6, 2.5), 3: ("dong_few", 4, 7.0), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None), 7: ("dong", 5, 4.0)}


def test_grades_taxes_and_loans(spark):
    df = spark.createDataFrame([(12.438, 20.0, 22.0), (6.0, None, 9.0), (9.0, 9.5, 10.0), (7.5, 9.0, 9.0), (20.0, 19.0, 30.0)], "base double, low double, mkt double")
    out = df.withColumn("cost", rules.cost(F.col("base"), F.lit(0.0))).withColumn("g", rules.grade(F.col("cost"), F.col("low"), F.col("mkt"))).collect()
    assert [r.g for r in out] == ["lotto", "unknown", "flat", "consider", "pass"]
    assert out[0].cost == pytest.approx(12.438 * 1.033) and out[1].cost == pytest.approx(6.066) and out[3].cost == pytest.approx(7.5 * 1.022)
    loan = spark.range(1).select(rules.loan_capacity(F.lit(12.0), F.lit(26.0), F.lit(True), F.lit(True), F.lit(9.0), F.lit(0.0)).alias("l")).first().l
    assert (loan.loan, loan.limit_by) == (2.0, "cap")


def test_months_and_points(spark):
    df = spark.createDataFrame([("2024-01-31", "2024-02-29"), ("2024-01-15", "2024-03-15"), ("2024-01-15", "2024-03-14")], "a string, b string")
    assert [r.m for r in df.select(rules.months_between_days(F.to_date("a"), F.to_date("b")).alias("m")).collect()] == [0, 2, 1]
    p = spark.range(1).select(rules.points(F.lit(None).cast("int"), F.lit(7), F.lit(11)).alias("p")).first().p
    assert (p.homeless, p.dependants, p.account) == (None, 35, 2)


def test_adding_a_required_constraint_never_adds_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else i % 9) for i in range(200)], "id int, price double, rooms int")
    one = [search.Constraint("max", "price", 4.0)]
    two = [*one, search.Constraint("min", "rooms", 3)]
    kept = lambda cs: {r.id for r in search.evaluate(df, cs).where("result <> 'excluded'").collect()}
    assert kept(two) < kept(one)
    assert {r.result for r in search.evaluate(df.where("rooms is null and price <= 4"), two).collect()} == {"unsure"}


def test_redaction_against_another_engine(spark):
    texts = [None, "", "call 010-1234-5678 or 02-123-4567", "id 900101-1234567, mail a.b+c@d-e.org.", "101동 1203호, 110-234-567890", "on 2026-10-01 and 1999-1-2", "12-34-56-7 x@y.z x@y.z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", text.redact(F.col("t")).alias("r")).collect():
        out, kinds = texts[r.i] or "", []
        for kind, pattern in text.REDACTIONS:
            out, n = re.subn(pattern, f"[{kind} 가림]", out, flags=re.ASCII)
            kinds += [kind] if n and kind not in kinds else []
        assert (r.r.text, r.r.kinds) == (out, kinds)


def test_money_numbers_dates_and_particles(spark):
    money = spark.createDataFrame([("15억5천", 15.5), ("8000만", 0.8), ("7.5억", 7.5), ("122,202만", 12.2202), ("none", None)], "t string, w double")
    assert all(r.m == pytest.approx(r.w) if r.w is not None else r.m is None for r in money.select("w", text.money(F.col("t")).alias("m")).collect())
    nums = spark.createDataFrame([("1,280",), ("-",), ("(△7)",), ("",), (" 32.00 ",)], "t string")
    assert [r.n for r in nums.select(text.number(F.col("t")).alias("n")).collect()] == [1280.0, None, None, None, 32.0]
    days = spark.createDataFrame([("2026.10.02",), ("20261002",), ("2026-10-2",), ("soon",)], "t string")
    assert [str(r.d) for r in days.select(text.date_of(F.col("t")).alias("d")).collect()] == ["2026-10-02"] * 3 + ["None"]
    words = spark.createDataFrame([("집",), ("학교",), ("abc",)], "t string")
    assert [r.w for r in words.select(text.with_particle(F.col("t"), "이", "가").alias("w")).collect()] == ["집이", "학교가", "abc가"]


def test_chunks_keep_all_text(spark):
    rnd = random.Random(5)
    rows = [(i, "\n".join("x" * rnd.choice([1, 50, 300, 799, 800, 801, 2500]) for _ in range(rnd.randrange(0, 9)))) for i in range(40)] + [(99, None), (100, " \n ")]
    out = text.chunks(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()
    for i, t in rows:
        own = [r.t for r in sorted((r for r in out if r.id == i), key=lambda r: r.pos)]
        assert all(len(c) <= 800 for c in own) and "".join(own).replace("\n", "") == (t or "").replace("\n", "").strip()


def test_budgeted_pick_skips_and_goes_on(spark):
    rows = [("q", 0, "a" * 10, 5.0), ("q", 1, "b" * 95, 4.0), ("q", 2, "c" * 80, 3.0), ("q", 3, "d", 0.0), ("q", 4, "e" * 5, 1.0)]
    got = text.budgeted_pick(spark.createDataFrame(rows, "question string, pos int, t string, score double"), "question", 3, 100).collect()
    assert sorted(r.pos for r in got) == [0, 2, 4]


def test_state_and_sets(spark):
    new = state.new_keys(spark.range(5), spark.range(3), "id")
    assert sorted(r.id for r in new.collect()) == [3, 4]
    assert state.new_keys(spark.range(5), spark.range(3), "id", 1).count() == 0
    dates = spark.createDataFrame([([1, None, 3],), ([3, 1],), ([],)], "d array<int>")
    assert [r.o for r in dates.select(sets.in_order(F.col("d")).alias("o")).collect()] == [True, False, True]
    near = spark.range(1).select(market.metres(F.lit(37.5), F.lit(127.0), F.lit(37.51), F.lit(127.0)).alias("m")).first().m
    assert near == 1112
    same = spark.createDataFrame([("River Town (2)", "RiverTown2", None, None, True), ("A", "", None, None, False), ("River", "Rivers", "x dong", "y", False), (None, "a", None, None, False)], "a string, b string, u string, d string, w boolean")
    assert all(r.s == r.w for r in same.select("w", market.same_complex(F.col("a"), F.col("b"), F.col("u"), F.col("d")).alias("s")).collect())


def test_all_tiers_of_the_ladder(spark):
    units = [
        (1, "a", 84.0, False, "own", "84A"), (2, "a", 84.0, False, "none", "84A"), (3, "a", 92.0, False, "none", "92A"), (4, "a", 150.0, True, "own", "150A"),
        (5, "a", 150.0, True, "own", "150p "), (6, "b", 120.0, True, "none", "120A"), (7, "b", 120.0, True, None, "120P"), (8, "c", 84.0, False, None, None),
    ]
    rows = [("a", "own", 84.0, 8.4, False, False, False)] * 3 + [("a", "x", 84.0, 16.8, False, True, False)] * 5 + [("b", "y", 200.0, 20.0, False, True, True)] * 5
    rows += [("c", "z", 84.0, 1.0, True, True, False)] * 9
    listings = spark.createDataFrame(units, "id long, district string, area double, large boolean, complex string, unit string")
    trades = spark.createDataFrame(rows, "district string, complex string, area double, amount double, direct boolean, new_build boolean, large boolean")
    got = {r.id: (r.basis, r.n, r.base and round(r.base, 6)) for r in market.listing_ladder(listings, trades).collect()}
    assert got == {
        1: ("same_complex", 3, 8.4), 2: ("district_newbuild", 5, 16.8), 3: ("district_area_ppa", 5, 18.4), 4: ("same_complex_ppa", 3, 15.0),
        5: (None, None, None), 6: ("district_large_ppa", 5, 12.0), 7: (None, None, None), 8: (None, None, None),
    }


def test_nearest_area_of_other_groups(spark):
    rows = [(i, f"d{i % 3}", float(i * 7 % 40), f"g{i * 5 % 6}", i * 11 % 17) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, district string, area double, group string, at long")
    got = {}
    for r in market.nearest_area_per_group(df.withColumnRenamed("id", "listing"), df.withColumnRenamed("id", "other"), 6, 2).collect():
        got.setdefault(r.listing, []).append((r.group, r.other, r.difference))
    for i, d, a, g, _ in rows:
        best = {}
        for o, od, oa, og, at in rows:
            if od == d and og != g and abs(oa - a) <= 6:
                best[og] = min(best.get(og, (99.0, 0, 0)), (abs(oa - a), o, at))
        want = sorted(best.items(), key=lambda x: (-x[1][2], x[0]))[:2]
        assert sorted(got.get(i, [])) == sorted((k, o, x) for k, (x, o, _) in want), i


def test_events_without_a_region_reach_subscribers_of_everything(spark):
    subs = spark.createDataFrame([(1, []), (2, None), (3, ["x"]), (4, ["x", None])], "sub_id long, regions array<string>").selectExpr("*", "false good_only", "true reminders")
    events = spark.createDataFrame([(10, None), (11, "x"), (12, "y")], "event_id long, region string").selectExpr("*", "true good", "'new' kind", "'line' line")
    got = sorted((r.sub_id, r.event_id) for r in sets.subscriber_matches(subs, events).collect())
    assert got == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 12), (3, 11), (4, 11)]


def test_a_class_of_events_is_cut_into_parts(spark):
    """Subscribers of everything share four classes; where nothing is broadcast their work must not be that of four tasks."""
    subs = spark.range(300).selectExpr("id sub_id", "cast(array() as array<int>) regions", "id % 3 = 0 good_only", "id % 2 = 0 reminders")
    events = spark.range(40).selectExpr("id event_id", "1 region", "id % 4 = 0 good", "if(id % 3 = 0, 'new', 'end') kind", "'x' line")
    got = sets.subscriber_matches(subs, events)
    want = {(s, e) for s in range(300) for e in range(40) if (s % 3 or e % 4 == 0) and (s % 2 == 0 or e % 3 == 0)}
    rows = [(r.sub_id, r.event_id) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "own" in got._jdf.queryExecution().optimizedPlan().toString()


def test_matches_come_in_short_runs(spark):
    """The same short run of events for subscriber after subscriber: files keep that in a fraction of the room of a subscriber's whole class of events."""
    subs = spark.range(200).selectExpr("id sub_id", "cast(array() as array<int>) regions", "false good_only", "true reminders")
    events = spark.range(1000).selectExpr("id event_id", "1 region", "true good", "'new' kind", "'x' line")
    got = sets.subscriber_matches(subs, events)
    rows = [(r.sub_id, r.event_id) for r in got.collect()]
    assert len(set(rows)) == len(rows) == 200_000
    assert "inline(__events" in got._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(list(run)) for _, run in itertools.groupby(s for s, _ in rows)) <= 64


def test_digests_need_no_matches(spark):
    subs = spark.createDataFrame([(i, r, i % 3 == 0, i % 2 == 0) for i, r in enumerate([[], [1], [1, 1, 2], None, [9], [2, None], [3]] * 4)], "sub_id long, regions array<int>, good_only boolean, reminders boolean")
    events = spark.createDataFrame([(i, [1, 2, 3, None][i % 4], i % 3 == 0, ["new", "end", None][i % 5 % 3], f"e{i}") for i in range(60)], "event_id long, region int, good boolean, kind string, line string")
    got, want = sets.subscriber_digests(subs, events), sets.digests(sets.subscriber_matches(subs, events))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_band_quantiles_against_a_loop(spark):
    """Outliers, values of zero and less, repeats and few values; the values themselves aren't held for quantiles."""
    rnd = random.Random(5)
    value = lambda: rnd.choice([rnd.uniform(9, 20), rnd.randrange(5) / 4, -rnd.random(), 1e12 * rnd.random(), 12.5])
    trades = [(f"d{rnd.randrange(3)}", float(rnd.randrange(1, 40)), value()) for _ in range(900)] + [("e", 5.0, 1.0), ("f", 5.0, 1.0), ("f", 6.0, 4.0)]
    pairs = sorted({(d, a) for d, a, _ in trades} | {("g", 1.0), ("e", 8.0)})
    df = spark.createDataFrame(trades, "district string, area double, amount double")
    found = market.band_groups(spark.createDataFrame(pairs + pairs[:9], "district string, area double"), df)
    plan = found._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
    got = {(r.district, r.area): (r.n, r.base, r.low) for r in found.collect()}
    want = {}
    for d, a in pairs:
        near = [x for e, b, x in trades if e == d and abs(a - b) <= 3]
        if near:
            low = statistics.quantiles(near, n=4, method="inclusive")[0] if len(near) >= 4 else statistics.median(near) * 0.9
            want[d, a] = (len(near), statistics.median(near), low)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


def test_address_parts_are_computed_once(spark):
    """An expression that names another several times must not compute it as often; small files are spread over tasks."""
    from hearthline.operators import listing
    from hearthline.plans import catalog

    df = spark.createDataFrame([("경기도 화성시 동탄구 오산동 1",)], "address string").select(F.col("address"))
    for made, most in ((listing.coded_district(F.col("address")), 1), (listing.is_regulated(F.col("address")), 1), (listing.district(listing.main_address(F.col("address"))), 2)):
        plan = df.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("특례시") <= most, plan.count("특례시")
    for name in ("address_places", "listing_build"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan, name
