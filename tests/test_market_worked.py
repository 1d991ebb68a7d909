"""Worked numbers of valuation: what a few trades must give."""

import pytest

from hearthline.operators import market

TRADES = "district string, complex string, area double, amount double, direct boolean, new_build boolean, large boolean"


def units(spark, *rows):
    return spark.createDataFrame(rows or [(1, "d", 84.98, False, "own", "84C")], "id long, district string, area double, large boolean, complex string, unit string")


def test_four_deals_and_their_quarter(spark):
    deals = [("d", "own", 84.9, a, False, True, False) for a in (22.0, 21.5, 20.5, 22.5)]
    row = market.listing_ladder(units(spark), spark.createDataFrame(deals, TRADES)).first()
    assert (row.basis, row.n, row.base, row.low) == ("same_complex", 4, pytest.approx(21.75), pytest.approx(21.25))


def test_direct_deals_are_left_out_and_counted(spark):
    deals = [("d", "x", 84.0, a, False, True, False) for a in (10.0, 10.1, 9.9)] + [("d", "x", 84.0, 5.0, True, True, False), ("d", "x", 30.0, 3.0, True, True, False)]
    df = spark.createDataFrame(deals, TRADES).selectExpr("*", "date'2026-09-01' date")
    row = market.band_summary(units(spark), df).first()
    assert (row.n, row.base, row.low) == (3, pytest.approx(10.0), pytest.approx(9.0))
    why = market.diagnosis(units(spark), df).first()
    assert (why.in_band, why.direct) == (3, 1)


def test_deposits_of_the_own_complex_then_of_new_builds(spark):
    rents = [("d", "own", 84.0, x, 0.0, False) for x in (8.0, 7.8, 8.5)] + [("d", "own", 84.0, 1.0, 0.5, False)] + [("e", "y", 84.0, x, None, True) for x in (5.0, 6.0, 7.0)] + [("f", "z", 84.0, 9.0, 0.0, True)] * 2
    df = spark.createDataFrame(rents, "district string, complex string, area double, deposit double, monthly double, new_build boolean")
    rows = units(spark, (1, "d", 84.98, False, "own", "84C"), (2, "e", 84.98, False, "none", "84C"), (3, "f", 84.98, False, None, "84C"), (4, "d", 120.0, False, "own", "120A"))
    got = {r.id: (r.basis, r.n, r.jeonse, r.weak) for r in market.jeonse(rows, df).collect()}
    assert got == {1: ("same_complex", 3, pytest.approx(7.2), True), 2: ("district_newbuild", 3, pytest.approx(5.4), True), 3: (None, None, None, True), 4: (None, None, None, True)}


def test_why_there_is_no_estimate(spark):
    deal = lambda district, area, new, n: [(district, "x", area, 5.0, False, new, False)] * n
    deals = deal("few", 84.0, True, 9) + deal("old", 84.0, False, 12) + deal("small", 40.0, True, 12) + deal("aged", 84.0, False, 4) + deal("aged", 60.0, True, 6) + deal("aged", 93.0, True, 5)
    rows = units(spark, *[(i, d, 84.0, False, None, None) for i, d in enumerate(("few", "old", "small", "aged", "none"))])
    got = {r.district: r.reason for r in market.shortage(rows, spark.createDataFrame(deals, TRADES)).collect()}
    assert got == {"few": "few trades", "old": "few new builds", "small": "no new build as large", "aged": "only old builds of the area", "none": "few trades"}
