"""Every registered query of the reference's operators against its SQL, run by another engine on the same tables."""

import math
import random

import duckdb
import pytest

from hearthline.operators import market
from hearthline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    assert len(got) == len(want) and len(got) > 0
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_stations_meet_no_nested_loop(spark):
    plan = catalog.queries()["nearest_station"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_nearest_points_at_all_distances(spark):
    """Dense and far points, the edges of cells, high latitudes and equal distances."""
    rnd = random.Random(4)
    points = [(i, 37 + rnd.random() / 5, 127 + rnd.random() / 5) for i in range(60)] + [(100, -10.0, 20.0), (101, 70.0, 25.0), (102, 70.0, 25.0), (103, 37.0, -170.0)]
    homes = [(i, 37 + rnd.random() / 2, 127 + rnd.random() / 2) for i in range(80)] + [(200, 70.0, 26.0), (201, 0.0, 0.0), (202, None, 1.0), (203, 36.9, 126.9), (204, 69.99, 24.0)]
    got = market.nearest_point(spark.createDataFrame(homes, "id int, lat double, lng double"), spark.createDataFrame(points, "point int, plat double, plng double"))

    def far(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return round(2 * 6_371_000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = {i: min((far(lat, lng, plat, plng), p) for p, plat, plng in points) for i, lat, lng in homes if lat is not None}
    assert {r.id: (r.metres, r.point) for r in got.collect()} == want
    assert market.nearest_point(spark.createDataFrame(homes[:3], "id int, lat double, lng double"), spark.createDataFrame([], "point int, plat double, plng double")).count() == 0
