"""Registered queries of the reference's operators, and for each the SQL that says the same independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import text as text_functions
from hearthline.operators import market, rules, search, sets, state
from hearthline.plans import standin
from hearthline.plans.registry import Query, cases, facts, found_queries, found_sql, query
from hearthline.plans.standin import LISTINGS_SQL, TODAY, TRADES_SQL, table


def queries() -> dict[str, Query]:
    return dict(found_queries)


def oracle_sql() -> dict[str, str]:
    return dict(found_sql)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """For display and comparison; operators return unrounded values."""
    return df.withColumns({c: F.round(c, 8) for c in columns})


# --- valuation ---------------------------------------------------------------------------------------------------------------

_BAND = f"""{LISTINGS_SQL}, {TRADES_SQL}, pairs AS (SELECT DISTINCT district, area FROM listings),
band AS (SELECT p.district, p.area, t.* EXCLUDE (district, area), t.area AS trade_area FROM pairs p JOIN trades t ON t.district = p.district AND abs(t.area - p.area) <= 3)"""
_LOW = "CASE WHEN count(*) >= 4 THEN quantile_cont(amount, 0.25) ELSE median(amount) * 0.9 END"
_SUMMARY = f"SELECT district, area, count(*) AS n, median(amount) AS base, {_LOW} AS low FROM band WHERE NOT direct AND amount <> 0 GROUP BY ALL"


@query(f"WITH {_BAND}, s AS ({_SUMMARY}) SELECT district, area, n, round(base, 8) AS base, round(low, 8) AS low FROM s")
def band_market_summary(spark, sf_dir):
    return rounded(market.band_summary(standin.listings(spark, sf_dir), standin.trades(spark, sf_dir)), "base", "low")


@query(f"""WITH {_BAND}, s AS ({_SUMMARY}),
c AS (SELECT l.id, l.district, l.area, l.price, s.n, s.base, s.low,
  l.price + l.price * 1.1 * CASE WHEN l.price <= 6 THEN 0.01 WHEN l.price <= 9 THEN (l.price * 2 / 3 - 3) / 100 ELSE 0.03 END AS cost
  FROM listings l LEFT JOIN s USING (district, area))
SELECT id, district, area, n, round(base, 8) AS base, round(low, 8) AS low, round(cost, 8) AS cost,
  CASE WHEN low IS NULL THEN 'unknown' WHEN low - cost >= 5 OR (low - cost) / cost >= 0.3 THEN 'lotto' WHEN low - cost >= 1 THEN 'consider' WHEN low - cost >= 0 THEN 'flat' ELSE 'pass' END AS grade FROM c""")
def valuation_with_grade(spark, sf_dir):
    units = standin.listings(spark, sf_dir)
    found = units.join(market.band_summary(units, standin.trades(spark, sf_dir)), ["district", "area"], "left")
    found = found.withColumn("cost", rules.cost(F.col("price"), F.lit(0.0)))
    found = found.withColumn("grade", rules.grade(F.col("cost"), F.col("low"), F.col("base")))
    return rounded(found, "base", "low", "cost").select("id", "district", "area", "n", "base", "low", "cost", "grade")


@query(f"""WITH {_BAND}, s AS ({_SUMMARY}),
c AS (SELECT s.low, l.district, l.price + l.price * 1.1 * CASE WHEN l.price <= 6 THEN 0.01 WHEN l.price <= 9 THEN (l.price * 2 / 3 - 3) / 100 ELSE 0.03 END AS cost
  FROM listings l LEFT JOIN s USING (district, area)),
g AS (SELECT district, CASE WHEN low IS NULL THEN 'unknown' WHEN low - cost >= 5 OR (low - cost) / cost >= 0.3 THEN 'lotto' WHEN low - cost >= 1 THEN 'consider' WHEN low - cost >= 0 THEN 'flat' ELSE 'pass' END AS grade FROM c)
SELECT district, grade, count(*) AS n FROM g GROUP BY ALL""")
def grade_distribution(spark, sf_dir):
    return valuation_with_grade(spark, sf_dir).groupBy("district", "grade").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LISTINGS_SQL}, {TRADES_SQL}, r AS (SELECT district, amount, least(count(*) OVER (PARTITION BY district, complex), 5) / count(*) OVER (PARTITION BY district, complex) AS w FROM trades WHERE NOT direct),
o AS (SELECT district, amount, w, sum(w) OVER (PARTITION BY district ORDER BY amount, w ROWS UNBOUNDED PRECEDING) - w AS before, row_number() OVER (PARTITION BY district ORDER BY amount, w) AS i, count(*) OVER (PARTITION BY district) AS n FROM r),
d AS (SELECT district, any_value(n) AS n, sum(w) - max_by(w, i) AS den, max(amount) AS top FROM o GROUP BY district),
p AS (SELECT o.district, amount AS x, before / den AS pos, lead(amount) OVER (PARTITION BY o.district ORDER BY i) AS nx, lead(before / den) OVER (PARTITION BY o.district ORDER BY i) AS np, i FROM o JOIN d USING (district)),
q AS (SELECT district, q, min_by(x + (nx - x) * CASE WHEN np = pos THEN 0 ELSE (q - pos) / (np - pos) END, i) AS v FROM p, (VALUES (0.5), (0.25)) qs(q) WHERE pos <= q AND q <= np GROUP BY ALL)
SELECT d.district, d.n, round(a.v, 8) AS base, round(b.v, 8) AS low FROM d JOIN q a ON a.district = d.district AND a.q = 0.5 JOIN q b ON b.district = d.district AND b.q = 0.25""")
def capped_weight_quantile(spark, sf_dir):
    return rounded(market.capped_summary(standin.trades(spark, sf_dir).where("not direct"), ["district"]), "base", "low")


@query(f"WITH {LISTINGS_SQL}, {TRADES_SQL} SELECT district, complex, count(*) AS n FROM trades GROUP BY ALL HAVING count(*) > 5")
def capped_complexes(spark, sf_dir):
    return market.capped_complexes(standin.trades(spark, sf_dir), ["district"])


_PPA = """SELECT p.district, p.area, count(*) AS n, median(amount / t.area) * max(p.area) AS base,
  CASE WHEN count(*) >= 4 THEN quantile_cont(amount / t.area, 0.25) ELSE median(amount / t.area) * 0.9 END * max(p.area) AS low
  FROM pairs p JOIN trades t ON t.district = p.district AND abs(t.area - p.area) <= 10 WHERE NOT direct{} GROUP BY p.district, p.area HAVING count(*) >= 5"""


def seven_digits(df: DataFrame, *columns: str) -> DataFrame:
    """For comparison of quotients, which decimal places would round apart where two engines' last bits differ: what single precision keeps of them."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


_SEVEN = "CAST(CAST({} AS FLOAT) AS DOUBLE)"


@query(f"WITH {_BAND}, s AS ({_PPA.format('')}) SELECT district, area, n, {_SEVEN.format('base')} AS base, {_SEVEN.format('low')} AS low FROM s")
def price_per_area(spark, sf_dir):
    found = market.price_per_area(standin.listings(spark, sf_dir), standin.trades(spark, sf_dir))
    return seven_digits(found, "base", "low")


@query(f"""WITH {_BAND}, n AS (SELECT district, area, count(*) AS n, median(amount) AS base, {_LOW} AS low FROM band WHERE NOT direct AND new_build GROUP BY ALL HAVING count(*) >= 3),
w AS ({_PPA.format(' AND new_build')}),
g AS (SELECT district, count(*) AS n, median(amount / area) AS base, CASE WHEN count(*) >= 4 THEN quantile_cont(amount / area, 0.25) ELSE median(amount / area) * 0.9 END AS low
  FROM trades WHERE NOT direct AND new_build AND large GROUP BY ALL HAVING count(*) >= 5),
b AS (SELECT DISTINCT l.district, l.area, g.n, g.base * l.area AS base, g.low * l.area AS low FROM listings l JOIN g USING (district) WHERE l.large)
SELECT p.district, p.area, CASE WHEN n.n IS NOT NULL THEN 'district_newbuild' WHEN w.n IS NOT NULL THEN 'district_area_ppa' WHEN b.n IS NOT NULL THEN 'district_large_ppa' END AS basis,
  coalesce(n.n, w.n, b.n) AS n, {_SEVEN.format('coalesce(n.base, w.base, b.base)')} AS base, {_SEVEN.format('coalesce(n.low, w.low, b.low)')} AS low
FROM pairs p LEFT JOIN n USING (district, area) LEFT JOIN w USING (district, area) LEFT JOIN b USING (district, area)""")
def ladder_valuation(spark, sf_dir):
    return seven_digits(market.ladder(standin.listings(spark, sf_dir), standin.trades(spark, sf_dir)), "base", "low")


@query(f"""WITH {LISTINGS_SQL}, {TRADES_SQL}, u AS (SELECT p_partkey AS id, p_partkey % 400 + 1 AS complex, p_type LIKE '%COPPER' AS penthouse, p_brand AS district, CAST(p_size AS DOUBLE) AS area, p_size >= 45 AS large FROM part),
live AS (SELECT * FROM trades WHERE NOT direct AND amount <> 0), k AS (SELECT DISTINCT district, complex, area FROM u), pairs AS (SELECT DISTINCT district, area FROM u),
o AS (SELECT k.district, k.complex, k.area, count(*) AS n, median(amount) AS base, {_LOW} AS low FROM k JOIN live t ON t.district = k.district AND t.complex = k.complex AND abs(t.area - k.area) <= 3 GROUP BY ALL),
a AS (SELECT p.district, p.area, count(*) AS n, median(amount) AS base, {_LOW} AS low FROM pairs p JOIN live t ON t.district = p.district AND abs(t.area - p.area) <= 3 WHERE new_build GROUP BY ALL HAVING count(*) >= 3),
w AS ({_PPA.format(' AND new_build AND amount <> 0')}),
s AS (SELECT district, complex, count(*) AS n, median(amount / area) AS base, CASE WHEN count(*) >= 4 THEN quantile_cont(amount / area, 0.25) ELSE median(amount / area) * 0.9 END AS low FROM live GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT district, count(*) AS n, median(amount / area) AS base, CASE WHEN count(*) >= 4 THEN quantile_cont(amount / area, 0.25) ELSE median(amount / area) * 0.9 END AS low FROM live WHERE new_build AND large GROUP BY ALL HAVING count(*) >= 5),
c AS (SELECT u.id, CASE WHEN o.n IS NOT NULL THEN 'same_complex' WHEN a.n IS NOT NULL THEN 'district_newbuild' WHEN w.n IS NOT NULL THEN 'district_area_ppa' WHEN penthouse THEN NULL
  WHEN s.n IS NOT NULL THEN 'same_complex_ppa' WHEN u.large AND g.n IS NOT NULL THEN 'district_large_ppa' END AS basis,
  o.n AS n0, a.n AS n1, w.n AS n2, s.n AS n3, g.n AS n4, o.base AS b0, a.base AS b1, w.base AS b2, s.base * u.area AS b3, g.base * u.area AS b4, o.low AS l0, a.low AS l1, w.low AS l2, s.low * u.area AS l3, g.low * u.area AS l4
  FROM u LEFT JOIN o USING (district, complex, area) LEFT JOIN a USING (district, area) LEFT JOIN w USING (district, area) LEFT JOIN s USING (district, complex) LEFT JOIN g USING (district))
SELECT id, basis, CASE basis WHEN 'same_complex' THEN n0 WHEN 'district_newbuild' THEN n1 WHEN 'district_area_ppa' THEN n2 WHEN 'same_complex_ppa' THEN n3 WHEN 'district_large_ppa' THEN n4 END AS n,
  {_SEVEN.format("CASE basis WHEN 'same_complex' THEN b0 WHEN 'district_newbuild' THEN b1 WHEN 'district_area_ppa' THEN b2 WHEN 'same_complex_ppa' THEN b3 WHEN 'district_large_ppa' THEN b4 END")} AS base,
  {_SEVEN.format("CASE basis WHEN 'same_complex' THEN l0 WHEN 'district_newbuild' THEN l1 WHEN 'district_area_ppa' THEN l2 WHEN 'same_complex_ppa' THEN l3 WHEN 'district_large_ppa' THEN l4 END")} AS low FROM c""")
def ladder_all_tiers(spark, sf_dir):
    """Every listing over all trades, by all five tiers."""
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 400 + 1).alias("complex"), F.when(F.col("p_type").endswith("COPPER"), "84P").otherwise("84A").alias("unit"))
    found = market.listing_ladder(standin.listings(spark, sf_dir).join(units, "id"), standin.trades(spark, sf_dir))
    return seven_digits(found, "base", "low")


@query(f"""WITH {LISTINGS_SQL}, {TRADES_SQL}, r AS (SELECT district, l_orderkey, l_linenumber, date, round(amount, 8) AS amount,
  row_number() OVER (PARTITION BY district ORDER BY date DESC, l_orderkey, l_linenumber) AS rn FROM trades) SELECT * FROM r WHERE rn <= 8""")
def latest_n_comps(spark, sf_dir):
    rows = standin.trades(spark, sf_dir).select("district", "l_orderkey", "l_linenumber", "date", F.round("amount", 8).alias("amount"))
    return market.latest(rows, ["district"], [F.col("date").desc(), F.col("l_orderkey"), F.col("l_linenumber")]).withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH {LISTINGS_SQL}, {TRADES_SQL}, p AS (SELECT DISTINCT district, area FROM listings), t AS (SELECT * FROM trades WHERE NOT direct AND amount <> 0), w AS (SELECT district, count(*) AS trades, count(*) FILTER (new_build) AS new, max(area) FILTER (new_build) AS largest_new FROM t GROUP BY 1),
b AS (SELECT p.district, p.area, count(*) FILTER (abs(t.area - p.area) <= 3) AS band, count(*) FILTER (abs(t.area - p.area) <= 3 AND new_build) AS band_new, count(*) AS wide, count(*) FILTER (new_build) AS wide_new FROM p JOIN t ON t.district = p.district AND abs(t.area - p.area) <= 10 GROUP BY ALL)
SELECT p.district, p.area, coalesce(trades, 0) AS trades, coalesce(new, 0) AS new, coalesce(band, 0) AS band, coalesce(band_new, 0) AS band_new, coalesce(wide, 0) AS wide, coalesce(wide_new, 0) AS wide_new, largest_new,
  CASE WHEN coalesce(trades, 0) < 10 THEN 'few trades' WHEN coalesce(new, 0) < 5 THEN 'few new builds' WHEN coalesce(wide_new, 0) < 5 AND p.area > largest_new + 10 THEN 'no new build as large' WHEN coalesce(band, 0) >= 3 AND coalesce(band_new, 0) < 3 THEN 'only old builds of the area'
  ELSE 'under the least number' END AS reason FROM p LEFT JOIN w USING (district) LEFT JOIN b USING (district, area)""")
def market_shortage(spark, sf_dir):
    return market.shortage(standin.listings(spark, sf_dir), standin.trades(spark, sf_dir))


@query(f"""WITH {_BAND} SELECT district, area, count(*) FILTER (NOT direct) AS in_band, count(*) FILTER (NOT direct AND new_build) AS new_in_band,
  count(*) FILTER (direct) AS direct, max(date) AS latest FROM band GROUP BY ALL""")
def market_diagnosis(spark, sf_dir):
    return market.diagnosis(standin.listings(spark, sf_dir), standin.trades(spark, sf_dir))


@query("""WITH a AS (SELECT p_partkey AS listing, p_brand AS district, CAST(p_size AS DOUBLE) AS area, p_type AS grp FROM part),
b AS (SELECT p_partkey AS other, p_brand AS district, CAST(p_size AS DOUBLE) AS area, p_type AS grp, p_retailprice AS latest FROM part),
j AS (SELECT listing, b.grp, other, abs(b.area - a.area) AS difference, latest, row_number() OVER (PARTITION BY listing, b.grp ORDER BY abs(b.area - a.area), other) AS i
  FROM a JOIN b ON a.district = b.district AND a.grp <> b.grp AND abs(b.area - a.area) <= 15),
k AS (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY latest DESC, grp) AS rn FROM j WHERE i = 1) SELECT listing, grp AS "group", other, difference FROM k WHERE rn <= 3""")
def nearest_area_per_group(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("area", F.col("p_size").cast("double"))
    mine = part.select(F.col("p_partkey").alias("listing"), F.col("p_brand").alias("district"), "area", F.col("p_type").alias("group"))
    others = part.select(F.col("p_partkey").alias("other"), F.col("p_brand").alias("district"), "area", F.col("p_type").alias("group"), F.col("p_retailprice").alias("at"))
    return market.nearest_area_per_group(mine, others, 15, 3)


@query("""WITH a AS (SELECT p_partkey AS listing, p_brand AS district, CAST(p_size AS DOUBLE) AS area, p_type AS grp FROM part),
b AS (SELECT p_partkey AS other, p_brand AS district, CAST(p_size AS DOUBLE) AS area, p_type AS grp, p_retailprice AS latest FROM part),
j AS (SELECT listing, b.grp, other, abs(b.area - a.area) AS difference, latest, row_number() OVER (PARTITION BY listing, b.grp ORDER BY abs(b.area - a.area), other) AS i
  FROM a JOIN b ON a.district = b.district AND a.grp <> b.grp AND abs(b.area - a.area) <= 15),
k AS (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY latest DESC, grp) AS rn FROM j WHERE i = 1) SELECT listing, grp AS "group", other, difference FROM k WHERE rn <= 3""")
def nearest_area_of_all(spark, sf_dir):
    """Every part as a listing."""
    part = table(spark, sf_dir, "part").withColumn("area", F.col("p_size").cast("double"))
    mine = part.select(F.col("p_partkey").alias("listing"), F.col("p_brand").alias("district"), "area", F.col("p_type").alias("group"))
    others = part.select(F.col("p_partkey").alias("other"), F.col("p_brand").alias("district"), "area", F.col("p_type").alias("group"), F.col("p_retailprice").alias("at"))
    return market.nearest_area_per_group(mine, others, 15, 3)


@query("""WITH c AS (SELECT o_orderkey AS listing, l_linenumber, l_partkey % 3 = 0 AS same_dong, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_partkey * 13 % 2600 END AS metres,
  o_orderkey % 97 = 0 AND l_linenumber = 1 AS pending, l_returnflag = 'R' AS direct, l_extendedprice AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
s AS (SELECT listing, bool_or(pending) AS pending, count(*) FILTER (NOT direct AND same_dong AND coalesce(metres, 0) <= 2000) AS n0, count(*) FILTER (NOT direct AND metres <= 1000) AS n1,
  count(*) FILTER (NOT direct AND metres <= 1500) AS n2, count(*) FILTER (NOT direct AND metres <= 2000) AS n3, median(amount) FILTER (NOT direct AND same_dong AND coalesce(metres, 0) <= 2000) AS m0,
  median(amount) FILTER (NOT direct AND metres <= 1000) AS m1, median(amount) FILTER (NOT direct AND metres <= 1500) AS m2, median(amount) FILTER (NOT direct AND metres <= 2000) AS m3 FROM c GROUP BY listing),
t AS (SELECT *, CASE WHEN pending THEN NULL WHEN n0 >= 5 THEN 0 WHEN n1 >= 5 THEN 1 WHEN n2 >= 5 THEN 2 WHEN n3 >= 5 THEN 3 WHEN n0 >= 3 THEN 10 WHEN n1 >= 3 THEN 11 WHEN n2 >= 3 THEN 12 WHEN n3 >= 3 THEN 13 END AS k FROM s)
SELECT listing, CASE k % 10 WHEN 0 THEN 'dong' WHEN 1 THEN 'r1000' WHEN 2 THEN 'r1500' WHEN 3 THEN 'r2000' END || CASE WHEN k >= 10 THEN '_few' ELSE '' END AS stage,
  CASE k % 10 WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 END AS n, round(CASE k % 10 WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 END, 8) AS base FROM t""")
def nearest_tier(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    candidates = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("listing"), (F.col("l_partkey") % 3 == 0).alias("same_dong"), F.when(F.col("l_suppkey") % 11 != 0, F.col("l_partkey") * 13 % 2600).alias("metres"),
        ((F.col("o_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1)).alias("pending"), (F.col("l_returnflag") == "R").alias("direct"), F.col("l_extendedprice").alias("amount"),
    )
    return rounded(market.nearest_tier(candidates), "base")


@query("""WITH p AS (SELECT c_custkey AS id, 36 + c_custkey % 200 / 100.0 AS lat, 126 + c_custkey % 300 / 100.0 AS lng FROM customer),
s AS (SELECT n_nationkey AS station, 36 + n_nationkey * 8 % 200 / 100.0 AS slat, 126 + n_nationkey * 11 % 300 / 100.0 AS slng FROM nation),
d AS (SELECT id, station, CAST(round(2 * 6371000 * asin(sqrt(pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin((radians(slng) - radians(lng)) / 2), 2)))) AS BIGINT) AS metres FROM p, s)
SELECT id, min_by(station, metres * 1000 + station) AS station, min(metres) AS metres FROM d GROUP BY id""")
def nearest_station(spark, sf_dir):
    homes = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "36 + c_custkey % 200 / 100.0D lat", "126 + c_custkey % 300 / 100.0D lng")
    stations = table(spark, sf_dir, "nation").selectExpr("n_nationkey point", "36 + n_nationkey * 8 % 200 / 100.0D plat", "126 + n_nationkey * 11 % 300 / 100.0D plng")
    return market.nearest_point(homes, stations).withColumnRenamed("point", "station")


# --- rules -------------------------------------------------------------------------------------------------------------------

_RULE_FACTS = """SELECT c_custkey AS id, c_acctbal / 1000 + 5 AS price, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 900 + 6 END AS market, c_nationkey % 2 = 0 AS regulated, c_nationkey % 3 <> 0 AS capital,
  c_custkey % 13 / 10.0 AS income, c_custkey % 4 / 50.0 AS repaid FROM customer"""


def _rule_facts(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey id", "c_acctbal / 1000 + 5 price", "case when c_custkey % 5 = 0 then null else c_acctbal / 900 + 6 end market", "c_nationkey % 2 = 0 regulated", "c_nationkey % 3 <> 0 capital",
        "c_custkey % 13 / 10.0D income", "c_custkey % 4 / 50.0D repaid",
    )


@query(f"""WITH f AS ({_RULE_FACTS}), l AS (SELECT *, greatest(0, income * 0.4 - repaid) / 12 * ((1 - pow(1 + 0.07 / 12, -360)) / (0.07 / 12)) AS a,
  least(price, coalesce(market, price)) * CASE WHEN regulated THEN 0.4 ELSE 0.7 END AS b,
  CASE WHEN regulated THEN CASE WHEN coalesce(market, price) <= 15 THEN 6 WHEN coalesce(market, price) <= 25 THEN 4 ELSE 2 END WHEN capital THEN 6 ELSE 1e300 END AS c FROM f)
SELECT id, round(least(a, b, c), 8) AS loan, CASE WHEN least(a, b, c) = a THEN 'income' WHEN least(a, b, c) = c THEN 'cap' ELSE 'ratio' END AS limit_by,
  round(price + price * 1.1 * CASE WHEN price <= 6 THEN 0.01 WHEN price <= 9 THEN (price * 2 / 3 - 3) / 100 ELSE 0.03 END - least(a, b, c) - 2, 8) AS gap FROM l""")
def funding_gaps(spark, sf_dir):
    f = _rule_facts(spark, sf_dir)
    loan = rules.loan_capacity(*[F.col(c) for c in ("price", "market", "regulated", "capital", "income", "repaid")])
    f = f.withColumn("l", loan).select("id", "price", "l.loan", "l.limit_by")
    return rounded(f.select("id", "loan", "limit_by", (rules.cost(F.col("price"), F.lit(0.0)) - F.col("loan") - 2).alias("gap")), "loan", "gap")


@query("""WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 20 - 1 END AS y, c_custkey % 8 AS d, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 240 END AS m FROM customer)
SELECT id, CAST(CASE WHEN y < 0 THEN 0 WHEN y < 1 THEN 2 WHEN y IS NOT NULL THEN least(32, 2 + 2 * y) END AS INT) AS homeless, CAST(least(35, 5 + 5 * d) AS INT) AS dependants,
  CAST(CASE WHEN m < 6 THEN 1 WHEN m < 12 THEN 2 WHEN m IS NOT NULL THEN least(17, m // 12 + 2) END AS INT) AS account FROM f""")
def points_score(spark, sf_dir):
    f = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "case when c_custkey % 9 = 0 then null else c_custkey % 20 - 1 end y", "c_custkey % 8 d", "case when c_custkey % 7 = 0 then null else c_custkey % 240 end m")
    return f.select("id", rules.points(F.col("y"), F.col("d"), F.col("m")).alias("p")).select("id", "p.*")


@query("""WITH f AS (SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'Gyeonggi' ELSE 'Busan' END AS region, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS in_capital,
  c_custkey % 6 = 0 AS owns, c_custkey % 4 = 0 AS need_head, c_custkey % 3 = 0 AS head, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS account, c_custkey % 2 = 0 AS need_account FROM customer),
s AS (SELECT id, CASE WHEN region = 'Seoul' THEN CASE WHEN coalesce(in_capital, false) THEN 'ok' ELSE 'fail' END WHEN region = 'Gyeonggi' AND coalesce(in_capital, false) THEN 'ok' ELSE 'warn' END AS a,
  CASE WHEN owns THEN 'fail' ELSE 'ok' END AS b, CASE WHEN NOT need_head THEN 'na' WHEN head THEN 'ok' ELSE 'fail' END AS c, CASE WHEN NOT need_account THEN 'na' WHEN account = 'yes' THEN 'ok' WHEN account = 'no' THEN 'fail' ELSE 'warn' END AS d FROM f)
SELECT id, CASE WHEN 'fail' IN (a, b, c, d) THEN 'no' WHEN 'warn' IN (a, b, c, d) THEN 'unsure' ELSE 'ok' END AS outcome,
  CASE WHEN a = 'fail' THEN 'residence' WHEN b = 'fail' THEN 'homeless' WHEN c = 'fail' THEN 'head' WHEN d = 'fail' THEN 'account' END AS reason FROM s""")
def eligibility_outcomes(spark, sf_dir):
    f = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey id", "case c_nationkey % 3 when 0 then 'Seoul' when 1 then 'Gyeonggi' else 'Busan' end region", "case when c_custkey % 10 = 0 then null else c_custkey % 2 = 0 end in_capital",
        "c_custkey % 6 = 0 owns", "c_custkey % 4 = 0 need_head", "c_custkey % 3 = 0 head", "case c_custkey % 3 when 0 then 'yes' when 1 then 'no' end account", "c_custkey % 2 = 0 need_account",
    )
    no, day, none = F.lit(False), F.lit(None).cast("date"), F.lit(None).cast("string")
    c = F.col
    items = rules.eligibility(c("region"), c("in_capital"), c("owns"), no, no, no, no, no, c("need_head"), c("head"), day, day, c("need_account"), c("account"), no, none)
    return f.withColumn("items", items).select("id", rules.outcome(F.col("items")).alias("outcome"), rules.first_failing(F.col("items")).alias("reason"))


@query(f"""SELECT o_orderkey AS id, CASE WHEN DATE '{TODAY}' < CAST(o_orderdate AS DATE) THEN 'upcoming' WHEN DATE '{TODAY}' > CAST(o_orderdate AS DATE) + 30 THEN 'closed' ELSE 'open' END AS status FROM orders""")
def listing_status(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), rules.status(day, F.date_add(day, 30), F.lit(TODAY).cast("date")).alias("status"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS INT) % 3 END AS a, l_suppkey % 3 AS b, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_partkey % 3 END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(a, b) = b AND coalesce(c, b) = b THEN b WHEN a IS NULL OR c IS NULL THEN NULL WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS value,
  CASE WHEN coalesce(a, b) = b AND coalesce(c, b) = b THEN false WHEN a IS NULL OR c IS NULL THEN true ELSE NOT (a = b OR a = c OR b = c) END AS conflict FROM v""")
def three_reading_vote(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_linenumber = 3 then null else cast(cast(l_quantity as int) % 3 as bigint) end a", "l_suppkey % 3 b", "case when l_linenumber > 4 then null else l_partkey % 3 end c")
    return v.select("l_orderkey", "l_linenumber", rules.vote(F.col("a"), F.col("b"), F.col("c")).alias("v")).select("l_orderkey", "l_linenumber", "v.*")


# --- search ------------------------------------------------------------------------------------------------------------------

CONSTRAINTS = [
    search.Constraint("in", "district", ("Brand#11", "Brand#12", "Brand#21", "Brand#22", "Brand#33")),
    search.Constraint("max", "price", 14.0),
    search.Constraint("between", "area", (10.0, 30.0)),
    search.Constraint("min", "households", 20),
    search.Constraint("in", "kind_group", ("PROMO", "ECONOMY"), required=False, weight=2.0),
    search.Constraint("min", "area", 20.0, required=False),
]
_FACTS = """facts AS (SELECT p_partkey AS id, p_brand AS district, CAST(p_size AS DOUBLE) AS area, p_retailprice / 100 AS price, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 60 END AS households,
  split_part(p_type, ' ', 1) AS kind_group, p_partkey // 4 AS notice FROM part),
st AS (SELECT *, district IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22', 'Brand#33') AS a, price <= 14.0 + 1e-9 AS b, area BETWEEN 10 AND 30 AS c, households >= 20 AS d FROM facts),
r AS (SELECT *, CASE WHEN NOT a THEN 'in:district' WHEN NOT b THEN 'max:price' WHEN NOT c THEN 'between:area' WHEN NOT d THEN 'min:households' END AS reason,
  (NOT a)::INT + (NOT b)::INT + (NOT c)::INT + coalesce((NOT d)::INT, 0) AS misses,
  CASE WHEN kind_group IN ('PROMO', 'ECONOMY') THEN 2.0 ELSE -2.0 END + CASE WHEN area >= 20 THEN 3.0 ELSE -3.0 END AS score FROM st),
f AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN d IS NULL THEN 'unsure' ELSE 'ok' END AS result FROM r)"""


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey id", "p_brand district", "cast(p_size as double) area", "p_retailprice / 100 price", "case when p_partkey % 9 = 0 then null else p_partkey % 60 end households",
        "split_part(p_type, ' ', 1) kind_group", "p_partkey div 4 notice",
    )


def _found(spark, sf_dir):
    return search.evaluate(_facts(spark, sf_dir), CONSTRAINTS)


@query(f"WITH {_FACTS} SELECT id, result, reason, CAST(misses AS INT) AS misses, CAST(score AS DOUBLE) AS score FROM f")
def constraint_search(spark, sf_dir):
    return _found(spark, sf_dir).select("id", "result", "reason", "misses", "score")


@query(f"WITH {_FACTS} SELECT reason, count(*) AS n FROM f WHERE result = 'excluded' GROUP BY reason")
def exclusion_reasons(spark, sf_dir):
    return search.exclusion_reasons(_found(spark, sf_dir))


@query(f"""WITH {_FACTS}, o AS (SELECT count(DISTINCT notice) FILTER (b AND c AND coalesce(d, true)) AS n0, count(DISTINCT notice) FILTER (a AND price <= 15.4 + 1e-9 AND c AND coalesce(d, true)) AS n1,
  count(DISTINCT notice) FILTER (a AND b AND area BETWEEN -5 AND 45 AND coalesce(d, true)) AS n2, count(DISTINCT notice) FILTER (a AND b AND c AND coalesce(households >= 14, true)) AS n3 FROM f)
SELECT * FROM (SELECT 'in:district' AS relaxed, n0 AS n FROM o UNION ALL SELECT 'max:price', n1 FROM o UNION ALL SELECT 'between:area', n2 FROM o UNION ALL SELECT 'min:households', n3 FROM o) WHERE n > 0""")
def relaxation_counts(spark, sf_dir):
    return search.relaxation_counts(_facts(spark, sf_dir), CONSTRAINTS, "notice")


@query(f"""WITH {_FACTS}, m AS (SELECT *, row_number() OVER (PARTITION BY notice ORDER BY misses, price, id) AS i FROM f WHERE result = 'excluded')
SELECT id, notice, CAST(misses AS INT) AS misses, reason FROM m WHERE i = 1 ORDER BY misses, price, id LIMIT 3""")
def closest_misses(spark, sf_dir):
    return search.closest_misses(_found(spark, sf_dir), "notice", [F.col("price"), F.col("id")]).select("id", "notice", "misses", "reason")


@query(f"""WITH {_FACTS}, k AS (SELECT * FROM f WHERE result <> 'excluded')
SELECT 'cheapest' AS view, (SELECT id FROM k ORDER BY price, id LIMIT 1) AS key UNION ALL SELECT 'largest', (SELECT id FROM k ORDER BY area DESC, id DESC LIMIT 1) UNION ALL SELECT 'best', (SELECT id FROM k ORDER BY score DESC, id DESC LIMIT 1)""")
def search_perspectives(spark, sf_dir):
    kept = _found(spark, sf_dir).where("result <> 'excluded'")
    return search.perspectives(kept, {"cheapest": ("min", F.struct("price", "id")), "largest": ("max", F.struct("area", "id")), "best": ("max", F.struct("score", "id"))}, "id")


# --- state -------------------------------------------------------------------------------------------------------------------

@query("""WITH e AS (SELECT *, event_type IN ('error', 'click') AS bad, lag(event_type IN ('error', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
i AS (SELECT *, sum((bad AND NOT coalesce(before, false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS snapshots FROM i WHERE bad GROUP BY user_id, island""")
def islands_episodes(spark, sf_dir):
    return state.episodes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "click"))


@query("""WITH d AS (SELECT CAST(max(ts) AS DATE) AS today FROM events) SELECT CAST(ts AS DATE) AS day, event_type AS key, count(*) AS n FROM events, d WHERE CAST(ts AS DATE) > today - 20 GROUP BY ALL""")
def daily_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("key", F.col("event_type"))
    return state.daily_counters(events, events.agg(F.to_date(F.max("ts"))).scalar(), 20)


@query("""SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def rate_limit_first_n(spark, sf_dir):
    return state.first_per_day(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 2).select("event_id", "user_id", "day", "allowed")


@query("""WITH e AS (SELECT *, event_id % 3 = 0 AS failed FROM events), l AS (SELECT *, max_by(value, i) OVER w AS v, max_by(ts, i) OVER w AS since FROM (SELECT *, CASE WHEN NOT failed AND value IS NOT NULL THEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS i FROM e)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN failed THEN v ELSE value END AS filled, CASE WHEN failed THEN since END AS carried_from FROM l""")
def carry_forward(spark, sf_dir):
    return state.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("event_id") % 3 == 0).select("event_id", "filled", "carried_from")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')")
def new_since_snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return state.new_keys(orders.where("o_orderdate >= timestamp'1997-01-01'"), orders.where("o_orderdate < timestamp'1997-01-01'"), "o_custkey")


@query(f"""SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END, DATE '{TODAY}') >= DATE '{TODAY}' - 365""")
def retention_window(spark, sf_dir):
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.date_add(day, 30)).alias("closes"), F.when(F.col("o_orderkey") % 9 != 0, day).alias("noticed"))
    return state.retained(rows, "closes", "noticed", F.date_sub(F.lit(TODAY).cast("date"), 365)).select("o_orderkey")


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderkey % 2 = 0 AS locked FROM orders WHERE o_orderstatus <> 'F'), f AS (SELECT o_orderkey AS id, o_totalprice + 1 AS v, false AS locked FROM orders WHERE o_orderpriority NOT LIKE '5%')
SELECT coalesce(a.id, f.id) AS id, CASE WHEN a.locked OR f.id IS NULL THEN a.v ELSE f.v END AS v, CASE WHEN a.locked OR f.id IS NULL THEN a.locked ELSE f.locked END AS locked FROM a FULL JOIN f ON a.id = f.id""")
def archive_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    archive = orders.where("o_orderstatus <> 'F'").selectExpr("o_orderkey id", "o_totalprice v", "o_orderkey % 2 = 0 locked")
    return state.merge_archive(archive, orders.where("o_orderpriority not like '5%'").selectExpr("o_orderkey id", "o_totalprice + 1 v", "false locked"), "id")


# --- sets and verification -----------------------------------------------------------------------------------------------------

@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def coverage_missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.missing(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS t, o_orderpriority LIKE '1%' AS c FROM orders) SELECT o_orderkey FROM o WHERE c OR t NOT IN (SELECT t FROM o WHERE c)""")
def superseded(spark, sf_dir):
    return sets.drop_superseded(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderpriority").startswith("1")).select("o_orderkey")


@query("""WITH u AS (SELECT c_custkey AS id, c_name AS name, 0 AS source FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT c_custkey, c_mktsegment, 2 FROM customer)
SELECT id, min_by(name, source) AS name, min(source) AS source FROM u GROUP BY id""")
def source_precedence_union(spark, sf_dir):
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    sources = [customer.where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey id", "c_name name"), supplier.selectExpr("s_suppkey id", "s_name name"), customer.selectExpr("c_custkey id", "c_mktsegment name")]
    return sets.by_precedence(sources, "id").select("id", "name", "source")


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '2%' AND o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
  AND o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '2%' AND o_orderdate >= TIMESTAMP '1997-01-01')""")
def restore_category(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    today = orders.where("o_orderdate >= timestamp'1997-01-01' and o_orderpriority not like '2%'")
    return sets.restore_missing(today, orders.where("o_orderdate < timestamp'1997-01-01'"), "o_orderpriority").select("o_orderkey")


@query("""WITH s AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS parts_sum FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 100 END AS total, parts_sum,
  abs(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 100 END - parts_sum) <= 50 AS agrees FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def sum_reconcile(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.lit(100)).alias("t"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("q"))
    return sets.reconcile(totals, parts, "o_orderkey", "t", "q", 50)


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return sets.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT o_orderkey, 'high total' AS "check" FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'open but old' FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01'
  UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority LIKE '1%'""")
def invariant_violations(spark, sf_dir):
    checks = {
        "high total": F.col("o_totalprice") > 200_000, "open but old": (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")),
        "urgent": F.col("o_orderpriority").startswith("1"),
    }
    return sets.violations(table(spark, sf_dir, "orders"), "o_orderkey", checks)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS lo, l_partkey % 50 + 1 + l_suppkey % 9 AS hi FROM lineitem), p AS (SELECT *, lag(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi) AS previous_high FROM b)
SELECT l_orderkey, lo, previous_high FROM p WHERE previous_high <> lo""")
def band_gaps(spark, sf_dir):
    bands = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey % 50 lo", "l_partkey % 50 + 1 + l_suppkey % 9 hi")
    return sets.band_gaps(bands, ["l_orderkey"], "lo", "hi")


@query("""WITH l AS (SELECT l.*, d.lang, length(coalesce(text, '')) > 1500 AS found FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT lang, count(*) FILTER (quality = 1 AND found) AS tp,
  count(*) FILTER (quality <> 1 AND found) AS fp, count(*) FILTER (quality = 1 AND NOT found) AS fn FROM l GROUP BY lang) SELECT *, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM s""")
def slot_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rounded(sets.confusion(rows, "lang", F.col("quality") == 1, F.length(F.coalesce("text", F.lit(""))) > 1500), "f1")


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, greatest(1, round(100 * n / (SELECT sum(n) FROM n))) AS quota FROM n),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '-7'), doc_id) AS rn FROM documents) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE rn <= quota""")
def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sets.stratified(docs, "lang", "doc_id", 100, "-7")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'F' THEN 0 WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def headline_priority(spark, sf_dir):
    first = F.col("o_orderpriority").startswith("1")
    order = [F.when(first & (F.col("o_orderstatus") == "F"), 0).when(first, 1).otherwise(2), F.col("o_orderkey")]
    return sets.headline(table(spark, sf_dir, "orders"), "o_custkey", order).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT l_returnflag, arg_min(l_orderkey, {'a': l_extendedprice, 'b': l_orderkey, 'c': l_linenumber}) AS cheapest, arg_max(l_orderkey, {'a': l_extendedprice, 'b': l_orderkey, 'c': l_linenumber}) AS dearest, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1""")
def argmin_argmax(spark, sf_dir):
    order = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.min_by("l_orderkey", order).alias("cheapest"), F.max_by("l_orderkey", order).alias("dearest"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )


@query("""SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS amount FROM part WHERE p_size IS NOT NULL UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part WHERE p_retailprice IS NOT NULL""")
def stack_unpivot(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return sets.unpivot(part, ["p_partkey"], ["p_size", "p_retailprice"], "measure", "amount").where("amount is not null")


_SUBS = """subs AS (SELECT c_custkey AS sub_id, CASE WHEN c_custkey % 4 = 0 THEN [] ELSE [c_nationkey, (c_nationkey + 7) % 25] END AS regions, c_custkey % 3 = 0 AS good_only, c_custkey % 2 = 0 AS reminders FROM customer),
ev AS (SELECT s_suppkey AS event_id, s_nationkey AS region, s_acctbal > 5000 AS good, CASE s_suppkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'start' ELSE 'end' END AS kind, s_name AS line FROM supplier),
m AS (SELECT sub_id, event_id, kind, line FROM subs JOIN ev ON (len(regions) = 0 OR list_contains(regions, region)) AND (NOT good_only OR good) AND (reminders OR kind = 'new'))"""


def _subscribers_and_events(spark, sf_dir):
    subs = table(spark, sf_dir, "customer").selectExpr("c_custkey sub_id", "case when c_custkey % 4 = 0 then array() else array(c_nationkey, (c_nationkey + 7) % 25) end regions", "c_custkey % 3 = 0 good_only", "c_custkey % 2 = 0 reminders")
    events = table(spark, sf_dir, "supplier").selectExpr("s_suppkey event_id", "s_nationkey region", "s_acctbal > 5000 good", "case s_suppkey % 3 when 0 then 'new' when 1 then 'start' else 'end' end kind", "s_name line")
    return subs, events


@query(f"WITH {_SUBS} SELECT * FROM m")
def subscriber_matches(spark, sf_dir):
    return sets.subscriber_matches(*_subscribers_and_events(spark, sf_dir))


@query(f"""WITH {_SUBS}, o AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY event_id) AS rn FROM m)
SELECT sub_id, count(*) AS n, string_agg(line, '|' ORDER BY rn) FILTER (rn <= 4) AS lines, CAST(greatest(0, count(*) - 4) AS BIGINT) AS more FROM o GROUP BY sub_id""")
def subscriber_digests(spark, sf_dir):
    return sets.subscriber_digests(*_subscribers_and_events(spark, sf_dir))


# --- text --------------------------------------------------------------------------------------------------------------------

TERMS = {"the": 1.0, "license": 3.0, "mail": 2.0}


def _score_sql(text: str, head: str) -> str:
    one = lambda t, w: f"(length({text}) - length(replace({text}, '{t}', ''))) / {len(t)}.0"
    return " + ".join(f"CASE WHEN contains({text}, '{t}') THEN {w} * least({one(t, w)}, 4) + CASE WHEN contains({head}, '{t}') THEN {3 * w} ELSE 0 END ELSE 0 END" for t, w in TERMS.items())


@query(f"""WITH s AS (SELECT doc_id, lang, {_score_sql("coalesce(text, '')", "source")} AS score FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rn FROM s)
SELECT doc_id, lang, CAST(score AS DOUBLE) AS score FROM r WHERE rn <= 10 AND score > 0""")
def keyword_score_topk(spark, sf_dir):
    score = text_functions.keyword_score(F.coalesce("text", F.lit("")), F.col("source"), TERMS)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", score.cast("double").alias("score"))
    return market.latest(rows, ["lang"], [F.col("score").desc(), F.col("doc_id")], 10).where("score > 0").drop("rn")


@query()
def redact_pii(spark, sf_dir):
    """The account rule looks ahead, which the oracle's patterns can't; tests hold it against another regular-expression engine."""
    r = table(spark, sf_dir, "documents").select("doc_id", text_functions.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.sha2(F.col("r")["text"].cast("binary"), 256).alias("text_sha256"), F.array_join(F.col("r")["kinds"], ",").alias("kinds"))


@query("""SELECT page_id, i AS pos, l[i] AS link FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l
  FROM (SELECT page_id, regexp_extract_all(html, 'href\\s*=\\s*["'']([^"''#]+)["'']', 1) AS l FROM pages)))""")
def link_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text_functions.links(F.col("html"))).alias("pos", "link"))
    return pages.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "link")


@query()
def chunk_documents(spark, sf_dir):
    return text_functions.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS id FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.content_id(F.coalesce("text", F.lit(""))).alias("id"))


QUESTIONS = [
    ("지금 사도 돼?", "out_of_scope"), ("필요한 서류가 뭐야?", "docs"), ("접수 일정 알려줘", "schedule"), ("언제 신청 가능해?", "judge"), ("가점은 어떻게 계산해?", "rule"), ("왜 내가 가능?", "judge"), ("나 신청돼?", "judge"), (None, "judge"),
]
_KEY = "conv_id * 7 + turn"


@query(f"SELECT conv_id, turn, {cases(f'({_KEY})', [q[1] for q in QUESTIONS])} AS intent FROM conversations")
def question_kinds(spark, sf_dir):
    asked = facts(spark, sf_dir, f"SELECT conv_id, turn, {cases(f'({_KEY})', [q[0] for q in QUESTIONS])} AS text FROM conversations", "conversations")
    return asked.select("conv_id", "turn", text_functions.intent(F.coalesce("text", F.lit("")), list(text_functions.INTENTS), "judge").alias("intent"))


INTENTS = [("contact", r"@|mail", None), ("licence", r"[Ll]icense", "GNU"), ("question", r"\?", None)]


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '@|mail') THEN 'contact' WHEN regexp_matches(text, '[Ll]icense') AND NOT regexp_matches(text, 'GNU') THEN 'licence' WHEN regexp_matches(text, '\\?') THEN 'question' ELSE 'other' END AS intent FROM conversations""")
def intent_classes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text_functions.intent(F.col("text"), INTENTS, "other").alias("intent"))


# modules that register more
from hearthline.plans import asked, extracts, notices, rentals, snapshots  # noqa: E402, F401
