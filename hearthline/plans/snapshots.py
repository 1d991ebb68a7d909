"""Registered queries of search in the domain's words, of results and events between snapshots, of verification and of text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.operators import audit, conditions, history, market
from hearthline.plans.registry import cases, facts, query
from hearthline.plans.standin import LISTINGS_SQL, TODAY, TRADES_SQL, listings, table

# --- search -----------------------------------------------------------------------------------------------------------------------

_FACTS = f"""SELECT p_partkey AS id, CAST(floor(p_partkey / 4) AS BIGINT) AS notice, p_name AS name, {cases('p_partkey', ['서울 강남구 역삼동', '경기도 하남시 감일동', '부산 서구', None])} AS address, {cases('p_partkey', ['서울', '경기', '부산', None])} AS sido,
  {cases('p_partkey', ['강남구', '하남시', '서구', None])} AS district, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_retailprice / 100 END AS price, p_size * CAST(2 AS DOUBLE) AS area, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 60 END AS households,
  {cases('p_partkey', ['no', 'no', 'maybe', 'unknown', 'no'])} AS single, CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 25 END AS INT) AS station_walk, {cases('p_partkey', ['lotto', 'consider', 'flat', 'pass', 'unknown'])} AS grade,
  {cases('p_partkey', ['ok', 'unsure', 'no', None, 'r2'])} AS eligible, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 37 + p_partkey % 100 / CAST(100 AS DOUBLE) END AS lat, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 126.5 + p_partkey % 70 / CAST(100 AS DOUBLE) END AS lng,
  p_partkey % 5 = 0 AS past FROM part"""
_REGIONS = [{"label": "서울", "sido": "서울"}, {"label": "하남", "sido": "경기", "district": "하남시"}]
REQUIRED = [("region_in", _REGIONS), ("price_max", 14.0), ("area", (20.0, 80.0)), ("households_min", 10), ("not_single", None)]
PREFERRED = [("station_walk", 10), ("margin", None)]
_M = "CAST(round(2 * 6371000 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))) AS BIGINT)"
_FOUND = f"""f AS ({_FACTS}), s AS (SELECT *, coalesce(sido = '서울' OR (sido = '경기' AND district = '하남시'), false) AS a, price <= 14 + 1e-9 AS b, area BETWEEN 20 AND 80 AS c, households >= 10 AS d, CASE single WHEN 'no' THEN true WHEN 'maybe' THEN false END AS e,
  CASE WHEN station_walk <= 10 THEN 3.0 WHEN station_walk > 10 THEN -3.0 ELSE 0 END + CASE WHEN grade IN ('lotto', 'consider') THEN 2.0 WHEN grade = 'unknown' THEN 0 ELSE -2.0 END
  + CASE grade WHEN 'lotto' THEN 1.5 WHEN 'consider' THEN 1.0 WHEN 'pass' THEN -0.5 ELSE 0 END AS score FROM f),
r AS (SELECT *, CASE WHEN NOT a THEN '서울·하남이(가) 아닌 곳' WHEN NOT b THEN '예산 초과(14억)' WHEN NOT c THEN '면적 조건 밖' WHEN NOT d THEN '단지 10세대 미만' WHEN NOT e THEN '나홀로일 가능성' END AS reason,
  (NOT a)::INT + coalesce((NOT b)::INT, 0) + (NOT c)::INT + coalesce((NOT d)::INT, 0) + coalesce((NOT e)::INT, 0) AS misses FROM s),
found AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN b IS NULL OR d IS NULL OR e IS NULL THEN 'unsure' WHEN eligible = 'no' THEN 'refused' ELSE 'ok' END AS result,
  coalesce(CASE eligible WHEN 'ok' THEN 3 WHEN 'unsure' THEN 2 WHEN 'r2' THEN 1 WHEN 'no' THEN 0 END, 0) AS er FROM r)"""


def _found(spark, sf_dir):
    return conditions.search(facts(spark, sf_dir, _FACTS, "part"), REQUIRED, PREFERRED)


@query(f"WITH {_FOUND} SELECT id, result, reason, CAST(misses AS INT) AS misses, CAST(score AS DOUBLE) AS score FROM found")
def domain_search(spark, sf_dir):
    return _found(spark, sf_dir).select("id", "result", "reason", "misses", "score")


@query(f"""WITH {_FOUND}, o AS (SELECT notice, id, row_number() OVER (PARTITION BY notice ORDER BY er DESC, score DESC, coalesce(price, 99), id) AS rn FROM found WHERE result IN ('ok', 'unsure'))
SELECT notice, max(id) FILTER (rn = 1) AS best, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS types FROM o GROUP BY notice""")
def search_by_notice(spark, sf_dir):
    found = conditions.by_notice(_found(spark, sf_dir).where("result in ('ok', 'unsure')"))
    return found.select("notice", "best", F.array_join(F.transform("types", lambda x: x.cast("string")), ",").alias("types"))


_POINTS = [(37.5, 127.0), (37.55, 126.9)]


@query(f"""WITH {_FOUND}, w AS (SELECT *, least({_M.format(a='lat', b='lng', c=37.5, d=127.0)}, {_M.format(a='lat', b='lng', c=37.55, d=126.9)}) / 1000.0 AS km FROM found
  WHERE NOT a AND b AND c AND d AND e AND coalesce(eligible, '') <> 'no'), g AS (SELECT *, CASE grade WHEN 'lotto' THEN 1.5 WHEN 'consider' THEN 1.0 WHEN 'pass' THEN -0.5 ELSE 0 END AS s2 FROM w),
o AS (SELECT notice, id, km, NOT coalesce(km <= 30, false) AS far, er, coalesce(least(6, km / 8), 4) - s2 AS rk, coalesce(price, 99) AS p, row_number() OVER (PARTITION BY notice ORDER BY NOT coalesce(km <= 30, false), er DESC, coalesce(least(6, km / 8), 4) - s2, coalesce(price, 99), id) AS rn FROM g)
SELECT notice, id AS best, CAST(round(km) AS BIGINT) AS km FROM o WHERE rn = 1 ORDER BY far, er DESC, rk, p, id LIMIT 3""")
def search_outside(spark, sf_dir):
    return conditions.outside(facts(spark, sf_dir, _FACTS, "part"), REQUIRED, _POINTS)


@query(f"""WITH f AS ({_FACTS}), m AS (SELECT *, {_M.format(a='lat', b='lng', c=37.5, d=127.0)} AS m1, {_M.format(a='lat', b='lng', c=37.55, d=126.9)} AS m2 FROM f WHERE lat IS NOT NULL), n AS (SELECT *, least(m1, m2) AS m, CASE WHEN m2 < m1 THEN '둘' ELSE '하나' END AS st FROM m)
SELECT '2호선' AS line, count(DISTINCT notice) AS notices, count(*) AS types, min(price) AS least_price, string_agg(DISTINCT st, ',' ORDER BY st) AS stations FROM n WHERE m <= 20000""")
def line_info(spark, sf_dir):
    stations = [("하나", *_POINTS[0]), ("둘", *_POINTS[1])]
    found = conditions.line_info(facts(spark, sf_dir, _FACTS, "part"), "2호선", stations, 20_000)
    return found.withColumn("stations", F.array_join("stations", ","))


_PLACES = "SELECT CAST(c_custkey AS STRING) AS district, 36 + c_custkey % 211 / CAST(100 AS DOUBLE) AS lat, 126 + c_custkey % 307 / CAST(100 AS DOUBLE) AS lng FROM customer"


@query(f"""WITH d AS ({_PLACES}), c AS (SELECT * FROM d WHERE CAST(district AS BIGINT) IN (SELECT n_nationkey FROM nation)),
p AS (SELECT d.district, c.district AS near_of, {_M.format(a='c.lat', b='c.lng', c='d.lat', d='d.lng')} AS m FROM d, c WHERE d.district NOT IN (SELECT district FROM c)),
o AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY m, near_of) AS rn FROM p WHERE m <= 15000) SELECT district, near_of, CAST(round(m / 1000.0) AS BIGINT) AS km FROM o WHERE rn = 1""")
def neighbour_districts(spark, sf_dir):
    chosen = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("district"))
    return conditions.neighbours(facts(spark, sf_dir, _PLACES, "customer"), chosen, 15.0)


_TIGHT = [("price_max", 9.05), ("households_min", 10)]


@query(f"""WITH f AS ({_FACTS}), v AS (SELECT *, coalesce(CASE eligible WHEN 'ok' THEN 3 WHEN 'unsure' THEN 2 WHEN 'r2' THEN 1 END, 0) AS er FROM f WHERE households >= 10 AND coalesce(eligible, '') <> 'no'),
w AS (SELECT * FROM v WHERE price <= {round(9.05 * 1.1, 2)} + 1e-9), h AS (SELECT DISTINCT notice FROM v WHERE price <= 9.05 + 1e-9),
x AS (SELECT *, CASE grade WHEN 'lotto' THEN 1.5 WHEN 'consider' THEN 1.0 WHEN 'pass' THEN -0.5 ELSE 0 END AS s2 FROM w WHERE notice NOT IN (SELECT notice FROM h)),
o AS (SELECT *, row_number() OVER (PARTITION BY notice ORDER BY er DESC, s2 DESC, coalesce(price, 99), id) AS rn FROM x), t AS (SELECT notice, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS types FROM o GROUP BY 1)
SELECT notice, id AS best, types FROM o JOIN t USING (notice) WHERE rn = 1 ORDER BY coalesce(price, 99), id LIMIT 2""")
def search_near_misses(spark, sf_dir):
    found = conditions.near_misses(facts(spark, sf_dir, _FACTS, "part"), _TIGHT)
    return found.select("notice", "best", F.array_join(F.transform("types", lambda x: x.cast("string")), ",").alias("types"))


# --- results, history, events -------------------------------------------------------------------------------------------------------

_RESULTS = f"""SELECT CAST(l_orderkey AS STRING) AS HOUSE_MANAGE_NO, {cases('l_partkey', ['084.9811C ', '059.1A', '101'])} AS HOUSE_TY, {cases('l_suppkey', ['1', '2', '01', '1순위'])} AS SUBSCRPT_RANK_CODE,
  {cases('l_linenumber', ['기타지역', '해당지역', '기타경기'])} AS RESIDE_SENM, CAST(CAST(l_quantity AS INT) AS STRING) AS SUPLY_HSHLDCO, {cases('l_partkey', ['1,280', '35', '-', ''])} AS REQ_CNT, {cases('l_partkey', ['32.00', '-', '(△7)', '1.5'])} AS CMPET_RATE, l_linenumber AS line FROM lineitem"""


@query(f"""WITH r AS ({_RESULTS}), c AS (SELECT trim(HOUSE_MANAGE_NO) AS notice, trim(HOUSE_TY) AS house_ty, SUBSCRPT_RANK_CODE AS rank, RESIDE_SENM AS reside, CAST(SUPLY_HSHLDCO AS INT) AS supply, TRY_CAST(replace(REQ_CNT, ',', '') AS INT) AS req, CMPET_RATE AS rate,
  TRY_CAST(CMPET_RATE AS DOUBLE) AS rate_num, line FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY notice, house_ty ORDER BY CASE WHEN rank IN ('1', '01', '1순위') THEN CASE WHEN contains(reside, '해당') THEN 0 ELSE 1 END ELSE 2 END, line, rank, reside, supply, rate) AS rn FROM c)
SELECT notice, house_ty, rank, reside, supply, req, rate, rate_num FROM o WHERE rn = 1""")
def competition_summary(spark, sf_dir):
    raw = facts(spark, sf_dir, _RESULTS, "lineitem")
    return history.summary_by_type(_competition_rows(raw), ["line", "rank", "reside", "supply", "rate"])


def _competition_rows(raw):
    # the line number orders rows of one type and rank
    return history.competition(raw.withColumn("HOUSE_MANAGE_NO", F.concat_ws("|", "HOUSE_MANAGE_NO", "line"))).withColumns({
        "line": F.split_part("notice", F.lit("|"), F.lit(2)).cast("int"), "notice": F.split_part("notice", F.lit("|"), F.lit(1)),
    })


_CLOSED = "SELECT o_orderkey AS notice, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS closed FROM orders"
_KNOWN = f"SELECT c_custkey AS notice, c_custkey % 3 = 0 AS found, DATE '{TODAY}' - CAST(c_custkey % 60 AS INT) AS checked, DATE '{TODAY}' - CAST(c_custkey % 500 AS INT) AS apply, c_acctbal AS v FROM customer"


@query(f"""WITH n AS ({_CLOSED}), h AS ({_KNOWN}) SELECT notice, closed FROM n WHERE closed < DATE '{TODAY}' AND notice NOT IN (SELECT notice FROM h WHERE found OR checked > DATE '{TODAY}' - 30) ORDER BY closed DESC, notice LIMIT 60""")
def history_to_look_up(spark, sf_dir):
    return history.to_look_up(facts(spark, sf_dir, _CLOSED, "orders"), facts(spark, sf_dir, _KNOWN, "customer"), F.lit(TODAY).cast("date"))


_NEWS = f"SELECT s_suppkey AS notice, true AS found, DATE '{TODAY}' AS checked, DATE '{TODAY}' - CAST(s_suppkey % 400 AS INT) AS apply, s_acctbal AS v FROM supplier"


@query(f"""WITH a AS ({_KNOWN}), b AS ({_NEWS}), u AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE notice NOT IN (SELECT notice FROM b)) SELECT * FROM u WHERE apply >= DATE '{TODAY}' - 372""")
def history_merged(spark, sf_dir):
    return history.merged(facts(spark, sf_dir, _KNOWN, "customer"), facts(spark, sf_dir, _NEWS, "supplier"), F.lit(TODAY).cast("date"))


@query(f"WITH c AS ({_KNOWN}) SELECT notice FROM c WHERE found OR checked >= DATE '{TODAY}' - 7")
def cache_usable(spark, sf_dir):
    return history.usable(facts(spark, sf_dir, _KNOWN, "customer"), F.lit(TODAY).cast("date"), 7).select("notice")


@query("""SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS notice, max_by(p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice - p_size * 20 END, -99) * 1e9 - p_partkey) AS id FROM part GROUP BY 1""")
def best_unit_of_notice(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS notice, p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice - p_size * 20 END AS lo FROM part", "part")
    return history.best_unit(rows, "notice", "lo", "id").select("notice", "id")


_SNAPSHOT = f"SELECT o_orderkey AS notice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE DATE '{TODAY}' + CAST(o_orderkey % 60 - 30 AS INT) END AS first, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE DATE '{TODAY}' + CAST(o_orderkey % 60 - 25 AS INT) END AS closes FROM orders"


@query(f"""WITH t AS ({_SNAPSHOT}), n AS (SELECT notice FROM t WHERE coalesce(closes, first, DATE '9999-12-31') >= DATE '{TODAY}' AND notice NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 40 <> 7))
SELECT notice, 'new' AS kind FROM n WHERE (SELECT count(*) FROM n) <= 100000 UNION ALL SELECT notice, CASE WHEN first = DATE '{TODAY}' + 1 THEN 'start' ELSE 'end' END FROM t WHERE first = DATE '{TODAY}' + 1 OR (closes = DATE '{TODAY}' + 1 AND coalesce(first <> DATE '{TODAY}' + 1, true))""")
def notice_events(spark, sf_dir):
    """The snapshot before lacks every fortieth notice, which is what is new."""
    before = facts(spark, sf_dir, "SELECT o_orderkey AS notice FROM orders WHERE o_orderkey % 40 <> 7", "orders")
    return history.events(facts(spark, sf_dir, _SNAPSHOT, "orders"), before, F.lit(TODAY).cast("date"), 100_000)


_MATCHES = f"SELECT o_custkey AS sub_id, o_orderkey AS event_id, {cases('o_orderkey', ['new', 'start', 'new', 'end'])} AS kind, o_orderpriority AS line FROM orders"


@query(f"""WITH m AS ({_MATCHES}), o AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY event_id) AS rn, CASE kind WHEN 'start' THEN '[내일 접수 시작] ' WHEN 'end' THEN '[내일 접수 마감] ' ELSE '' END || line AS l FROM m)
SELECT sub_id, concat_ws(' · ', CASE WHEN count(*) FILTER (kind = 'new') > 0 THEN '새 공고 ' || count(*) FILTER (kind = 'new') END, CASE WHEN count(*) FILTER (kind = 'start') > 0 THEN '내일 접수 시작 ' || count(*) FILTER (kind = 'start') END,
  CASE WHEN count(*) FILTER (kind = 'end') > 0 THEN '내일 접수 마감 ' || count(*) FILTER (kind = 'end') END) AS title, string_agg(l, chr(10) ORDER BY rn) FILTER (rn <= 4) || CASE WHEN count(*) > 4 THEN chr(10) || '외 ' || (count(*) - 4) || '건' ELSE '' END AS body FROM o GROUP BY sub_id""")
def digest_titles(spark, sf_dir):
    return history.digest_titles(facts(spark, sf_dir, _MATCHES, "orders"))


# --- verification -------------------------------------------------------------------------------------------------------------------

MESSAGES = ["세대주 요건을 공고문에서 확인하지 못해 추정했어요", "날짜 순서가 이상해요", "분양가 120억이 범위를 벗어나요", "지도 좌표가 국내 범위를 벗어나요", "새 문구", "시세 근거 거래가 2건뿐이에요"]
_MESSAGES = f"SELECT l_orderkey AS notice, {cases('l_partkey', MESSAGES)} AS message FROM lineitem"


@query(f"""WITH m AS (SELECT DISTINCT * FROM (SELECT l_orderkey AS notice, {cases('l_partkey', ['unread', 'notice', 'market', 'geo', 'other', 'market'])} AS category, {cases('l_partkey', MESSAGES)} AS message FROM lineitem))
SELECT category, count(DISTINCT notice) AS notices, count(*) AS messages FROM m GROUP BY category""")
def check_categories(spark, sf_dir):
    return audit.category_counts(facts(spark, sf_dir, _MESSAGES, "lineitem"))


@query("""WITH r AS (SELECT p_partkey, p_size AS size, p_retailprice AS price, p_brand AS brand FROM part), g AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END END AS size, p_retailprice + CASE WHEN p_partkey % 5 = 0 THEN 0.5 ELSE 0.00001 END AS price, 'Brand#11' AS brand FROM part)
SELECT p_partkey, 'size' AS field FROM r JOIN g USING (p_partkey) WHERE g.size <> r.size UNION ALL SELECT p_partkey, 'price' FROM r JOIN g USING (p_partkey) WHERE abs(r.price - g.price) >= 0.0001 UNION ALL SELECT p_partkey, 'brand' FROM r WHERE brand <> 'Brand#11'""")
def golden_mismatches(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size size", "p_retailprice price", "p_brand brand")
    golden = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "case when p_partkey % 3 <> 0 then p_size + case when p_partkey % 7 = 0 then 1 else 0 end end size", "p_retailprice + case when p_partkey % 5 = 0 then 0.5D else 0.00001D end price", "'Brand#11' brand")
    return audit.golden_mismatches(rows, golden, "p_partkey").select("p_partkey", "field")


@query("""WITH f AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE CAST(l_orderkey AS VARCHAR) END AS id, CASE WHEN l_suppkey % 4 = 0 THEN 'system' ELSE 'listing' END AS kind, l_linenumber = 7 AS stale FROM lineitem),
s AS (SELECT CASE WHEN stale THEN 'pending' WHEN trim(id) = '' OR kind = 'system' THEN 'global' ELSE 'row' END AS scope, id FROM f) SELECT scope, CASE WHEN scope = 'row' THEN id END AS id, count(*) AS n FROM s GROUP BY ALL""")
def failure_scopes(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").selectExpr("case when l_partkey % 5 = 0 then ' ' else cast(l_orderkey as string) end id", "case when l_suppkey % 4 = 0 then 'system' else 'listing' end kind", "l_linenumber = 7 stale")
    return audit.failure_scope(f)


@query("""SELECT event_type AS key, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'P1' ELSE 'P2' END AS severity, array_to_string(list_sort(list(event_id))[1:20], ',') AS numbers FROM events GROUP BY event_type""")
def grouped_issues(spark, sf_dir):
    issues = table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), "event_type", F.date_format("ts", "HH:mm")).alias("title"))
    found = audit.grouped_issues(issues)
    return found.select("key", "n", "severity", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


_DAY = date.fromisoformat(TODAY)


@query(f"""WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey FROM o WHERE (i - ({_DAY.toordinal()} * 8) % n + n) % n < 8""")
def rotating_sample(spark, sf_dir):
    return audit.rotating_pick(table(spark, sf_dir, "part"), "p_partkey", _DAY, 8)


@query("""WITH a AS (SELECT p_partkey AS k, p_brand AS b, p_type AS t FROM part), x AS (SELECT a.k, o.k AS other, row_number() OVER (PARTITION BY a.k ORDER BY o.k DESC) AS rn FROM a JOIN a o ON a.b = o.b AND a.k <> o.k), s AS (SELECT k, other FROM x WHERE rn <= 5),
y AS (SELECT a.k, o.k AS other, row_number() OVER (PARTITION BY a.k ORDER BY o.k DESC) AS rn FROM a JOIN a o ON a.t = o.t AND a.k <> o.k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = a.k AND s.other = o.k))
SELECT k AS p_partkey, other, 'p_brand' AS "by" FROM s UNION ALL SELECT k, other, 'p_type' FROM y WHERE rn <= 5""")
def related_items(spark, sf_dir):
    return audit.related(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"], [F.col("p_partkey").desc()])


@query()
def version_strengths(spark, sf_dir):
    """Suppliers of neighbouring lines of an order; the larger discount wins. Iterative; tests hold it against a plain loop."""
    games = facts(spark, sf_dir, """SELECT CAST(a AS STRING) AS a, CAST(b AS STRING) AS b, CASE WHEN da = db THEN 'tie' WHEN da > db THEN CAST(a AS STRING) ELSE CAST(b AS STRING) END AS winner
      FROM (SELECT l_suppkey AS a, l_discount AS da, lead(l_suppkey) OVER w AS b, lead(l_discount) OVER w AS db FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) x WHERE b IS NOT NULL AND a <> b""", "lineitem")
    return audit.strengths(games)


# --- valuation ----------------------------------------------------------------------------------------------------------------------

@query(f"""WITH {LISTINGS_SQL}, {TRADES_SQL}, u AS (SELECT id, district, area, id % 400 + 1 AS complex FROM listings), k AS (SELECT DISTINCT district, complex, area FROM u), p AS (SELECT DISTINCT district, area FROM u), r AS (SELECT * FROM trades WHERE NOT direct AND amount <> 0),
o AS (SELECT k.district, k.complex, k.area, count(*) AS n, median(amount) AS m FROM k JOIN r ON r.district = k.district AND r.complex = k.complex AND abs(r.area - k.area) <= 3 GROUP BY ALL),
d AS (SELECT p.district, p.area, count(*) AS n, median(amount) AS m FROM p JOIN r ON r.district = p.district AND abs(r.area - p.area) <= 3 WHERE new_build GROUP BY ALL HAVING count(*) >= 3)
SELECT u.id, CASE WHEN o.n IS NOT NULL THEN 'same_complex' WHEN d.n IS NOT NULL THEN 'district_newbuild' END AS basis, coalesce(o.n, d.n) AS n, round(coalesce(o.m, d.m) * 0.9, 6) AS jeonse, coalesce(coalesce(o.n, d.n) < 5, true) AS weak
FROM u LEFT JOIN o USING (district, complex, area) LEFT JOIN d USING (district, area)""")
def jeonse_estimates(spark, sf_dir):
    from hearthline.plans.standin import trades

    units = listings(spark, sf_dir).withColumn("complex", F.col("id") % 400 + 1)
    rents = trades(spark, sf_dir).where("not direct").select("district", "complex", "area", F.col("amount").alias("deposit"), F.lit(0.0).alias("monthly"), "new_build")
    return market.jeonse(units, rents).withColumn("jeonse", F.round("jeonse", 6))


# --- text ---------------------------------------------------------------------------------------------------------------------------

@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS w FROM documents), p AS (SELECT doc_id, w, string_split(w, 'the ') AS parts FROM d),
a AS (SELECT doc_id, w, len(parts) - 1 AS n, length(parts[1]) AS i1, length(parts[1]) + 4 + length(parts[2]) AS i2 FROM p)
SELECT doc_id, concat_ws('|', CASE WHEN n >= 1 THEN trim(substr(w, greatest(0, i1 - 20) + 1, i1 + 90 - greatest(0, i1 - 20))) END, CASE WHEN n >= 2 THEN trim(substr(w, greatest(0, i2 - 20) + 1, i2 + 90 - greatest(0, i2 - 20))) END) AS found FROM a""")
def word_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.snippets(F.col("text"), "the "), "|").alias("found"))


@query()
def notice_chunks(spark, sf_dir):
    """A fold over lines; tests hold it against a plain loop."""
    return text.notice_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


_URLS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'https://a.example/f?houseManageNo=' || o_custkey || '&atchmnflSeqNo=' || o_orderkey || '&atchmnflSn=1' WHEN 1 THEN 'http://b.example/?atchmnflSn=1&atchmnflSeqNo=' || o_orderkey WHEN 2 THEN 'https://a.example/f?houseManageNo=3' END AS url, o_orderkey % 3000 AS m FROM orders"


@query(f"""WITH f AS ({_URLS}) SELECT id, CASE id % 4 WHEN 0 THEN regexp_extract(url, 'houseManageNo=([0-9]+)', 1) END AS house, CASE WHEN id % 4 IN (0, 1) THEN CAST(id AS VARCHAR) END AS file, CAST(greatest(1, round_even(m * 1.3 / 67, 0)) AS INT) AS minutes FROM f""")
def attachments_and_walks(spark, sf_dir):
    f = facts(spark, sf_dir, _URLS, "orders").select("id", text.attachment(F.col("url")).alias("a"), text.walking_minutes(F.col("m")).alias("minutes"))
    return f.select("id", "a.house", "a.file", "minutes")


@query("""SELECT event_id, round((epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(date_trunc('second', ts))) / 3600, 1) AS hours, (epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(date_trunc('second', ts))) / 3600 > 36.05 AS stale FROM events""")
def snapshot_ages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", text.stale(F.col("ts"), F.lit("2024-06-01 00:00:00").cast("timestamp"), 36.05).alias("s"))
    return e.select("event_id", "s.*")


# --- contradictions between rules ------------------------------------------------------------------------------------------------------

#: Rules of order lines, as both engines read them.
_RULES = {
    "huge": "l_quantity >= 50", "large": "l_quantity > 40", "full price": "l_discount = 0", "cheap": "l_discount >= 0.08", "returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'",
    "dear": "l_extendedprice > 60000", "taxed": "l_tax > 0", "heavily taxed": "l_tax >= 0.08",
}
_IMPLIED, _EXCLUDED = [("huge", "large"), ("dear", "large"), ("heavily taxed", "taxed"), ("open", "taxed")], [("full price", "cheap"), ("returned", "open"), ("huge", "cheap")]
_LINE = "l_orderkey * 10 + l_linenumber"
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_a, count(*) FILTER ({y}) AS n_both, count(*) FILTER (NOT ({y})) AS only_a, min({_LINE}) FILTER (NOT ({y})) AS example FROM lineitem WHERE {x}"
    for a, x in _RULES.items() for b, y in _RULES.items() if a != b)
_in = lambda pairs: "(a, b) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ")"


@query(f"""WITH p AS ({_PAIRS_SQL}), k AS (SELECT *, CASE WHEN {_in(_IMPLIED)} AND only_a > 0 THEN 'implies' WHEN {_in(_EXCLUDED)} AND n_both > 0 THEN 'excludes'
  WHEN NOT ({_in(_IMPLIED)}) AND n_a >= 100 AND only_a > 0 AND only_a <= 0.01 * n_a THEN 'suspect' END AS kind FROM p)
SELECT a, b, kind, CASE WHEN kind = 'excludes' THEN n_both ELSE only_a END AS n, CASE WHEN kind <> 'excludes' THEN example END AS example FROM k WHERE kind IS NOT NULL""")
def rule_contradictions(spark, sf_dir):
    """Declared implications and exclusions between rules that order lines go against, with examples."""
    lines = facts(spark, sf_dir, f"SELECT *, {_LINE} AS line FROM lineitem", "lineitem")
    return audit.contradictions(audit.implications(lines, "line", {n: F.expr(c) for n, c in _RULES.items()}), _IMPLIED, _EXCLUDED)
