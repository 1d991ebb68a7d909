"""Registered queries of listings and decisions. Facts are SQL that both engines read alike; what is made of them is said twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import checks, decisions, judging, lineage, listing
from hearthline.plans.registry import cases, facts, query
from hearthline.plans.standin import TODAY

# --- place ---------------------------------------------------------------------------------------------------------------------

#: An address, and by hand: region, province, district, code, regulated, capital, dong, prefix.
ADDRESSES = [
    ("서울특별시 강남구 역삼동 12-3", "서울", "서울", "강남구", "11680", True, True, "역삼동", "서울특별시 강남구"),
    ("서울 중구 을지로 5가 1", "서울", "서울", "중구", "11140", True, True, "", "서울 중구 을지로"),
    ("경기도 성남시 분당구 정자동 90번지", "경기", "경기", "성남시 분당구", "41135", True, True, "정자동", "경기도 성남시 분당구"),
    ("경기도 화성특례시 만세구 향남읍", "경기", "경기", "화성시 만세구", "41591", False, True, "향남읍", "경기도 화성특례시 만세구"),
    ("경기도 수원시 권선구 세류동", "경기", "경기", "수원시 권선구", "41113", False, True, "세류동", "경기도 수원시 권선구"),
    ("경기도 화성시 동탄구 오산동 1", "경기", "경기", "화성시 동탄구", None, False, True, "오산동", "경기도 화성시 동탄구"),
    ("경기도 과천시 갈현동", "경기", "경기", "과천시", "41290", True, True, "갈현동", "경기도 과천시"),
    ("인천광역시 서구 당하동 10", "인천", "인천", "서구", "28260", False, True, "당하동", "인천광역시 서구"),
    ("경상남도 거제시 옥포동 1670번지", "지방", "경남", "거제시", None, False, False, "옥포동", "경상남도 거제시"),
    ("전북특별자치도 전주시 완산구 효자동1가 3", "지방", "전북", "전주시 완산구", None, False, False, "효자동1가", "전북특별자치도 전주시 완산구"),
    ("세종특별자치시 한솔동 4", "지방", "세종", None, None, False, False, "한솔동", "세종특별자치시"),
    ("첨단3지구 A6블록(광주광역시 북구 월출동)", "지방", None, "북구", None, False, False, "", ""),
    ("", "지방", None, None, None, False, False, "", ""),
    (None, "지방", None, None, None, False, False, "", ""),
]
_ADDRESS_FACTS = f"SELECT c_custkey AS id, {cases('c_custkey', [a[0] for a in ADDRESSES])} AS address FROM customer"
_places = ", ".join(f"{cases('c_custkey', [a[i] for a in ADDRESSES])} AS {n}" for i, n in enumerate(("region", "sido", "district", "lawd", "regulated", "capital", "dong", "prefix"), 1))


@query(f"SELECT c_custkey AS id, {_places} FROM customer")
def address_places(spark, sf_dir):
    f, a = lineage.spread(facts(spark, sf_dir, _ADDRESS_FACTS, "customer"), "id"), F.col("address")
    return f.select(
        "id", listing.region(a).alias("region"), listing.province(a).alias("sido"), listing.district(listing.main_address(a)).alias("district"),
        listing.district_code(listing.coded_district(a)).alias("lawd"), listing.is_regulated(a).alias("regulated"), listing.is_capital(a).alias("capital"),
        listing.dong(a).alias("dong"), listing.address_prefix(a).alias("prefix"),
    )


# --- kind and supply -------------------------------------------------------------------------------------------------------------

#: A name, rental by name, target group, for organisations.
NAMES = [
    ("힐스테이트 강남", False, None, False), ("고덕강일 3단지 토지임대부 분양주택", False, None, False), ("인천 행복주택 임차인 모집", True, None, False),
    ("수원 신혼희망타운", False, "신혼부부", False), ("마포 청년 매입임대주택", True, "청년", False), ("기장군 중소기업 근로자 공공임대주택 기관공급 사업 대상기업 모집계획", True, None, True),
    ("우선분양전환 후 잔여세대", False, None, False), ("토지임대부 국민임대", False, None, False), (None, False, None, False),
]
#: A house type, its area and its label.
HOUSE_TYPES = [("084.9811C", 84.9811, "84C"), ("059.9288A", 59.9288, "59A"), (" 101", 101.0, "101"), ("P", None, "P"), ("", None, ""), (None, None, ""), ("000.0000B", 0.0, "B")]
_NOTICE_FACTS = f"""SELECT o_orderkey AS id, {cases('o_orderkey', [n[0] for n in NAMES])} AS name, {cases('o_orderkey', [h[0] for h in HOUSE_TYPES])} AS house_ty,
  {cases('o_orderkey', [None, None, '분양주택', '분양전환 가능임대', ''])} AS rent_secd, {cases('o_orderkey', ['general', 'remainder', 'general'])} AS category,
  {cases('o_orderkey', [None, 'APT', '국민', '민간사전청약', '무순위', ''])} AS kind, {cases('o_orderkey', [None, True, False, False])} AS speculative, {cases('o_orderkey', [None, False, True])} AS adjusted,
  {cases('o_orderkey', [0, 0, None, 5])} AS general_units, {cases('o_orderkey', [0, None, 3, 0, 0])} AS special_units FROM orders"""


@query(f"""WITH f AS ({_NOTICE_FACTS}) SELECT id, CAST({cases('id', [h[1] for h in HOUSE_TYPES])} AS DOUBLE) AS area, {cases('id', [h[2] for h in HOUSE_TYPES])} AS unit,
  CASE WHEN category = 'remainder' THEN coalesce(nullif(kind, ''), '무순위·잔여세대') WHEN coalesce(kind, '') IN ('', 'APT', '국민') THEN '일반분양 (특별공급·1순위)' ELSE '일반분양 · ' || kind END AS label,
  CASE rent_secd WHEN '분양주택' THEN false WHEN '분양전환 가능임대' THEN true ELSE {cases('id', [n[1] for n in NAMES])} END AS rental,
  {cases('id', [n[2] for n in NAMES])} AS target, {cases('id', [n[3] for n in NAMES])} AS for_organisations,
  CASE WHEN speculative THEN '투기과열' WHEN adjusted THEN '조정' WHEN speculative = false AND adjusted = false THEN '비규제' END AS reg_kind,
  coalesce(category = 'general' AND general_units = 0 AND special_units = 0, false) AS no_supply FROM f""")
def notice_kinds(spark, sf_dir):
    f, c = facts(spark, sf_dir, _NOTICE_FACTS, "orders"), F.col
    return f.select(
        "id", listing.area_of(c("house_ty")).alias("area"), listing.unit_label(c("house_ty")).alias("unit"), listing.kind_label(c("kind"), c("category")).alias("label"),
        listing.is_rental(c("rent_secd"), c("name")).alias("rental"), listing.target(c("name")).alias("target"), listing.for_organisations(c("name")).alias("for_organisations"),
        listing.regulation(c("speculative"), c("adjusted")).alias("reg_kind"), listing.no_supply(c("category"), c("general_units"), c("special_units")).alias("no_supply"),
    )


_RAW_FACTS = f"""SELECT CAST(p_partkey AS STRING) AS notice_no, {cases('p_partkey', [h[0] for h in HOUSE_TYPES])} AS house_ty, {cases('p_partkey', [n[0] for n in NAMES[:8]])} AS name,
  {cases('p_partkey', [a[0] for a in ADDRESSES[:12]])} AS address, {cases('p_partkey', [None, 'APT', '국민'])} AS kind, {cases('p_partkey', ['general', 'remainder', 'general', 'general'])} AS category,
  {cases('p_partkey', [None, None, '분양주택', '분양전환 가능임대'])} AS rent_secd, {cases('p_partkey', [None, None, True, False])} AS speculative, {cases('p_partkey', [None, False, True])} AS adjusted,
  {cases('p_partkey', [None, True, False, True])} AS price_cap, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / 100 END AS price,
  {cases('p_partkey', [None, '1998-03', '1998-12', '2030-05', '1998-11-02'])} AS move_in FROM part"""


@query(f"""WITH f AS (SELECT *, CAST(notice_no AS BIGINT) AS k FROM ({_RAW_FACTS})), g AS (SELECT *, {cases('k', [h[2] for h in HOUSE_TYPES])} AS unit, {cases('k', [a[1] for a in ADDRESSES[:12]])} AS region,
  coalesce(speculative, {cases('k', [a[5] for a in ADDRESSES[:12]])}) AS regulated,
  CASE rent_secd WHEN '분양주택' THEN false WHEN '분양전환 가능임대' THEN true ELSE {cases('k', [n[1] for n in NAMES[:8]])} END AS rental,
  CASE WHEN category = 'remainder' THEN coalesce(kind, '무순위·잔여세대') ELSE '일반분양 (특별공급·1순위)' END AS l FROM f WHERE price IS NOT NULL)
SELECT notice_no || '-' || coalesce(nullif(house_ty, ''), unit) AS id, unit, CAST({cases('k', [h[1] for h in HOUSE_TYPES])} AS DOUBLE) AS area, region, {cases('k', [a[3] for a in ADDRESSES[:12]])} AS district, {cases('k', [a[4] for a in ADDRESSES[:12]])} AS lawd,
  rental, contains(name, '토지임대부') AS land_lease, CASE WHEN rental THEN replace(l, '일반분양', '공공임대') ELSE l END AS label, {cases('k', [n[2] for n in NAMES[:8]])} AS target,
  region <> '지방' AS capital, regulated, regulated AND region <> '지방' AS land_permit, CASE WHEN move_in[1:7] <= '1998-12' THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS mid_rate,
  CASE WHEN coalesce(price_cap, false) THEN NULL ELSE 0 END AS residence_duty, regulated AND NOT contains(name, '신혼희망타운') AS need_head, category <> 'remainder' AS need_account,
  CASE WHEN regulated THEN '10년' WHEN coalesce(price_cap, false) THEN '공고문 확인' ELSE '없음' END || CASE WHEN coalesce(price_cap, false) THEN '|공고문 확인' ELSE '' END AS limits FROM g""")
def listing_build(spark, sf_dir):
    """Listings of raw notices as of a day in 1998."""
    found = listing.listings(lineage.spread(facts(spark, sf_dir, _RAW_FACTS, "part"), "notice_no"), F.lit(TODAY).cast("date"))
    return found.select(
        "id", "unit", "area", "region", "district", "lawd", "rental", "land_lease", "label", "target", "capital", "regulated", "land_permit", "mid_rate", "residence_duty", "need_head", "need_account",
        F.array_join(F.transform("limits", lambda x: x["value"]), "|").alias("limits"),
    )


_FILTER_FACTS = f"""SELECT p_partkey AS id, p_brand AS district, split_part(p_type, ' ', 1) AS supply_type, p_retailprice / 100 AS price, p_size * 2.0 AS area,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '{TODAY}' + CAST(p_partkey % 90 - 45 AS INT) END AS apply FROM part"""


@query(f"""WITH f AS ({_FILTER_FACTS}) SELECT id, apply FROM f WHERE supply_type = 'PROMO' AND apply BETWEEN DATE '1998-05-20' AND DATE '1998-06-20'""")
def listing_api_filter(spark, sf_dir):
    where = listing.listing_filter({"supply_type": "PROMO", "district": None}, "apply", "1998-05-20", "1998-06-20")
    return facts(spark, sf_dir, _FILTER_FACTS, "part").where(where).select("id", "apply")


@query(f"""WITH f AS ({_FILTER_FACTS}) SELECT CASE WHEN price < 5 THEN '5' WHEN price < 10 THEN '5-10' WHEN price < 15 THEN '10-15' WHEN price < 20 THEN '15-20' ELSE '20' END AS price_band,
  CASE WHEN area <= 60 THEN 's' WHEN area <= 85 THEN 'm' ELSE 'l' END AS size_band, count(*) AS n FROM f GROUP BY ALL""")
def band_filters(spark, sf_dir):
    f = facts(spark, sf_dir, _FILTER_FACTS, "part")
    price = F.coalesce(*[F.when(listing.in_price_band(F.col("price"), b), b) for b in listing.PRICE_BANDS])
    size = F.coalesce(*[F.when(listing.in_size_band(F.col("area"), b), b) for b in listing.SIZE_BANDS])
    return f.groupBy(price.alias("price_band"), size.alias("size_band")).agg(F.count(F.lit(1)).alias("n"))


_KEEP_FACTS = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 40 END AS winner, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 20 END AS apply_end,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS apply FROM orders"""


@query(f"""WITH f AS ({_KEEP_FACTS}) SELECT id FROM f WHERE coalesce(winner + 14, apply_end, apply, DATE '{TODAY}') >= DATE '{TODAY}'""")
def previous_kept(spark, sf_dir):
    return listing.kept_of_previous(facts(spark, sf_dir, _KEEP_FACTS, "orders"), F.lit(TODAY).cast("date")).select("id")


# --- decisions --------------------------------------------------------------------------------------------------------------------

_REF = "2026-08-31"
_DAY = "DATE '1970-01-15'"
_PROFILE_FACTS = f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE {_DAY} + CAST(c_custkey * 37 % 14000 AS INT) END AS birth, {cases('c_custkey', [True, False, None, True, True])} AS married,
  CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE DATE '1992-03-01' + CAST(c_custkey * 53 % 12000 AS INT) END AS married_on, {cases('c_custkey', [False, False, True, None, False, False, False])} AS owns,
  {cases('c_custkey', [False, None, False, False, True, False, False, False, False, False, False])} AS spouse_owns, {cases('c_custkey', ['0', '1', '2+', None, '0', '0', '1', '0'])} AS household_homes,
  {cases('c_custkey', [None, 'small_apt', '', 'inherit', None, 'other', None, None, None])} AS exemption, {cases('c_custkey', ['head', 'parents', 'head', None])} AS household,
  {cases('c_custkey', [True, False, None])} AS parents_own, {cases('c_custkey', [False, True, None, False, True])} AS parents_60, {cases('c_custkey', [None, 'other', '', 'self'])} AS owner,
  CASE WHEN c_custkey % 10 = 0 THEN DATE '2005-06-30' + CAST(c_custkey * 11 % 6000 AS INT) END AS sold_on, CASE WHEN c_custkey % 9 = 0 THEN DATE '2008-02-28' + CAST(c_custkey * 7 % 5000 AS INT) END AS spouse_sold_on,
  c_custkey % 8 AS dependants, DATE '2000-05-31' + CAST(c_custkey * 29 % 9400 AS INT) AS account_since, CASE WHEN c_custkey % 6 < 3 THEN DATE '2010-01-31' + CAST(c_custkey * 17 % 6000 AS INT) END AS spouse_account_since,
  {cases('c_custkey', [True, False, None, False])} AS pregnant, CASE WHEN c_custkey % 5 < 3 THEN DATE '2019-03-28' + CAST(c_custkey * 13 % 2600 AS INT) END AS youngest, CAST({cases('c_custkey', [0, 1, 2, None, 3, 0])} AS INT) AS minors,
  CAST(3000 + c_custkey * 7 % 26000 AS INT) AS household_income, CAST(c_custkey * 7 % 9000 AS INT) AS income, CAST({cases('c_custkey', [0, 4000, None, 9000, 2500])} AS INT) AS spouse_income,
  CAST(c_custkey * 101 % 40000 AS INT) AS estate, CAST(c_custkey * 31 % 6000 AS INT) AS car, CAST(c_custkey * 211 % 60000 AS INT) AS assets, CAST(c_custkey % 10 AS INT) AS size,
  {cases('c_custkey', [False, False, None, True, False])} AS ever_owned, {cases('c_custkey', [True, None, False])} AS household_never_owned, CAST(c_custkey % 30 AS INT) AS account_count,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey * 19 % 40000 AS INT) END AS own_assets, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE CAST(c_custkey * 23 % 140000 AS INT) END AS parents_assets,
  {cases('c_custkey', [True, False, None])} AS five_tax_years FROM customer"""


def _m(a: str, b: str) -> str:
    return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}) - CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)"


def _profile(spark, sf_dir):
    f = facts(spark, sf_dir, _PROFILE_FACTS, "customer")
    return f, {c: F.col(c) for c in f.columns}


_R = f"DATE '{_REF}'"
_ADULT = "CAST(birth + INTERVAL 19 YEAR AS DATE)"


@query(f"""WITH p AS ({_PROFILE_FACTS}), a AS (SELECT *, {_R} AS ref, {_ADULT} AS adult, DATE '2024-01-01' AS cut FROM p), m AS (SELECT id, birth, account_since, {_m('account_since', 'ref')} AS whole,
  CASE WHEN account_since < cut THEN greatest(0, {_m('account_since', 'least(adult, ref, cut)')}) ELSE 0 END AS before, CASE WHEN least(adult, ref) > cut THEN greatest(0, {_m('greatest(account_since, cut)', 'least(adult, ref)')}) ELSE 0 END AS after,
  CASE WHEN ref > adult THEN {_m('adult', 'ref')} ELSE 0 END AS grown, account_since >= adult AS late FROM a)
SELECT id, CAST(CASE WHEN birth IS NULL OR late OR least(60, least(24, before) + after) >= before + after THEN whole ELSE grown + least(60, least(24, before) + after) END AS INT) AS months FROM m""")
def account_period(spark, sf_dir):
    f, p = _profile(spark, sf_dir)
    return f.select("id", decisions.account_months(p["account_since"], p["birth"], F.lit(_REF).cast("date")).cast("int").alias("months"))


@query(f"""WITH p AS ({_PROFILE_FACTS}), a AS (SELECT *, {_R} AS ref, {_ADULT} AS adult, DATE '2024-01-01' AS cut, CAST(birth + INTERVAL 30 YEAR AS DATE) AS thirty, coalesce(married, false) AS wed,
  coalesce(household_homes, '') <> '2+' AND coalesce(exemption, '') IN ('small_apt', 'small_villa', 'tiny', 'inherit') AS free, coalesce(household_homes, '') IN ('1', '2+') AS hh_some,
  coalesce(household, '') = 'parents' AND coalesce(parents_own, false) AS par FROM p),
b AS (SELECT *, NOT free AND (coalesce(owns, false) OR (wed AND coalesce(spouse_owns, false))) AS mine FROM a),
c AS (SELECT *, NOT mine AND NOT free AND ((par AND NOT coalesce(parents_60, false)) OR (hh_some AND coalesce(owner, '') = 'other')) AS theirs, NOT mine AND NOT free AND hh_some AND coalesce(owner, '') = '' AND NOT par AS unclear,
  CASE WHEN wed AND married_on < thirty THEN married_on ELSE thirty END AS s0 FROM b),
d AS (SELECT *, greatest(s0, coalesce(sold_on, s0), CASE WHEN wed THEN coalesce(spouse_sold_on, s0) ELSE s0 END) AS s,
  CASE WHEN account_since < cut THEN greatest(0, {_m('account_since', 'least(adult, ref, cut)')}) ELSE 0 END AS before, CASE WHEN least(adult, ref) > cut THEN greatest(0, {_m('greatest(account_since, cut)', 'least(adult, ref)')}) ELSE 0 END AS after FROM c),
e AS (SELECT *, {_m('s', 'ref')} // 12 AS y, CASE WHEN birth IS NULL OR account_since >= adult OR least(60, least(24, before) + after) >= before + after THEN {_m('account_since', 'ref')}
  ELSE CASE WHEN ref > adult THEN {_m('adult', 'ref')} ELSE 0 END + least(60, least(24, before) + after) END AS am, {_m('spouse_account_since', 'ref')} / 2.0 AS sm FROM d),
g AS (SELECT *, CASE WHEN am < 6 THEN 1 WHEN am < 12 THEN 2 ELSE least(17, am // 12 + 2) END AS own FROM e)
SELECT id, CAST(CASE WHEN mine OR theirs THEN 0 WHEN unclear OR birth IS NULL THEN NULL WHEN ref < s THEN 0 WHEN y < 1 THEN 2 ELSE least(32, 2 + 2 * y) END AS INT) AS homeless, CAST(least(35, 5 + 5 * dependants) AS INT) AS dependants,
  CAST(CASE WHEN wed AND spouse_account_since IS NOT NULL THEN least(17, own + CASE WHEN sm < 6 THEN 1 WHEN sm < 12 THEN 2 ELSE 3 END) ELSE own END AS INT) AS account FROM g""")
def application_points(spark, sf_dir):
    f, p = _profile(spark, sf_dir)
    return f.select("id", decisions.application_points(p, F.lit(_REF).cast("date")).alias("p")).select("id", "p.*")


_SPECIAL = f"""WITH p AS ({_PROFILE_FACTS}), a AS (SELECT *, household_income * 10000 / 12.0 AS mon, coalesce(married, false) AND coalesce(income > 0, false) AND coalesce(spouse_income > 0, false) AS two_earn,
  CASE WHEN coalesce(pregnant, false) OR coalesce(youngest >= DATE '2023-03-28', false) THEN CASE WHEN coalesce(minors, 0) >= 2 OR (coalesce(pregnant, false) AND youngest IS NOT NULL) THEN 20 ELSE 10 END
    WHEN (minors = 0 AND NOT pregnant) OR (minors > 0 AND youngest IS NOT NULL AND NOT pregnant) THEN 0 END AS relax FROM p),
b AS (SELECT *, coalesce(relax, 0) AS r, relax IS NULL OR relax = 10 AS more, CAST(CASE WHEN size <= 3 THEN 7533763 WHEN size = 4 THEN 8802202 WHEN size = 5 THEN 9326985 WHEN size = 6 THEN 9906263 WHEN size = 7 THEN 10485541 ELSE 11064819 + 579278 * (size - 8) END AS BIGINT) AS base FROM a)"""


def _lim(percent: str) -> str:
    return f"((base * ({percent}) + 50) // 100)"


def _public_sql(kind: str) -> str:
    stages = decisions.PUBLIC_STAGES[kind]
    pick = " ".join(f"WHEN mon <= {_lim(f'CASE WHEN two_earn THEN {two} ELSE {one} END + r')} THEN '{name}'" for name, one, two in stages)
    _, one, two = stages[-1]
    return f"""{_SPECIAL}, c AS (SELECT *, CASE {pick} END AS stage0, {{0: 21550, 10: 23705, 20: 25860}}[r] AS re, {{0: 4542, 10: 4996, 20: 5451}}[r] AS ca FROM (SELECT * FROM b)),
    d AS (SELECT *, (estate > re AND NOT (more AND estate <= 25860)) OR (car > ca AND NOT (more AND car <= 5451)) AS bad, estate > re OR car > ca AS over FROM c)
    SELECT id, CASE WHEN stage0 IS NOT NULL THEN CASE WHEN bad THEN 'fail' WHEN over THEN 'warn' ELSE 'ok' END WHEN more AND mon <= {_lim(f'CASE WHEN two_earn THEN {two} ELSE {one} END + 20')} THEN 'warn' ELSE 'fail' END AS state,
    CASE WHEN NOT bad AND NOT over THEN stage0 END AS stage FROM d""".replace("{0: 21550, 10: 23705, 20: 25860}[r]", "CASE r WHEN 10 THEN 23705 WHEN 20 THEN 25860 ELSE 21550 END").replace(
        "{0: 4542, 10: 4996, 20: 5451}[r]", "CASE r WHEN 10 THEN 4996 WHEN 20 THEN 5451 ELSE 4542 END")


_PUBLIC_ALL = " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({_public_sql(k)})" for k in decisions.PUBLIC_STAGES)


@query(_PUBLIC_ALL)
def public_special_supply(spark, sf_dir):
    f, p = _profile(spark, sf_dir)
    return decisions.special_supply(f, p, p["size"], "public").select("kind", "id", "state", "stage")


def _private_sql(kind: str) -> str:
    pick = ""
    for name, one, two in decisions.PRIVATE_STAGES[kind]:
        least = f" AND (NOT two_earn OR least(coalesce(income, 0), coalesce(spouse_income, 0)) * 10000 / 12.0 <= {_lim(str(one))})" if kind == "newlywed" else ""
        pick += f" WHEN mon <= {_lim(f'CASE WHEN two_earn THEN {two or one} ELSE {one} END')}{least} THEN '{name}'"
    return f"{_SPECIAL}, c AS (SELECT *, CASE {pick} WHEN estate <= 33100 THEN '추첨' END AS stage FROM b) SELECT id, CASE WHEN stage IS NULL THEN 'fail' ELSE 'ok' END AS state, stage FROM c"


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({_private_sql(k)})" for k in decisions.PRIVATE_STAGES))
def private_special_supply(spark, sf_dir):
    f, p = _profile(spark, sf_dir)
    return decisions.special_supply(f, p, p["size"], "private").select("kind", "id", "state", "stage")


def _rental_sql(kind: str) -> str:
    stages, of_two = decisions.RENTAL_STAGES[kind]
    percents = [(n, f"CASE WHEN size = 2 THEN CASE WHEN d2 THEN {t[1]} ELSE {t[0]} END ELSE CASE WHEN d2 THEN {two} ELSE {one} END END") for (n, one, two), t in zip(stages, of_two or [s[1:] for s in stages], strict=True)]
    pick = " ".join(f"WHEN mon <= floor(b8 * ({p}) / 100) THEN '{n}'" for n, p in percents)
    return f"""{_SPECIAL}, c0 AS (SELECT *, two_earn AND size > 1 AS d2, list_value(3813363, 5866270, 8168429, 8802202, 9326985, 9906263, 10485541, 11064819)[size]::BIGINT AS b8 FROM b),
    c AS (SELECT *, CASE {pick} END AS s0, assets > 36200 AND (coalesce(relax = 0, false) OR assets > 43100) AS bad, assets > 36200 AND NOT (coalesce(relax > 0, false) AND assets <= 39700) AS open, coalesce(relax <> 0, true) AND mon <= b8 * (({percents[-1][1]}) + 20) / 100.0 AS near FROM c0)
    SELECT id, CASE WHEN bad THEN 'fail' WHEN open OR b8 IS NULL THEN 'warn' WHEN s0 IS NOT NULL THEN 'ok' WHEN near THEN 'warn' ELSE 'fail' END AS state, CASE WHEN NOT bad AND NOT open THEN s0 END AS stage FROM c"""


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({_rental_sql(k)})" for k in decisions.RENTAL_STAGES))
def rental_special_supply(spark, sf_dir):
    f, p = _profile(spark, sf_dir)
    return decisions.special_supply(f, p, p["size"], "rental").select("kind", "id", "state", "stage")


@query(f"""{_SPECIAL}, c AS (SELECT *, coalesce(relax, 10) <> 0 AS may, income * 10000 / 12.0 > 5338708 AS rich, coalesce(owns, false) OR coalesce(ever_owned, false) AS owned, date_diff('month', DATE '2000-01-01', {_R}) AS x FROM b),
d AS (SELECT *, coalesce(birth > DATE '2007-08-31' OR birth <= DATE '1986-08-31', false) OR coalesce(married, false) OR owned OR {_m('account_since', _R)} < 6 OR account_count < 6 OR (rich AND NOT may)
  OR coalesce(own_assets > 27600 AND NOT (may AND own_assets <= 34500), false) OR coalesce(parents_assets > 103500, false) AS bad,
  birth IS NULL OR married IS NULL OR (NOT owned AND ever_owned IS NULL AND NOT coalesce(household_never_owned, false)) OR rich OR own_assets IS NULL OR own_assets > 27600 OR parents_assets IS NULL AS open FROM c)
SELECT id, CASE WHEN bad THEN 'fail' WHEN open THEN 'warn' ELSE 'ok' END AS state, CASE WHEN NOT bad AND NOT open THEN CASE WHEN coalesce(five_tax_years, false) THEN '우선공급 (배점순)' ELSE '추첨' END END AS stage FROM d""")
def youth_special_supply(spark, sf_dir):
    f, p = _profile(spark, sf_dir)
    return f.select("id", decisions.youth_special(p, F.lit(_REF).cast("date")).alias("r")).select("id", "r.*")


_LAW_FACTS = f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size * 2.5 END AS area, {cases('p_partkey', ['투기과열', '조정', '비규제', None])} AS zone, p_partkey % 3 = 0 AS capital, p_partkey % 5 = 0 AS unread,
  CAST(p_partkey % 9 * 10 AS INT) AS small, CAST(p_partkey % 8 * 10 AS INT) AS middle FROM part"""


@query(f"""WITH f AS ({_LAW_FACTS}), l AS (SELECT *, CASE WHEN area IS NULL OR zone IS NULL THEN NULL WHEN zone = '투기과열' THEN CASE WHEN area <= 60 THEN 40 WHEN area <= 85 THEN 70 ELSE 80 END
  WHEN zone = '조정' THEN CASE WHEN area <= 60 THEN 40 WHEN area <= 85 THEN 70 ELSE 50 END WHEN area > 85 THEN CASE WHEN capital THEN 80 ELSE 0 END WHEN capital AND area > 60 THEN 70 ELSE 40 END AS percent FROM f),
b AS (SELECT *, CASE WHEN percent IS NOT NULL THEN CASE WHEN zone <> '비규제' OR (area > 85 AND NOT capital) THEN 'exact' ELSE 'max' END END AS bound, CASE WHEN unread THEN NULL WHEN area <= 60 THEN small WHEN area <= 85 THEN middle END AS said FROM l)
SELECT id, bound, percent, CASE WHEN percent IS NULL THEN NULL WHEN said IS NOT NULL THEN CASE WHEN (bound = 'exact' AND said = percent) OR (bound = 'max' AND said <= percent) THEN 'agrees' ELSE 'differs' END
  WHEN unread AND bound = 'exact' THEN 'filled by law' END AS checked FROM b""")
def score_ratio_by_law(spark, sf_dir):
    f, c = facts(spark, sf_dir, _LAW_FACTS, "part"), F.col
    row = lambda over, upto, score: F.struct(F.lit(over).alias("over"), F.lit(upto).alias("upto"), c(score).alias("score"), (100 - c(score)).alias("lottery"))
    f = f.withColumn("law", decisions.legal_score_ratio(c("area"), c("zone"), c("capital"))).withColumn("rows", F.when(~c("unread"), F.array(row(0, 60, "small"), row(60, 85, "middle"))))
    return f.select("id", "law.*", decisions.score_ratio_check(c("law"), c("rows"), F.lit(False), c("area")).alias("checked"))


_RESALE_FACTS = f"""SELECT o_orderkey AS id, {cases('o_orderkey', [False, False, True, None] + [False] * 7)} AS forbidden, {cases('o_orderkey', [None, True] + [False] * 11)} AS none, {cases('o_orderkey', [None] * 12 + [True])} AS passed,
  {cases('o_orderkey', [False] * 9 + [True])} AS until_registration, CAST({cases('o_orderkey', [12, 6, 36, None, 18, 120])} AS INT) AS months, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS base,
  {cases('o_orderkey', [False, True, None, False, False])} AS registration, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 10 END AS winners FROM orders"""


@query(f"""WITH f AS ({_RESALE_FACTS}), e AS (SELECT *, CAST(coalesce(base, winners) + to_months(months) AS DATE) AS ends, CASE WHEN months % 12 = 0 THEN (months // 12) || '년' ELSE months || '개월' END AS span FROM f)
SELECT id, CASE WHEN forbidden THEN '전매 불가(환매만)' WHEN none THEN '없음' WHEN passed THEN '이미 지남' WHEN until_registration THEN '등기 때까지' WHEN ends <= DATE '{TODAY}' THEN '이미 지남' WHEN months IS NULL THEN '공고문 확인'
  WHEN registration THEN span || '(등기 시 풀림)' WHEN ends IS NOT NULL THEN span || ' (~' || strftime(ends, '%y.%m.%d') || ')' ELSE span END AS resale FROM e""")
def resale_texts(spark, sf_dir):
    f = facts(spark, sf_dir, _RESALE_FACTS, "orders")
    return f.select("id", decisions.resale_text({c: F.col(c) for c in f.columns}, F.col("winners"), F.lit(TODAY).cast("date")).alias("resale"))


_DUTY_FACTS = f"""SELECT p_partkey AS id, CAST({cases('p_partkey', [None, 0, 3, 5])} AS INT) AS found, p_partkey % 5 = 0 AS land_lease, p_partkey % 3 > 0 AS capital, {cases('p_partkey', [True, False, None, True, True])} AS price_cap,
  CAST({cases('p_partkey', [0, None, 2])} AS INT) AS before FROM part"""


@query(f"""WITH f AS ({_DUTY_FACTS}) SELECT id, CASE WHEN found > 0 AND land_lease THEN found WHEN NOT (capital AND coalesce(price_cap, false)) THEN 0 WHEN found IS NOT NULL THEN found WHEN before = 0 THEN NULL ELSE before END AS duty FROM f""")
def residence_duties(spark, sf_dir):
    f = facts(spark, sf_dir, _DUTY_FACTS, "part")
    return f.select("id", decisions.residence_duty(*[F.col(c) for c in ("found", "land_lease", "capital", "price_cap", "before")]).alias("duty"))


# --- what looks wrong ----------------------------------------------------------------------------------------------------------------

_CHECK_FACTS = f"""SELECT p_partkey AS id, DATE '{TODAY}' + CAST(p_partkey % 5 AS INT) AS notice, CASE WHEN p_partkey % 4 = 0 THEN DATE '{TODAY}' + 3 END AS special_apply, DATE '{TODAY}' + CAST(p_partkey % 7 AS INT) AS apply,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '{TODAY}' + 8 END AS apply_end, DATE '{TODAY}' + 20 AS winner, DATE '{TODAY}' + 30 AS contract, CASE WHEN p_partkey % 9 = 0 THEN DATE '{TODAY}' + 29 END AS balance,
  p_partkey % 8 = 0 AS rental, p_partkey % 16 = 0 AS limits_known, {cases('p_partkey', ['국민', '민영', None])} AS house_dtl, {cases('p_partkey', ['general', 'general', 'remainder'])} AS category, {cases('p_partkey', [n[0] for n in NAMES])} AS name,
  p_size * CAST(2 AS DOUBLE) AS area, CASE WHEN p_partkey % 12 = 0 THEN DATE '{TODAY}' + 4 END AS schedule_special, CASE WHEN p_partkey % 15 = 0 THEN DATE '{TODAY}' + 9 END AS schedule_general, p_partkey % 7 = 1 AS ratio_unread, p_partkey % 7 < 3 AS ratio_by_law,
  '조정' AS reg_kind, CASE WHEN p_partkey % 25 = 0 THEN CAST(120 AS DOUBLE) ELSE p_retailprice / 100 END AS price, CASE WHEN p_partkey % 10 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ext, CAST(p_partkey % 4 AS INT) AS residence_duty,
  p_partkey % 3 = 0 AS capital, p_partkey % 2 = 0 AS price_cap, {cases('p_partkey', ['세대주 요건', '재당첨 제한', None, '실거주 의무'])} AS one, {cases('p_partkey', ['생애최초 특별공급 세대주', None, '일반공급 세대주', ''])} AS head_quote,
  {cases('p_partkey', [None, '신혼부부 특별공급 대상', '일반공급 거주', ''])} AS region_quote, CAST({cases('p_partkey', [0, 5, None])} AS INT) AS households, CAST({cases('p_partkey', [None, 3, 0, 2, None])} AS INT) AS special_total, p_partkey % 3 = 1 AS regulated, p_partkey % 2 = 1 AS need_head,
  {cases('p_partkey', ['lotto', 'unknown', 'pass', None])} AS grade, {cases('p_partkey', [1.5, 0.25, -0.75, None])} * CAST(1 AS DOUBLE) AS rate, CAST({cases('p_partkey', [2, 8, 1, 3])} AS INT) AS mkt_count, {cases('p_partkey', ['same_complex', 'district_newbuild'])} AS mkt_basis,
  CASE WHEN p_partkey % 3 = 0 THEN DATE '{TODAY}' - 300 ELSE DATE '{TODAY}' - 10 END AS comp_date, {cases('p_partkey', ['무순위', '불법행위 재공급'])} AS kind, {cases('p_partkey', ['서울', '', '경기', None, '부산'])} AS sido,
  CASE WHEN p_partkey % 14 = 0 THEN CAST(50 AS DOUBLE) WHEN p_partkey % 14 = 1 THEN NULL ELSE CAST(37 AS DOUBLE) END AS lat, CAST(127 AS DOUBLE) AS lng FROM part"""


def _check(condition: str, message: str) -> str:
    return f"SELECT id, {message} AS message FROM f WHERE {condition}"


_CHECKS = " UNION ALL ".join([
    _check("notice > start", "'날짜 순서가 이상해요 (공고일 ' || notice || ' > 접수 시작 ' || start || ')'"),
    _check("rental AND NOT limits_known", "'공공임대 일반공급 소득·총자산 기준을 공고문에서 읽지 못했어요 (화면은 확인 필요)'"),
    _check("NOT rental AND house_dtl = '국민' AND category = 'general' AND NOT contains(coalesce(name, ''), '신혼희망타운') AND area <= 60 AND NOT limits_known", "'공공분양 60㎡ 이하 일반공급 소득·자산 기준을 공고문에서 읽지 못했어요 (화면은 확인 필요)'"),
    _check("schedule_special <> special_apply", "'특별공급 접수일이 청약홈(' || special_apply || ')과 공고문(' || schedule_special || ')에서 달라요'"),
    _check("schedule_general <> apply_end", "'접수 마감일이 청약홈(' || apply_end || ')과 공고문 일반공급(' || schedule_general || ')에서 달라요'"),
    _check("house_dtl = '민영' AND ratio_unread", "'가점제·추첨제 비율 표를 공고문에서 읽지 못했어요 (화면은 비율 없이 안내)'"),
    _check("house_dtl = '민영' AND NOT ratio_unread AND ratio_by_law", "'가점제·추첨제 비율 표를 공고문에서 읽지 못해 법령 기준(주택공급에 관한 규칙 제28조, 조정)으로 추정했어요'"),
    _check("balance < contract", "'잔금일(' || balance || ')이 계약일(' || contract || ')보다 빨라요'"), _check("price > 100", "'분양가 120억이 범위를 벗어나요'"), _check("ext >= price * 0.1", "'확장비 2.5억이 분양가 대비 이상해요'"),
    _check("residence_duty > 0 AND NOT (capital AND price_cap) AND NOT (coalesce(one, '') = '실거주 의무' AND contains(coalesce(name, ''), '토지임대부'))", "'실거주 의무가 수도권 분양가상한제 주택이 아닌데 붙어 있어요'"),
    _check("one = '세대주 요건' AND id % 4 = 0", "'세대주 요건의 근거 문장이 특별공급 대상자 문장이에요 — 일반공급 조건이 맞는지 원문 확인 필요'"),
    _check("households > 0 AND id % 4 = 1", "'거주 지역 요건의 근거 문장이 특별공급 대상자 문장이에요 — 일반공급 거주 요건이 맞는지 원문 확인 필요'"),
    _check("regulated AND coalesce(one, '') <> '세대주 요건' AND need_head AND NOT (coalesce(households, 0) = 0 AND coalesce(special_total, 0) > 0)", "'세대주 요건을 공고문에서 확인하지 못해 규제지역 기준으로 추정했어요'"),
    _check("coalesce(one, '') <> '재당첨 제한' AND (regulated OR price_cap)", "'재당첨 제한 기간을 공고문에서 확인하지 못해 추정했어요'"),
    _check("coalesce(grade, '') <> 'unknown' AND mkt_count < 3 AND NOT (mkt_basis = 'same_complex' AND mkt_count = 2)", "'시세 근거 거래가 ' || mkt_count || '건뿐이에요'"),
    _check("coalesce(grade, '') <> 'unknown' AND (rate > CASE WHEN id % 2 = 1 AND mkt_basis = 'same_complex' THEN 2.5 ELSE 1 END OR rate < -0.5)", "'마진율 ' || CAST(CAST(rate * 100 AS INT) AS VARCHAR) || '%는 이례적이에요. 시세 근거를 확인하세요'"),
    _check(f"coalesce(grade, '') <> 'unknown' AND comp_date < DATE '{TODAY}' - 217", "'시세 근거에 기간을 벗어난 거래가 섞여 있어요'"),
    _check("kind = '불법행위 재공급' AND coalesce(households, 0) = 0 AND special_total IS NULL", "'재공급 물량(특별공급 세대수)을 공고문 공급대상 표에서 읽지 못했어요 — 모집공고문 확인'"),
    _check("coalesce(sido, '') = ''", "'주소에서 시·도를 찾지 못했어요'"), _check("lat > 39", "'지도 좌표가 국내 범위를 벗어나요'"),
])


@query(f"WITH f AS (SELECT *, coalesce(special_apply, apply) AS start FROM ({_CHECK_FACTS})) SELECT * FROM ({_CHECKS})")
def listing_checks(spark, sf_dir):
    f = facts(spark, sf_dir, _CHECK_FACTS, "part")
    comp = F.struct(F.lit(10.0).alias("amount"), F.col("comp_date").alias("date"))
    f = f.withColumns({"comps": F.array(comp, F.struct(F.lit(11.0).alias("amount"), F.col("comp_date").alias("date"))), "from_notice": F.array_compact(F.array("one")), "conflicts": F.lit(None).cast("array<string>")})
    return checks.listing_checks(f, F.lit(TODAY).cast("date")).select("id", "message")


# --- listings times profiles -----------------------------------------------------------------------------------------------------------

PROFILES = [
    {"name": "head", "seoul": True, "married": True, "spouse_own": False, "household": "head", "account": "yes", "income": 4000.0, "spouse_income": 3000.0, "cash": 32500.0},
    {"name": "child", "seoul": True, "married": False, "household": "parents", "parents_own": True, "parents_60": True, "account": "no", "income": 6000.0, "cash": 1000.0, "family": 500.0},
    {"name": "owner", "seoul": False, "self_own": True, "married": True, "spouse_own": True, "household": "head", "income": 90000.0, "loan_monthly": 100.0, "cash": 90000.0, "recent_win": True},
]
_JUDGED_FACTS = f"""SELECT p_partkey AS id, {cases('p_partkey', ['서울', '경기', '지방'])} AS region, p_partkey % 4 = 0 AS need_head, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE DATE '{TODAY}' END AS notice, p_partkey % 5 > 1 AS need_account,
  {cases('p_partkey', [None, None, '신혼부부', None, '청년'])} AS target, p_retailprice / 100 AS price, CAST(0.1 AS DOUBLE) AS ext, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / 100 + p_partkey % 9 - 2 END AS mkt_low,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / 100 + p_partkey % 9 END AS mkt_base, p_partkey % 13 = 0 AS land_lease, CAST(500000 AS DOUBLE) AS land_rent, CAST(0.025 AS DOUBLE) AS land_rent_rate, CAST({cases('p_partkey', [0, None, 3])} AS INT) AS residence_duty,
  p_partkey % 2 = 0 AS regulated, p_partkey % 3 < 2 AS capital, p_partkey % 6 = 0 AS jeonse_weak, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(5 AS DOUBLE) END AS jeonse, CAST(0.1 AS DOUBLE) AS contract_rate FROM part"""
_A = "((1 - pow(1 + 0.07 / 12, -360)) / (0.07 / 12))"


@query(f"""WITH pr(profile, seoul, married, head, folks, home, account, income, repaid, have, cash, won) AS (VALUES ('head', true, true, true, false, '', 'yes', 0.7, 0.0, 3.25, 3.25, false), ('child', true, false, false, true, '', 'no', 0.6, 0.0, 0.15, 0.1, false),
  ('owner', false, true, true, false, '본인 명의 주택, 배우자 명의 주택', '', 9.0, 0.12, 9.0, 9.0, true)), j AS (SELECT f.*, pr.*, price + 0.1 + (price + 0.1) * 1.1 * CASE WHEN price + 0.1 <= 6 THEN 0.01 WHEN price + 0.1 <= 9 THEN ((price + 0.1) * 2 / 3 - 3) / 100 ELSE 0.03 END AS total FROM ({_JUDGED_FACTS}) f, pr),
s AS (SELECT *, CASE WHEN region = '서울' AND NOT seoul THEN 'fail' WHEN region = '지방' OR NOT seoul THEN 'warn' ELSE 'ok' END AS s1, CASE WHEN home <> '' THEN 'fail' ELSE 'ok' END AS s2, CASE WHEN NOT need_head THEN 'na' WHEN head THEN 'ok' ELSE 'fail' END AS s3,
  CASE WHEN NOT need_account THEN 'na' WHEN account = 'yes' THEN 'ok' WHEN account = 'no' THEN 'fail' ELSE 'warn' END AS s4, CASE WHEN won THEN 'fail' ELSE 'ok' END AS s5, CASE WHEN target = '신혼부부' THEN CASE WHEN married THEN 'ok' ELSE 'fail' END WHEN target IS NOT NULL THEN 'warn' ELSE 'na' END AS s6,
  least(greatest(0, income * 0.4 - repaid) / 12 * {_A}, least(price, coalesce(mkt_base, price)) * CASE WHEN regulated THEN 0.4 ELSE 0.7 END,
    CASE WHEN regulated THEN CASE WHEN coalesce(mkt_base, price) <= 15 THEN 6 WHEN coalesce(mkt_base, price) <= 25 THEN 4 ELSE 2 END WHEN capital THEN 6 ELSE 1e300 END) AS loan,
  CASE WHEN residence_duty IS NULL THEN 'check' WHEN residence_duty > 0 OR (regulated AND capital) OR jeonse_weak OR jeonse IS NULL THEN 'cond' ELSE 'ok' END AS lease,
  CASE WHEN land_lease OR mkt_low IS NULL THEN 'unknown' WHEN mkt_low - total >= 5 OR (mkt_low - total) / total >= 0.3 THEN 'lotto' WHEN mkt_low - total >= 1 THEN 'consider' WHEN mkt_low - total >= 0 THEN 'flat' ELSE 'pass' END AS grade FROM j),
g AS (SELECT *, coalesce(total - jeonse - have, total - loan - have) AS gap, CASE WHEN 'fail' IN (s1, s2, s3, s4, s5, s6) THEN 'no' WHEN 'warn' IN (s1, s2, s3, s4, s5, s6) THEN 'unsure' ELSE 'ok' END AS outcome FROM s)
SELECT id, profile, outcome, CASE WHEN s1 = 'fail' THEN '서울 거주자만 신청할 수 있어요.' WHEN s2 = 'fail' THEN '세대에 주택 소유자가 있어요 (' || home || ').' WHEN s3 = 'fail' THEN CASE WHEN notice IS NULL THEN '세대주가 아니에요.' ELSE '모집공고일(' || notice || ') 기준 세대주가 아니에요. 지금 바꿔도 이번 공고에는 반영되지 않아요.' END
  WHEN s4 = 'fail' THEN '1순위 청약통장 요건을 채우지 못했어요.' WHEN s5 = 'fail' THEN '재당첨 제한 기간이에요.' WHEN s6 = 'fail' THEN '신혼부부 대상 공급이에요. 혼인신고를 한 신혼부부만 신청할 수 있어요' ELSE '' END AS reason,
  CASE WHEN s3 <> 'fail' THEN '' WHEN folks THEN '부모님이 모두 만 60세 이상이라 세대주만 본인으로 변경하면 무주택 세대주가 돼요. 다음 공고부터 적용돼요.' ELSE '다음 공고의 모집공고일 전에 세대주가 되어 두세요. 전입신고로 세대를 만들 때는 실제로 살아야 해요.' END AS fix,
  grade, lease, round(loan, 6) AS loan, round(gap, 6) AS gap, cash >= (price + 0.1) * 0.1 AS contract_ok, CASE WHEN outcome = 'no' THEN '신청 불가' WHEN grade IN ('pass', 'flat') THEN '자격은 되지만 마진 부족' WHEN grade = 'unknown' THEN '시세 확인 필요' WHEN gap > 0 THEN '자금 부족' ELSE '넣어도 돼요' END AS verdict FROM g""")
def judged_profiles(spark, sf_dir):
    found = judging.judge(facts(spark, sf_dir, _JUDGED_FACTS, "part"), PROFILES)
    return found.select(
        "id", "profile", "outcome", "reason", "fix", "grade", "lease", F.round("loan", 6).alias("loan"), F.round("gap", 6).alias("gap"), "contract_ok",
        F.when(F.col("verdict").startswith("자금"), "자금 부족").otherwise(F.col("verdict")).alias("verdict"),
    )


_CAP = "CASE WHEN two_earn THEN {} ELSE {} END"


@query(f"""{_SPECIAL}, h AS (SELECT *, coalesce(household, '') = 'parents' AND coalesce(parents_own, false) AS par, coalesce(parents_60, false) AS p60 FROM b)
SELECT id, CASE WHEN coalesce(owns, false) OR (coalesce(married, false) AND coalesce(spouse_owns, false)) OR (par AND NOT p60) OR coalesce(owner, '') = 'other' THEN 'fail' WHEN coalesce(household_homes, '') IN ('1', '2+') AND NOT (par AND p60) THEN 'warn' ELSE 'ok' END AS homeless,
  CASE WHEN mon <= {_lim(_CAP.format(200, 100) + ' + r')} THEN 'ok' WHEN mon > {_lim(_CAP.format(200, 100) + ' + CASE WHEN coalesce(relax, 1) = 0 THEN 0 ELSE 20 END')} THEN 'fail' ELSE 'warn' END AS income,
  CASE WHEN mon <= {_lim(_CAP.format(200, 130))} THEN 'ok' ELSE 'fail' END AS town_income,
  CASE WHEN assets <= 36200 OR (coalesce(relax, 0) > 0 AND assets <= 39700) THEN 'ok' WHEN coalesce(relax, 1) = 0 OR assets > 43100 THEN 'fail' ELSE 'warn' END AS town_assets,
  CASE WHEN {_m('account_since', _R)} >= 24 THEN 'ok' ELSE 'fail' END AS account_period FROM h""")
def general_supply_states(spark, sf_dir):
    f, p = _profile(spark, sf_dir)
    town = decisions.town_limits(p, p["size"])
    account = decisions.first_rank_account(p["account_since"], F.lit(300), F.lit("서울"), F.lit(_REF).cast("date"), F.lit(24))
    return f.select(
        "id", decisions.homeless_household(p).alias("homeless"), decisions.public_general_income(p, p["size"]).alias("income"), town["income"].alias("town_income"),
        town["assets"].alias("town_assets"), account["period"].alias("account_period"),
    )
