"""Registered queries of rental tiers. Customers are persons and suppliers are notices of their nation; what they say are sums of their keys, which both engines read alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthline.functions import rents
from hearthline.operators import lineage, readings, tiers
from hearthline.plans.registry import cases, facts, query


def _days(key: str, a: int, n: int, back_from: str) -> str:
    return f"DATE '{back_from}' - CAST(({key} * {a}) % {n} AS INT)"


_k, _s = "c_custkey", "s_suppkey"
_PERSON = f"""SELECT c_custkey AS person, c_nationkey AS nation,
  CASE WHEN {_k} % 23 = 0 THEN NULL ELSE {_days(_k, 131, 26000, '2012-03-01')} END AS birth, {cases(f'({_k} * 7)', [True, False, True, False, None])} AS married,
  CASE WHEN {_k} % 5 = 1 THEN NULL ELSE {_days(_k, 977, 5200, '2026-08-01')} END AS married_on, {cases(f'({_k} * 3)', [False, False, True, None, False, False, False])} AS pregnant,
  CASE WHEN {_k} % 3 = 0 THEN NULL ELSE {_days(_k, 389, 4400, '2026-07-01')} END AS youngest_birth, {cases(f'({_k} * 11)', [0, 1, 2, None, 0, 3])} AS minors, {cases(f'({_k} * 5)', [None, 0, 1, 2])} AS births,
  {cases(f'({_k} * 13)', ['head', 'parents', 'head', 'spouse', '', 'head', 'head'])} AS household, {cases(f'({_k} * 17)', [1, 2, 3, 4, 1, None, 9, 1])} AS size, {cases(f'({_k} * 19)', [0, None, 0, 1, 0])} AS elders,
  {cases(f'({_k} * 2)', [0, 0, None, 1, 0, 0, 0, 0, 0])} AS children_on_deed, {cases(f'({_k} * 29)', [False, False, False, None, False, True, False, False, False, False, False])} AS own,
  {cases(f'({_k} * 31)', [False, None, False, True, False, False])} AS spouse_own, {cases(f'({_k} * 37)', [False, None, True])} AS parents_own, {cases(f'({_k} * 41)', ['0', '0', '', '0', '1', '0', '2+', '0', '0', '0', '0', '0', '0'])} AS homes,
  {cases(f'({_k} * 43)', [None, True, False])} AS home_outside, {cases(f'({_k} * 47)', ['서울', '부산', '경기', '경기', '', '경기', '부산'])} AS province, {cases(f'({_k} * 53)', ['수원시', '경기도 의정부시', '수원', '', '영통구', '가평군 청평면', '수원시 영통구', '전주시, 수원시'])} AS city,
  {cases(f'({_k} * 59)', ['all', 'saving', 'none', '', 'deposit', 'all', 'all'])} AS account, {_days(_k, 61, 700, '2026-08-20')} AS account_since, {cases(f'({_k} * 67)', [0, 5, 6, None, 30])} AS payments,
  CASE WHEN {_k} % 17 = 0 THEN 0 ELSE {_k} * 7919 % 9000 END AS income, CASE WHEN {_k} % 4 < 2 THEN 0 ELSE {_k} * 104729 % 5000 END AS spouse_income, CASE WHEN {_k} % 7 = 0 THEN NULL ELSE {_k} * 15485863 % 14000 END AS household_income,
  CASE WHEN {_k} % 11 = 0 THEN NULL ELSE {_k} * 86028121 % 40000 END AS own_asset, CASE WHEN {_k} % 13 = 0 THEN NULL ELSE {_k} * 32452843 % 30000 END AS real_estate, CASE WHEN {_k} % 14 = 0 THEN NULL ELSE {_k} * 49979687 % 6000 END AS car,
  {cases(_k, [0, 2000, 0, 500])} AS cash, {cases(_k, [0, 100, 200])} AS liquid, {cases(_k, [0, 3000])} AS deposit, {cases(_k, [0, 50, None, 20, 10])} AS insurance, 0 AS other_finance, 0 AS other_asset,
  CASE WHEN {_k} % 6 = 0 THEN NULL ELSE {_k} * 67867967 % 4000 END AS debt, {cases(f'({_k} * 71)', [True, None, False])} AS student, {cases(f'({_k} * 73)', [True, None, False, True])} AS student_income,
  {cases(f'({_k} * 79)', [True, None, False])} AS single_parent, {cases(f'({_k} * 83)', [None, True, False])} AS engaged, {cases(f'({_k} * 89)', [True, False, None])} AS minor_head,
  {cases(f'({_k} * 97)', [True, None, False])} AS long_worker, {_k} % 4 <> 2 AS told FROM customer"""
_NOTICE = f"""SELECT s_suppkey AS notice, s_nationkey AS nation, CASE WHEN {_s} % 3 = 0 THEN '공공임대' ELSE '국민임대' END AS kind, {_days(_s, 11, 60, '2026-09-20')} AS reference, {_s} % 4 = 1 AS engaged_ok,
  {_s} % 5 = 2 AS homeless_relaxed, {_s} % 10 = 2 AS homeless_one, {cases(f'({_s} * 3)', [None, '경기', '부산', '경기'])} AS local_province, {cases(f'({_s} * 3)', [None, '수원시', None, '가평군'])} AS local_city, {_s} % 7 = 3 AS others_check,
  {_s} % 6 = 5 AS other_cities_check, {_s} % 8 = 7 AS with_account, {cases(_s, [None, 'none', None, 'table', None])} AS birth_bonus, {_s} % 9 = 4 AS relaxed FROM supplier"""
TIERS = ["청년", "대학생", "고령자", "신혼부부·한부모", "일반", "장기종사자", "다자녀"]
_TIERS = f"""SELECT *, CAST(i AS INT) AS ord, {cases('(notice + i)', TIERS)} AS tier, {cases('(notice * 3 + i)', ['self', 'household', 'self_or_household', 'household_or_single_self', 'self_unclear', 'household', ''])} AS homeless,
  (notice + 2 * i) % 5 = 3 AS income_excluded, 60 + 10 * ((notice + i) % 5) AS pct, CASE WHEN (notice + i) % 3 = 1 THEN 20 END AS dual_add, 21000 + 1000 * (notice % 9) AS asset, (notice + i) % 6 = 5 AS asset_excluded,
  CASE WHEN (notice + i) % 11 = 6 THEN 0 ELSE 4542 END AS car, (notice + i) % 4 = 2 AS newcomer, (notice + i) % 9 = 8 AS lower_tiers FROM n"""
_FACTS = f"WITH p AS ({_PERSON}), n AS (SELECT *, unnest_i AS i FROM ({_NOTICE}) x, (SELECT 0 AS unnest_i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) y), g AS ({_TIERS}) SELECT p.*, g.* FROM p JOIN g ON p.nation = g.nation"

# the same rules by cases, each state by itself
_mon = "(year * 10000 / 12.0)"
_bcheck = lambda v, lim, ten, twenty: (
    f"CASE WHEN bonus IS NULL THEN 'check' WHEN bonus = 0 THEN 'no' WHEN birth_bonus = 'table' THEN CASE WHEN {v} <= (CASE bonus WHEN 10 THEN {ten} ELSE {twenty} END) THEN 'ok' ELSE 'no' END WHEN {v} <= {lim} * (1 + bonus / 100.0) THEN 'check' ELSE 'no' END")
_own_home = "CASE WHEN NOT homeless_relaxed THEN 'no' WHEN home_outside IS NULL THEN 'check' WHEN home_outside THEN 'ok' ELSE 'no' END"
_two = "CASE WHEN homes = '2+' THEN 'no' ELSE 'check' END"
_yn = lambda c: f"CASE WHEN {c} IS NULL THEN 'check' WHEN {c} THEN 'ok' ELSE 'no' END"
RULES_SQL = {
    "unknown": "CASE WHEN tier = '다자녀' THEN 'check' END",
    "youth": "CASE WHEN tier = '청년' THEN CASE WHEN age IS NULL THEN 'check' WHEN age BETWEEN 19 AND 39 THEN 'ok' WHEN newcomer THEN 'check' ELSE 'na' END END",
    "unmarried": "CASE WHEN tier IN ('청년', '대학생') THEN CASE WHEN married THEN 'na' WHEN married IS NULL THEN 'check' END END",
    "student": "CASE WHEN tier = '대학생' THEN CASE WHEN student IS NULL THEN 'check' WHEN NOT student THEN 'na' END END",
    "elder": "CASE WHEN tier = '고령자' THEN CASE WHEN age IS NULL THEN 'check' WHEN age < 65 THEN 'na' END END",
    "wed": """CASE WHEN tier = '신혼부부·한부모' THEN CASE WHEN married IS NULL THEN 'check'
      WHEN married THEN CASE WHEN coalesce(married_on >= seven, false) OR coalesce(youngest_birth > seven, false) THEN 'ok' WHEN married_on IS NULL OR (youngest_birth IS NULL AND coalesce(minors, 1) > 0) THEN 'check' ELSE 'na' END
      WHEN coalesce(minors, 0) > 0 AND coalesce(single_parent, true) THEN CASE WHEN single_parent IS NULL OR youngest_birth IS NULL THEN 'check' WHEN youngest_birth > seven THEN 'ok' ELSE 'na' END
      WHEN engaged_ok AND coalesce(engaged, false) THEN 'ok' ELSE 'na' END END""",
    "family": "CASE WHEN tier = '장기종사자' THEN CASE WHEN minors = 0 THEN 'na' WHEN size IS NULL OR minors IS NULL THEN 'check' WHEN size < 3 THEN 'na' END END",
    "note": f"CASE WHEN tier = '장기종사자' THEN {_yn('long_worker')} END",
    "adult": f"CASE WHEN tier NOT IN ('대학생', '청년') THEN CASE WHEN age IS NULL THEN 'check' WHEN age >= 19 THEN 'ok' WHEN household = '' THEN 'check' WHEN household <> 'head' THEN 'no' ELSE {_yn('minor_head')} END END",
    "homeless": f"""CASE scope WHEN 'self' THEN CASE WHEN own THEN CASE WHEN homeless_relaxed AND homeless_one AND homes <> '1' THEN {_two} ELSE {_own_home} END WHEN own IS NULL THEN 'check' ELSE 'ok' END
      WHEN 'household' THEN CASE WHEN homes = '0' AND owners > 0 THEN 'check'
        WHEN owners > 0 OR homes IN ('1', '2+') THEN CASE WHEN homeless = 'self_unclear' AND (CASE WHEN homeless_relaxed AND homeless_one AND homes <> '1' THEN {_two} ELSE {_own_home} END) = 'no' THEN 'check'
          WHEN homeless_relaxed AND homeless_one AND homes <> '1' THEN {_two} ELSE {_own_home} END
        WHEN homes = '0' AND ((NOT couple AND married = false) OR spouse_own = false) THEN 'ok' WHEN homes = '0' AND couple AND spouse_own IS NULL THEN 'check'
        WHEN size = 1 AND NOT at_home AND coalesce(children_on_deed, 0) = 0 AND own = false AND married = false AND NOT couple THEN 'ok' ELSE 'check' END ELSE 'check' END""",
    "place": f"""CASE WHEN local_province IS NOT NULL THEN CASE WHEN province = '' THEN 'check' WHEN province <> local_province THEN CASE WHEN others_check THEN 'check' ELSE 'no' END WHEN local_city IS NULL THEN 'ok' WHEN city = '' THEN 'check'
      ELSE CASE (CASE local_city WHEN '수원시' THEN {cases('k', ['y', 'n', 'y', '', '?', 'n', 'y', 'y'])} ELSE {cases('k', ['n', 'n', '?', '', '?', 'y', 'n', 'n'])} END) WHEN 'y' THEN 'ok' WHEN 'n' THEN CASE WHEN other_cities_check THEN 'check' ELSE 'no' END ELSE 'check' END END END""",
    "unread": "CASE WHEN kind = '공공임대' AND NOT with_account THEN 'check' END",
    "region": "CASE WHEN with_account THEN CASE WHEN province = '' THEN 'check' WHEN province IN ('경기', '서울') THEN 'ok' ELSE 'no' END END",
    "account": """CASE WHEN with_account THEN CASE WHEN account IN ('none', 'deposit') THEN 'no' WHEN account = '' OR payments IS NULL THEN 'check' WHEN account_months >= 12 AND payments >= 6 THEN 'ok' WHEN account_months >= 6 AND payments >= 5 THEN 'ok' ELSE 'no' END END""",
    "income": f"""CASE WHEN income_excluded THEN CASE WHEN NOT relaxed AND kind <> '공공임대' THEN 'check' END WHEN tier = '대학생' THEN {_yn('student_income')} WHEN n IS NULL OR year IS NULL THEN 'check' WHEN {_mon} <= base * (pct + added) / 100.0 THEN 'ok'
      WHEN dual AND dual_add IS NULL AND {_mon} <= base * (pct + 30) / 100.0 THEN 'check' WHEN may_be_dual AND NOT dual AND (own_income IS NULL OR other_income IS NULL) AND dual_add IS NOT NULL AND {_mon} <= base * (pct + dual_add) / 100.0 THEN 'check'
      WHEN births_may AND birth_bonus IS NULL AND {_mon} <= base * (pct + 20 + added) / 100.0 THEN CASE WHEN bonus IS NULL THEN 'check' WHEN {_mon} <= base * (pct + bonus + added) / 100.0 THEN 'ok' ELSE 'no' END
      WHEN lower_tiers THEN 'check' ELSE 'no' END""",
    "assets": f"""CASE WHEN asset_excluded THEN CASE WHEN NOT relaxed AND kind <> '공공임대' THEN 'check' END
      WHEN tier = '대학생' OR by_self THEN CASE WHEN own_asset IS NULL THEN 'check' WHEN own_asset <= asset THEN 'ok' WHEN births_may AND coalesce(birth_bonus, '') <> 'none' AND own_asset <= most_asset THEN {_bcheck('own_asset', 'asset', 'asset + 2500', 'asset + 5000')}
        WHEN lower_tiers AND own_asset <= 30000 THEN 'check' ELSE 'no' END
      WHEN total > asset AND debt IS NOT NULL AND (NOT (births_may AND coalesce(birth_bonus, '') <> 'none') OR total > most_asset) THEN 'no' WHEN some_missing THEN 'check' WHEN total <= asset THEN CASE WHEN insurance IS NULL THEN 'check' ELSE 'ok' END WHEN debt IS NULL THEN 'check'
      ELSE {_bcheck('total', 'asset', 'asset + 2500', 'asset + 5000')} END""",
    "car": f"""CASE WHEN car_value IS NULL THEN 'check' WHEN car = 0 THEN CASE WHEN car_value > 0 THEN 'no' ELSE 'ok' END WHEN car_value <= car THEN 'ok'
      WHEN births_may AND coalesce(birth_bonus, '') <> 'none' AND car_value <= (CASE WHEN birth_bonus = 'table' THEN 5400 ELSE 5450 END) THEN {_bcheck('car_value', 'car', '5000', '5400')} ELSE 'no' END""",
}
_told = lambda c, zero: f"CASE WHEN {c} <> {zero} OR told THEN {c} END"
_STATED = f"""f AS ({_FACTS.replace('SELECT p.*, g.* FROM', 'SELECT p.* EXCLUDE (nation, spouse_own, cash, liquid, deposit, car, pregnant), p.car AS car_value, g.* EXCLUDE (nation), (p.person * 53) % 8 AS k, ' + ", ".join(f"{_told(f'p.{c}', z)} AS {c}" for c, z in (('spouse_own', 'false'), ('cash', '0'), ('liquid', '0'), ('deposit', '0'))) + ', p.pregnant, ' + _told('p.income', '0') + ' AS own_income, ' + _told('p.spouse_income', '0') + ' AS other_income FROM')}),
a AS (SELECT *, CAST(date_part('year', reference) - date_part('year', birth) - CASE WHEN strftime(reference, '%m%d') < strftime(birth, '%m%d') THEN 1 ELSE 0 END AS INT) AS age, CAST(reference - INTERVAL 84 MONTH AS DATE) AS seven,
  (date_part('year', reference) - date_part('year', account_since)) * 12 + date_part('month', reference) - date_part('month', account_since) - CASE WHEN date_part('day', reference) < date_part('day', account_since) THEN 1 ELSE 0 END AS account_months,
  coalesce(married, false) OR (tier = '신혼부부·한부모' AND married = false AND engaged_ok AND coalesce(engaged, false)) AS couple, household = 'parents' OR coalesce(elders, 0) > 0 AS at_home,
  tier = '청년' AND household = 'parents' AS by_self,
  coalesce(youngest_birth >= DATE '2023-03-28', false) OR coalesce(pregnant, false) OR coalesce(births, 0) > 0 OR NOT (births IS NOT NULL OR ((youngest_birth IS NOT NULL OR coalesce(minors = 0, false)) AND pregnant IS NOT NULL)) AS births_may,
  CASE WHEN births = 0 THEN 0 WHEN births = 2 THEN 20 WHEN births = 1 THEN CASE WHEN minors >= 2 THEN 20 ELSE 10 END END AS bonus,
  coalesce(real_estate, 0) + coalesce(cash, 0) + coalesce(liquid, 0) + coalesce(insurance, 0) + coalesce(deposit, 0) + coalesce(car_value, 0) - coalesce(debt, 0) AS total,
  real_estate IS NULL OR car_value IS NULL OR cash IS NULL OR liquid IS NULL OR deposit IS NULL AS some_missing, CASE WHEN birth_bonus = 'table' THEN asset + 5000 ELSE asset * 1.2 END AS most_asset FROM f),
b AS (SELECT *, CASE WHEN homeless IN ('self', 'household') THEN homeless WHEN homeless = 'self_unclear' THEN CASE WHEN own THEN 'self' ELSE 'household' END
    WHEN homeless = 'self_or_household' THEN CASE WHEN married THEN 'household' WHEN married = false THEN 'self' END
    WHEN homeless = 'household_or_single_self' THEN CASE WHEN married = false AND household = 'head' AND size = 1 AND coalesce(elders, 0) = 0 AND coalesce(children_on_deed, 0) = 0 THEN 'self' WHEN married IS NOT NULL AND size IS NOT NULL AND household <> '' THEN 'household' END END AS scope,
  CASE WHEN own THEN 1 ELSE 0 END + CASE WHEN couple AND spouse_own THEN 1 ELSE 0 END + CASE WHEN at_home AND parents_own THEN 1 ELSE 0 END AS owners, CASE WHEN by_self THEN 1 ELSE size END AS n,
  couple AND (tier = '신혼부부·한부모' OR dual_add IS NOT NULL) AS may_be_dual FROM a),
c AS (SELECT *, may_be_dual AND coalesce(own_income, 0) > 0 AND coalesce(other_income, 0) > 0 AS dual, CASE n WHEN 1 THEN 3813363 WHEN 2 THEN 5866270 WHEN 3 THEN 8168429 WHEN 4 THEN 8802202 WHEN 9 THEN 11064819 + 579278 END AS base,
  CASE WHEN by_self THEN own_income WHEN household_income IS NOT NULL THEN household_income WHEN n = 1 AND married = false AND household = 'head' THEN own_income END AS year FROM b),
d AS (SELECT *, CASE WHEN dual THEN coalesce(dual_add, 0) ELSE 0 END AS added FROM c),
s AS (SELECT person, notice, ord, tier, {", ".join(f"CASE WHEN tier = '다자녀' AND '{n}' <> 'unknown' THEN NULL ELSE {c} END AS r_{n}" for n, c in RULES_SQL.items())} FROM d),
states AS (SELECT person, notice, ord, tier, CASE {" ".join(f"WHEN '{x}' IN ({', '.join(f'coalesce(r_{n}, {chr(39)}{chr(39)})' for n in RULES_SQL)}) THEN '{x}'" for x in ("na", "no", "check"))} ELSE 'ok' END AS state FROM s)"""


def _persons_and_notices(spark, sf_dir):
    f, c = facts(spark, sf_dir, _PERSON, "customer", dealt={"customer": ("c_custkey",)}), F.col
    told = F.when(c("told"), F.array(*[F.lit(z) for z in tiers.ZEROS])).otherwise(F.array().cast("array<string>"))
    persons = f.select("person", "nation", F.struct(*[x for x in f.columns if x not in ("person", "nation", "told")], told.alias("entered")).alias("p"))
    g = spark.sql(f"SELECT g.* FROM ({_TIERS.replace('FROM n', 'FROM (SELECT *, explode(array(0, 1, 2, 3)) AS i FROM {notices})')}) g", notices=facts(spark, sf_dir, _NOTICE, "supplier"))
    youth, long_worker = c("tier") == "청년", c("tier") == "장기종사자"
    local = F.when(c("local_province").isNotNull(), F.struct(c("local_province").alias("province"), c("local_city").alias("city"), F.lit(None).cast("string").alias("also"), "others_check", "other_cities_check"))
    account = F.when(c("with_account"), F.struct(F.lit(False).alias("none"), F.lit(12).alias("months"), F.lit(6).alias("payments"), F.lit(False).alias("second_any"), F.lit(6).alias("second_months"), F.lit(5).alias("second_payments")))
    terms = F.struct("kind", "reference", "engaged_ok", "homeless_relaxed", "homeless_one", local.alias("local"), account.alias("account"), F.when(c("with_account"), F.array(F.lit("경기"), F.lit("서울"))).alias("regions"), "birth_bonus", "relaxed")
    tier = F.struct(
        c("tier").alias("key"), F.when(youth, 19).when(c("tier") == "고령자", 65).alias("age_min"), F.when(youth, 39).alias("age_max"), "newcomer", "homeless", "income_excluded", F.array(*[c("pct").cast("double")] * 3).alias("income_pct"), c("dual_add").cast("double").alias("dual_add"),
        "asset", "asset_excluded", F.struct((c("asset") + 2500).alias("b10"), (c("asset") + 5000).alias("b20")).alias("asset_bonus"), "car", F.struct(F.lit(5000).alias("b10"), F.lit(5400).alias("b20")).alias("car_bonus"), F.when(long_worker, 3).alias("min_family"),
        F.when(long_worker, F.array(F.lit("해당 업종에 장기 종사한 사람"))).alias("notes"), "lower_tiers", F.lit(30000).alias("lower_asset"))
    notices = g.select("notice", "nation", "ord", terms.alias("t"), tier.alias("g"))
    return tiers.prepared(persons, "p"), tiers.prepared(notices, "t")


def _rows(spark, sf_dir, parts=False):
    """Every pair judged by itself; tests hold the queries against it."""
    persons, notices = _persons_and_notices(spark, sf_dir)
    return tiers.judge(lineage.spread(persons, "person").join(notices, "nation").drop("nation"), parts)


def _judged(spark, sf_dir):
    return tiers.Judged(*_persons_and_notices(spark, sf_dir), "nation")


_SQL = f"WITH {_STATED}"


@query(f"{_SQL} SELECT person, notice, tier, state FROM states")
def rental_tiers(spark, sf_dir):
    """Every person for every tier of the notices of their nation."""
    return _judged(spark, sf_dir).states().select("person", "notice", "tier", "state")


@query(f"{_SQL} SELECT person, notice, tier, state FROM states QUALIFY row_number() OVER (PARTITION BY person, notice ORDER BY CASE state WHEN 'ok' THEN 1 WHEN 'check' THEN 2 WHEN 'no' THEN 3 ELSE 4 END, ord) = 1")
def rental_best_tier(spark, sf_dir):
    return _judged(spark, sf_dir).best()


_COUNTED = {"youth": "age", "unmarried": "unmarried", "student": "student", "elder": "age", "wed": "wed", "family": "family", "note": "note", "adult": "adult", "homeless": "homeless", "place": "place", "unread": "unread", "region": "region", "account": "account", "income": "income", "assets": "assets", "car": "car", "unknown": "tier"}


@query(f"""{_SQL}, r AS ({" UNION ALL ".join(f"SELECT tier, '{name}' AS rule, r_{n} AS state FROM s" for n, name in _COUNTED.items())})
SELECT tier, rule, state, count(*) AS n FROM r WHERE state IN ('check', 'no', 'na') GROUP BY ALL""")
def rental_tier_reasons(spark, sf_dir):
    """How often each rule stands in the way of a tier."""
    return _judged(spark, sf_dir).counts().where("state <> 'ok'")


# --- rent tables ---------------------------------------------------------------------------------------------------------------------

_TYPES, _TIER_WORDS = ["26A", "36", "46.98B", "59", "84C"], ["고령자", "대학생", "청년(소득 있음)", "주거급여 수급자", "신혼부부"]
_TIER_NAMES = ["고령자", "대학생", "청년(소득 있음)", "주거급여수급자", "신혼부부·한부모"]
#: Orders are notices and their lines rows of a table; one in nine doesn't add up. Layouts: 0 plain, 1 in thousands, 2 the contract part once, 3 the type once, with words and dates between.
_RENTS = f"""SELECT l_orderkey AS notice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS no, l_orderkey % 4 AS layout, {cases('(l_orderkey + l_linenumber)', _TYPES)} AS type, {cases('(l_linenumber * 3 + l_orderkey)', _TIER_WORDS)} AS word,
  {cases('(l_linenumber * 3 + l_orderkey)', _TIER_NAMES)} AS tier, (10 + l_partkey % 90) * 100000 + 1000 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS contract, (10 + l_suppkey * 7 % 900) * 100000 AS balance, 10500 + 1000 * (l_partkey * 13 % 800) AS rent, (l_partkey + l_linenumber) % 9 = 4 AS wrong FROM lineitem"""


@query(f"""WITH r AS ({_RENTS}), first AS (SELECT notice, min(no) AS no FROM r GROUP BY notice), f AS (SELECT r.notice, r.contract, r.type FROM r JOIN first ON r.notice = first.notice AND r.no = first.no),
a AS (SELECT r.notice, r.no, CASE WHEN layout = 3 THEN f.type ELSE r.type END AS type, tier, CASE WHEN layout = 2 THEN f.contract ELSE r.contract END AS contract, balance, rent, wrong AND NOT (layout = 2 AND first.no = r.no) AS wrong
      FROM r JOIN f ON f.notice = r.notice JOIN first ON first.notice = r.notice),
g AS (SELECT notice, type, tier, contract + balance AS deposit, contract, rent, min(no) AS no FROM a WHERE NOT wrong GROUP BY ALL)
SELECT notice, CAST(row_number() OVER (PARTITION BY notice ORDER BY no) AS INT) AS line, type, tier, deposit, contract, rent FROM g""")
def rent_tables(spark, sf_dir):
    """Rows read back out of texts that are made of the lines of orders."""
    r, c = facts(spark, sf_dir, _RENTS, "lineitem", dealt={"lineitem": ("l_orderkey",)}), F.col
    first = F.col("no") == F.min("no").over(Window.partitionBy("notice"))
    r = r.withColumn("first", first).withColumn("own", F.first(F.when(c("first"), c("contract")), ignorenulls=True).over(Window.partitionBy("notice")))
    contract = F.when(c("layout") == 2, c("own")).otherwise(c("contract"))
    deposit = contract + c("balance") + F.when(c("wrong") & ~((c("layout") == 2) & c("first")), 50000).otherwise(0)
    amount = lambda x: F.format_number(F.when(c("layout") == 1, x / 1000).otherwise(x), 0)
    says = F.when((c("layout") == 3) & ~c("first"), "다음").otherwise(c("type"))
    note = F.when(c("layout") == 3, "공고일 2026.10.05 전환 6.5% 적용").otherwise("")
    part = F.when((c("layout") == 2) & ~c("first"), "").otherwise(amount(contract))
    line = F.concat_ws(" ", says, "word", amount(deposit), part, note, amount(c("balance")), F.format_number("rent", 0))
    head = F.when(c("layout") == 1, "(단위: 천원) 임대보증금").otherwise("임대보증금(원) 계약금 잔금 월임대료")
    texts = r.groupBy("notice", head.alias("head")).agg(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))).alias("lines"))
    texts = texts.select("notice", F.concat_ws("\n", "head", F.concat_ws("\n", "lines.line")).alias("body"))
    return rents.rent_rows(texts, "notice", "body")


# --- several readings ------------------------------------------------------------------------------------------------------------------

#: What three tools read of a part's text: its size, container and two marks, each with faults of its own.
_READ = """SELECT p_partkey AS id, p_size AS size_1, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS size_2, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS size_3,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS box_1, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_name END AS box_2, CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE p_name END AS box_3,
  p_partkey % 10 = 1 AS mark_1, p_partkey % 8 = 1 AS mark_2, p_partkey % 6 = 1 AS mark_3 FROM part"""


def _voted(a: str, b: str, c: str) -> str:
    return f"CASE WHEN coalesce({a} = {b}, true) AND coalesce({a} = {c}, true) AND coalesce({b} = {c}, true) THEN coalesce({a}, {b}, {c}) WHEN {a} = {b} OR {a} = {c} THEN {a} WHEN {b} = {c} THEN {b} END"


_sizes, _boxes = ("size_1", "size_2", "size_3"), ("box_1", "box_2", "box_3")


@query(f"""WITH r AS ({_READ}), v AS (SELECT *, {_voted(*_sizes)} AS size, {_voted(*_boxes)} AS box FROM r)
SELECT id, size, box, mark_1 OR mark_2 OR mark_3 AS mark, list_aggregate(list_distinct([box_1, box_2, box_3]), 'count') AS boxes,
  CASE WHEN box IS NULL AND coalesce(box_1, box_2, box_3) IS NOT NULL THEN 'box' ELSE '' END || CASE WHEN size IS NULL AND coalesce(size_1, size_2, size_3) IS NOT NULL THEN ',size' ELSE '' END AS conflicts FROM v""")
def merged_readings(spark, sf_dir):
    """Three readings of each part merged by a walk through their schema."""
    f, c = facts(spark, sf_dir, _READ, "part"), F.col
    one = lambda i: F.struct(F.lit(f"tool {i}").alias("tool"), F.struct(c(f"size_{i}").alias("size"), c(f"box_{i}").alias("box"), c(f"mark_{i}").alias("mark"), F.array_compact(F.array(f"box_{i}")).alias("boxes")).alias("terms"))
    read = f.select("id", F.inline(F.array(*map(one, (1, 2, 3)))))
    merged = readings.merge(read, "id", "tool", "terms", ["tool 1", "tool 2", "tool 3"], either=("mark",))
    conflict = F.transform(F.filter("log", lambda x: x["how"] == readings.CONFLICT), lambda x: x["path"])
    text = F.concat(F.when(F.array_contains(conflict, "box"), "box").otherwise(""), F.when(F.array_contains(conflict, "size"), ",size").otherwise(""))
    return merged.select("id", "terms.size", "terms.box", "terms.mark", F.size("terms.boxes").cast("long").alias("boxes"), text.alias("conflicts"))
