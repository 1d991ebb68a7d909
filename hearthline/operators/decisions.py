"""Decisions about an application: points, special-supply stages, legal ratios, resale, duty. Column expressions with three values.

An answer that isn't known leaves a decision open (warn or null); it never counts as no or zero, unless the rule itself says so.
Money of profiles is in 10,000 won, limits of income in won a month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 100 % of the monthly income by household size (3 or fewer to 8), and what each further person adds.
INCOME_3_TO_8 = (7533763, 8802202, 9326985, 9906263, 10485541, 11064819)
INCOME_ADDED = 579278
# The same by household size from 1 to 8, as rental notices have it.
INCOME_1_TO_8 = (3813363, 5866270, 8168429, 8802202, 9326985, 9906263, 10485541, 11064819)
# Stages of special supply with the limits of one and of two earners, in percent.
PUBLIC_STAGES = {
    "newborn": (("우선공급", 100, 120), ("일반공급", 140, 150), ("추첨", 140, 200)),
    "newlywed": (("우선공급", 100, 120), ("일반공급", 130, 140), ("추첨", 130, 200)),
    "first": (("우선공급", 100, 120), ("일반공급", 130, 140), ("추첨", 130, 200)),
    "multichild": (("우선공급 (배점순)", 120, 130), ("추첨", 120, 200)),
    "elder": (("우선공급", 120, 130), ("추첨", 120, 200)),
}
PRIVATE_STAGES = {
    "newborn": (("우선공급", 130, None), ("일반공급", 160, None)),
    "first": (("우선공급", 130, None), ("일반공급", 160, None)),
    "newlywed": (("우선공급", 100, 120), ("일반공급", 140, 160)),
}
# Limits of real estate and car by the relaxation for births, in percentage points.
ESTATE_LIMITS, CAR_LIMITS = {0: 21550, 10: 23705, 20: 25860}, {0: 4542, 10: 4996, 20: 5451}
PRIVATE_ESTATE = 33100
RENTAL_ASSETS, RENTAL_ASSETS_ONE, RENTAL_ASSETS_MORE = 36200, 39700, 43100
BIRTHS_SINCE = "2023-03-28"
MINOR_RULE_FROM = "2024-01-01"
YOUTH = {"income": 5338708, "own": 27600, "own_more": 34500, "parents": 103500, "account_months": 6, "account_count": 6}

_yes = lambda c: F.coalesce(c, F.lit(False))
_zero = lambda c: F.coalesce(c, F.lit(0))
_any = lambda *cs: reduce(lambda a, b: a | b, cs)
_day = lambda s: F.lit(s).cast("date")


# --- time --------------------------------------------------------------------------------------------------------------------

def whole_months(start: Column, end: Column) -> Column:
    """One less where the end's day is before the start's, with no rule for ends of months."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - (F.day(end) < F.day(start)).cast("int")


def years_later(day: Column, years: int) -> Column:
    """The same day so many years later; from 29 February the 28th."""
    return F.add_months(day, 12 * years)


def account_months(since: Column, birth: Column, ref: Column) -> Column:
    """Months of a savings account: as a minor at most 24 before 2024 and 60 in all; an unknown birth date counts all."""
    adult, cut = years_later(birth, 19), _day(MINOR_RULE_FROM)
    end = F.least(adult, ref)
    before = F.when(since < cut, F.greatest(F.lit(0), whole_months(since, F.least(end, cut)))).otherwise(0)
    after = F.when(end > cut, F.greatest(F.lit(0), whole_months(F.greatest(since, cut), end))).otherwise(0)
    minor = F.least(F.lit(60), F.least(F.lit(24), before) + after)
    whole = whole_months(since, ref)
    grown = F.when(ref > adult, whole_months(adult, ref)).otherwise(0)
    return F.when(birth.isNull() | (since >= adult) | (minor >= before + after), whole).otherwise(grown + minor)


# --- points ------------------------------------------------------------------------------------------------------------------

def account_points(months: Column) -> Column:
    return F.when(months < 6, 1).when(months < 12, 2).when(months.isNotNull(), F.least(F.lit(17), F.floor(months / 12).cast("int") + 2)).cast("int")


def homeless_points(owns: Column, unclear: Column, birth: Column, married_on: Column, sold_on: Column, ref: Column) -> Column:
    """0 to 32 by years without a home since 30 or marriage, or since the last home was sold; null where it isn't known who owns."""
    thirty = years_later(birth, 30)
    start = F.greatest(F.least(thirty, F.coalesce(married_on, thirty)), F.coalesce(sold_on, _day("0001-01-01")))
    years = F.floor(whole_months(start, ref) / 12).cast("int")
    return F.when(owns, 0).when(unclear | birth.isNull(), None).when(ref < start, 0).when(years < 1, 2).otherwise(F.least(F.lit(32), 2 + 2 * years)).cast("int")


def application_points(p: dict[str, Column], ref: Column) -> Column:
    """struct(homeless, dependants, account): p holds a profile's columns (see the keys used here).

    A small or cheap only home, a tiny one or an inherited share counts as none; parents over 60 own nothing; a spouse's account adds up to 3.
    """
    married = _yes(p["married"])
    one_or_more = _yes(p["household_homes"].isin("1", "2+"))
    exempt = ~_yes(p["household_homes"] == "2+") & _yes(p["exemption"].isin("small_apt", "small_villa", "tiny", "inherit"))
    mine = ~exempt & (_yes(p["owns"]) | (married & _yes(p["spouse_owns"])))
    with_parents = _yes(p["household"] == "parents") & _yes(p["parents_own"])
    other = ~mine & ~exempt & ((with_parents & ~_yes(p["parents_60"])) | (one_or_more & _yes(p["owner"] == "other")))
    unclear = ~mine & ~exempt & one_or_more & (F.coalesce(p["owner"], F.lit("")) == "") & ~with_parents
    sold = F.greatest(p["sold_on"], F.when(married, p["spouse_sold_on"]))
    homeless = homeless_points(mine | other, unclear, p["birth"], F.when(married, p["married_on"]), sold, ref)
    own = account_points(account_months(p["account_since"], p["birth"], ref))
    half = whole_months(p["spouse_account_since"], ref) / 2
    with_spouse = F.when(married & own.isNotNull() & p["spouse_account_since"].isNotNull(), F.least(F.lit(17), own + F.when(half < 6, 1).when(half < 12, 2).otherwise(3))).otherwise(own)
    return F.struct(homeless.alias("homeless"), F.when(p["dependants"].isNotNull(), F.least(F.lit(35), 5 + 5 * p["dependants"])).cast("int").alias("dependants"), with_spouse.cast("int").alias("account"))


# --- special supply -------------------------------------------------------------------------------------------------------------

def income_base(size: Column) -> Column:
    """The monthly income of a household that percentages are of."""
    base = F.get(F.lit(list(INCOME_3_TO_8)), F.greatest(F.lit(0), F.least(F.lit(5), size - 3))) + INCOME_ADDED * F.greatest(F.lit(0), size - 8)
    return base.cast("long")


def income_limit(base: Column, percent: Column) -> Column:
    """Rounded as notices' tables are."""
    return F.floor((base * percent + 50) / 100)


def birth_relaxation(pregnant: Column, youngest: Column, minors: Column) -> Column:
    """Percentage points that births add: 10 or 20; 0 where there surely are none; null where it isn't known."""
    new = _yes(pregnant) | _yes(youngest >= _day(BIRTHS_SINCE))
    two = (_zero(minors) >= 2) | (_yes(pregnant) & youngest.isNotNull())
    none = _yes((minors == 0) & ~pregnant) | (_yes(minors > 0) & youngest.isNotNull() & _yes(~pregnant))
    return F.when(new, F.when(two, 20).otherwise(10)).when(none, 0)


def _result(state: Column | str, stage: Column | None = None) -> Column:
    state = F.lit(state) if isinstance(state, str) else state
    return F.struct(state.alias("state"), (F.lit(None).cast("string") if stage is None else stage).alias("stage"))


def _by_relaxation(add: Column, limits: dict[int, int]) -> Column:
    return F.when(add == 10, limits[10]).when(add == 20, limits[20]).otherwise(limits[0])


def _first_stage(ok) -> Column:
    """The name of the first stage, of the column `stages`, that ok(stage) holds for."""
    return F.get(F.filter("stages", ok), F.lit(0))["name"]


def _public(p: dict[str, Column]) -> Column:
    """struct(state, stage) of public special supply: the first stage whose income limit holds, then assets; open where a larger relaxation may apply."""
    month, dual, known, base = (F.col(f"__{c}") for c in ("month", "dual", "relaxed", "base"))
    add = F.coalesce(known, F.lit(0))
    may_be_more = F.coalesce(known.isNull() | (known == 10), F.lit(True))  # 20 is the most, and a known 0 stays
    percent = lambda s: F.when(dual, s["two"]).otherwise(s["one"])
    stage = _first_stage(lambda s: month <= income_limit(base, percent(s) + add))
    over = [(_zero(p["estate"]), _by_relaxation(add, ESTATE_LIMITS), ESTATE_LIMITS[20]), (_zero(p["car"]), _by_relaxation(add, CAR_LIMITS), CAR_LIMITS[20])]
    fails = _any(*[(v > lim) & ~(may_be_more & (v <= most)) for v, lim, most in over])
    open_ = _any(*[v > lim for v, lim, _ in over])
    near = may_be_more & (month <= income_limit(base, percent(F.element_at("stages", -1)) + 20))
    return F.when(stage.isNotNull(), F.when(fails, _result("fail")).when(open_, _result("warn")).otherwise(_result("ok", stage))).otherwise(_result(F.when(near, "warn").otherwise("fail")))


def _private(p: dict[str, Column]) -> Column:
    """struct(state, stage) of private special supply; over the last stage the draw is open to those with little real estate."""
    month, dual, base = (F.col(f"__{c}") for c in ("month", "dual", "base"))
    less = F.least(_zero(p["income"]), _zero(p["spouse_income"])) * 10000 / 12
    alone = lambda s: (F.col("kind") != "newlywed") | ~dual | (less <= income_limit(base, s["one"]))
    found = _first_stage(lambda s: (month <= income_limit(base, F.when(dual, s["two"]).otherwise(s["one"]))) & alone(s))
    stage = F.coalesce(found, F.when(_zero(p["estate"]) <= PRIVATE_ESTATE, "추첨"))
    return F.when(stage.isNotNull(), _result("ok", stage)).otherwise(_result("fail"))


#: Stages of rental special supply: of three or more people, and of two where the notice has its own.
RENTAL_STAGES = {
    "multichild": ((("우선공급 (배점순)", 120, 130), ("추첨", 120, 200)), None),
    "elder": ((("우선공급", 120, 130), ("추첨", 120, 200)), ((130, 140), (130, 200))),
    "first": ((("우선공급", 100, 120), ("일반공급", 130, 140), ("추첨", 130, 200)), ((110, 130), (140, 150), (140, 200))),
    "newlywed": ((("우선공급", 100, 120), ("일반공급", 130, 140), ("추첨", 130, 200)), ((110, 130), (140, 150), (140, 200))),
    "newborn": ((("우선공급", 100, 120), ("일반공급", 140, 150), ("추첨", 140, 200)), ((110, 130), (150, 160), (150, 200))),
}


def _rental(p: dict[str, Column]) -> Column:
    """struct(state, stage) of rental special supply: income by size, and total assets (p["assets"], less debts). Sizes that the notice's table hasn't are open."""
    month, dual, relaxed, base, size = (F.col(f"__{c}") for c in ("month", "dual", "relaxed", "rental_base", "size"))
    dual = dual & (size > 1)
    percent = lambda s: F.when(size == 2, F.when(dual, s["two2"]).otherwise(s["one2"])).otherwise(F.when(dual, s["two"]).otherwise(s["one"]))
    # the notice's tables cut fractions of a won
    stage = _first_stage(lambda s: month <= F.floor(base * percent(s) / 100))
    total = p["assets"]
    over = total > RENTAL_ASSETS
    fails = over & (_yes(relaxed == 0) | (total > RENTAL_ASSETS_MORE))
    open_ = base.isNull() | (over & ~fails & ~(_yes(relaxed > 0) & (total <= RENTAL_ASSETS_ONE)))
    near = F.coalesce(relaxed != 0, F.lit(True)) & (month <= base * (percent(F.element_at("stages", -1)) + 20) / 100)
    return F.when(fails, _result("fail")).when(open_, _result("warn")).when(stage.isNull(), _result(F.when(near, "warn").otherwise("fail"))).otherwise(_result("ok", stage))


def _table(stages: dict, of_two: dict | None = None) -> Column:
    """Array of struct(kind, stages) out of a table of stages: their names and percentages, those of two earners and of two people too."""
    def stage(kind: str, i: int, name: str, one: int, two: int | None) -> Column:
        one2, two2 = of_two[kind][i] if of_two and of_two[kind] else (one, two or one)
        return F.struct(F.lit(name).alias("name"), *[F.lit(v).alias(c) for c, v in (("one", one), ("two", two or one), ("one2", one2), ("two2", two2))])

    return F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*[stage(k, i, *s) for i, s in enumerate(found)]).alias("stages")) for k, found in stages.items()])


def special_supply(df: DataFrame, p: dict[str, Column], size: Column, scheme: str) -> DataFrame:
    """df's rows for each kind of special supply of a scheme (public, private or rental), with kind, state and stage.

    What the kinds share is computed once; a kind's stages come out of a table with it, so that a rule stands in the plan once, not once for each kind and stage.
    """
    tables = {"public": (_table(PUBLIC_STAGES), _public), "private": (_table(PRIVATE_STAGES), _private), "rental": (_table({k: s for k, (s, _) in RENTAL_STAGES.items()}, {k: t for k, (_, t) in RENTAL_STAGES.items()}), _rental)}
    table, rule = tables[scheme]
    shared = df.withColumns({
        "__size": size, "__month": p["household_income"] * 10000 / 12, "__dual": _yes(p["married"]) & _yes(p["income"] > 0) & _yes(p["spouse_income"] > 0),
        "__relaxed": birth_relaxation(p["pregnant"], p["youngest"], p["minors"]), "__base": income_base(size), "__rental_base": F.get(F.lit(list(INCOME_1_TO_8)), size - 1).cast("long"),
    })
    each = shared.select("*", F.inline(table)).withColumn("__r", rule(p))
    return each.select(*df.columns, "kind", "__r.state", "__r.stage")


def youth_special(p: dict[str, Column], ref: Column) -> Column:
    """struct(state, stage) of youth special supply: age 19 to 39, unmarried, never an owner, account, income, own and parents' assets."""
    late, early = F.add_months(ref, -12 * 19), F.add_months(ref, -12 * 40)
    relaxed = birth_relaxation(p["pregnant"], p["youngest"], p["minors"])
    may_relax = F.coalesce(relaxed != 0, F.lit(True))
    rich = _zero(p["income"]) * 10000 / 12 > YOUTH["income"]
    owned = _yes(p["owns"]) | _yes(p["ever_owned"])
    fail = _any(
        _yes((p["birth"] > late) | (p["birth"] <= early)), _yes(p["married"]), owned,
        (whole_months(p["account_since"], ref) < YOUTH["account_months"]) | (_zero(p["account_count"]) < YOUTH["account_count"]),
        rich & ~may_relax, _yes((p["own_assets"] > YOUTH["own"]) & ~(may_relax & (p["own_assets"] <= YOUTH["own_more"]))), _yes(p["parents_assets"] > YOUTH["parents"]),
    )
    warn = _any(
        p["birth"].isNull(), p["married"].isNull(), ~owned & p["ever_owned"].isNull() & ~_yes(p["household_never_owned"]), rich & may_relax,
        p["own_assets"].isNull() | _yes(p["own_assets"] > YOUTH["own"]), p["parents_assets"].isNull(),
    )
    return F.when(fail, _result("fail")).when(warn, _result("warn")).otherwise(_result("ok", F.when(_yes(p["five_tax_years"]), "우선공급 (배점순)").otherwise("추첨")))


# --- notices and the law ---------------------------------------------------------------------------------------------------------

def legal_score_ratio(area: Column, zone: Column, capital: Column) -> Column:
    """struct(bound, percent): the share of units by points that the law sets (exact) or allows (max); null where area or zone isn't known."""
    by_area = lambda a, b, c: F.when(area <= 60, a).when(area <= 85, b).otherwise(c)
    of = lambda bound, percent: F.struct(F.lit(bound).alias("bound"), percent.cast("int").alias("percent"))
    rest = F.when(area > 85, F.when(capital, of("max", F.lit(80))).otherwise(of("exact", F.lit(0)))).otherwise(of("max", F.when(capital & (area > 60), 70).otherwise(40)))
    known = area.isNotNull() & zone.isNotNull()
    return F.when(known, F.when(zone == "투기과열", of("exact", by_area(40, 70, 80))).when(zone == "조정", of("exact", by_area(40, 70, 50))).otherwise(rest))


def score_ratio_check(law: Column, rows: Column, unknown: Column, area: Column) -> Column:
    """agrees, differs, or filled by law; null where nothing can be said. rows: array of struct(over, upto, score, lottery) as the notice has them."""
    row = F.get(F.filter(rows, lambda r: (area > r["over"]) & (r["upto"].isNull() | (area <= r["upto"]))), F.lit(0))
    ok = F.when(law["bound"] == "exact", row["score"] == law["percent"]).otherwise(row["score"] <= law["percent"])
    fill = (F.coalesce(F.size(rows), F.lit(0)) <= 0) | _yes(unknown)
    return F.when(law.isNull(), None).when(row.isNotNull(), F.when(ok, "agrees").otherwise("differs")).when(fill & (law["bound"] == "exact"), "filled by law")


def resale_text(r: dict[str, Column], winners: Column, today: Column) -> Column:
    """One line on when a home may be sold again. r: forbidden, none, passed, until_registration, months, base (a date), registration."""
    n = r["months"]
    span = F.when(n % 12 == 0, F.concat((n / 12).cast("int").cast("string"), F.lit("년"))).otherwise(F.concat(n.cast("string"), F.lit("개월")))
    end = F.add_months(F.coalesce(r["base"], winners), F.when(n != 0, n))
    return (
        F.when(_yes(r["forbidden"]), "전매 불가(환매만)").when(_yes(r["none"]), "없음").when(_yes(r["passed"]), "이미 지남").when(_yes(r["until_registration"]), "등기 때까지")
        .when(_yes(end <= today), "이미 지남").when(n.isNull(), "공고문 확인").when(_yes(r["registration"]), F.concat(span, F.lit("(등기 시 풀림)")))
        .when(end.isNotNull(), F.concat(span, F.lit(" (~"), F.date_format(end, "yy.MM.dd"), F.lit(")"))).otherwise(span)
    )


def residence_duty(found: Column, land_lease: Column, capital: Column, price_cap: Column, before: Column) -> Column:
    """Years of residence duty: a land lease's as its notice says; otherwise none outside capped homes of the capital region, there the notice's, else unknown."""
    return F.when((_zero(found) > 0) & land_lease, found).when(~_yes(capital & price_cap), 0).when(found.isNotNull(), found).when(before == 0, None).otherwise(before)


def resupply_check(special_total: Column, sentence: Column, table: Column, units: Column) -> Column:
    """agrees, differs or filled: the supply sentence against the sums of the supply table by type.

    sentence and table: map of type to units (table summed over the notice's house types, null where it wasn't read); units: number of house types.
    """
    positive = lambda m: F.map_filter(m, lambda _, v: v > 0)
    entries = lambda m: F.array_sort(F.map_entries(m))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, b: a + b.cast("int"))
    want, have = positive(sentence), positive(table)
    differs = ((F.size(want) > 0) & (entries(want) != entries(have))) | (total(have) != special_total)
    filled = (special_total == 0) | ((units == 1) & (F.size(sentence) > 0) & (total(sentence) == special_total))
    return F.when(special_total.isNull(), None).when(table.isNotNull(), F.when(differs, "differs").otherwise("agrees")).when(filled, "filled")


# --- conditions of general supply ----------------------------------------------------------------------------------------------------

# Deposits in 10,000 won for homes of up to 85 square metres, by where an applicant lives.
DEPOSITS = {300: ("서울", "부산"), 250: ("인천", "대구", "광주", "대전", "울산")}
OTHER_DEPOSIT = 200
GENERAL_PERCENT, GENERAL_PERCENT_TWO = 100, 200
TOWN_PERCENT, TOWN_PERCENT_TWO = 130, 200


def first_rank_account(since: Column, amount: Column, province: Column, ref: Column, months: Column) -> Column:
    """struct(period, deposit), each ok or fail, or null where the account's date or amount isn't known: for homes of up to 85 square metres."""
    need = reduce(lambda out, kv: F.when(province.isin(*kv[1]), kv[0]).otherwise(out), DEPOSITS.items(), F.lit(OTHER_DEPOSIT))
    state = lambda ok: F.when(ok, "ok").when(~ok, "fail")
    return F.struct(state(whole_months(since, ref) >= months).alias("period"), state(F.when(province.isNotNull(), amount >= need)).alias("deposit"))


def homeless_household(p: dict[str, Column], private: Column | None = None, elder_supply: Column | None = None) -> Column:
    """ok, warn or fail: whether a household owns no home. A home of parents over 60 is none, but for the supply to those who support parents; a home whose
    owner isn't known leaves it open; in private supply a household with a home may apply as well."""
    some = _yes(p["household_homes"].isin("1", "2+"))
    parents = _yes(p["household"] == "parents") & _yes(p["parents_own"])
    older = (parents & _yes(p["parents_60"])) | _yes(p["owner"] == "parent60")
    strict = F.lit(False) if elder_supply is None else _yes(elder_supply)
    own = _yes(p["owns"]) | (_yes(p["married"]) & _yes(p["spouse_owns"])) | (parents & ~_yes(p["parents_60"])) | _yes(p["owner"] == "other") | (older & strict)
    state = F.when(own, "fail").when(some & ~older, "warn").otherwise("ok")
    return state if private is None else F.when(_yes(private), "ok").otherwise(state)


def _by_income(p: dict[str, Column], size: Column, one: int, two: int, relaxed: bool) -> Column:
    month = p["household_income"] * 10000 / 12
    dual = _yes(p["married"]) & _yes(p["income"] > 0) & _yes(p["spouse_income"] > 0)
    cap = F.when(dual, two).otherwise(one)
    if not relaxed:
        return F.when(month <= income_limit(income_base(size), cap), "ok").when(month.isNotNull(), "fail")
    known = birth_relaxation(p["pregnant"], p["youngest"], p["minors"])
    sure, most = F.coalesce(known, F.lit(0)), F.when(_yes(known == 0), 0).otherwise(20)
    return F.when(month <= income_limit(income_base(size), cap + sure), "ok").when(month > income_limit(income_base(size), cap + most), "fail").when(month.isNotNull(), "warn")


def public_general_income(p: dict[str, Column], size: Column) -> Column:
    """ok, warn or fail for general public supply of small homes; open where births may relax the limit further. Null without an income."""
    return _by_income(p, size, GENERAL_PERCENT, GENERAL_PERCENT_TWO, True)


def town_limits(p: dict[str, Column], size: Column) -> Column:
    """struct(income, assets) for newlywed towns: total assets (p["assets"], less debts) with a higher limit for one birth, open beyond it up to the one for two."""
    known, total = birth_relaxation(p["pregnant"], p["youngest"], p["minors"]), p["assets"]
    assets = (
        F.when(total <= RENTAL_ASSETS, "ok").when(_yes(known > 0) & (total <= RENTAL_ASSETS_ONE), "ok").when(total.isNull(), None).when(_yes(known == 0) | (total > RENTAL_ASSETS_MORE), "fail").otherwise("warn")
    )
    return F.struct(_by_income(p, size, TOWN_PERCENT, TOWN_PERCENT_TWO, False).alias("income"), assets.alias("assets"))


def residence_tier(home: Column, home_city: Column, since: Column, province: Column, city: Column, months: Column, others: Column, ref: Column) -> Column:
    """local, other or none: the notice's own area (a province, or a city in it) lived in for long enough, other provinces that may apply, or neither.

    others: array of provinces. Null where the applicant's province isn't known, or their city where the area is one. A day counts from itself on.
    """
    here = (home == province) & F.when(city.isNull(), True).otherwise(F.when(home_city.isNotNull(), F.replace(home_city, F.lit(" "), F.lit("")) == city))
    long = (F.coalesce(months, F.lit(0)) == 0) | (since <= F.add_months(ref, -F.coalesce(months, F.lit(0))))
    return F.when(_yes(here & long), "local").when(here.isNull(), None).when(_yes(here & long.isNull()), None).when(_yes(F.array_contains(others, home)) | _yes(here), "other").otherwise("none")


def general_rank(first: Column, account: Column) -> Column:
    """ok, r2, unsure or no: who fails the first rank has the second with any account; an account that isn't known leaves it open. first: ok, warn or fail."""
    second = F.when(account == "none", "no").when(F.coalesce(account, F.lit("")).isin("", "unknown"), "unsure").otherwise("r2")
    return F.when(first == "ok", "ok").when(first == "fail", second).otherwise("unsure")
