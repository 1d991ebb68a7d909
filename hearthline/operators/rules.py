"""Rules as column expressions with three values: a null fact is unknown, never zero or false. Money is in 100 million won."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
LOTTO, LOTTO_RATE, CONSIDER = 5.0, 0.30, 1.0
LTV_REGULATED, LTV_OTHER = 0.40, 0.70
LOAN_CAPS_REGULATED = ((15.0, 6.0), (25.0, 4.0), (float("inf"), 2.0))
LOAN_CAP_CAPITAL = 6.0
DSR, STRESS_RATE, LOAN_YEARS = 0.40, 0.07, 30


def acquisition_tax(base: Column) -> Column:
    rate = F.when(base <= 6, 0.01).when(base <= 9, (base * 2 / 3 - 3) / 100).otherwise(0.03)
    return F.when(base.isNotNull(), base * rate * 1.1)


def cost(price: Column, extension: Column) -> Column:
    return price + extension + acquisition_tax(price + extension)


def grade(total: Column, low: Column, base: Column, land_lease: Column | None = None) -> Column:
    margin = low - total
    out = (
        F.when(low.isNull() | base.isNull(), "unknown").when((margin >= LOTTO) | (margin / total >= LOTTO_RATE), "lotto")
        .when(margin >= CONSIDER, "consider").when(margin >= 0, "flat").otherwise("pass")
    )
    return out if land_lease is None else F.when(land_lease, "unknown").otherwise(out)


def land_value(monthly_rent: Column, rate: Column) -> Column:
    """The land's share of a land-lease home, from the monthly rent in won and the conversion rate."""
    return F.when((monthly_rent > 0) & (rate > 0), monthly_rent * 12 / rate / 1e8)


def loan_capacity(price: Column, market: Column, regulated: Column, capital: Column, income: Column, repaid: Column) -> Column:
    """struct(loan, limit_by): the least of what income, the ratio and the cap allow. income and repaid are yearly."""
    r, n = STRESS_RATE / 12, LOAN_YEARS * 12
    by_income = F.greatest(F.lit(0.0), income * DSR - repaid) / 12 * ((1 - (1 + r) ** -n) / r)
    by_ratio = F.coalesce(F.least(price, market), price) * F.when(regulated, LTV_REGULATED).otherwise(LTV_OTHER)
    value = F.coalesce(market, price)
    of_value = reduce(lambda out, step: F.when(value <= step[0], step[1]).otherwise(out), reversed(LOAN_CAPS_REGULATED[:-1]), F.lit(LOAN_CAPS_REGULATED[-1][1]))
    cap = F.when(regulated, of_value).when(capital, LOAN_CAP_CAPITAL).otherwise(F.lit(float("inf")))
    loan = F.least(by_income, by_ratio, cap)
    return F.struct(loan.alias("loan"), F.when(loan == by_income, "income").when(loan == cap, "cap").otherwise("ratio").alias("limit_by"))


def item(key: str, state: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), state.alias("state"))


def eligibility(
    region: Column, in_capital: Column, owns: Column, spouse_owns: Column, married: Column, lives_with_parents: Column, parents_own: Column, parents_60: Column,
    need_head: Column, head: Column, head_since: Column, notice: Column, need_account: Column, account: Column, recent_win: Column, target: Column,
) -> Column:
    """Array of (key, state) items; states are ok, warn, fail and na."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    ok = lambda c: F.when(c, "ok").otherwise("fail")
    home = yes(owns) | (yes(married) & yes(spouse_owns)) | (yes(lives_with_parents) & yes(parents_own) & ~yes(parents_60))
    late = yes(head_since > notice)
    items = F.array(
        item("residence", F.when(region == "Seoul", ok(yes(in_capital))).when(region.isin("Gyeonggi", "Incheon"), F.when(yes(in_capital), "ok").otherwise("warn")).otherwise("warn")),
        item("homeless", ok(~home)),
        item("head", F.when(yes(need_head), ok(yes(head) & ~late)).otherwise("na")),
        item("account", F.when(~yes(need_account), "na").when(account == "yes", "ok").when(account == "no", "fail").otherwise("warn")),
        item("rewin", ok(~yes(recent_win))),
        item("target", F.when(target.isNull(), "na").when(target == "newlywed", ok(yes(married))).otherwise("warn")),
    )
    return F.filter(items, lambda x: x["state"] != "na")


def outcome(items: Column) -> Column:
    """no, unsure or ok of an array of items."""
    has = lambda s: F.exists(items, lambda x: x["state"] == s)
    return F.when(has("fail"), "no").when(has("warn"), "unsure").otherwise("ok")


def first_failing(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x["state"] == "fail"), F.lit(0))["key"]


def worst(states: Column, order: tuple[str, ...] = ("ok", "cond", "check", "no")) -> Column:
    """The most severe of an array of states."""
    ranks = F.transform(states, lambda s: F.coalesce(F.array_position(F.lit(list(order)), s), F.lit(1)))
    return F.element_at(F.lit(list(order)), F.coalesce(F.array_max(ranks), F.lit(1)).cast("int"))


def lease_check(duty_years: Column, regulated: Column, capital: Column, weak: Column, deposit: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    states = F.array(
        F.when(duty_years.isNull(), "check").when(duty_years > 0, "cond").otherwise("ok"),
        F.when(yes(regulated) & yes(capital), "cond").otherwise("ok"), F.when(yes(weak), "cond").otherwise("ok"), F.when(deposit.isNull(), "cond").otherwise("ok"),
    )
    return worst(states)


def months_between_days(start: Column, end: Column) -> Column:
    """Whole months: one less where the end's day is before the start's, with no rule for ends of months."""
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - (F.day(end) < F.day(start)).cast("int")).cast("int")


def points(homeless_years: Column, dependants: Column, account_months: Column) -> Column:
    """struct(homeless, dependants, account) points; an unknown period stays unknown."""
    a = F.when(homeless_years < 0, 0).when(homeless_years < 1, 2).when(homeless_years.isNotNull(), F.least(F.lit(32), 2 + 2 * homeless_years))
    b = F.least(F.lit(35), 5 + 5 * dependants)
    c = F.when(account_months < 6, 1).when(account_months < 12, 2).when(account_months.isNotNull(), F.least(F.lit(17), F.floor(account_months / 12).cast("int") + 2))
    return F.struct(a.cast("int").alias("homeless"), b.cast("int").alias("dependants"), c.cast("int").alias("account"))


def verdict(ok: Column, grade_: Column, gap: Column) -> Column:
    return (
        F.when(~ok, "not eligible").when(grade_.isin("pass", "flat"), "too little margin").when(grade_ == "unknown", "check the market")
        .when(gap > 0, "short of funds").otherwise("go")
    )


def status(opens: Column, closes: Column, today: Column) -> Column:
    return F.when(opens.isNotNull() & (today < opens), "upcoming").when(closes.isNotNull() & (today > closes), "closed").otherwise("open")


def vote(a: Column, b: Column, c: Column) -> Column:
    """struct(value, conflict) of three readings: all that are known agree, or two of three do; else a conflict and no value."""
    known = F.array_compact(F.array(a, b, c))
    one = F.size(F.array_distinct(known)) == 1
    two = F.when(a == b, a).when(a == c, a).when(b == c, b)
    value = F.when(one, F.get(known, F.lit(0))).otherwise(F.when(F.size(known) == 3, two))
    return F.struct(value.alias("value"), ((F.size(known) > 0) & value.isNull()).alias("conflict"))
