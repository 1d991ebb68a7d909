"""Listings judged for profiles: eligibility with reasons and what would help, lease, loan, gaps and verdict.

Profiles are a driver-side list, as many as a question has (a household, or the few of a test), and become one array of structs that every listing row is exploded
by: no join and nothing broadcast. Money of profiles is in 10,000 won, of listings in 100 million.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators import rules

PROFILE = {
    "name": "string", "seoul": "boolean", "self_own": "boolean", "married": "boolean", "spouse_own": "boolean", "household": "string", "parents_own": "boolean", "parents_60": "boolean", "head_since": "date",
    "account": "string", "recent_win": "boolean", "income": "double", "spouse_income": "double", "loan_monthly": "double", "spouse_loan": "double", "cash": "double", "liquid": "double", "deposit": "double", "family": "double",
}
_yes = lambda c: F.coalesce(c, F.lit(False))
_zero = lambda c: F.coalesce(c, F.lit(0.0))
_text = lambda c: F.coalesce(c, F.lit(""))


def with_profiles(listings: DataFrame, profiles: list[dict[str, Any]]) -> DataFrame:
    """listings times profiles, as column p; a fact that a profile hasn't is null."""
    one = lambda p: F.struct(*[F.lit(p.get(k)).cast(t).alias(k) for k, t in PROFILE.items()])
    return listings.withColumn("p", F.explode(F.array(*[one(p) for p in profiles])))


def _item(k: Column | str, s: Column, v: Column | str, note: Column | str = "") -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(lit(k).alias("k"), s.alias("s"), lit(v).alias("v"), lit(note).alias("note"))


def eligibility_items() -> Column:
    """Array of struct(k, s, v, note): s is ok, warn, fail or na. Columns: region, need_head, notice, need_account, target, and p."""
    c, p = F.col, F.col("p")
    said = lambda s: F.when(s == "ok", "충족").when(s == "fail", "미충족").otherwise("확인 필요")
    seoul, region = _yes(p["seoul"]), c("region")
    near = region.isin("경기", "인천")
    home = F.when(region == "서울", F.when(seoul, "ok").otherwise("fail")).when(near & seoul, "ok").otherwise("warn")
    where = F.when(region == "서울", "거주지 (서울)").when(near, "거주지 (수도권)").otherwise(F.concat(F.lit("거주지 ("), region, F.lit(")")))
    home_note = F.when(near & seoul, "해당 지역 우선공급 대상은 아니에요").when((region != "서울") & ~near, "공고문의 거주 지역 요건을 확인하세요").otherwise("")
    with_parents = _yes(p["household"] == "parents") & _yes(p["parents_own"])
    own = F.array_compact(F.array(
        F.when(_yes(p["self_own"]), "본인 명의 주택"), F.when(_yes(p["married"]) & _yes(p["spouse_own"]), "배우자 명의 주택"), F.when(with_parents & ~_yes(p["parents_60"]), "부모님 주택 (만 60세 미만)")))
    free = F.array_compact(F.array(F.when(with_parents & _yes(p["parents_60"]), "부모님 주택: 만 60세 이상 예외 적용"), F.when(~_yes(p["married"]), "혼인신고 전: 배우자 주택 미합산")))
    homeless = F.when(F.size(own) > 0, "fail").otherwise("ok")
    late = _yes(p["head_since"] > c("notice"))
    head = F.when(_yes(p["household"] == "head") & ~late, "ok").otherwise("fail")
    of_day = F.coalesce(F.concat(F.lit("공고일 "), c("notice").cast("string"), F.lit(" 기준")), F.lit(""))
    account = F.when(p["account"] == "yes", "ok").when(p["account"] == "no", "fail").otherwise("warn")
    couple, married = c("target") == "신혼부부", _yes(p["married"])
    target = F.when(couple, F.when(married, "ok").otherwise("fail")).otherwise("warn")
    target_note = F.when(couple, F.when(married, "혼인신고 7년 이내 등 공고문 요건 확인").otherwise("혼인신고를 한 신혼부부만 신청할 수 있어요")).otherwise("공고문의 대상 요건을 확인하세요")
    items = F.array(
        _item(where, home, said(home), home_note), _item("무주택 세대", homeless, said(homeless), F.when(F.size(own) > 0, F.array_join(own, ", ")).otherwise(F.array_join(free, " · "))),
        F.when(_yes(c("need_head")), _item("세대주", head, said(head), F.when(_yes(p["household"] == "head") & late, "공고일보다 늦게 세대주가 됐어요").otherwise(of_day))),
        F.when(_yes(c("need_account")), _item("청약통장", account, said(account))).otherwise(_item("청약통장", F.lit("na"), "불필요")),
        _item("재당첨 제한 (내 이력)", F.when(_yes(p["recent_win"]), "fail").otherwise("ok"), F.when(_yes(p["recent_win"]), "제한 중").otherwise("해당 없음"), "과거 당첨으로 지금 제한 기간인지 여부"),
        F.when(_text(c("target")) != "", _item(F.concat(c("target"), F.lit(" 전용")), target, said(target), target_note)),
    )
    return F.filter(items, lambda x: x.isNotNull())


def reason_and_fix(items: Column) -> Column:
    """struct(reason, fix) of the first failing item, and what would help where being head of the household is among the failing ones; blank where nothing fails."""
    c, p = F.col, F.col("p")
    fails = F.filter(items, lambda x: x["s"] == "fail")
    f = F.get(fails, F.lit(0))
    head = F.when(c("notice").isNull(), "세대주가 아니에요.").otherwise(F.concat(F.lit("모집공고일("), c("notice").cast("string"), F.lit(") 기준 세대주가 아니에요. 지금 바꿔도 이번 공고에는 반영되지 않아요.")))
    reason = (
        F.when(f.isNull(), "").when(f["k"] == "세대주", head).when(f["k"].startswith("무주택"), F.concat(F.lit("세대에 주택 소유자가 있어요 ("), f["note"], F.lit(").")))
        .when(f["k"].startswith("거주"), F.concat(c("region"), F.lit(" 거주자만 신청할 수 있어요."))).when(f["k"].endswith("전용"), F.concat(F.replace(f["k"], F.lit(" 전용"), F.lit("")), F.lit(" 대상 공급이에요. "), f["note"]))
        .when(f["k"] == "청약통장", "1순위 청약통장 요건을 채우지 못했어요.").otherwise("재당첨 제한 기간이에요.")
    )
    older = _yes(p["household"] == "parents") & _yes(p["parents_60"])
    fix = F.when(F.exists(fails, lambda x: x["k"] == "세대주"), F.when(older, "부모님이 모두 만 60세 이상이라 세대주만 본인으로 변경하면 무주택 세대주가 돼요. 다음 공고부터 적용돼요.")
                 .otherwise("다음 공고의 모집공고일 전에 세대주가 되어 두세요. 전입신고로 세대를 만들 때는 실제로 살아야 해요.")).otherwise("")
    return F.struct(reason.alias("reason"), fix.alias("fix"))


def judge(listings: DataFrame, profiles: list[dict[str, Any]], mode: str | None = None, jeonse: float | None = None) -> DataFrame:
    """id, profile, outcome (ok, unsure, no), reason, fix, grade, lease (ok, cond, check, no), loan, limit_by, gap_live, gap_jeonse, gap, contract_ok, verdict for every listing and profile.

    listings: id, region, need_head, notice, need_account, target, price, ext, mkt_low, mkt_base, land_lease, land_rent, land_rent_rate, residence_duty, regulated, capital, jeonse_weak, jeonse, contract_rate.
    mode: jeonse or live; where it isn't given, a lease is planned unless it can't be. jeonse: a deposit in 10,000 won in place of the estimate.
    """
    c, p = F.col, F.col("p")
    won = lambda x: _zero(x) / 10_000
    rows = with_profiles(listings, profiles).withColumn("items", eligibility_items())
    total = rules.cost(c("price"), _zero(c("ext")))
    land = _zero(F.when(_yes(c("land_lease")), rules.land_value(c("land_rent"), c("land_rent_rate"))))
    lease = rules.lease_check(c("residence_duty"), c("regulated"), c("capital"), c("jeonse_weak"), c("jeonse"))
    income = won(p["income"]) + F.when(_yes(p["married"]), won(p["spouse_income"])).otherwise(0.0)
    repaid = (won(p["loan_monthly"]) + F.when(_yes(p["married"]), won(p["spouse_loan"])).otherwise(0.0)) * 12
    loan = rules.loan_capacity(c("price"), F.nullif(c("mkt_base"), F.lit(0.0)), _yes(c("regulated")), _yes(c("capital")), income, repaid)
    has = lambda s: F.exists("items", lambda x: x["s"] == s)
    outcome = F.when(has("fail"), "no").when(has("warn"), "unsure").otherwise("ok")
    rows = rows.select("*", reason_and_fix(c("items")).alias("why"), outcome.alias("outcome"), total.alias("total"), land.alias("land"), lease.alias("lease"), loan.alias("l"))
    rows = rows.withColumn("grade", rules.grade(c("total"), c("mkt_low"), c("mkt_base"), _yes(c("land_lease"))))
    have = reduce(lambda a, b: a + b, [won(p[k]) for k in ("cash", "liquid", "deposit", "family")])
    deposit = F.lit(jeonse / 10_000) if jeonse is not None else c("jeonse")
    gap_live = c("total") - c("l.loan") - have
    gap_jeonse = F.when(c("lease") != "no", c("total") - deposit - have)
    planned = F.when(c("lease") == "no", "live").otherwise(mode or "jeonse")
    rows = rows.select("*", gap_live.alias("gap_live"), gap_jeonse.alias("gap_jeonse")).withColumn("gap", F.when(planned == "jeonse", F.coalesce("gap_jeonse", "gap_live")).otherwise(c("gap_live")))
    short = F.concat(F.lit("자금 "), F.format_number("gap", 2), F.lit("억 부족"))
    verdict = (
        F.when(c("outcome") == "no", "신청 불가").when(c("grade").isin("pass", "flat"), "자격은 되지만 마진 부족").when(c("grade") == "unknown", "시세 확인 필요").when(c("gap") > 0, short).otherwise("넣어도 돼요")
    )
    return rows.select(
        "id", c("p.name").alias("profile"), "outcome", "why.reason", "why.fix", "grade", "lease", "l.loan", "l.limit_by", "gap_live", "gap_jeonse", "gap",
        (won(p["cash"]) >= (c("price") + _zero(c("ext"))) * c("contract_rate")).alias("contract_ok"), verdict.alias("verdict"), (c("total") + c("land")).alias("total_with_land"),
    )
