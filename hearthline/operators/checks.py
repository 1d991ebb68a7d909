"""What looks wrong about a listing: messages of its own values against one another, in the order in which they are shown.

A value that isn't known breaks no check, unless the check is that it should be known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEAST_PRICE, MOST_PRICE, MARKET_DAYS = 0.5, 100.0, 31 * 6 + 31
KOREA = (33.0, 39.0, 124.0, 132.0)
STEPS = (("공고일", "notice"), ("접수 시작", "start"), ("접수 마감", "apply_end"), ("발표", "winner"), ("계약", "contract"))
SPECIAL_WORDS = ("생애최초", "다자녀", "신혼부부", "신생아", "특별공급")

_yes = lambda c: F.coalesce(c, F.lit(False))
_text = lambda c: F.coalesce(c, F.lit(""))
_has = lambda name, what: F.contains(_text(F.col(name)), F.lit(what))
_any = lambda cs: reduce(lambda a, b: a | b, cs)


def date_order() -> Column:
    """A message for each known step that is later than the next known one."""
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in STEPS]), lambda x: x["v"].isNotNull())

    def wrong(steps: Column) -> Column:
        pairs = F.transform(steps, lambda x, i: F.struct(x.alias("a"), F.get(steps, i + 1).alias("b")))
        pairs = F.filter(pairs, lambda p: p["a"]["v"] > p["b"]["v"])
        return F.transform(pairs, lambda p: F.concat(F.lit("날짜 순서가 이상해요 ("), p["a"]["k"], F.lit(" "), p["a"]["v"], F.lit(" > "), p["b"]["k"], F.lit(" "), p["b"]["v"], F.lit(")")))

    return F.get(F.transform(F.array(known), wrong), F.lit(0))


def messages(today: Column) -> Column:
    """The array of messages of a row with: notice, special_apply, apply, apply_end, winner, contract, balance (dates), conflicts (array), rental, limits_known, house_dtl, category,
    name, area, schedule_special (first day), schedule_general (last day), ratio_unread, ratio_by_law, reg_kind, price, ext, residence_duty, capital, price_cap, from_notice (array),
    head_quote, region_quote, households, special_total, regulated, need_head, grade, rate, mkt_count, mkt_basis, comps (array of struct(amount, date)), kind, sido, lat, lng.
    start: special_apply or apply."""
    c = F.col
    said = lambda what: _yes(F.array_contains("from_notice", what))
    town, land_lease = _has("name", "신혼희망타운"), _has("name", "토지임대부")
    small_public = ~_yes(c("rental")) & _yes(c("house_dtl") == "국민") & _yes(c("category") == "general") & ~town & (F.coalesce("area", F.lit(0.0)) <= 60) & ~_yes(c("limits_known"))
    amounts = F.filter(F.transform("comps", lambda x: x["amount"]), lambda a: a > 0)
    pair = _yes((c("mkt_basis") == "same_complex") & (c("mkt_count") >= 2) & (F.size(amounts) >= 2) & ((F.array_max(amounts) - F.array_min(amounts)) / F.array_min(amounts) <= 0.15))
    most = F.when(_has("kind", "재공급") & _yes(c("mkt_basis") == "same_complex"), 2.5).otherwise(1.0)
    head_of = F.replace(_text(c("head_quote")), F.lit("공급신청자격자"), F.lit("공급신청 자격자"))
    only_special = (F.coalesce("households", F.lit(0)) == 0) & (F.coalesce("special_total", F.lit(0)) > 0)
    number = lambda name: F.format_string("%s", F.regexp_replace(c(name).cast("string"), r"\.0$", ""))
    valued = ~_yes(c("grade") == "unknown")
    tests = [
        (_yes(c("rental")) & ~_yes(c("limits_known")), F.lit("공공임대 일반공급 소득·총자산 기준을 공고문에서 읽지 못했어요 (화면은 확인 필요)")),
        (small_public, F.lit("공공분양 60㎡ 이하 일반공급 소득·자산 기준을 공고문에서 읽지 못했어요 (화면은 확인 필요)")),
        (c("schedule_special") != c("special_apply"), F.concat(F.lit("특별공급 접수일이 청약홈("), c("special_apply").cast("string"), F.lit(")과 공고문("), c("schedule_special").cast("string"), F.lit(")에서 달라요"))),
        (c("schedule_general") != c("apply_end"), F.concat(F.lit("접수 마감일이 청약홈("), c("apply_end").cast("string"), F.lit(")과 공고문 일반공급("), c("schedule_general").cast("string"), F.lit(")에서 달라요"))),
        (_yes(c("house_dtl") == "민영") & _yes(c("ratio_unread")), F.lit("가점제·추첨제 비율 표를 공고문에서 읽지 못했어요 (화면은 비율 없이 안내)")),
        (_yes(c("house_dtl") == "민영") & ~_yes(c("ratio_unread")) & _yes(c("ratio_by_law")), F.concat(F.lit("가점제·추첨제 비율 표를 공고문에서 읽지 못해 법령 기준(주택공급에 관한 규칙 제28조, "), _text(c("reg_kind")), F.lit(")으로 추정했어요"))),
        (c("balance") < c("contract"), F.concat(F.lit("잔금일("), c("balance").cast("string"), F.lit(")이 계약일("), c("contract").cast("string"), F.lit(")보다 빨라요"))),
        (~c("price").between(LEAST_PRICE, MOST_PRICE), F.concat(F.lit("분양가 "), number("price"), F.lit("억이 범위를 벗어나요"))),
        ((c("ext") != 0) & ~((c("ext") > 0) & (c("ext") < c("price") * 0.1)), F.concat(F.lit("확장비 "), number("ext"), F.lit("억이 분양가 대비 이상해요"))),
        ((c("residence_duty") != 0) & ~_yes(c("capital") & c("price_cap")) & ~(said("실거주 의무") & land_lease), F.lit("실거주 의무가 수도권 분양가상한제 주택이 아닌데 붙어 있어요")),
        (said("세대주 요건") & (head_of != "") & ~_any([F.contains(head_of, F.lit(w)) for w in ("일반공급", "세대주 요건", "공급신청 자격자")]) & _any([F.contains(head_of, F.lit(w)) for w in SPECIAL_WORDS]),
         F.lit("세대주 요건의 근거 문장이 특별공급 대상자 문장이에요 — 일반공급 조건이 맞는지 원문 확인 필요")),
        ((F.coalesce("households", F.lit(0)) > 0) & ~_has("region_quote", "일반공급") & _any([_has("region_quote", w) for w in ("생애최초로", "다자녀가구 특별", "신혼부부 특별", "신생아 특별", "노부모부양 특별", "특별공급 대상")]),
         F.lit("거주 지역 요건의 근거 문장이 특별공급 대상자 문장이에요 — 일반공급 거주 요건이 맞는지 원문 확인 필요")),
        (_yes(c("regulated")) & ~said("세대주 요건") & _yes(c("need_head")) & ~only_special, F.lit("세대주 요건을 공고문에서 확인하지 못해 규제지역 기준으로 추정했어요")),
        (~said("재당첨 제한") & (_yes(c("regulated")) | _yes(c("price_cap"))), F.lit("재당첨 제한 기간을 공고문에서 확인하지 못해 추정했어요")),
        (valued & (c("mkt_count") < 3) & ~pair, F.concat(F.lit("시세 근거 거래가 "), c("mkt_count").cast("string"), F.lit("건뿐이에요"))),
        (valued & ((c("rate") > most) | (c("rate") < -0.5)), F.concat(F.lit("마진율 "), F.bround(c("rate") * 100).cast("int").cast("string"), F.lit("%는 이례적이에요. 시세 근거를 확인하세요"))),
        (valued & F.exists("comps", lambda x: x["date"] < F.date_sub(today, MARKET_DAYS)), F.lit("시세 근거에 기간을 벗어난 거래가 섞여 있어요")),
        (_has("kind", "재공급") & (F.coalesce("households", F.lit(0)) == 0) & c("special_total").isNull(), F.lit("재공급 물량(특별공급 세대수)을 공고문 공급대상 표에서 읽지 못했어요 — 모집공고문 확인")),
        (_text(c("sido")) == "", F.lit("주소에서 시·도를 찾지 못했어요")),
        (~(c("lat").between(*KOREA[:2]) & c("lng").between(*KOREA[2:])), F.lit("지도 좌표가 국내 범위를 벗어나요")),
    ]
    conflicts = F.transform(F.coalesce("conflicts", F.array().cast("array<string>")), lambda x: F.concat(F.lit("공고문 안에서 값이 서로 달라요 — "), x))
    return F.concat(date_order(), conflicts, F.array_compact(F.array(*[F.when(_yes(broken), message) for broken, message in tests])))


def listing_checks(rows: DataFrame, today: Column) -> DataFrame:
    """id, message: one row a message. rows: see messages; special_apply or apply is the start."""
    started = rows.withColumn("start", F.coalesce("special_apply", "apply"))
    return started.select("id", F.posexplode(messages(today)).alias("pos", "message"))
