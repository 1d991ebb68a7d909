"""Conditions of a search in words of the domain: each key becomes one column, struct(state, why) with state pass, fail or unknown.

facts: id, notice, name, address, sido, district, price, area, households and single (complex), station_walk, school_walk, status, category, town, house_dtl,
rental, special (map of type to units), eligible (ok, unsure, no or null), grade, margin, lat, lng. What a fact doesn't say is unknown and neither passes nor fails.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.market import metres

# Fixed values.
GRADE_RANK = {"lotto": 4, "consider": 3, "flat": 2, "pass": 1, "unknown": 0}
ELIGIBLE_RANK = {"ok": 3, "unsure": 2, "r2": 1, "no": 0}
GRADE_BONUS = {"lotto": 1.5, "consider": 1.0, "flat": 0.0, "pass": -0.5, "unknown": 0.0}
NO_PRICE = 99.0

_yes = lambda c: F.coalesce(c, F.lit(False))
_any = lambda cs: reduce(lambda a, b: a | b, cs)
_flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def _state(known: Column, ok: Column, why: str, unknown: str | None = None) -> Column:
    state = F.when(~_yes(known), "unknown").when(_yes(ok), "pass").otherwise("fail")
    return F.struct(state.alias("state"), F.when(state == "fail", why).when(state == "unknown", unknown).cast("string").alias("why"))


def in_region(region: dict[str, Any]) -> Column:
    """Whether a listing lies in a region: a province, a district in it, or words of its address."""
    ok = F.lit(True) if region.get("sido") is None else _yes(F.col("sido") == region["sido"])
    words = [F.contains(_flat(F.col("address")), F.lit(w)) for w in region.get("words", ())]
    if region.get("district") is not None:
        return ok & _any([F.contains(_flat(F.col("district")), F.lit(region["district"].replace(" ", ""))), *words])
    return ok & _any([*words, *[F.contains(_flat(F.col("name")), F.lit(w)) for w in region["words"]]]) if words else ok


def nearest_metres(points: list[tuple[float, float]]) -> Column:
    """Metres to the nearest of a query's points, which are a few constants of its plan."""
    return F.array_min(F.array(*[metres(F.col("lat"), F.col("lng"), F.lit(a), F.lit(b)) for a, b in points]))


def condition(key: str, value: Any = None) -> Column:
    c = F.col
    some = lambda name: c(name).isNotNull()
    if key == "region_in":
        return _state(F.lit(True), _any([in_region(r) for r in value]), "·".join(r["label"] for r in value) + "이(가) 아닌 곳")
    if key == "region_out":
        return _state(F.lit(True), ~_any([in_region(r) for r in value]), "·".join(r["label"] for r in value) + " 제외")
    if key == "price_max":
        return _state(some("price"), c("price") <= value + 1e-9, f"예산 초과({value:g}억)", "분양가 없음")
    if key == "price_min":
        return _state(some("price"), c("price") >= value, f"{value:g}억 미만")
    if key == "price_range":
        return _state(some("price"), (c("price") >= value[0]) & (c("price") < value[1]), f"가격대가 {value[0]:g}억대가 아님")
    if key == "area":
        return _state(some("area"), c("area").between(*value), "면적 조건 밖")
    if key == "households_min":
        return _state(some("households"), c("households") >= value, f"단지 {value}세대 미만", "단지 규모 확인 필요")
    if key == "not_single":
        return _state(c("single").isin("no", "maybe"), c("single") == "no", "나홀로일 가능성", "단지 규모 확인 필요")
    if key == "rooms":
        return _state(F.lit(False), F.lit(False), "", "방·욕실 구조 확인 필요")
    if key == "station_walk":
        return _state(some("station_walk"), c("station_walk") <= value, f"역 도보 {value}분 넘음", "역 거리 확인 불가")
    if key == "school_walk":
        return _state(some("school_walk"), c("school_walk") <= value, f"초등학교 도보 {value}분 넘음", "학교 거리 확인 불가")
    if key == "commute":
        return _state(F.lit(False), F.lit(False), "", f"{value} 출퇴근 시간 확인 불가")
    if key == "supply":
        if value.startswith("sp:"):
            units = F.try_element_at("special", F.lit(value[3:]))
            return _state(F.lit(True), units.isNotNull() & ((units > 0) | _yes(c("town"))), f"{value[3:]} 특별공급 없음")
        tests = {"remainder": c("category") == "remainder", "town": c("town"), "public": c("house_dtl") == "국민", "private": c("house_dtl") == "민영", "rental": c("rental")}
        return _state(F.lit(value in tests), tests.get(value, F.lit(False)), f"{value} 아님")
    if key == "status":
        return _state(F.lit(True), c("status").isin(*value), "·".join(value) + " 아님")
    if key == "eligible_only":
        return _state(c("eligible").isin("ok", "no"), c("eligible") == "ok", "신청 자격 없음", "자격 확인 필요")
    if key == "margin":
        good = [g for g, r in GRADE_RANK.items() if r >= GRADE_RANK["consider"]]
        return _state(some("grade") & (c("grade") != "unknown"), c("grade").isin(*good), "시세 차익 작음(추정)", "시세 확인 불가")
    if key == "new_build":
        return _state(F.lit(True), F.lit(True), "")
    if key in ("line", "near_station"):
        name, points, most = value
        if not points:
            return _state(F.lit(False), F.lit(False), "", f"{name} 역 정보 없음")
        return _state(some("lat") & some("lng"), nearest_metres(points) <= most, f"{name} 역에서 {most / 1000:g}km 넘음", "단지 좌표 없음")
    return _state(F.lit(False), F.lit(False), "")


def search(facts: DataFrame, required: list[tuple[str, Any]], preferred: list[tuple[str, Any]] = (), places: list[tuple[float, float]] = ()) -> DataFrame:
    """facts with result (ok, unsure, refused or excluded), reason (the first failing condition's), misses, unknown (reasons) and score; one pass.

    places: where somebody commutes to; the mean straight way lowers the score. A listing that somebody can't apply for is refused, not recommended.
    """
    states = F.array(*[condition(k, v) for k, v in required]) if required else F.array().cast("array<struct<state:string,why:string>>")
    weight = {"region_in": 4.0, "margin": 2.0, "commute": 0.0}
    score = F.lit(0.0)
    for k, v in preferred:
        s = condition(k, v)["state"]
        score = score + F.when(s == "pass", weight.get(k, 3.0)).when(s == "fail", -weight.get(k, 3.0)).otherwise(0.0)
    score = score + F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GRADE_BONUS.items() for x in kv]), F.col("grade")), F.lit(0.0))
    if places:
        km = sum((metres(F.col("lat"), F.col("lng"), F.lit(a), F.lit(b)) / 1000 for a, b in places), F.lit(0.0)) / len(places)
        score = score - F.coalesce(F.least(F.lit(12.0), km / 4) + F.when(km > 40, 6.0).otherwise(0.0), F.lit(6.0))
    out = facts.withColumn("states", states).withColumn("score", score)
    of = lambda s: F.filter("states", lambda x: x["state"] == s)
    return out.withColumns({
        "result": F.when(F.size(of("fail")) > 0, "excluded").when(F.size(of("unknown")) > 0, "unsure").when(_yes(F.col("eligible") == "no"), "refused").otherwise("ok"),
        "reason": F.get(of("fail"), F.lit(0))["why"], "misses": F.size(of("fail")), "unknown": F.transform(of("unknown"), lambda x: x["why"]),
    }).drop("states")


def ranking() -> list[Column]:
    """Better eligibility, then the higher score, then the lower price, then the least id."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ELIGIBLE_RANK.items() for x in kv]), F.col("eligible")), F.lit(0))
    return [-rank, -F.col("score"), F.coalesce("price", F.lit(NO_PRICE)), F.col("id")]


def by_notice(found: DataFrame) -> DataFrame:
    """notice, best (its first listing in ranking order), types (all of them in that order)."""
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(ranking())])
    return found.groupBy("notice").agg(F.min_by("id", keys).alias("best"), F.array_sort(F.collect_list(F.struct(keys.alias("k"), F.col("id").alias("id")))).alias("t")).select(
        "notice", "best", F.transform("t", lambda x: x["id"]).alias("types")
    )


def near_misses(facts: DataFrame, required: list[tuple[str, Any]], n: int = 2) -> DataFrame:
    """notice, best of notices that a budget a tenth higher would add: over the budget alone. No rows without a budget."""
    wide = [(k, round(v * 1.1, 2) if k == "price_max" else v) for k, v in required]
    if wide == list(required):
        return by_notice(search(facts, required).where("false"))
    have = search(facts, required).where("result = 'ok'").select("notice").distinct()
    more = search(facts, wide).where("result = 'ok'").join(have, "notice", "left_anti")
    return by_notice(more).join(more.select(F.col("id").alias("best"), "price", "score"), "best").orderBy(F.coalesce("price", F.lit(NO_PRICE)), "best").limit(n).select("notice", "best", "types")


def neighbours(districts: DataFrame, chosen: DataFrame, km: float) -> DataFrame:
    """district, near_of, km of districts within so many kilometres of a chosen one that aren't chosen themselves: of each the nearest.

    Districts are joined by grid cells of that width and the cells around, not all with all. districts: district, lat, lng; chosen: district.
    """
    step = km / 111.0  # degrees of latitude; a degree of longitude is shorter, so cells by longitude are wider: at 38 degrees by a quarter
    cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
    d = districts.select("district", "lat", "lng", cell("lat", step).alias("x"), cell("lng", step / 0.75).alias("y"))
    near = [F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    base = d.join(chosen.select("district").distinct(), "district").select(F.col("district").alias("near_of"), F.col("lat").alias("a"), F.col("lng").alias("b"), F.explode(F.array(*near)).alias("c"))
    pairs = d.join(base, (F.col("x") == F.col("c.x")) & (F.col("y") == F.col("c.y"))).withColumn("m", metres(F.col("a"), F.col("b"), F.col("lat"), F.col("lng")))
    pairs = pairs.where(F.col("m") <= km * 1000).join(chosen.select("district").distinct(), "district", "left_anti")
    return pairs.groupBy("district").agg(F.min(F.struct("m", "near_of")).alias("n")).select("district", "n.near_of", F.round(F.col("n.m") / 1000).cast("long").alias("km"))


def line_info(facts: DataFrame, name: str, stations: list[tuple[str, float, float]], most: int) -> DataFrame:
    """line, notices, types, least_price, stations: what lies within most metres of a line's stations."""
    each = F.array(*[F.struct(metres(F.col("lat"), F.col("lng"), F.lit(a), F.lit(b)).alias("m"), F.lit(s).alias("name")) for s, a, b in stations])
    near = facts.where("lat is not null and lng is not null").withColumn("n", F.array_min(each)).where(F.col("n.m") <= most)
    return near.agg(
        F.lit(name).alias("line"), F.count_distinct("notice").alias("notices"), F.count(F.lit(1)).alias("types"), F.min("price").alias("least_price"), F.array_sort(F.collect_set("n.name")).alias("stations"),
    )


def outside(facts: DataFrame, required: list[tuple[str, Any]], points: list[tuple[float, float]], n: int = 3) -> DataFrame:
    """notice, best, km of listings that meet all but the region: within 30 km first, then by eligibility and by score less the way."""
    regions = [r for k, v in required if k == "region_in" for r in v]
    found = search(facts, [(k, v) for k, v in required if k != "region_in"]).where("result = 'ok'").where(~_any([in_region(r) for r in regions]))
    km = nearest_metres(points) / 1000 if points else F.lit(None).cast("double")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ELIGIBLE_RANK.items() for x in kv]), F.col("eligible")), F.lit(0))
    found = found.withColumn("km", km).withColumn("order", F.struct(
        (~_yes(F.col("km") <= 30)).alias("far"), (-rank).alias("e"), (F.coalesce(F.least(F.lit(6.0), F.col("km") / 8), F.lit(4.0)) - F.col("score")).alias("r"), F.coalesce("price", F.lit(NO_PRICE)).alias("p"), "id"))
    best = found.groupBy("notice").agg(F.min_by(F.struct("id", "km"), "order").alias("b"), F.min("order").alias("o"))
    return best.orderBy("o").limit(n).select("notice", F.col("b.id").alias("best"), F.round("b.km").cast("long").alias("km"))


def find_targets(facts: DataFrame, query: str) -> DataFrame:
    """Listings whose name or address has all of a query's words, one at least in the name; where a live one is among them, only live ones. facts: also past."""
    import re

    words = [w for w in re.split(r"[\s·,]+", re.sub(r"\(.*?\)|아파트|단지", " ", query)) if len(w) >= 2]
    if not words:
        return facts.where("false")
    named = [F.contains(_flat(F.col("name")), F.lit(w)) for w in words]
    hits = facts.where(reduce(lambda a, b: a & b, [n | F.contains(_flat(F.col("address")), F.lit(w)) for n, w in zip(named, words, strict=True)]) & _any(named))
    live = hits.agg(F.coalesce(F.bool_or(~F.col("past")), F.lit(False)).alias("l")).scalar()
    return hits.where(~live | ~F.col("past"))
