"""Listings from raw notices: normalised fields, place, kind, regulation, filters and retention, as column expressions.

A fact that a notice doesn't say is null and stays unknown: no rule takes it for no or for zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Provinces by an address's first word.
PROVINCES = {
    "서울": "서울", "서울특별시": "서울", "부산": "부산", "부산광역시": "부산", "대구": "대구", "대구광역시": "대구",
    "인천": "인천", "인천광역시": "인천", "광주": "광주", "광주광역시": "광주", "대전": "대전", "대전광역시": "대전",
    "울산": "울산", "울산광역시": "울산", "세종": "세종", "세종특별자치시": "세종", "경기": "경기", "경기도": "경기",
    "강원": "강원", "강원도": "강원", "강원특별자치도": "강원", "충북": "충북", "충청북도": "충북",
    "충남": "충남", "충청남도": "충남", "전북": "전북", "전라북도": "전북", "전북특별자치도": "전북",
    "전남": "전남", "전라남도": "전남", "경북": "경북", "경상북도": "경북", "경남": "경남", "경상남도": "경남",
    "제주": "제주", "제주도": "제주", "제주특별자치도": "제주",
}
# Public codes of districts, in the order in which names are looked for.
SEOUL = {
    "종로구": "11110", "중구": "11140", "용산구": "11170", "성동구": "11200", "광진구": "11215", "동대문구": "11230", "중랑구": "11260", "성북구": "11290",
    "강북구": "11305", "도봉구": "11320", "노원구": "11350", "은평구": "11380", "서대문구": "11410", "마포구": "11440", "양천구": "11470", "강서구": "11500",
    "구로구": "11530", "금천구": "11545", "영등포구": "11560", "동작구": "11590", "관악구": "11620", "서초구": "11650", "강남구": "11680", "송파구": "11710",
    "강동구": "11740",
}
GYEONGGI = {
    "수원시 장안구": "41111", "수원시 권선구": "41113", "수원시 팔달구": "41115", "수원시 영통구": "41117", "성남시 수정구": "41131", "성남시 중원구": "41133",
    "성남시 분당구": "41135", "의정부시": "41150", "안양시 만안구": "41171", "안양시 동안구": "41173", "부천시 원미구": "41192", "광명시": "41210", "평택시": "41220",
    "동두천시": "41250", "안산시 상록구": "41271", "안산시 단원구": "41273", "고양시 덕양구": "41281", "고양시 일산동구": "41285", "고양시 일산서구": "41287",
    "과천시": "41290", "구리시": "41310", "남양주시": "41360", "오산시": "41370", "시흥시": "41390", "군포시": "41410", "의왕시": "41430", "하남시": "41450",
    "용인시 처인구": "41461", "용인시 기흥구": "41463", "용인시 수지구": "41465", "파주시": "41480", "이천시": "41500", "안성시": "41550", "김포시": "41570",
    "화성시 만세구": "41591", "광주시": "41610", "양주시": "41630", "포천시": "41650", "여주시": "41670", "연천군": "41800", "가평군": "41820", "양평군": "41830",
}
INCHEON = {
    "중구": "28110", "동구": "28140", "미추홀구": "28177", "연수구": "28185", "남동구": "28200", "부평구": "28237", "계양구": "28245", "서구": "28260",
    "강화군": "28710", "옹진군": "28720",
}
# Districts of Gyeonggi's cities that have some; those without a code above count too.
CITY_DISTRICTS = {
    "수원시": ["장안구", "권선구", "팔달구", "영통구"], "성남시": ["수정구", "중원구", "분당구"], "안양시": ["만안구", "동안구"], "안산시": ["상록구", "단원구"],
    "고양시": ["덕양구", "일산동구", "일산서구"], "용인시": ["처인구", "기흥구", "수지구"], "부천시": ["원미구", "소사구", "오정구"],
    "화성시": ["만세구", "효행구", "병점구", "동탄구"],
}
REGULATED_GYEONGGI = (
    "과천시", "광명시", "의왕시", "하남시", "성남시 분당구", "성남시 수정구", "성남시 중원구", "수원시 영통구", "수원시 장안구", "수원시 팔달구", "안양시 동안구", "용인시 수지구",
)
LAND_PERMIT_UNTIL = "2026-12-31"
# What names say.
PROVINCE_WORD = r"(특별시|광역시|특별자치시|특별자치도|도)$"
RENTAL_NAME = r"공공임대|건설임대|임대주택|임차인\s*모집|행복주택|국민임대|영구임대|통합공공임대|장기전세|민간임대|매입임대|전세임대|임대아파트"
LAND_LEASE_NAME = "토지임대부"
NEWLYWED_TOWN = "신혼희망타운"
FOR_ORGANISATIONS = r"기관\s?공급[^()]{0,30}?(?:대상\s?기업|참여\s?기업|기업\s?모집|기관\s?모집)|대상\s?기업\s?모집|기업체?\s?기관\s?공급"
KEEP_AFTER_WINNERS = 14
PRICE_BANDS = {"5": (0.0, 5.0), "5-10": (5.0, 10.0), "10-15": (10.0, 15.0), "15-20": (15.0, 20.0), "20": (20.0, 1e9)}
SIZE_BANDS = {"s": (0.0, 60.0), "m": (60.0, 85.0), "l": (85.0, 1e9)}

_yes = lambda c: F.coalesce(c, F.lit(False))
_text = lambda c: F.coalesce(c, F.lit(""))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _first_in(names, text: Column, before: str = "") -> Column:
    """The first name, in the table's order, that the text contains."""
    return F.get(F.filter(F.lit(list(names)), lambda n: F.contains(text, F.concat(F.lit(before), n))), F.lit(0))


def _once(value: Column, body) -> Column:
    """body(value), with value evaluated once a row; a column that an expression names several times is otherwise computed as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_word(text: Column) -> Column:
    return F.split_part(F.trim(_text(text)), F.lit(" "), F.lit(1))


# --- place -------------------------------------------------------------------------------------------------------------------

def plain_city(address: Column) -> Column:
    """City names by their legal form."""
    return F.regexp_replace(_text(address), "([가-힣]+)특례시", "$1시")


def main_address(address: Column) -> Column:
    """The address, or one in brackets if only that begins with a province."""
    known = lambda x: _once(first_word(x), lambda w: _lookup(PROVINCES, w).isNotNull() | w.rlike(PROVINCE_WORD))
    inner = lambda a: F.get(F.filter(F.regexp_extract_all(a, F.lit(r"\(([^)]*)\)"), F.lit(1)), known), F.lit(0))
    return _once(F.trim(_text(address)), lambda a: F.when(known(a), a).otherwise(F.coalesce(F.trim(inner(a)), a)))


def province(address: Column) -> Column:
    return _lookup(PROVINCES, first_word(address))


def region(address: Column) -> Column:
    """Seoul, Gyeonggi, Incheon, or one name for all others."""
    a = _text(address)
    return F.when(a.startswith("서울"), "서울").when(a.startswith("경기"), "경기").when(a.startswith("인천"), "인천").otherwise("지방")


def coded_district(address: Column) -> Column:
    """The district as the code table names it; a city with districts stays a city if none is named."""
    inside = lambda city: F.try_element_at(F.create_map(*[x for k, v in CITY_DISTRICTS.items() for x in (F.lit(k), F.lit(v))]), city)

    def in_gyeonggi(a: Column) -> Column:
        part = lambda city: F.get(F.filter(inside(city), lambda n: F.contains(a, n)), F.lit(0))
        named = lambda city: _once(part(city), lambda p: F.when(p.isNotNull(), F.concat_ws(" ", city, p)).otherwise(city))
        return _once(_first_in(dict.fromkeys(k.split(" ")[0] for k in GYEONGGI), a), named)

    return _once(plain_city(address), lambda a: (
        F.when(region(a) == "서울", _first_in(SEOUL, a, " "))
        .when(region(a) == "경기", in_gyeonggi(a))
        .when(region(a) == "인천", F.concat(F.lit("인천 "), _first_in(INCHEON, a, " ")))
    ))


def district(address: Column) -> Column:
    """The city, county or district of any address in the country."""
    def plain(words: Column) -> Column:
        second, third = F.get(words, F.lit(1)), F.get(words, F.lit(2))
        return F.when(second.rlike("[시군구]$"), F.when(second.endswith("시") & _yes(third.endswith("구")), F.concat_ws(" ", second, third)).otherwise(second))

    def named(a: Column) -> Column:
        words = F.filter(F.split(plain_city(a), r"(?U)\s+"), lambda w: w != "")
        other = _once(words, lambda w: F.when((F.size(w) < 2) | _yes(province(a) == "세종"), None).otherwise(plain(w)))
        return F.coalesce(F.replace(coded_district(a), F.lit("인천 "), F.lit("")), other)

    return _once(address, named)


def district_code(name: Column) -> Column:
    """The code of a district as coded_district names it."""
    return _once(name, lambda n: F.when(n.startswith("인천 "), _lookup(INCHEON, F.substring(n, 4, 100))).otherwise(F.coalesce(_lookup(SEOUL, n), _lookup(GYEONGGI, n))))


def is_capital(address: Column) -> Column:
    return region(address) != "지방"


def is_regulated(address: Column) -> Column:
    whole = lambda name: name.isin("성남시", "수원시") & ~F.contains(_text(address), F.lit("권선구"))
    named = _once(coded_district(address), lambda name: _yes(name.isin(*REGULATED_GYEONGGI) | whole(name)))
    return F.when(region(address) == "서울", True).when(region(address) == "경기", named).otherwise(False)


def dong(address: Column) -> Column:
    """The smallest place name among the second to fifth word, none after a word with a digit; blank if there is none."""
    words = F.slice(F.filter(F.split(_text(address), r"(?U)\s+"), lambda w: w != ""), 2, 4)
    name = lambda w: w.rlike("^[가-힣]+[0-9]?(?:동|읍|면|가)$") & (w != "공동")
    stop = F.filter(words, lambda w: name(w) | w.rlike(r"\d"))
    return _once(F.get(stop, F.lit(0)), lambda found: F.when(_yes(name(found)), found).otherwise(""))


def address_prefix(address: Column) -> Column:
    """The words before the first place name below the district or with a digit."""
    words = F.filter(F.split(_text(address), r"(?U)\s+"), lambda w: w != "")
    stops = F.transform(words, lambda w, i: ((i > 0) & w.rlike("^[가-힣]+[0-9]?(?:동|읍|면|가|리)$") & (w != "공동")) | w.rlike(r"\d"))
    end = F.array_position(stops, F.lit(True))
    return F.concat_ws(" ", F.when(end > 0, F.slice(words, F.lit(1), (end - 1).cast("int"))).otherwise(words))


# --- kind and supply ---------------------------------------------------------------------------------------------------------

def area_of(house_type: Column) -> Column:
    """The area in a house type: 84.9811 of 084.9811C."""
    return F.regexp_extract(_text(house_type), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")


def unit_label(house_type: Column) -> Column:
    """Whole area and suffix: 84C of 084.9811C."""
    whole = F.when(area_of(house_type) > 0, F.floor(area_of(house_type)).cast("string")).otherwise("")
    label = F.concat(whole, F.regexp_replace(_text(house_type), r"^[\d.\s]+", ""))
    return F.when(label == "", _text(house_type)).otherwise(label)


def kind_label(kind: Column, category: Column) -> Column:
    k = _text(kind)
    plain = k.isin("", "APT", "민영", "국민")
    return F.when(category == "general", F.when(plain, "일반분양 (특별공급·1순위)").otherwise(F.concat(F.lit("일반분양 · "), k))).otherwise(F.when(k == "", "무순위·잔여세대").otherwise(k))


def is_rental(rent_code: Column, name: Column) -> Column:
    """By the code where there is one, otherwise by the name."""
    return F.when(_text(rent_code) != "", F.contains(rent_code, F.lit("임대"))).otherwise(_text(name).rlike(RENTAL_NAME) & ~F.contains(_text(name), F.lit(LAND_LEASE_NAME)))


def target(name: Column) -> Column:
    n = _text(name)
    return F.when(F.contains(n, F.lit(NEWLYWED_TOWN)), "신혼부부").when(F.contains(n, F.lit("청년")) & F.contains(n, F.lit("주택")), "청년")


def for_organisations(title: Column) -> Column:
    return _text(title).rlike(FOR_ORGANISATIONS)


def regulation(speculative: Column, adjusted: Column) -> Column:
    """The zone by the notice's two flags; unknown unless one says yes or both say no."""
    return F.when(_yes(speculative), "투기과열").when(_yes(adjusted), "조정").when(_yes(~speculative & ~adjusted), "비규제")


def no_supply(category: Column, general: Column, special: Column) -> Column:
    """No general and no special units; unknown numbers aren't none."""
    return _yes((category == "general") & (general == 0) & (special == 0))


def listings(raw: DataFrame, today: Column) -> DataFrame:
    """raw (normalised notices times house types) with place, kind, regulation and defaults; rows without a price have no listing.

    raw: notice_no, house_ty, name, address, kind, category, rent_secd, speculative, adjusted, price_cap, price, move_in (yyyy-MM).
    """
    c = F.col
    # columns that others are made of, each computed once
    raw = raw.where("price is not null and price <> 0").withColumns({
        "__rental": is_rental(c("rent_secd"), c("name")), "__regulated": F.coalesce("speculative", is_regulated(c("address"))),
        "__coded": coded_district(c("address")), "__kind": kind_label(c("kind"), c("category")), "__label": unit_label(c("house_ty")),
    })
    rental, regulated = c("__rental"), c("__regulated")
    cap = _yes(c("price_cap"))
    built = _yes(F.substring("move_in", 1, 7) <= F.date_format(F.date_add(today, 183), "yyyy-MM"))
    rewin = F.when(regulated, "10년").when(cap, "공고문 확인").otherwise("없음")
    kind, label = c("__kind"), c("__label")
    return raw.select(
        *[x for x in raw.columns if not x.startswith("__")],
        F.concat_ws("-", "notice_no", F.when(_text(c("house_ty")) != "", c("house_ty")).otherwise(label)).alias("id"), label.alias("unit"), area_of(c("house_ty")).alias("area"),
        region(c("address")).alias("region"), c("__coded").alias("sigungu"), province(c("address")).alias("sido"),
        district(main_address(c("address"))).alias("district"), district_code(c("__coded")).alias("lawd"),
        rental.alias("rental"), F.contains(_text(c("name")), F.lit(LAND_LEASE_NAME)).alias("land_lease"),
        F.when(rental, F.replace(kind, F.lit("일반분양"), F.lit("공공임대"))).otherwise(kind).alias("label"), target(c("name")).alias("target"),
        is_capital(c("address")).alias("capital"), regulated.alias("regulated"), regulation(c("speculative"), c("adjusted")).alias("reg_kind"),
        (regulated & is_capital(c("address")) & (today <= F.lit(LAND_PERMIT_UNTIL).cast("date"))).alias("land_permit"),
        F.lit(0.10).alias("contract_rate"), F.when(built, 0.0).otherwise(0.6).alias("mid_rate"), F.when(~cap, 0).alias("residence_duty"),
        (regulated & ~F.contains(_text(c("name")), F.lit(NEWLYWED_TOWN))).alias("need_head"), (c("category") != "remainder").alias("need_account"),
        F.filter(F.array(F.struct(F.lit("재당첨 제한").alias("name"), rewin.alias("value")), F.when(cap, F.struct(F.lit("실거주 의무").alias("name"), F.lit("공고문 확인").alias("value")))), lambda x: x.isNotNull()).alias("limits"),
    )


# --- filters and retention -----------------------------------------------------------------------------------------------------

def listing_filter(equal: dict[str, str | None], date_field: str = "apply", since: str | None = None, until: str | None = None) -> Column:
    """All given equalities, and the date field in the range; a row without the date isn't in any range."""
    out = F.lit(True)
    for name, value in equal.items():
        if value is not None:
            out = out & _yes(F.col(name) == value)
    if since is not None:
        out = out & _yes(F.col(date_field) >= F.lit(since).cast("date"))
    if until is not None:
        out = out & _yes(F.col(date_field) <= F.lit(until).cast("date"))
    return out


def in_price_band(price: Column, band: str) -> Column:
    low, high = PRICE_BANDS[band]
    return _yes((price >= low) & (price < high))


def in_size_band(area: Column, band: str) -> Column:
    """Sizes are closed above, prices below."""
    low, high = SIZE_BANDS[band]
    return _yes((area > low) & (area <= high))


def by_grade_and_date(grade: Column, day: Column, order: tuple[str, ...] = ("lotto", "consider", "flat", "pass", "unknown")) -> list[Column]:
    """Sort columns: better grades first, then earlier days, unknown days last."""
    return [F.array_position(F.lit(list(order)), grade), day.asc_nulls_last()]


def still_listed(winners: Column, closes: Column, opens: Column, today: Column) -> Column:
    """Whether a listing of the previous run belongs to today's: until some days after its winners, else until it closes."""
    until = F.coalesce(F.date_add(winners, KEEP_AFTER_WINNERS), closes, opens)
    return _yes(until >= today)


def kept_of_previous(previous: DataFrame, today: Column) -> DataFrame:
    """The previous rows that stay when a source gave nothing: undated ones too, since their time isn't known."""
    dated = F.coalesce("winner", "apply_end", "apply").isNotNull()
    return previous.where(~dated | still_listed(F.col("winner"), F.col("apply_end"), F.col("apply"), today))
