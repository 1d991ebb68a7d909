"""Readers of notices and transactions: JSON overviews with candidate field names, XML transactions, and a drift report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthline.functions.text import date_of, number

# Tags of a transaction and the columns they become.
TRANSACTION_TEXT = {"aptNm": "apt", "umdNm": "umd", "jibun": "jibun", "aptDong": "dong", "ownershipGbn": "kind", "dealingGbn": "deal_type"}
TRANSACTION_NUMBER = {"excluUseAr": "area", "dealAmount": "amount", "deposit": "deposit", "monthlyRent": "monthly", "floor": "floor", "buildYear": "build_year"}
TRANSACTION_OTHER = ("dealYear", "dealMonth", "dealDay", "cdealType")


def first_known(df: DataFrame, candidates: list[str]) -> Column:
    """The first of several field names that the table has with a value; null if it has none of them."""
    here = [F.col(c).cast("string") for c in candidates if c in df.columns]
    blank_is_unknown = [F.when(F.trim(c) != "", F.trim(c)) for c in here]
    return F.coalesce(*blank_is_unknown) if here else F.lit(None).cast("string")


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of XML <item> files: typed, with cancelled deals still in and marked, so that pages are counted before they are dropped."""
    tags = [*TRANSACTION_TEXT, *TRANSACTION_NUMBER, *TRANSACTION_OTHER]
    schema = ", ".join(f"{t} string" for t in tags)
    return typed(spark.read.format("xml").option("rowTag", "item").schema(schema).load(path))


def typed(raw: DataFrame) -> DataFrame:
    """Columns named as the tags, typed and under the names that transactions have."""
    day = F.concat_ws("-", *[F.trim(F.col(c)) for c in ("dealYear", "dealMonth", "dealDay")])
    return raw.select(
        *[F.trim(F.col(t)).alias(c) for t, c in TRANSACTION_TEXT.items()], *[number(F.col(t)).alias(c) for t, c in TRANSACTION_NUMBER.items()],
        date_of(day).alias("date"), F.coalesce(F.trim(F.col("cdealType")) == "O", F.lit(False)).alias("cancelled"),
    )


def live(rows: DataFrame) -> DataFrame:
    """Transactions that count; a rent without a monthly amount has none to pay."""
    return rows.where("not cancelled").drop("cancelled").withColumn("monthly", F.coalesce("monthly", F.when(F.col("deposit").isNotNull(), 0.0)))


# What an answer's fields are called, those of an overview and those of a house type; the first that has a value counts.
OVERVIEW = {
    "notice_no": ["PBLANC_NO", "HOUSE_MANAGE_NO"], "name": ["HOUSE_NM"], "address": ["HSSPLY_ADRES"], "kind": ["HOUSE_SECD_NM", "HOUSE_DTL_SECD_NM"], "notice": ["RCRIT_PBLANC_DE"],
    "apply": ["RCEPT_BGNDE", "SUBSCRPT_RCEPT_BGNDE", "GNRL_RNK1_CRSPAREA_RCPTDE"], "apply_end": ["RCEPT_ENDDE", "SUBSCRPT_RCEPT_ENDDE"], "winner": ["PRZWNER_PRESNATN_DE"],
    "contract": ["CNTRCT_CNCLS_BGNDE"], "contract_end": ["CNTRCT_CNCLS_ENDDE"], "total_households": ["TOT_SUPLY_HSHLDCO"], "move_in": ["MVN_PREARNGE_YM"], "url": ["PBLANC_URL", "HMPG_ADRES"],
    "house_secd": ["HOUSE_SECD"], "house_dtl": ["HOUSE_DTL_SECD_NM"], "rent_secd": ["RENT_SECD_NM"], "special_apply": ["SPSPLY_RCEPT_BGNDE"], "special_apply_end": ["SPSPLY_RCEPT_ENDDE"],
    "area_code_nm": ["SUBSCRPT_AREA_CODE_NM"], "speculative": ["SPECLT_RDN_EARTH_AT"], "adjusted": ["MDAT_TRGET_AREA_SECD"], "price_cap": ["PARCPRC_ULS_AT"],
}
UNIT = {"house_ty": ["HOUSE_TY"], "price": ["LTTOT_TOP_AMOUNT", "SUPLY_AMOUNT"], "households": ["SUPLY_HSHLDCO", "SPSPLY_HSHLDCO"]}
SPECIAL = {
    "newborn": "NWBB_HSHLDCO", "newlywed": "NWWDS_HSHLDCO", "first": "LFE_FRST_HSHLDCO", "multichild": "MNYCH_HSHLDCO", "elder": "OLD_PARNTS_SUPORT_HSHLDCO", "agency": "INSTT_RECOMEND_HSHLDCO",
    "relocated": "TRANSR_INSTT_ENFSN_HSHLDCO", "youth": "YGMN_HSHLDCO", "etc": "ETC_HSHLDCO", "total": "SPSPLY_HSHLDCO",
}
DAYS = ("notice", "apply", "apply_end", "winner", "contract", "contract_end", "special_apply", "special_apply_end")


def _whole(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("long")


def normalised(overviews: DataFrame, units: DataFrame) -> DataFrame:
    """Overviews times house types, under the names that listing.listings takes; body is an answer's JSON text in both. Keys: category, notice_no."""
    fields = lambda c: F.from_json(c, "map<string,string>")
    of = lambda m, names: F.coalesce(*[F.when(F.trim(F.col(m)[n]) != "", F.trim(F.col(m)[n])) for n in names])
    rows = overviews.where("notice_no <> ''").select("category", "notice_no", fields("body").alias("o")).join(
        units.where("body is not null").select("category", "notice_no", fields("body").alias("u")), ["category", "notice_no"])
    flag = lambda c: F.upper(c).isin("Y", "1", "TRUE")
    month = F.regexp_replace(of("o", OVERVIEW["move_in"]), "[^0-9]", "")
    special = F.struct(*[F.when(F.map_contains_key("u", n), F.coalesce(_whole(F.col("u")[n]), F.lit(0))).alias(k) for k, n in SPECIAL.items()])
    has_special = F.exists(F.map_keys("u"), lambda k: k.isin(*[n for k_, n in SPECIAL.items() if k_ != "total"]))
    out = {
        **{k: of("o", n) for k, n in OVERVIEW.items() if k != "notice_no"}, **{k: of("u", n) for k, n in UNIT.items()},
        **{k: date_of(of("o", OVERVIEW[k])) for k in DAYS}, **{k: flag(of("o", OVERVIEW[k])) for k in ("speculative", "adjusted", "price_cap")},
        "kind": F.coalesce(of("o", OVERVIEW["kind"]), F.when(F.col("category") == "remainder", "무순위·잔여세대").otherwise("일반분양")),
        "name": F.coalesce(of("o", OVERVIEW["name"]), F.lit("")), "address": F.coalesce(of("o", OVERVIEW["address"]), F.lit("")),
        "total_households": _whole(of("o", OVERVIEW["total_households"])), "households": _whole(of("u", UNIT["households"])),
        "move_in": F.when(F.length(month) >= 6, F.concat_ws("-", F.substring(month, 1, 4), F.substring(month, 5, 2), F.when(F.length(month) >= 8, F.substring(month, 7, 2)))),
        "price": F.nullif(_whole(of("u", UNIT["price"])), F.lit(0)) / 10000, "special_units": F.when(has_special, special),
    }
    return rows.select("category", "notice_no", *[c.alias(k) for k, c in out.items()])


def recent(rows: DataFrame, column: str, today: Column, n: int) -> DataFrame:
    """Rows of the last n months, by a partition column of months (yyyyMM)."""
    return rows.where(F.array_contains(months(today, n), F.col(column)))


def with_origin(**frames: DataFrame) -> DataFrame:
    """The union of several tables by column name, and where each row is from."""
    named = [df.withColumn("origin", F.lit(name)) for name, df in frames.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def months(today: Column, n: int) -> Column:
    """The last n months as yyyyMM, the newest first: a filter on a month partition column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.add_months(F.trunc(today, "month"), -i), "yyyyMM"))


def open_units(overviews: DataFrame, models: DataFrame, key: str, closes: str, winners: str, today: Column, days: int = 14) -> DataFrame:
    """Overview times house type, of notices not closed yet or whose winners were announced at most so many days ago; undated ones stay."""
    until = F.greatest(F.col(closes), F.date_add(F.col(winners), days))
    return overviews.where(until.isNull() | (until >= today)).join(models, key)


def drift(df: DataFrame, expected: StructType) -> list[str]:
    """What differs from the expected schema: missing, new and retyped fields, without reading a row."""
    want, have = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (expected, df.schema))
    return (
        [f"missing {c}" for c in sorted(want.keys() - have.keys())] + [f"new {c}" for c in sorted(have.keys() - want.keys())]
        + [f"{c}: {want[c]} became {have[c]}" for c in sorted(want.keys() & have.keys()) if want[c] != have[c]]
    )
