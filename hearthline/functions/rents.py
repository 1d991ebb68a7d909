"""Rows of rent tables out of a stream of numbers.

Text of a table comes without its lines: what is left is an order of words and numbers. A row says the deposit, the part due at contract, the part due at moving
in and the monthly rent, and the first is the sum of the next two: four numbers that add up like that are a row, whatever stands between them. Where the contract part is printed once for
several rows, three numbers are, with the contract part of the row before. House type, tier and unit are said before a row and hold until they are said again.

Tokens become rows of a table and are read by windows in their order: what holds is the last that was said, what follows is a few rows ahead. So a text
of any length is read once, in time that grows with it, and nothing is copied from step to step. Of numbers that could belong to two rows the earlier row has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of tables and the tiers that they name, and what is possible in won.
TIER_WORDS = {
    "청년\\(소득 ?있음\\)": "청년(소득 있음)", "청년\\(소득 ?없음\\)": "청년(소득 없음)", "신혼부부": "신혼부부·한부모", "주거급여": "주거급여수급자", "고령자": "고령자", "대학생": "대학생", "청년": "청년", "가 ?군": "가군", "나 ?군": "나군",
}
DATE, SHARE, AMOUNT = r"\d{4}[.\-]\d{1,2}[.\-]\d{1,2}", r"[\d.]+ ?%", r"\d{1,3}(?:,\d{3})+|\d{5,}"
TYPE = r"(?<![\d.,])\d{2,3}(?:\.\d{1,4})?[A-Z]{0,2}\d?(?![\d,.])"
UNIT, LESS = r"천원|\(원\)|단위 ?:? ?원", r"\([+\-−]\)"
DEPOSIT, RENT = (1_000_000, 500_000_000), (10_000, 3_000_000)
LEAST_AREA, MOST_AREA = 10, 200


def tokens(text: Column) -> Column:
    """Array of struct(kind, token) in the order of the text; kinds are amount, type, tier, unit and less."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    every = "|".join([DATE, SHARE, LESS, UNIT, *TIER_WORDS, AMOUNT, TYPE])
    area = lambda x: F.regexp_extract(x, r"^[\d.]+", 0).try_cast("double").between(LEAST_AREA, MOST_AREA) & ~x.startswith("0")
    is_a = lambda x, pattern: x.rlike(f"^(?:{pattern})$")

    def kind(x: Column) -> Column:
        return (
            F.when(is_a(x, DATE) | is_a(x, SHARE), None).when(is_a(x, LESS), "less").when(is_a(x, UNIT), "unit").when(is_a(x, "|".join(TIER_WORDS)), "tier")
            .when(is_a(x, AMOUNT), "amount").when(area(x), "type")
        )

    found = F.transform(F.regexp_extract_all(squeezed, F.lit(f"({every})"), F.lit(1)), lambda x: F.struct(kind(x).alias("kind"), x.alias("token")))
    return F.filter(found, lambda x: x["kind"].isNotNull())


def _tier(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(TIER_WORDS.items()):
        out = F.when(token.rlike(f"^{pattern}$"), name).otherwise(out)
    return out


def rent_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, type, tier, deposit, contract, rent: the rows of each text's tables, in won. Equal rows of a text are one, and a row without a type is none."""
    c, n = F.col, F.lit
    read = texts.select(c(key).alias("__key"), F.posexplode(tokens(c(text))).alias("at", "x")).select("__key", "at", "x.kind", "x.token")
    in_order = Window.partitionBy("__key").orderBy("at")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = lambda kind: F.when(c("kind") == kind, c("token"))
    held = read.select(
        "__key", "at", "kind", F.last(said("type"), ignorenulls=True).over(so_far).alias("type"), F.last(_tier(said("tier")), ignorenulls=True).over(so_far).alias("tier"),
        F.coalesce(F.last(said("unit"), ignorenulls=True).over(so_far) == "천원", n(False)).alias("thousands"), (F.lag("kind").over(in_order) == "less").alias("after_less"),
        F.regexp_replace(said("amount"), ",", "").try_cast("long").alias("a"),
    ).where("a is not null")
    ahead = held.select("*", F.row_number().over(in_order).alias("i"), *[F.lead("a", j).over(in_order).alias(x) for j, x in ((1, "b"), (2, "c"), (3, "d"))])
    unit = F.when((c("a") < DEPOSIT[0]) & c("thousands"), 1000).otherwise(1)
    fits = lambda contract, rent: (c("a") * unit).between(*DEPOSIT) & rent.between(*RENT) & (contract < c("a"))
    four = (c("a") == c("b") + c("c")) & (c("b") > 0) & (c("c") > 0) & fits(c("b"), c("d"))
    marked = ahead.withColumn("four", F.coalesce(four, n(False)))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("kept", F.last(F.when(c("four"), c("b")), ignorenulls=True).over(before))
    three = ~c("four") & (c("b") > 0) & (c("a") == c("b") + c("kept")) & ~F.coalesce(c("after_less"), n(False)) & fits(c("kept"), c("c"))
    rows = marked.withColumn("used", F.when(c("four"), 4).when(F.coalesce(three, n(False)), 3)).where("used is not null and type is not null")
    # rows that may share numbers are one run; of a run, each row that begins after the end of the one before
    new = F.coalesce(c("i") >= F.max(c("i") + c("used")).over(before), n(True))
    runs = rows.withColumn("run", F.sum(new.cast("int")).over(so_far))
    row = F.struct("i", "used", "type", "tier", (c("a") * unit).alias("deposit"), (F.when(c("four"), c("b")).otherwise(c("kept")) * unit).alias("contract"), F.when(c("four"), c("d")).otherwise(c("c")).alias("rent"))
    grouped = runs.groupBy("__key", "run").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    starts = F.aggregate(
        "rows", F.struct(n(0).alias("end"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.when(x["i"] >= acc["end"], F.struct((x["i"] + x["used"]).alias("end"), F.concat(acc["starts"], F.array(x["i"])).alias("starts"))).otherwise(acc), lambda acc: acc["starts"])
    alone = F.when(F.size("rows") == 1, F.col("rows")).otherwise(F.filter("rows", lambda x: F.array_contains(starts, x["i"])))
    taken = grouped.select("__key", F.explode(alone).alias("x")).select("__key", "x.*")
    lines = taken.groupBy("__key", "type", "tier", "deposit", "contract", "rent").agg(F.min("i").alias("i"))
    return lines.select(c("__key").alias(key), F.row_number().over(Window.partitionBy("__key").orderBy("i")).alias("line"), "type", "tier", "deposit", "contract", "rent")
