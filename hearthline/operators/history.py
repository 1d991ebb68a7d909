"""Competition results and their history, notices' events and who hears of them: joins of snapshots, never loops over notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.text import number
from hearthline.operators.market import nearest_area_per_group

# Fixed values.
HISTORY_DAYS, RETRY_DAYS, AREA_TOLERANCE, BACKFILL, MOST_NEW = 31 * 12, 30, 15.0, 60, 30

_yes = lambda c: F.coalesce(c, F.lit(False))


def competition(raw: DataFrame) -> DataFrame:
    """notice, house_ty, rank, reside, supply, req, rate (as written), rate_num (null for dashes and marks) of raw rows of strings."""
    return raw.select(
        F.trim("HOUSE_MANAGE_NO").alias("notice"), F.trim("HOUSE_TY").alias("house_ty"), F.trim("SUBSCRPT_RANK_CODE").alias("rank"), F.trim("RESIDE_SENM").alias("reside"),
        number(F.col("SUPLY_HSHLDCO")).cast("int").alias("supply"), number(F.col("REQ_CNT")).cast("int").alias("req"), F.trim("CMPET_RATE").alias("rate"), number(F.col("CMPET_RATE")).alias("rate_num"),
    )


def summary_by_type(rows: DataFrame, order: list[str]) -> DataFrame:
    """notice, house_ty and the row that stands for it: rank 1 of the own region, then rank 1 of any, then the first. order: a total order of the rows of a type."""
    first = F.col("rank").isin("1", "01", "1순위")
    priority = F.when(first & F.contains("reside", F.lit("해당")), 0).when(first, 1).otherwise(2)
    best = rows.groupBy("notice", "house_ty").agg(F.min_by(F.struct("rank", "reside", "supply", "req", "rate", "rate_num"), F.struct(priority.alias("p"), *order)).alias("r"))
    return best.select("notice", "house_ty", "r.*")


def with_competition(listings: DataFrame, summary: DataFrame) -> DataFrame:
    """listings (notice, house_ty) with their competition; types are told apart without blanks around them."""
    s = summary.select(F.col("notice").alias("n"), F.col("house_ty").alias("t"), F.struct(*[c for c in summary.columns if c not in ("notice", "house_ty")]).alias("competition"))
    return listings.join(s, (F.col("notice") == F.col("n")) & (F.trim(F.col("house_ty")) == F.col("t")), "left").drop("n", "t")


def for_present_districts(history: DataFrame, listings: DataFrame, key: str = "district") -> DataFrame:
    return history.join(listings.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")


def similar_results(listings: DataFrame, history: DataFrame, today: Column, band: float = AREA_TOLERANCE, n: int = 3) -> DataFrame:
    """listing, group, other, difference: of other notices of the district in the last year the type nearest in area; the newest n notices. See nearest_area_per_group."""
    recent = history.where(_yes(F.col("at") >= F.date_sub(today, HISTORY_DAYS)))
    return nearest_area_per_group(listings, recent, band, n)


def to_look_up(notices: DataFrame, history: DataFrame, today: Column, most: int = BACKFILL) -> DataFrame:
    """Closed notices to be looked up: not in the history with results, nor looked up in vain within the last days; the newest first, as many as the budget allows.

    notices: notice, closed; history: notice, found (boolean), checked.
    """
    done = history.where(F.col("found") | _yes(F.col("checked") > F.date_sub(today, RETRY_DAYS))).select("notice")
    return notices.where(_yes(F.col("closed") < today)).join(done, "notice", "left_anti").orderBy(F.col("closed").desc(), "notice").limit(most)


def merged(history: DataFrame, found: DataFrame, today: Column) -> DataFrame:
    """The history with today's results in place of older ones, without what has grown too old or has no date."""
    both = history.withColumn("p", F.lit(1)).unionByName(found.withColumn("p", F.lit(0)))
    rest = [c for c in history.columns if c != "notice"]
    latest = both.groupBy("notice").agg(F.min_by(F.struct(*rest), "p").alias("r")).select("notice", "r.*").select(*history.columns)
    return latest.where(_yes(F.col("apply") >= F.date_sub(today, HISTORY_DAYS)))


def usable(cache: DataFrame, today: Column, days: int) -> DataFrame:
    """Cached answers that still count: those that found something, and those that found nothing within the last days."""
    return cache.where(F.col("found") | _yes(F.col("checked") >= F.date_sub(today, days)))


def best_unit(listings: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """A group's row with the highest value; an unknown value is below all, and of equal ones the least key counts."""
    order = F.struct(F.coalesce(F.col(value), F.lit(-99.0)).alias("v"), (-F.col(key)).alias("k"))
    return listings.groupBy(group).agg(F.max_by(F.struct(*[c for c in listings.columns if c != group]), order).alias("r")).select(group, "r.*")


def events(today: DataFrame, before: DataFrame, day: Column, most: int = MOST_NEW) -> DataFrame:
    """notice, kind: new (open, and not in the snapshot before; none at all if there are too many), start and end (tomorrow).

    today: notice, first (first day of applications), closes; before: notice.
    """
    tomorrow = F.date_add(day, 1)
    rows = today.groupBy("notice").agg(F.min("first").alias("first"), F.min("closes").alias("closes"))
    fresh = rows.where(F.coalesce("closes", "first", F.lit("9999-12-31").cast("date")) >= day).join(before.select("notice").distinct(), "notice", "left_anti")
    fresh = fresh.select("notice", F.lit("new").alias("kind"))
    fresh = fresh.where(F.lit(most) >= fresh.agg(F.count(F.lit(1)).alias("n")).scalar())
    soon = F.when(F.col("first") == tomorrow, "start").when((F.col("closes") == tomorrow) & ~_yes(F.col("first") == tomorrow), "end")
    return fresh.unionByName(rows.select("notice", soon.alias("kind")).where("kind is not null"))


def digest_titles(matches: DataFrame, shown: int = 4) -> DataFrame:
    """sub_id, title (events by kind), body (the first lines, reminders marked, and how many more). matches: sub_id, event_id, kind, line."""
    titles = {"new": "새 공고", "start": "내일 접수 시작", "end": "내일 접수 마감"}
    name = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    top = matches.withColumn("rn", F.row_number().over(Window.partitionBy("sub_id").orderBy("event_id")))
    line = F.concat(F.when(F.col("kind") == "new", "").otherwise(F.concat(F.lit("["), name[F.col("kind")], F.lit("] "))), F.col("line"))
    sums = top.groupBy("sub_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in titles], F.array_sort(F.collect_list(F.when(F.col("rn") <= shown, F.struct("rn", line.alias("line"))))).alias("l"),
    )
    head = F.array_join(F.array_compact(F.array(*[F.when(F.col(k) > 0, F.concat(F.lit(f"{title} "), F.col(k).cast("string"))) for k, title in titles.items()])), " · ")
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n외 "), (F.col("n") - shown).cast("string"), F.lit("건"))).otherwise("")
    return sums.select("sub_id", head.alias("title"), F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), more).alias("body"))
