"""Batch operators with carried state: episodes, counters, limits, carry-forward, snapshot differences and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def episodes(snapshots: DataFrame, group: list[str], at: list[str], bad: Column) -> DataFrame:
    """group, started, ended, snapshots: runs of bad snapshots (gaps and islands). at: a total order whose first column is the time."""
    order = Window.partitionBy(*group).orderBy(*at)
    marked = snapshots.withColumn("bad", bad).withColumn("starts", (F.col("bad") & ~F.coalesce(F.lag("bad").over(order), F.lit(False))).cast("int"))
    island = marked.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("bad")
    return island.groupBy(*group, "island").agg(F.min(at[0]).alias("started"), F.max(at[0]).alias("ended"), F.count(F.lit(1)).alias("snapshots")).drop("island")


def daily_counters(events: DataFrame, today: Column, keep_days: int) -> DataFrame:
    """day, key, n of the last keep_days days before today."""
    day = F.to_date("ts")
    return events.withColumn("day", day).where(F.col("day") > F.date_sub(today, keep_days)).groupBy("day", "key").agg(F.count(F.lit(1)).alias("n"))


def first_per_day(events: DataFrame, user: str, order: list[str], limit: int) -> DataFrame:
    """events with day and allowed: the first so many of a user's day."""
    rows = events.withColumn("day", F.to_date(order[0]))
    return rows.withColumn("allowed", F.row_number().over(Window.partitionBy(user, "day").orderBy(*order)) <= limit)


def carry_forward(rows: DataFrame, group: list[str], order: list[str], value: str, failed: Column) -> DataFrame:
    """rows with filled and carried_from: a failed row takes the last good value before it; other nulls stay unknown."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(~failed & F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order[0]).alias("at")))
    last = F.last(good, ignorenulls=True).over(w)
    return rows.withColumn("last", last).withColumns({
        "filled": F.when(failed, F.col("last")["v"]).otherwise(F.col(value)), "carried_from": F.when(failed, F.col("last")["at"]),
    }).drop("last")


def new_keys(today: DataFrame, before: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Keys of today that the snapshot before hasn't; none at all if there are more than most (a source that broke, not news)."""
    new = today.select(key).distinct().join(before.select(key), key, "left_anti")
    return new if most is None else new.where(F.lit(most) >= new.agg(F.count(F.lit(1)).alias("n")).scalar())


def retained(rows: DataFrame, closes: str, noticed: str, cutoff: Column) -> DataFrame:
    """Rows that closed, or else were noticed, on or after the cutoff; undated rows stay."""
    at = F.coalesce(closes, noticed)
    return rows.where(at.isNull() | (at >= cutoff))


def merge_archive(archive: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Locked rows of the archive win, then fresh rows, then the rest of the archive."""
    both = archive.withColumn("prio", F.when(F.col("locked"), 0).otherwise(2)).unionByName(fresh.withColumn("prio", F.lit(1)))
    return both.groupBy(key).agg(F.min_by(F.struct(*[c for c in archive.columns if c != key]), "prio").alias("r")).select(key, "r.*")


def reread(documents: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Documents to be read again: not in the cache with this version and attachment."""
    done = cache.where(F.col("version") == version).select("id", "attachment")
    return documents.join(done, ["id", "attachment"], "left_anti")
