"""Exact deduplication by stateful streaming.

A stream reads the table's files. Its keyed state lives in RocksDB on executors' disks and in the
checkpoint folder, and never expires: for each digest it holds the identifier and the content locator
(file and row) of the row that stays, and how many rows had the digest. A later run with the same
state folder takes only new files. Then every hit is checked on its full bytes: rows that share a digest
are compared with the text at the kept row's locator, and rows that differ form groups of their own.

Defined cases: null text counts as empty, and all empty texts are one group. Of equal texts the row with
the largest doc_id stays; null is the least, and repeated rows with one doc_id are told apart by file and row.
Very long texts are compared whole. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import Scratch, drop_by_keys, persisted, reduce_by_keys, remove, text_of
from hearthline.llm.common import scratch as scratch_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(df: DataFrame, digest) -> DataFrame:
    return df.select(
        "doc_id",
        text_of(df["text"]).alias("text"),
        digest(text_of(df["text"])).alias("digest"),
        F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"),
    )


def update_state(spark: SparkSession, path: str, state: str, digest=sha256, max_files: int = 10_000) -> DataFrame:
    """Feed the files of path that the state folder hasn't seen to the stream; return (digest, keep, n) of all seen so far.

    max_files bounds a micro-batch. A batch's changes are written under its number, so that a batch
    that is run again after a loss overwrites itself.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    # a run ends with its files: a partition's store is closed once its task is done, not kept open for a next batch
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(path).schema
    source = f"{path[:-1]}[{path[-1]}]"  # a pattern that only path fits: a source without it must be a folder
    rows = _located(session.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source), digest)
    groups = rows.groupBy("digest").agg(F.max("locator").alias("keep"), F.count(F.lit(1)).alias("n"))
    log = f"{state}/log"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = (
        groups.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # both only grow, so the last update of a digest is its largest
    return spark.read.parquet(log).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, state: str | None = None, digest=sha256, max_files: int = 10_000, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, locator) for each row of the Parquet table at path.

    Shuffled are digests and locators of all rows, and the texts of rows with a hit only (a semi-join
    reducer of fixed size goes first). Both joins' inputs are plain exchanges, so that the adaptive planner
    splits a digest that a third of all rows share. A state folder of its own, where none is given, and the texts of hits are
    removed before the end; groups are the caller's scratch, if given.
    """
    with Scratch(spark, "dedup") as own_tables:
        keep = scratch.table if scratch else lambda df, name: persisted(df, f"dedup-{name}")
        own_state = state or scratch_folder(spark, "dedup-state")
        groups = keep(update_state(spark, path, own_state, digest, max_files), "groups")
        if not state:
            remove(spark, own_state)
        rows = _located(spark.read.parquet(path), digest)
        hits = groups.where("n > 1")
        # the kept rows of groups with hits, fetched by their locators
        kept_texts = reduce_by_keys(rows, F.col("locator"), hits.select("keep"))
        keepers = own_tables.table(
            kept_texts.join(hits.select(F.col("keep").alias("locator"), F.col("digest").alias("d")), "locator")
            .select("digest", F.col("text").alias("keep_text")),
            "keepers",
        )
        clash = own_tables.table(
            reduce_by_keys(rows, F.col("digest"), hits.select("digest"))
            .join(keepers, "digest").where("text <> keep_text").select("locator", "digest", "text"),
            "clashes",
        )
        light = rows.select("doc_id", "digest", "locator", sha256(F.col("text")).alias("text_sha256") if digest is not sha256 else F.col("digest").alias("text_sha256"))
        if not clash.isEmpty():
            own = clash.groupBy("digest", "text").agg(F.max("locator").alias("keep"), F.count(F.lit(1)).alias("n"))
            regrouped = keep(clash.join(own, ["digest", "text"]).select("locator", F.col("keep").alias("own_keep"), F.col("n").alias("own_n")), "regrouped")
            lost = clash.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
            groups = keep(groups.join(lost, "digest", "left").select("digest", "keep", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")), "groups-left")
            found = light.join(groups, "digest").join(regrouped, "locator", "left").withColumns({
                "n": F.when(F.col("own_keep").isNotNull(), F.col("own_n")).otherwise(F.col("n")),
                "keep": F.coalesce("own_keep", "keep"),
            })
        else:
            found = light.join(groups, "digest")
    return found.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("locator").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256", "locator",
    )


def _folder_of(spark: SparkSession, docs: DataFrame) -> str | None:
    """The folder that docs is the plain reading of, or None."""
    folders = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
    if len(folders) != 1 or "%" in (path := folders.pop()):
        return None
    # files are named with their file system, docs' folder perhaps without
    for name in (path, re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?(?=/)", "", path)):
        try:
            if docs.sameSemantics(spark.read.schema(docs.schema).parquet(name)):
                return name
        except AnalysisException:  # no such folder on the default file system
            continue
    return None


def dedup_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with its columns. Rows need locators, so a docs that isn't the reading of a folder is written first.

    Only rows in a hash bucket with a row that goes are shuffled; see drop_by_keys.
    """
    path = _folder_of(spark, docs)
    if path is None:
        path = scratch_folder(spark, "dedup-input")
        docs.write.parquet(path)
    with Scratch(spark, "dedup-stage") as scratch:
        gone = persisted(exact_dedup(spark, path, scratch=scratch).where("not kept").select(F.struct("locator.file", "locator.row").alias("at")), "dedup-gone")
    rows = spark.read.schema(docs.schema).parquet(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    located = rows.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"), at.alias("at"))
    kept = drop_by_keys(located, "at", gone)
    return kept.select(*[F.col("whole")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
