"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside this ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


# re takes numerals such as ² and Ⅷ for word characters; a class without them is slow, so that it is used only where there are some
_numerals = "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_runs, _runs_exactly = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_numerals}]+")


def letter_runs(text: str) -> tuple[re.Pattern, list[str]]:
    """The runs of letters in a text, and a pattern that finds them in it."""
    found = _runs.findall(text)
    return (_runs, found) if not found or "".join(found).isalpha() else (_runs_exactly, _runs_exactly.findall(text))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables under spark.checkpoint.dir.

    The setting is read from the session; only where it is unset (tests) a local folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "/tmp/hearthline-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persisted(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, on storage that outlives executors, and the write's shuffle files go. options: the writer's."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """An operator's intermediate tables. They are removed at its end, except those that its result reads (kept)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.tables = spark, name, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        out = persisted(df, f"{self.name}-{name}", **options)
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.tables = [x for x in self.tables if x is not t]
            for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                remove(self.spark, folder)

    def __exit__(self, *error) -> None:
        self.drop(*self.tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; an empty array where there are none."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


#: Buckets of a reducer; a bucket table has at most this many rows of one integer.
REDUCER_BUCKETS = 1 << 18


def reduce_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of df whose key may be in keys (a one-column table of any size): a semi-join reducer before a shuffle.

    Broadcast are only the occupied ones of REDUCER_BUCKETS hash buckets, so the size is bounded by a
    constant; with many keys all buckets are occupied, every row passes, and the join that follows decides.
    """
    hits = keys.select(F.pmod(F.xxhash64(keys[keys.columns[0]]), F.lit(REDUCER_BUCKETS)).cast("int").alias("__b")).distinct()
    marked = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(REDUCER_BUCKETS)).cast("int"))
    return marked.join(F.broadcast(hits), "__b", "left_semi").drop("__b")


def crc_fold(col: str, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) with component the smallest node of each connected component, in one of scratch's tables.

    edges has two columns of one orderable type. Alternating large-star and small-star steps (Kiveris et
    al. 2014): every step keeps the number of edges, groups with map-side combining, and writes its edges
    to the shared folder; the edges before go. Nothing is collected but a count and a checksum. Rows with a null
    end, and nodes that only link to themselves, are left out.
    """
    a, b = edges.columns
    current = scratch.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        # large star: every larger neighbour of u goes to the smallest node around u
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the adaptive planner can split a node that a third of all rows link to
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = (
            current.select(F.col("v").alias("u"), F.col("u").alias("x")).join(low, "u")
            .select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = scratch.table(large, "large")
        scratch.drop(current, low)
        # small star: the smaller neighbours of u, and u itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        current = scratch.table(small, "small")
        scratch.drop(large)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003))).first()
        if state == seen:
            break
        seen = state
    out = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Bytes of text that a Python task handles at once; a longer text is a slice of its own.
SLICE = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of whole rows of about size bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def drop_by_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key isn't in keys (one column, no nulls). Only rows in a bucket with a key are shuffled; see reduce_by_keys."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(REDUCER_BUCKETS)).cast("int")
    hits = F.broadcast(keys.select(bucket(keys[keys.columns[0]]).alias("__b")).distinct())
    marked = df.withColumn("__b", bucket(df[key]))
    maybe = marked.join(hits, "__b", "left_semi").drop("__b")
    gone = keys.select(keys[keys.columns[0]].alias("__gone"))
    return marked.join(hits, "__b", "left_anti").drop("__b").unionAll(maybe.join(gone, maybe[key] == gone["__gone"], "left_anti"))
