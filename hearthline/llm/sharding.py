"""Sharding by Hilbert-curve order over several metadata dimensions.

Language, source and size are quantised to BITS bits each, the cell's place on the Hilbert curve is its index,
rows are sorted by it, and the sorted rows are cut into runs of equal count. Neighbours on the curve are
neighbours in every dimension, so a file of a run covers a small box of all of them and a reader skips most files
whichever dimension it filters on.

Text dimensions are quantised by equal depth: values in code point order, null last, at the share of rows before them.
Ranks come from counts, never from one sorted task: rows per cell, a cell's rows in ranges of their texts' hashes of about
ROWS rows, running sums over cells (at most 2 ** (3 * BITS)), over a cell's ranges and over a range's texts, and a row number within
one text of a range. Equal texts go to the first of their cells and are neighbours there, so that of all groups at most one is cut where one shard ends
and the next begins, which equal counts need. A text with more than ROWS copies is itself cut into ranges by doc_id's hash, so that a cell or a text that a third of all rows share is many tasks.

Defined cases: null text counts as no bytes, so that its size is 1; very long texts are one row like others; rows equal in all dimensions are ordered by the
hash of their text, then of their doc_id; equal rows in any order; an empty table gives an empty result; other columns don't matter. The law is `rows`: counts of shards are at most one apart, and grown_shard is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import persisted, text_of

DIMENSIONS = 3
BITS = 4
SHARDS = 8
#: Rows of one hash bucket, on average.
ROWS = 2_000

_ALL = (1 << DIMENSIONS) - 1


def _rotated(x: int, by: int) -> int:
    """x rotated right by so many bits, of DIMENSIONS."""
    by %= DIMENSIONS
    return ((x >> by) | (x << (DIMENSIONS - by))) & _ALL


def _entry(w: int) -> int:
    """The corner where the curve enters part w: the Gray code of the even number before w."""
    even = 2 * ((w - 1) // 2)
    return 0 if w == 0 else even ^ (even >> 1)


def _direction(w: int) -> int:
    """The axis along which the curve passes part w: by the trailing ones of the odd number at or before it."""
    odd = w if w % 2 else w - 1
    ones = (odd ^ (odd + 1)).bit_length() - 1 if w else 0
    return ones % DIMENSIONS


def _order(corner: int) -> int:
    """The place of a corner in Gray order."""
    out = corner
    for shift in range(1, DIMENSIONS):
        out ^= corner >> shift
    return out


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell, from DIMENSIONS integer columns of so many bits.

    Goes from the highest bit to the lowest with the part's corner and axis as state (Hamilton and
    Rau-Chaplin 2008); the steps' small tables are built from their rules.
    """
    def table(f, *sizes):
        rows = [f(i, j) for i in range(sizes[0]) for j in range(sizes[1])] if len(sizes) == 2 else [f(i) for i in range(sizes[0])]
        return F.array(*[F.lit(x) for x in rows])

    parts, axes = 1 << DIMENSIONS, DIMENSIONS
    place = table(lambda d, x: _order(_rotated(x, d + 1)), axes, parts)
    corner = table(lambda d, w: _rotated(_entry(w), -(d + 1)), axes, parts)
    turned = table(lambda d, w: (d + _direction(w) + 1) % DIMENSIONS, axes, parts)
    level = lambda i: sum((F.shiftright(c, bits - 1 - i).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(coordinates)), F.lit(0))
    levels = F.array(*[level(i).cast("int") for i in range(bits)])

    def step(state: Column, at: Column) -> Column:
        w = F.get(place, state["axis"] * parts + state["corner"].bitwiseXOR(at))
        return F.struct(
            (state["index"] * parts + w).alias("index"),
            state["corner"].bitwiseXOR(F.get(corner, state["axis"] * parts + w)).alias("corner"),
            F.get(turned, state["axis"] * parts + w).alias("axis"),
        )

    start = F.struct(F.lit(0).alias("index"), F.lit(0).alias("corner"), F.lit(0).alias("axis"))
    return F.aggregate(levels, start, step, lambda s: s["index"])


def _depth(rows: DataFrame, column: str) -> DataFrame:
    """value and its quantised place by equal depth. The window runs over the different values, not over rows."""
    counts = rows.groupBy(F.col(column).alias(f"{column}_value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col(f"{column}_value").asc_nulls_last())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select(f"{column}_value", F.floor(before * (1 << BITS) / total).cast("int").alias(f"{column}_at"))


def _meta(docs: DataFrame) -> DataFrame:
    text = text_of(docs["text"])
    size = F.octet_length(text).cast("long") + 1
    return docs.select(
        docs["doc_id"], docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"),
        size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    ).withColumn("size_at", F.least(F.lit((1 << BITS) - 1), F.floor(F.log2("size"))).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, rows_per_bucket: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for each row of docs. Texts are read once and not shuffled."""
    meta = persisted(_meta(docs), "shard-meta")
    lang, source = persisted(_depth(meta, "lang"), "shard-lang"), persisted(_depth(meta, "source"), "shard-source")
    placed = (
        meta.join(lang, meta["lang"].eqNullSafe(lang["lang_value"])).join(source, meta["source"].eqNullSafe(source["source_value"]))
        .withColumn("hilbert", hilbert_index([F.col("lang_at"), F.col("source_at"), F.col("size_at")]))
        .select("doc_id", "size", "text_crc32", "hilbert", F.shiftrightunsigned("text_hash", 1).alias("t"), F.shiftrightunsigned(F.xxhash64("doc_id"), 33).alias("h"))
    )
    placed = persisted(placed, "shard-cells-of-rows")
    # texts with copies: their first cell, and the ranges that they are cut into
    copies = placed.groupBy("t").agg(F.min("hilbert").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = persisted(copies.select("t", "first", F.ceil(F.col("n") / rows_per_bucket).cast("int").alias("parts")), "shard-copies")
    placed = placed.join(copies, "t", "left").withColumn("hilbert", F.coalesce("first", "hilbert")).drop("first")
    placed = persisted(placed, "shard-placed")
    cells = placed.groupBy("hilbert").agg(F.count(F.lit(1)).alias("in_cell"))
    cells = cells.withColumn("buckets", F.ceil(F.col("in_cell") / rows_per_bucket).cast("int"))
    up_to = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = persisted(cells.withColumn("before_cell", F.coalesce(F.sum("in_cell").over(up_to), F.lit(0))), "shard-cells")
    # at most 2 ** (DIMENSIONS * BITS) rows of a few integers
    dealt = placed.join(F.broadcast(cells.select("hilbert", "buckets", "before_cell")), "hilbert")
    # hash ranges, so that ranges in order are rows in order
    dealt = dealt.withColumns({
        "bucket": F.floor(F.shiftrightunsigned("t", 32) * F.col("buckets") / F.lit(1 << 31)).cast("int"),
        "part": F.floor(F.col("h") * F.coalesce("parts", F.lit(1)) / F.lit(1 << 31)).cast("int"),
    })
    key = ["hilbert", "bucket", "t", "part"]
    counts = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("before_cell").alias("b"))
    counts = persisted(counts, "shard-counts")
    in_cell = Window.partitionBy("hilbert").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("hilbert", "bucket").agg(F.sum("n").alias("n"), F.first("b").alias("b"))
    ranges = persisted(ranges.select("hilbert", "bucket", (F.col("b") + F.coalesce(F.sum("n").over(in_cell), F.lit(0))).alias("before_range")), "shard-ranges")
    in_range = Window.partitionBy("hilbert", "bucket").orderBy("t", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = persisted(
        counts.withColumn("in_range", F.coalesce(F.sum("n").over(in_range), F.lit(0))).join(ranges, ["hilbert", "bucket"])
        .select(*key, (F.col("before_range") + F.col("in_range")).alias("before")),
        "shard-offsets",
    )
    number = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id", "size"))
    ranked = dealt.withColumn("number", number).join(offsets, key)
    total = cells.agg(F.coalesce(F.sum("in_cell"), F.lit(0)).alias("total"))
    rank, n = F.col("before") + F.col("number") - 1, total.scalar()
    out = ranked.withColumn("rank", rank).withColumn("total", n).withColumn("shard", F.expr(f"(rank * {shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the least rank of the shard
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def write_sharded(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """docs as one folder a shard, each sorted along the curve, so that files' column ranges are narrow. key: of unique values."""
    found = shard(docs, shards).select(F.col("doc_id").alias("__id"), "shard", "slot")
    rows = docs.join(found, docs[key] == found["__id"]).drop("__id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
