"""Ranked lexical search over a tiered index.

One reading of the texts gives each document's length and the frequencies of the terms that items ask for: a bitmap of BITS bits, whatever the number of
terms, tells them apart from most others. These rows are kept, and of every BLOCK of them one row of postings is made, in tiers: a term's postings with the
highest impacts in the first, the rest in lower ones, each tier in a column of its own, so that a search that needs the first tier reads no other.
With each tier goes, for every term, a residual bound: the highest impact in the tiers below.

A search reads the first tier of all blocks and takes each item's k best sums as its bar, since no sum is above the document's score. In a block an item is proven
when the residual bounds leave no unseen document at the bar and few seen ones; the scores of these come from their own rows. A block and item without that proof
fall through to the next tier, and the last tier has exact scores. So results are exact, and how deep a search goes is for the data to say.

Items are searched in groups of about TERMS terms, so that what tasks get of them has a bound; documents are never collected, joined with each other or grouped.

Defined cases: null and empty texts have no terms: as documents they don't count, as items they find nothing; a document of null id takes part and is the last of equal
scores; documents that repeat an id are documents of their own, of equal scores and ids in any order; equal items are one; very long texts count whole;
empty tables give an empty result; other columns don't matter. Terms are 64-bit hashes: two terms with one hash would be one term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import Scratch, reduce_by_keys, slices

#: Documents whose postings are one row of the index.
BLOCK = 8192
#: Bits of the bitmap of terms.
BITS = 1 << 20
#: Least postings of a term in the tiers but the last, and their shares of its postings in a block.
TIERS = ((64, 1 / 16), (256, 1 / 4))
#: Terms of items that are searched at once, about.
TERMS = 200_000
#: A proven block and item have at most so many documents to look up; with more, the next tier is cheaper.
LOOKUPS = 400
#: Distinct words that a task remembers, for speed alone.
MEMORY = 1_000_000

_NULL = np.iinfo(np.int64).max
# terms are runs of ASCII letters and digits and of all that isn't ASCII; in UTF-8 the latter are bytes from 0x80
_table = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_table).split()


def _hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number), item_id, h, times: the terms of each different item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (item, item_id, np.uint64(_hash(t)).astype(np.int64), n)
                for item, item_id, text in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), _texts(batch), strict=True)
                for t, n in Counter(terms_of(text or b"")).items()
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["item", "item_id", "h", "times"])

    numbered = items.select(F.col("item_id").cast("long"), "text").distinct().withColumn("item", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, "item long, item_id long, h long, times long")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with the terms' low bits. The driver gets BITS bits at most."""
    place = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1
    marked = terms.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


class _Hashes(dict):
    """A term's hash, or None if the bitmap rules it out."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, term: bytes) -> int | None:
        if len(self) > MEMORY:
            self.clear()
        h = _hash(term)
        place = h & (BITS - 1)
        self[term] = found = h if self.bits[place >> 3] >> (place & 7) & 1 else None
        return found


def scan(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id, n, h, tf: each document's number of terms, and hashes and frequencies of those that the bitmap lets pass. Documents of no terms are left out."""
    bits = bitmap.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(bits)
        for batch in slices(batches, "text"):
            ids, sizes, h, tf, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                terms = terms_of(text or b"")
                if not terms:
                    continue
                for term, n in Counter(terms).items():
                    if (found := hashes[term]) is not None:
                        h.append(found)
                        tf.append(n)
                ids.append(doc)
                sizes.append(len(terms))
                ends.append(len(h))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.array(h, np.uint64).view(np.int64), np.array(tf, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "h", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, h array<long>, tf array<int>")


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term's weight is multiplied by, in 64-bit integers."""
    m = 75 + 25 * n * documents // length
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m)


TIER = "struct<h: binary, ends: binary, slots: binary, impacts: binary, rest: binary>"
INDEX = f"block long, n int, ids binary, rows binary, terms array<struct<h: long, df: long>>, {', '.join(f't{i} {TIER}' for i in range(len(TIERS) + 1))}"


def _tiers(h: np.ndarray, slot: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Distinct terms, their numbers of postings, and (h, ends, slots, impacts, rest) of each tier."""
    order = np.lexsort((-impacts, h))
    h, slot, impacts = h[order], slot[order].astype(np.uint16), impacts[order].astype(np.int32)
    terms, first, df = np.unique(h, return_index=True, return_counts=True)
    out, start = [], np.zeros(len(terms), np.int64)
    for least, share in (*TIERS, (0, 1)):
        stop = np.minimum(df, np.maximum(least, np.ceil(df * share).astype(np.int64)))
        stop = np.maximum(start, stop)
        some = np.flatnonzero(stop > start)
        n = (stop - start)[some]
        ends = np.cumsum(n)
        at = np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat((first + start)[some], n)
        more = stop[some] < df[some]
        rest = np.where(more, impacts[np.minimum((first + stop)[some], len(impacts) - 1)], 0) if len(impacts) else np.zeros(0)
        out.append((terms[some], ends.astype(np.int32), slot[at], impacts[at], rest.astype(np.int32)))
        start = stop
    return terms, df, out


def index(scanned: DataFrame, documents: int, length: int) -> DataFrame:
    """A row for each BLOCK of scanned rows: their ids, their terms' numbers of postings, and the tiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(s, BLOCK)
                h, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("h", "tf"))
                per = batch.column("h").value_lengths().to_numpy(zero_copy_only=False)
                slot = np.repeat(np.arange(batch.num_rows), per)
                n = batch.column("n").to_numpy()
                terms, df, tiers = _tiers(h, slot, impact(tf, n[slot], documents, length))
                ids, rows = batch.column("doc_id").fill_null(_NULL).to_numpy(), batch.column("row").to_numpy()
                counts = pa.StructArray.from_arrays([pa.array(terms, pa.int64()), pa.array(df, pa.int64())], names=["h", "df"])
                counts = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), counts)
                packed = [
                    pa.StructArray.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in tier], names=["h", "ends", "slots", "impacts", "rest"]) for tier in tiers
                ]
                columns = [batch.column("row").slice(0, 1), pa.array([batch.num_rows], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, rows)), counts, *packed]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "n", "ids", "rows", "terms", *(f"t{i}" for i in range(len(packed)))])

    return scanned.mapInArrow(run, INDEX)


class Group:
    """A group of items: for each, its terms' hashes and weights. bars: of each item, what a document's score must reach."""

    def __init__(self, terms: list[tuple[int, int, int]]):
        """terms: (item, h, weight)."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for item, h, w in terms:
            by_item.setdefault(item, []).append((h, w))
        self.items = {item: (np.array([h for h, _ in t], np.int64), np.array([w for _, w in t], np.int64)) for item, t in by_item.items()}
        self.bars = dict.fromkeys(self.items, 1)


class _Block:
    """A block's tiers, as far as they were read."""

    def __init__(self, n: int, tiers: list[dict]):
        kinds = {"h": np.int64, "ends": np.int32, "slots": np.uint16, "impacts": np.int32, "rest": np.int32}
        self.n, self.tiers = n, [{c: np.frombuffer(t[c], kind) for c, kind in kinds.items()} for t in tiers]

    def sums(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each document's sum over the postings read, what its score may be at most, and what an unseen document's score may be at most."""
        low, seen, rests = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.zeros(len(h), np.int64)
        found = []
        for t in self.tiers:
            if not len(t["h"]):
                continue
            at = np.minimum(np.searchsorted(t["h"], h), len(t["h"]) - 1)
            for i in np.flatnonzero(t["h"][at] == h).tolist():
                s, e = int(t["ends"][at[i] - 1]) if at[i] else 0, int(t["ends"][at[i]])
                slots = t["slots"][s:e]
                low[slots] += w[i] * t["impacts"][s:e].astype(np.int64)
                rests[i] = t["rest"][at[i]]  # of the lowest tier that has the term
                found.append((i, slots))
        rest = int((w * rests).sum())
        if not rest:
            return low, low, 0
        for i, slots in found:
            if rests[i]:
                seen[slots] += w[i] * rests[i]
        return low, low + rest - seen, rest


def _best(low: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Slots of the k highest sums above 0, equal ones by id."""
    some = np.flatnonzero(low)
    if len(some) > k:
        some = some[low[some] >= np.partition(low[some], len(some) - k)[len(some) - k]]
    return some[np.lexsort((ids[some], -low[some]))][:k]


def _blocks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[dict, _Block, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            yield row, _Block(row["n"], [row[f"t{d}"] for d in range(depth)]), np.frombuffer(row["ids"], np.int64)


def first_bars(blocks: DataFrame, group: Group, k: int) -> DataFrame:
    """item, score: the best sums of the first tier, at least k of an item from each task that has as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for _, block, _ in _blocks(batches, 1):
            for item, (h, w) in group.items.items():
                low = block.sums(h, w)[0]
                best[item] = np.concatenate([best.get(item, low[:0]), low[low > 0]])
                if len(best[item]) > k:
                    best[item] = np.partition(best[item], len(best[item]) - k)[-k:]
        rows = [(item, int(x)) for item, found in best.items() for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["item", "score"])

    return blocks.select("n", "ids", "t0").mapInArrow(run, "item long, score long")


def _deeper(depth: int, last: bool, group: Group, k: int):
    """Of blocks with their first depth tiers, per item: rows that may be among the k best and their sums, exact where the tier is the last, or, if it is open, its best sums and no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, ids in _blocks(batches, depth):
            out, number = [], np.frombuffer(row["rows"], np.int64)
            for item in group.items if row["items"] is None else row["items"]:
                low, most, unseen = block.sums(*group.items[item])
                if last:
                    out += [(item, int(number[s]), int(low[s]), int(ids[s])) for s in _best(low, ids, k).tolist() if low[s] >= group.bars[item]]
                    continue
                fit = np.flatnonzero((most >= group.bars[item]) & (low > 0))
                if unseen >= group.bars[item] or len(fit) > LOOKUPS:
                    out += [(item, None, int(low[s]), None) for s in _best(low, ids, k).tolist()] or [(item, None, 0, None)]
                else:
                    out += [(item, int(number[s]), int(low[s]), None) for s in fit.tolist()]
            columns = [pa.array([row["block"]] * len(out), pa.int64()), *(pa.array([r[i] for r in out], pa.int64()) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "item", "row", "score", "doc_id"])

    return run


def _exact(group: Group, documents: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, h, tf, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "h", "tf", "items")), strict=True):
                of = dict(zip(h, impact(np.array(tf, np.int64), np.array(n), documents, length).tolist(), strict=True))
                for item in items:
                    out.append((item, doc, sum(w * of.get(t, 0) for t, w in zip(*(x.tolist() for x in group.items[item]), strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"])

    return run


def _bars(best: DataFrame, k: int) -> list[tuple[int, int]]:
    """(item, its k-th best score), for items that have as many."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    found = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar"))
    return [(r["item"], r["bar"]) for r in found.where(F.col("n") == k).select("item", "bar").collect()]


def _search(group: Group, rows: DataFrame, blocks: DataFrame, documents: int, length: int, k: int, scratch: Scratch) -> DataFrame:
    """item, doc_id, score: exact scores of documents among which each item's k best are."""
    group.bars |= dict(_bars(first_bars(blocks, group, k), k))
    found, looked_up, open_ = [], [], None
    for depth in range(1, len(TIERS) + 2):
        last = depth == len(TIERS) + 1
        here = blocks.select("block", "n", "ids", "rows", *(f"t{d}" for d in range(depth)))
        if open_ is None:
            here = here.withColumn("items", F.lit(None).cast("array<long>"))
        else:
            here = here.join(open_.select("block", "item").distinct().groupBy("block").agg(F.collect_list("item").alias("items")), "block")
        result = scratch.table(here.mapInArrow(_deeper(depth, last, group, k), "block long, item long, row long, score long, doc_id long"), f"depth-{depth}")
        done = result.where("row is not null")
        if last:
            found.append(done.select("item", F.nullif("doc_id", F.lit(int(_NULL))).alias("doc_id"), "score"))
            break
        looked_up.append(done)
        open_ = result.where("row is null")
        if open_.isEmpty():
            break
        best = result.where("score > 0").select("item", "score")
        group.bars |= {item: max(bar, group.bars[item]) for item, bar in _bars(best, k)}
    wanted = looked_up[0] if len(looked_up) == 1 else looked_up[0].unionAll(looked_up[1])
    bars = rows.sparkSession.createDataFrame([(int(i), int(b)) for i, b in group.bars.items()], "item long, bar long")  # at most as many as a group has items
    wanted = scratch.table(wanted.groupBy("row").agg(F.collect_set("item").alias("items")), "wanted")
    exact = reduce_by_keys(rows, F.col("row"), wanted.select("row")).join(wanted, "row").mapInArrow(_exact(group, documents, length), "item long, doc_id long, score long")
    found.append(exact.join(F.broadcast(bars), "item").where("score >= bar").drop("bar"))
    return found[0] if len(found) == 1 else found[0].unionAll(found[1])


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    out = Scratch(spark, "lexical-result")
    with Scratch(spark, "lexical") as scratch:
        asked = scratch.table(item_terms(items), "items")
        rows = scratch.table(scan(docs, _bitmap(asked)).withColumn("row", F.monotonically_increasing_id()), "scan")
        documents, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        blocks = scratch.table(index(rows, documents, length), "index")
        df = blocks.selectExpr("inline(terms)").groupBy("h").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
        weighed = scratch.table(asked.join(df, "h").select("item", "item_id", "h", (weight * F.col("times")).cast("long").alias("w")), "weights")
        groups = math.ceil(weighed.count() / TERMS)
        number = F.pmod(F.xxhash64("item"), F.lit(max(groups, 1)))
        results = []
        for g in range(groups):
            own = weighed.where(number == g)
            group = Group([tuple(r) for r in own.select("item", "h", "w").collect()])  # about TERMS rows
            if not group.items:
                continue
            names = own.select("item", "item_id").distinct()
            scored = _search(group, rows, blocks, documents, length, k, scratch).where("score > 0").join(names, "item")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            results.append(out.table(best.select("item_id", "rank", "doc_id", "score"), "ranked"))
        if not results:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = results[0]
    for more in results[1:]:
        result = result.unionAll(more)
    return result
