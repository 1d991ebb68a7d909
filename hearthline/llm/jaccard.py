"""N-gram Jaccard self-join with PartEnum signatures (Arasu, Ganti, Kaushik 2006).

A document is the set of its distinct word shingles. Sets that may be similar enough lie in one band of
sizes, or the smaller one also takes part in the larger one's band. Within a band, the similarity bounds the number
k of elements that two sets don't share. The domain of elements is cut into k // 2 + 1 partitions, so that two such sets
differ by at most one element in one of them, and each partition into parts, so that leaving out one part leaves equal
projections. A set's signatures are the hashes of all those projections:
no link is missed. A projection of very few elements is shared by unrelated texts. So some partitions are spare, in which linked
sets agree as well, and a set leaves out its smallest projections, as many as make up no more partitions than are spare: of
the spare + 1 partitions in which two sets agree, one at least has only projections that both keep, since equal ones are equally large.

Sets that share a signature form a bucket. Each set of a bucket is compared with the bucket's first, before anything is
grouped, and the links found are components. A bucket's first is done with then; where sets of several components are left in it,
they are compared with their new first, ROUNDS times in all: groups of copies end here, and so do buckets of a few sets. What is
left are sets that share a passage but nothing else. Their buckets are one task's work each; one that is larger than a block is cut into blocks,
and each pair of its blocks is one task's work. Comparing is exact: the parities of a set's elements in a bit map of about two bits an element differ in no
more places than the sets have elements of their own, so that most pairs are ruled out by their bit maps, and the texts of the others are read.

Signatures are never stored: a task leaves out those that it has had in the same run of rows (only the link between the two sets goes
on, so that a signature that a third of all rows share is few rows), and the rest are shuffled once, beside the id of a document.

Defined cases: null and empty texts, or texts of white space, have no set, link with nothing and are their own
component; with fewer words than a shingle has, the whole sequence is the one element; rows with one doc_id are one
node; null ids take the component of their equal sets, or null. Very long texts are read whole, a task's run of rows by itself. An
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import Scratch, connected_components, drop_by_keys, persisted, reduce_by_keys, slices

#: Parts of a partition.
PARTS = 3
#: Spare partitions, as a share of those that are needed.
SPARE = 0.1
#: A band's largest size over its smallest.
BAND = 1.25
#: Elements (and 50 a document) of a block; sets of a bucket beyond it are cut into several.
BLOCK = 3_000_000
#: Comparisons of a bucket's sets with its first before blocks are compared.
ROUNDS = 2
#: Words and sets that a task remembers, for speed alone.
MEMORY = 1_000_000

_mask = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted arrays of the 64-bit hashes of a text's distinct shingles of n words."""

    def __init__(self, n: int):
        self.n, self.words = n, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z, and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[j : len(words) - n + 1 + j]
            out ^= out >> np.uint64(29)
        return np.unique(_mix(out))


class Bands:
    """Size bands and the partitions of each, for a least similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        low, self.low, self.high, self.shape = 1, [], [], []
        while low < 1 << 40:
            high = max(low, int(low * BAND))
            self.low.append(low)
            self.high.append(high)
            self.shape.append(self._shape(low, high))
            low = high + 1

    def _shape(self, low: int, high: int) -> tuple[int, int, int]:
        """Partitions, parts of each, and how many partitions are spare."""
        k = 2 * high * (100 - self.percent) // (100 + self.percent)
        if k == 0:
            return 0, 1, 0  # only equal sets, which have one key
        base = k // 2 + 1
        spare = math.ceil(SPARE * base)
        return base + spare, PARTS, spare

    def of(self, size: int) -> list[int]:
        """The set's own band, and those of larger sets that it may be similar to."""
        band = int(np.searchsorted(self.high, size))
        out = [band]
        while 100 * size >= self.percent * self.low[band + 1]:
            band += 1
            out.append(band)
        return out

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """elements: sorted. A part is a range of hashes, so that its elements are neighbours and running sums give its hash."""
        out = []
        for band in self.of(len(elements)):
            n, parts, spare = self.shape[band]
            if n == 0:
                continue
            cells = n * parts
            counts = np.bincount(((elements >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64), minlength=cells)
            sums = np.zeros(len(elements) + 1, np.uint64)
            np.cumsum(_mix(elements + np.uint64(band + 1)), out=sums[1:])
            ends = np.cumsum(counts)
            sums, counts = (sums[ends] - sums[ends - counts]).reshape(n, parts), counts.reshape(n, parts)
            sums, counts = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums, counts.sum(axis=1)[:, None] - counts
            tag = np.arange(cells, dtype=np.uint64).reshape(n, parts) + np.uint64(band << 40)
            signature = _mix(sums ^ _mix(tag))
            least = np.partition(counts.min(axis=1), spare)[spare]  # at most spare partitions have a smaller projection
            out.append(signature[counts >= least])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bit_map(elements: np.ndarray) -> bytes:
    """Parities of the numbers of elements in places, 64 or more and about two for each element."""
    places = 64
    while places < 2 * len(elements):
        places *= 2
    odd = np.bincount((elements & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Places in which two bit maps differ, the longer one folded to the shorter one's places."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n != m:
        if n > m:
            n //= 2
            x = (x >> n) ^ (x & ((1 << n) - 1))
        else:
            m //= 2
            y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


SCAN = "at long, doc long, x struct<sig: long, first: long, n: long, k1: long, k2: long, bits: binary>"


def scan(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of three kinds: a document (x.n), a signature of a set (x is null) and two sets with one signature (x.sig). A document's id stands for its set.

    at is where the row goes: the signature, or anywhere. A task sends the signatures of equal sets once. Of a run of rows one set sends a
    signature on, and the others are linked to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bands, seen = Shingler(n), Bands(percent), set()
        members = [("sig", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bits", pa.binary())]

        def batch_of(at, doc, x: dict | None = None) -> pa.RecordBatch:
            """x: members that the rows have, or None where they have none."""
            if x is None:
                x = pa.nulls(len(at), pa.struct(members))
            else:
                x = pa.StructArray.from_arrays([pa.array(x[k], t) if k in x else pa.nulls(len(at), t) for k, t in members], names=[k for k, _ in members])
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), doc if isinstance(doc, pa.Array) else pa.array(doc, pa.int64()), x], names=["at", "doc", "x"])

        for batch in slices(batches, "text"):
            ids, sizes, k1, k2, bits, sigs, owner = batch.column("doc_id"), [], [], [], [], [], []
            for doc, text in zip(ids.to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingle(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                a, b = struct.unpack("<qq", digest)
                sizes.append(len(s))
                k1.append(a)
                k2.append(b)
                bits.append(bit_map(s))
                if doc is not None and len(s) and digest not in seen:
                    if len(seen) > MEMORY:
                        seen.clear()
                    seen.add(digest)
                    sigs.append(bands.signatures(s).view(np.int64))
                    owner.append(np.full(len(sigs[-1]), doc, np.int64))
            anywhere = _mix(np.array(k1, np.int64).view(np.uint64) + np.arange(len(k1), dtype=np.uint64)).view(np.int64)
            yield batch_of(anywhere, ids, {"n": sizes, "k1": k1, "k2": k2, "bits": bits})
            if sigs:
                sig, owner = np.concatenate(sigs), np.concatenate(owner)
                _, first, which = np.unique(sig, return_index=True, return_inverse=True)
                leader = owner[first[which]]
                first.sort()  # in the order of documents, whose ids then are near each other
                yield batch_of(sig[first], owner[first])
                again = leader != owner
                if again.any():
                    sig, owner, leader = sig[again], owner[again], leader[again]
                    anywhere = _mix((sig ^ owner).view(np.uint64)).view(np.int64)
                    yield batch_of(anywhere, owner, {"sig": sig, "first": leader})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCAN)


def _near(percent: int):
    """Of rows (a, b, na, nb, xa, xb) with sizes and bit maps, the pairs a, b whose sets may be linked: no linked pair is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb")), strict=True)
            out = [(a, b) for a, b, na, nb, xa, xb in rows if (100 + percent) * apart(xa, xb) <= (100 - percent) * (na + nb)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _verified(n: int, percent: int):
    """Of rows (a, b, ta, tb), the pairs a, b whose texts ta and tb are linked. Rows with one b follow each other mostly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known, of = Shingler(n), None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                if tb is not known:
                    known, of = tb, shingle(tb)
                s = shingle(ta)
                inter = len(np.intersect1d(s, of, assume_unique=True))
                if len(s) and 100 * inter >= percent * (len(s) + len(of) - inter):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_pairs(ids: list[int], sizes: list[int], maps: list[bytes], side: list[int], known: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets of different known components (and sides, where there are two) that may be linked, by their bit maps: no linked pair is left out."""
    order = np.lexsort((sizes, [len(m) for m in maps]))
    size, side, known, ids = (np.array(x, np.int64)[order] for x in (sizes, side, known, ids))
    length, two, out = np.array([len(maps[i]) for i in order]), len(set(side.tolist())) > 1, []
    for n in np.unique(length).tolist():
        here = np.flatnonzero(length == n)
        bits = {n: np.frombuffer(b"".join(maps[order[i]] for i in here), np.uint64).reshape(len(here), -1)}
        rows = {n: here}
        # linked sets' sizes differ by less than a factor of two, and so do their maps' lengths
        more = np.flatnonzero(length == 2 * n)
        if len(more):
            wide = np.frombuffer(b"".join(maps[order[i]] for i in more), np.uint64).reshape(len(more), -1)
            half = wide.shape[1] // 2
            bits[2 * n], rows[2 * n] = wide[:, :half] ^ wide[:, half:], more
        for place, i in enumerate(here.tolist()):
            for m, js in rows.items():
                start = place + 1 if m == n else 0
                stop = int(np.searchsorted(size[js], size[i] * 100 // percent, side="right"))
                for part in range(start, stop, 4096):
                    some = js[part : min(stop, part + 4096)]
                    fit = known[some] != known[i]
                    if two:
                        fit &= side[some] != side[i]
                    fit = np.flatnonzero(fit)
                    if not len(fit):
                        continue
                    differ = np.bitwise_count(bits[m][part + fit] ^ bits[n][place]).sum(axis=1, dtype=np.int64)
                    hits = some[fit[(100 + percent) * differ <= (100 - percent) * (size[i] + size[some[fit]])]]
                    out += [(int(ids[i]), int(ids[j])) for j in hits]
    return out


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        pairs = near_pairs(*(table.column(c).to_pylist() for c in ("doc_id", "n", "bits", "block", "c")), percent)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run


class _Sets:
    """The join's tables and parameters, and comparing pairs of documents."""

    def __init__(self, docs: DataFrame, maps: DataFrame, scratch: Scratch, n: int, percent: int, block: int):
        self.docs, self.maps, self.scratch, self.n, self.percent, self.block = docs, maps, scratch, n, percent, block

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and bit maps don't rule out."""
        side = lambda c: self.maps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        return self.scratch.table(sized.mapInArrow(_near(self.percent), "a long, b long"), "near")

    def linked(self, near: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose texts are linked."""
        ids = self.scratch.table(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
        texts = reduce_by_keys(self.docs, F.col("doc_id"), ids).join(ids, "doc_id")
        texts = self.scratch.table(texts, "texts")
        side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
        found = near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(self.n, self.percent), "a long, b long")
        found = self.scratch.table(found.distinct(), "found")
        self.scratch.drop(texts, ids, near)
        return found

    def linked_in_buckets(self, left: DataFrame) -> DataFrame:
        """Links (a, b) between sets of one bucket and different components. left: sig, set a of component c."""
        placed = self.scratch.table(left.select("sig", F.col("a").alias("doc_id"), "c").join(self.maps, "doc_id"), "placed")
        blocks = placed.groupBy("sig").agg(F.ceil(F.sum(F.col("n") + 50) / F.lit(self.block)).cast("int").alias("blocks")).where("blocks > 1")
        one = F.lit(0)
        placed = placed.join(self.scratch.table(blocks, "blocks"), "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        # block i meets every block j: pairs (i, j) with i <= j, each of them dealt by itself
        pairs = placed.withColumn("other", F.explode(F.sequence(one, F.col("blocks") - 1))).select(
            "doc_id", "n", "bits", "c", "block", "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
        ).repartition("sig", "i", "j")
        near = pairs.groupBy("sig", "i", "j").applyInArrow(_compare(self.percent), "a long, b long")
        return self.linked(self.scratch.table(near.distinct(), "near"))

    def components(self, open_: DataFrame) -> DataFrame:
        """node, component of all links between different sets. open_: sig, a, b; b is the first of the signature's bucket."""
        links, components, pairs = None, None, open_.where("a <> b").select("a", "b").distinct()
        for _ in range(ROUNDS):
            found = self.linked(self.near(pairs))
            if links is None or not found.isEmpty():
                links = found if links is None else links.unionAll(found)
                components = connected_components(links, self.scratch)
            before, open_ = open_, self.scratch.table(_left(open_, components), "open")
            self.scratch.drop(before)
            if open_.isEmpty():
                return components
            pairs = open_.where("c <> d").select("a", "b").distinct()
        found = self.linked_in_buckets(open_)
        return components if found.isEmpty() else connected_components(links.unionAll(found), self.scratch)


def _left(open_: DataFrame, components: DataFrame) -> DataFrame:
    """sig, a, c, b, d: the sets of buckets in which sets of several components are left, and the bucket's first one of these. c and d are components."""
    of = components.withColumnsRenamed({"node": "a", "component": "c"})
    left = open_.where("a <> b").select("sig", "a").join(of, "a", "left").select("sig", "a", F.coalesce("c", "a").alias("c"))
    first = left.groupBy("sig").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min(F.struct("a", "c")).alias("b")).where("least < most")
    return left.join(first, "sig").select("sig", "a", "c", F.col("b.a").alias("b"), F.col("b.c").alias("d"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of docs."""
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        bucket = Window.partitionBy("at").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        scanned = scan(docs, n, percent).withColumn("first", F.first("doc").over(bucket))
        star = F.col("x.sig").isNotNull() | (F.col("x").isNull() & (F.col("first") != F.col("doc")))
        scanned = scratch.table(scanned.where(F.col("x.n").isNotNull() | star), "scan")
        sets = scanned.where("x.n is not null").select(F.col("doc").alias("doc_id"), F.col("x.n").alias("n_shingles"), "x.k1", "x.k2")
        rows = persisted(sets, "jaccard-sets")
        classes = scratch.table(rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
        # of buckets, sets by the documents that stand for them
        stars = scanned.where("x.n is null").select(F.coalesce("x.sig", "at").alias("sig"), F.col("doc").alias("p"), F.coalesce("x.first", "first").alias("q")).distinct()
        stars = scratch.table(stars, "stars-of-documents")
        ids = scratch.table(stars.select(F.explode(F.array("p", "q")).alias("doc_id")).distinct(), "documents")
        reps = ids.join(rows.where("n_shingles > 0"), "doc_id").join(classes.where("rep is not null"), ["k1", "k2"]).select("doc_id", "rep").distinct()
        reps = scratch.table(reps, "reps")
        rep = lambda key, name: reps.select(F.col("doc_id").alias(key), F.col("rep").alias(name))
        stars = scratch.table(stars.join(rep("p", "a"), "p").join(rep("q", "b"), "q").select("sig", "a", "b").distinct(), "stars")
        maps = scanned.where("x.n > 0").select(F.col("doc").alias("doc_id"), "x.n", "x.bits").join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").distinct()
        sets = _Sets(docs.select(F.col("doc_id").cast("long"), "text"), scratch.table(maps, "maps"), scratch, n, percent, block)
        components = sets.components(stars).withColumnsRenamed({"node": "rep", "component": "c"})
        found = persisted(classes.join(components, "rep", "left").select("k1", "k2", F.coalesce("c", "rep").alias("c")), "jaccard-components")
    with_set = rows.where("n_shingles > 0").join(found, ["k1", "k2"]).select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    return with_set.unionAll(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def jaccard_stage(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id."""
    found = jaccard_components(docs, n, percent)
    gone = persisted(found.where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    # rows as one value, so that no column's name clashes
    rows = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"), docs["doc_id"].alias("doc_id"))
    kept = drop_by_keys(rows, "doc_id", gone)
    return kept.select(*[F.col("whole")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
