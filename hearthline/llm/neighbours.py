"""Approximate nearest neighbours by adaptive dimension scan (ADSampling, Gao and Long 2023) within probed lists.

Equal vectors are one class, which has its least ids; so copies cost nothing and no list holds them all. A seeded rotation spreads what
distinguishes vectors over all columns, so that of D columns the first d give an estimate of a distance. Classes lie in lists by the nearest of LISTS centres at most,
k-means of a sample of vectors of SAMPLE numbers at most; a list is cut into parts of PART classes, about, each of them one task's input. A class's rotated columns are kept in blocks.

A query reads its nearest list whole; its k-th distance there is its bar. In its other lists a block of columns is read at a time for the candidates that are left: one
is given up when its partial distance, times D / d, is above the bar by more than the error that a rotation leaves with a probability set by ERROR. What remains is
measured on the original vectors. Classes of equal distance, and only these, are told apart by ids.

How many lists are probed is measured, not set: CALIBRATION of the queries read all lists, and the least number of lists is taken that would have held RECALL of their neighbours.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor those whose length isn't the commonest (of equally common ones
the least); a null vec_id takes no part; rows that repeat an id are one candidate each; of copies each is a candidate; ties go to the smaller id; fewer
candidates than k are all returned, as all lists are read where they hold few; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import Scratch

#: Most lists; with fewer classes their square root.
LISTS = 4096
#: Numbers in the vectors from which centres are learnt, at most.
SAMPLE = 2_000_000
#: Classes of a part of a list, and queries of a block, about.
PART, QUERIES = 8192, 1024
#: Columns of a block.
COLUMNS = 16
#: ADSampling's error parameter: a candidate within the bar is given up with a probability that falls as exp(-c * ERROR^2).
ERROR = 2.1
#: Queries that read all lists, at most, and the share of their neighbours that the probed lists must hold.
CALIBRATION, RECALL = 200, 0.97
SEED = 7


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Of each row of x the n nearest centres, nearest first."""
    out, step = np.zeros((len(x), n), np.int32), max(1, 2_000_000 // len(centres))
    square = (centres**2).sum(axis=1)
    for i in range(0, len(x), step):
        d = square - 2 * x[i : i + step] @ centres.T
        some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(n), d.shape)
        out[i : i + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means of a sample."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        of = _nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        counts = np.bincount(of, minlength=n)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def valid(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, v: rows that take part; -0.0 is 0.0."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: x + 0.0)
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.withColumn("d", F.size("v")).join(F.broadcast(usual.select("d")), "d").select("vec_id", "v")


def classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """class (the least id), v, ids (its k + 1 least, with repeats), asks: one row for each different vector; asks tells if an id of it is divisible by every."""
    order = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    ids = least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asks = rows.where(F.col("vec_id") % every == 0).select("v").distinct().withColumn("asks", F.lit(True))
    return ids.join(asks, "v", "left").select(F.col("ids")[0].alias("class"), "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))


def _placed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """rows with their nearest lists (list, and near from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch.column("v")), centres, probes) if batch.num_rows else np.zeros((0, 1), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, lists array<int>")


def _scanned(k: int, rotation: np.ndarray):
    """Of a part of a list and a block of queries: each query's k nearest classes that its bar lets pass, with those of the same distance."""
    d = len(rotation)

    def nearest(query: np.ndarray, turned: np.ndarray, bar: float, x: np.ndarray, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, partial, done = np.arange(len(x)), np.zeros(len(x)), 0
        for block in blocks:
            part = block[left] - turned[done : done + block.shape[1]]
            partial = partial + np.einsum("ij,ij->i", part, part)
            done += block.shape[1]
            # the hypothesis that a candidate is within the bar is tested on the columns read
            limit = bar * bar * done / d * (1 + ERROR / np.sqrt(done)) ** 2 if done < d else bar * bar * (1 + 1e-9)
            stay = partial <= limit
            left, partial = left[stay], partial[stay]
        exact = np.sqrt(((x[left] - query) ** 2).sum(axis=1))
        within = exact <= (np.partition(exact, k - 1)[k - 1] if len(exact) > k else np.inf)
        return left[within], exact[within]

    def run(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        if candidates.num_rows and queries.num_rows:
            own, x = candidates.column("class").to_numpy(), _matrix(candidates.column("v").combine_chunks())
            turned_x = _matrix(candidates.column("turned").combine_chunks())
            blocks = [np.ascontiguousarray(turned_x[:, i : i + COLUMNS]) for i in range(0, d, COLUMNS)]
            q = _matrix(queries.column("v").combine_chunks())
            turned = q @ rotation
            for i, (query, bar, near) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("class", "bar", "near")), strict=True)):
                at, distance = nearest(q[i], turned[i], np.inf if bar is None else bar, x, blocks)
                out.append((np.full(len(at), query), own[at], distance, near))
        parts = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        near = np.repeat([o[3] for o in out], [len(o[0]) for o in out]) if out else np.zeros(0)
        return pa.table([pa.array(parts[0].astype(np.int64)), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.float64)), pa.array(near.astype(np.int32))], names=["query", "class", "distance", "near"])

    return run


class _Index:
    """Lists of classes. parts: of each list, into how many parts it is cut."""

    def __init__(self, found: DataFrame, centres: np.ndarray, rotation: np.ndarray, k: int, scratch: Scratch):
        self.centres, self.rotation, self.k, self.scratch = centres, rotation, k, scratch

        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"))
                turned = (x @ rotation).ravel() if batch.num_rows else np.zeros(0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(rotation), pa.int32()), pa.array(turned))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "v", "list")), lists], names=["class", "v", "list", "turned"])

        placed = _placed(found.select("class", "v"), centres, 1).withColumn("list", F.col("lists")[0])
        turned = placed.mapInArrow(turn, "class long, v array<double>, list int, turned array<double>")
        self.rows = scratch.table(turned, "lists")
        self.parts = scratch.table(self.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")

    def probe(self, queries: DataFrame) -> DataFrame:
        """query, class, distance, near. queries: class, v, list, near, bar."""
        blocks = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
        shape = self.scratch.table(self.parts.join(blocks, "list"), "shape")
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        candidates = self.rows.join(shape, "list").withColumn("part", dealt("class", "parts")).withColumn("block", every("blocks"))
        asked = queries.join(shape, "list").withColumn("block", dealt("class", "blocks")).withColumn("part", every("parts"))
        keys = ["list", "part", "block"]
        left = candidates.select(*keys, "class", "v", "turned").groupBy(*keys)
        right = asked.select(*keys, "class", "v", "near", "bar").groupBy(*keys)
        schema = "query long, class long, distance double, near int"
        return self.scratch.table(left.cogroup(right).applyInArrow(_scanned(self.k, self.rotation), schema), "probed")

    def best(self, found: DataFrame) -> DataFrame:
        """query, class, distance, near: the k nearest classes of each query, and those as near as the last."""
        order = Window.partitionBy("query").orderBy("distance")
        return found.withColumn("r", F.rank().over(order)).where(F.col("r") <= self.k).drop("r")


def _probed(asking: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """class, v, list, near: each query with each of its lists."""
    return _placed(asking.select("class", "v"), centres, probes).select("class", "v", F.posexplode("lists").alias("near", "list"))


def _search(index: _Index, asking: DataFrame, probes: int) -> DataFrame:
    """The nearest list first, whose k-th distance is the bar in the others."""
    probed = index.scratch.table(_probed(asking, index.centres, probes), "asked")
    first = index.probe(probed.where("near = 0").withColumn("bar", F.lit(None).cast("double")))
    if probes == 1:
        return index.best(first)
    # a part of a list gives k classes at least, if it has as many
    bars = first.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance"))).where(F.col("r") == index.k)
    bars = bars.select(F.col("query").alias("class"), F.col("distance").alias("bar"))
    others = index.probe(probed.where("near > 0").join(bars, "class", "left"))
    return index.best(first.unionAll(others))


def neighbours(vectors: DataFrame, column: str = "embedding", every: int = 100, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by every, its k nearest other rows that were found. probes: lists a query reads, None to measure."""
    spark = vectors.sparkSession
    out = Scratch(spark, "neighbours-result")
    with Scratch(spark, "neighbours") as scratch:
        rows = scratch.table(valid(vectors, column), "rows")
        found = scratch.table(classes(rows, k, every), "classes")
        n = found.count()
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        # rows with the least hashes are a sample of bounded size that reruns agree on
        by_hash = lambda df, most: df.orderBy(F.xxhash64(F.lit(SEED), "class"), "class").limit(most)
        d = len(found.first()["v"])
        sample = _matrix(by_hash(found.select("class", "v"), max(1, SAMPLE // d)).toArrow().column("v").combine_chunks())
        n_lists = min(LISTS, max(1, int(np.sqrt(n) / 2)), len(sample))
        index = _Index(found, _centres(sample, n_lists), _rotation(d), k + 1, scratch)
        asking = found.where("asks")
        if probes is None:
            near = index.best(_search(index, by_hash(asking, CALIBRATION), n_lists)).groupBy("near").count().collect()
            held = np.zeros(n_lists)
            for r in near:
                held[r["near"]] = r["count"]
            probes = int(np.searchsorted(np.cumsum(held), RECALL * held.sum())) + 1 if held.sum() else n_lists
        probes = min(probes, n_lists)
        nearest = scratch.table(_search(index, asking, probes), "nearest")
        # lists of few classes: those queries that found less than k candidates read all of them
        ids = found.select("class", "ids")
        have = nearest.join(ids, "class").groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
        few = asking.join(have, asking["class"] == have["query"], "left").where(F.coalesce("n", F.lit(0)) <= k).select(asking["class"], "v")
        few = scratch.table(few, "few")
        if probes < n_lists and not few.isEmpty():
            again = scratch.table(_search(index, few, n_lists), "again")
            nearest = nearest.join(few.select(F.col("class").alias("query")), "query", "left_anti").unionAll(again.select(*nearest.columns))
        # each query class's k + 1 nearest ids, and then each of its ids that asks, without itself
        spread = nearest.join(ids, "class").select("query", "distance", F.explode("ids").alias("vec_id"))
        order = Window.partitionBy("query").orderBy("distance", "vec_id")
        top = spread.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "distance"))).alias("found"))
        asks = _askers(rows, found, every).join(top, "query")
        own = F.array_position(F.transform("found", lambda x: x["vec_id"]), F.col("query_id")).cast("int")
        others = F.when(own > 0, F.filter("found", lambda x: x["r"] != own)).otherwise(F.col("found"))
        each = asks.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
        result = each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.distance").alias("score"))
        return out.table(result, "ranked")


def _askers(rows: DataFrame, found: DataFrame, every: int) -> DataFrame:
    """query_id, query: each row that asks and its class."""
    asking = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return asking.join(found.where("asks").select(F.col("class").alias("query"), "v"), "v").select("query_id", "query")
