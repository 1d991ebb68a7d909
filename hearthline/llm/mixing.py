"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code point order, null last, weigh by a repeating list and share the total size; no target
exceeds LIMIT times its source's size, and the excess is shared again by weight among the others until none is above.
A source's target is r whole passes over it and a remaining budget. The budget is fitted on the histogram of
exact lengths, never on documents, by one law for all sizes: but for a reserve of RESERVE typical documents, every length gives the same share of its words; what a length can't give in
whole documents is carried to the next shorter one, so that long and short documents are taken alike. Then a bounded knapsack, over lengths in a seeded order, finds the reachable sum that is
nearest to the reserve and what was carried last. Its memory goes with the reserve, never with the longest text. Of each length, the documents with the
least seeded hashes are taken.

Sizes are counted, summed and joined as DataFrames. A source's histogram, bounded by its number of different
lengths, is one task's input. What is taken of a source and length are the documents up to some hash, so that one row for each of them says it all: texts
are read where they lie and never shuffled. That hash comes from counts by hash bucket and the one bucket in which it lies, so that no task
orders a whole source, even where a third of all rows share source and length. Windows over sources have no partition: there is a row for each source.

Defined cases: null and empty texts have size 0 and are taken with 0 words; very long texts count like others; sources of no words have target 0; rows
that repeat one doc_id are separate documents, taken in an order that their texts decide, and equal rows alike; other columns, whatever
their names, pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import persisted, text_of, words_of

WEIGHTS = (1, 2, 3)
#: A document is taken this often at most, and a target is at most this many times its source's size.
LIMIT = 3
SEED = 20
#: Documents of the median length that the knapsack fits, and most words that they have.
RESERVE, BUDGET = 64, 1 << 20
#: Bits of the hash by which the documents of one source and length are counted.
BITS = 10
#: Most rows of thresholds (one a source and length) that are broadcast.
LENGTHS = 200_000


def _hash(doc_id: Column, text: Column) -> Column:
    """A seeded hash of 63 bits, so that it isn't negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id, text), 1)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (seeded hash) of each document. Texts are read here, and nowhere else."""
    text = text_of(docs["text"])
    return docs.select(
        "doc_id", docs["source"].cast("string").alias("source"), F.size(words_of(text)).cast("long").alias("size"), _hash(docs["doc_id"], text).alias("h"),
    )


def targets(by_source: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target. by_source: source, source_size; one row a source.

    With sources ordered by limit * size / weight, those up to some place stop at their limit and the others
    share the rest by weight; the first place whose share per weight isn't above the next source's own
    ratio is that of the repeated sharing. The windows run over the sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        ranked.withColumn("ratio", limit * F.col("source_size") / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(everything) - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest))
        .withColumn("final", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything))
    )
    target = F.least(limit * F.col("source_size").cast("double"), F.col("w") * F.coalesce("final", F.lit(float("inf"))))
    return shared.select("source", "source_size", target.alias("target"))


def _shared(length: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """Documents of each length, lengths descending, so that each gives its share of words; what it can't give is carried on."""
    taken, carry = np.zeros(len(length), np.int64), 0.0
    for i, (n, c) in enumerate(zip(length.tolist(), count.tolist(), strict=True)):
        want = share * n * c + carry
        taken[i] = min(c, int(want // n))
        carry = want - int(taken[i]) * n
    return taken


def fit_budget(length: np.ndarray, count: np.ndarray, budget: float, most: int = BUDGET) -> np.ndarray:
    """How many documents of each length to take, so that their sum is near budget. Lengths differ and are positive."""
    order = np.argsort(-length)
    length, count = length[order].astype(np.int64), count[order].astype(np.int64)
    total = int((length * count).sum())
    goal = min(total, int(round(budget)))
    if not goal:
        return np.zeros(len(order), np.int64)
    median = int(length[np.searchsorted(np.cumsum(count), count.sum() / 2)])
    reserve = min(goal, RESERVE * median, most)
    taken = _shared(length, count, (goal - reserve) / total)
    goal -= int((length * taken).sum())
    free_now = np.flatnonzero(count > taken)
    least = int(length[free_now].min()) if len(free_now) else 0
    # what was carried last is less than the shortest document that is free
    if not len(free_now) or least > min(goal, most):
        one = free_now[np.argsort(np.abs(length[free_now] - goal))[:1]]
        taken[one] += np.abs(length[one] - goal) < goal
        out = np.zeros(len(taken), np.int64)
        out[order] = taken
        return out
    top = min(2 * goal, goal + int(length[free_now].max()))  # sums over the goal may be nearer to it
    fit = free_now[length[free_now] <= top]
    via, reach, mask, steps = np.full(top + 1, -1, np.int32), 1, (1 << (top + 1)) - 1, []
    for i in np.random.default_rng(SEED).permutation(fit).tolist():
        free, size = int(min(count[i] - taken[i], top // length[i])), 1
        while free > 0 and not reach >> goal & 1:
            n = min(size, free)
            shift = n * int(length[i])
            new = ((reach << shift) & mask) & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
                via[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: top + 1])] = len(steps)
                reach |= new
            steps.append((i, n, shift))
            free, size = free - n, 2 * size
        if reach >> goal & 1:
            break
    below = goal
    while below > 0 and not reach >> below & 1:
        below -= 1
    above = goal
    while above <= top and not reach >> above & 1:
        above += 1
    at = above if above <= top and above - goal < goal - below else below
    while at > 0:  # a sum's step only ever builds on sums of earlier steps
        i, n, shift = steps[via[at]]
        taken[i] += n
        at -= shift
    out = np.zeros(len(taken), np.int64)
    out[order] = taken
    return out


def _fit_source(table: pa.Table) -> pa.Table:
    length, count = (table.column(c).to_numpy() for c in ("size", "n"))
    budget = table.column("budget")[0].as_py()
    taken = fit_budget(length, count, budget)
    return pa.table({"source": table.column("source"), "size": table.column("size"), "extra": pa.array(taken, pa.int64())})


def thresholds(rows: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, size, source_size, target, passes, upto: one row a source and length. Its documents are taken passes times, and those with a hash up to upto once more."""
    bucket = F.shiftright("h", 63 - BITS).cast("int")
    rows = rows.withColumn("bucket", bucket)
    histogram = persisted(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mixing-histogram")
    by_length = histogram.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = persisted(
        targets(by_source, weights, limit)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")),
        "mixing-targets",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    lengths = by_length.where("size > 0").alias("l").join(goal.alias("g"), same(by_length, goal))
    extra = persisted(
        lengths.select("l.source", "l.size", "l.n", "g.budget").groupBy("source").applyInArrow(_fit_source, "source string, size long, extra long"),
        "mixing-extra",
    )
    # the bucket in which the last document lies that is taken once more, and how many of the bucket are
    in_order = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    e = extra.where("extra > 0").select(F.col("source").alias("es"), F.col("size").alias("ez"), "extra")
    cut = (
        histogram.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
        .join(e, histogram["source"].eqNullSafe(F.col("es")) & (histogram["size"] == F.col("ez")))
        .where("before < extra and before + n >= extra")
        .select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.col("bucket").alias("cb"), (F.col("extra") - F.col("before")).alias("place"))
    )
    cut = persisted(cut, "mixing-cut")
    last = rows.join(cut, rows["source"].eqNullSafe(F.col("cs")) & (rows["size"] == F.col("cz")) & (rows["bucket"] == F.col("cb")))
    number = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h"))
    last = last.withColumn("number", number).where("number = place").select(F.col("source").alias("ls"), F.col("size").alias("lz"), F.col("h").alias("upto"))
    g = goal.select(F.col("source").alias("gs"), "source_size", "target", "passes")
    found = by_length.join(g, by_length["source"].eqNullSafe(F.col("gs"))).join(last, by_length["source"].eqNullSafe(F.col("ls")) & (by_length["size"] == F.col("lz")), "left")
    return persisted(found.select("source", "size", "source_size", "target", "passes", F.coalesce("upto", F.lit(-1)).alias("upto")), "mixing-thresholds")


def _taken(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (source, size, h and more) with source_size, target and times. found: thresholds, broadcast while they are few."""
    t = found.withColumnsRenamed({"source": "ts", "size": "tz"})
    if found.limit(LENGTHS + 1).count() <= LENGTHS:
        t = F.broadcast(t)
    joined = rows.join(t, rows["source"].eqNullSafe(F.col("ts")) & (rows["size"] == F.col("tz"))).drop("ts", "tz")
    return joined.withColumn("times", F.col("passes") + (F.col("h") <= F.col("upto")).cast("long")).drop("passes", "upto")


def mix(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source, source_size, target, times, taken, h: how often the mix takes each document."""
    rows = persisted(sizes(docs), "mixing-sizes")
    out = _taken(rows, thresholds(rows, weights, limit))
    return out.select("doc_id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "h")


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its columns."""
    found = thresholds(persisted(sizes(docs), "mixing-sizes"))
    text = text_of(docs["text"])
    rows = docs.select(
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), docs["source"].cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"), _hash(docs["doc_id"], text).alias("h"),
    )
    repeated = _taken(rows, found).where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time"))
    return repeated.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
