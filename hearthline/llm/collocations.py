"""Phrase collocations by position bitmaps, after SPAM (Ayres, Flannick, Gehrke, Yiu 2002).

A shard is a run of texts of some megabytes. Its words stand at positions; between two pieces of text a position stays empty. Each
word has a bitmap of its positions, kept as bytes of eight positions, those that aren't zero with their places. A phrase's bitmap marks the
positions of its last word: it is shifted by one and ANDed with the bitmaps of the words in the same bytes, and what is left are the
bitmaps of the phrases that are one word longer; empty positions end phrases at pieces. A block of first words is extended depth first, all its
phrases at once. Popcounts are summed over shards as a DataFrame.

A phrase is at most as frequent as its parts, so that each length is counted with what the lengths before have shown: a bitmap of
FILTER bits, whose size doesn't grow with the data, marks the hashes of frequent parts. Where it is full, more phrases are counted; none is lost, and the
sums decide. Words are 64-bit hashes while they are counted; the query fails if two words of the corpus have one.

Defined cases: a null text has no words and a null lang is `und`; texts of white space or of separators have none; very long texts are shards by themselves, cut
nowhere; documents that repeat count as often as they occur, whatever their ids; ties are ordered by phrase; an empty table gives an empty result;
other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import Scratch, slices

#: Bytes of text of a shard.
SHARD = 4_000_000
#: Bits of the filter that marks frequent words or phrases, a power of two and of 32,768 at least.
FILTER = 1 << 25
#: Bytes of bitmaps that are extended at once.
BLOCK = 1 << 15

#: No byte of UTF-8.
BREAK = b"\xff"
#: Separators of pieces are breaks.
_pieces = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class _Ids(dict):
    """Numbers of a language's words within a shard; all languages count on in one list."""

    def __init__(self, lang: str, all_words: list[tuple[str, bytes]]):
        self.lang, self.all_words = lang, all_words
        self[BREAK] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.all_words)
        self.all_words.append((self.lang, word))
        return n


def words_and_breaks(text: bytes) -> list[bytes]:
    """Lower-cased words (A-Z alone) of a text in UTF-8, with a break at each separator and at the end."""
    return [*text.lower().translate(_pieces).replace(BREAK, b" \xff ").split(), BREAK]


def bitmaps(word: np.ndarray, position: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, places, bits): word i has the bytes ends[i - 1] to ends[i]. word is ordered, position within it."""
    place = position >> 3
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (place[1:] != place[:-1])
    starts = np.flatnonzero(new)
    bits = np.left_shift(np.uint8(1), (position & 7).astype(np.uint8))
    bits = np.bitwise_or.reduceat(bits, starts) if len(starts) else bits
    ends = np.cumsum(np.bincount(word[starts], minlength=n_words))
    return ends.astype(np.int64), place[starts].astype(np.int32), bits


WORDS = [("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("f", pa.int64())]
SHARDS = "words array<struct<lang: string, word: string, h: long, f: long>>, ends binary, places binary, bits binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SHARD):
        all_words, by_lang, runs = [], {}, []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            tokens = words_and_breaks(text or b"")
            ids = by_lang.get(lang) or by_lang.setdefault(lang, _Ids(lang, all_words))
            runs.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
        stream = np.concatenate(runs)
        position = np.flatnonzero(stream >= 0).astype(np.int32)
        word = stream[position]
        f = np.bincount(word, minlength=len(all_words)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        ends, places, bits = bitmaps(word[order], position[order], len(all_words))
        del runs, stream, position, word, order
        seeds = {lang: xxhash.xxh3_64_intdigest(lang) for lang in by_lang}
        h = np.array([xxhash.xxh3_64_intdigest(w, seed=seeds[lang]) for lang, w in all_words], np.uint64).view(np.int64)
        columns = [pa.array([lang for lang, _ in all_words], pa.string()), pa.array([w for _, w in all_words], pa.binary()).cast(pa.string()), pa.array(h), pa.array(f)]
        words = pa.ListArray.from_arrays(pa.array([0, len(all_words)], pa.int32()), pa.StructArray.from_arrays(columns, names=[n for n, _ in WORDS]))
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (ends, places, bits)]
        yield pa.RecordBatch.from_arrays([words, *packed], names=["words", "ends", "places", "bits"])
        pa.default_memory_pool().release_unused()


def shards(docs: DataFrame) -> DataFrame:
    """One row for each run of texts: its words with language, hash and number of occurrences, and their bitmaps. docs: text, lang."""
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(_shards, SHARDS)


def _place(h: list[np.ndarray]) -> np.ndarray:
    """Of phrases, the place in a filter. h: hashes of the first words, of the second, .."""
    return reduce(np.bitwise_xor, (x >> np.uint64(20 * i) for i, x in enumerate(h))) & np.uint64(FILTER - 1)


def filter_of(phrases: DataFrame) -> np.ndarray:
    """Bytes of a filter that marks the phrases whose hashes are in the columns h1, h2, .. The driver gets FILTER bits at most."""
    hashes = [c for c in phrases.columns if c[0] == "h"]
    place = reduce(lambda a, b: a.bitwiseXOR(b), (F.shiftrightunsigned(c, 20 * i) for i, c in enumerate(hashes))).bitwiseAND(F.lit(FILTER - 1)) + 1
    marked = phrases.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(FILTER // 8, np.uint8)
    for bucket, bits in marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _passes(bits: np.ndarray, h: list[np.ndarray]) -> np.ndarray:
    place = _place(h)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Shard:
    """The bitmaps of a shard's words that the first filter lets pass, by word and by place."""

    def __init__(self, h: np.ndarray, ends: np.ndarray, places: np.ndarray, bits: np.ndarray, filters: list[np.ndarray]):
        word = np.repeat(np.arange(len(h), dtype=np.int32), np.diff(ends, prepend=0))
        keep = _passes(filters[0], [h])[word]
        self.h, self.filters = h, filters
        self.word, self.place, self.bits = word[keep], places[keep], bits[keep]
        by_place = np.argsort(self.place, kind="stable")
        self.at_word, self.at_bits = self.word[by_place], self.bits[by_place]
        last = int(self.place.max(initial=0)) + 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.place, minlength=last + 1))])

    def phrases(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, popcounts) of phrases of k words; a phrase may come in several parts."""
        for s in range(0, len(self.word), BLOCK):
            first, of = np.unique(self.word[s : s + BLOCK], return_inverse=True)
            yield from self._extended(first[:, None], of, self.place[s : s + BLOCK], self.bits[s : s + BLOCK], k)

    def _extended(self, phrases: np.ndarray, of: np.ndarray, place: np.ndarray, bits: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # shift by one position; the last bit goes on to the next byte
        stay, carry = bits << 1, bits >> 7
        here, over = np.flatnonzero(stay), np.flatnonzero(carry)
        of, place = np.concatenate([of[here], of[over]]), np.concatenate([place[here], place[over] + 1])
        bits = np.concatenate([stay[here], carry[over]])
        # AND with the bitmaps of all words that have a byte there
        n = self.start[np.minimum(place + 1, len(self.start) - 1)] - self.start[np.minimum(place, len(self.start) - 1)]
        total = np.cumsum(n)
        entry = np.repeat(np.arange(len(place)), n)
        at = np.arange(len(entry)) - np.repeat(total - n, n) + np.repeat(self.start[np.minimum(place, len(self.start) - 1)], n)
        both = bits[entry] & self.at_bits[at]
        hit = np.flatnonzero(both)
        both, entry, word = both[hit], entry[hit], self.at_word[at[hit]]
        longer, which = np.unique(of[entry].astype(np.int64) * len(self.h) + word, return_inverse=True)
        child = np.column_stack([phrases[longer // len(self.h)], longer % len(self.h)])
        hashes = [self.h[child[:, i]] for i in range(child.shape[1])]
        length = child.shape[1]
        frequent = _passes(self.filters[length - 2], hashes[1:])
        if length < k:
            frequent &= _passes(self.filters[length - 1], hashes)
            some = np.flatnonzero(frequent[which])
            if len(some):
                number = np.cumsum(frequent) - 1
                yield from self._extended(child[frequent], number[which[some]], place[entry[some]], both[some], k)
        elif frequent.any():
            yield child[frequent], np.bincount(which, np.bitwise_count(both), len(longer)).astype(np.int64)[frequent]


def _counted(k: int, filters: list[np.ndarray]):
    names = [f"h{i + 1}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = batch.column("h")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                arrays = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("ends", np.int64), ("places", np.int32), ("bits", np.uint8)))
                for words, count in Shard(h, *arrays, filters).phrases(k):
                    hashes = [pa.array(h[words[:, j]].view(np.int64)) for j in range(k)]
                    yield pa.RecordBatch.from_arrays([*hashes, pa.array(count)], names=[*names, "f"])

    return run


def count_phrases(shards_: DataFrame, k: int, filters: list[np.ndarray], least: int) -> DataFrame:
    """h1 .. hk, f: phrases of k words that occur least times or more. filters: of the lengths below k."""
    names = [f"h{i + 1}" for i in range(k)]
    counted = shards_.select(F.col("words.h").alias("h"), "ends", "places", "bits").mapInArrow(_counted(k, filters), ", ".join(f"{c} long" for c in [*names, "f"]))
    return counted.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits: exact for counts below 10^16. It is a million at most, as a is at most l and at most r."""
    a, l, r = (f"cast({c} as decimal(16,0))" for c in (a, l, r))
    return F.expr(f"({a} * {a} * cast(1000000 as decimal(7,0))) div ({l} * {r})")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two to longest words by their weakest cut."""
    spark = docs.sparkSession
    out = Scratch(spark, "collocations-result")
    with Scratch(spark, "collocations") as scratch:
        # a file for each shard: a reader holds one at once, and a task has few of them, whose phrases it sums before the shuffle
        parts = scratch.table(shards(docs), "shards", maxRecordsPerFile=1)
        each = parts.selectExpr("inline(words)")
        totals = scratch.table(each.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        words = each.groupBy("lang", "word", F.col("h").alias("h1")).agg(F.sum("f").alias("f"))
        words = scratch.table(words, "words")
        if not words.groupBy("h1").count().where("count > 1").isEmpty():
            raise ValueError("two words have one hash")
        words = words.where(F.col("f") >= least)
        known, filters = {1: words.select("h1", "f")}, [filter_of(words.select("h1"))]
        for k in range(2, longest + 1):
            known[k] = scratch.table(count_phrases(parts, k, filters, least), f"phrases-{k}")
            if k < longest:
                filters.append(filter_of(known[k]))
        scored = []
        for k in range(2, longest + 1):
            rows = known[k].withColumnRenamed("f", "a")
            for i in range(k):
                word = words.select(F.col("h1").alias(f"h{i + 1}"), F.col("word").alias(f"w{i + 1}"), *(["lang"] if i == 0 else []))
                rows = rows.join(word, f"h{i + 1}")
            cuts = []
            for i in range(1, k):
                for side, start, n in (("l", 1, i), ("r", i + 1, k - i)):
                    names = [f"h{start + j}" for j in range(n)]
                    part = known[n].select(*[F.col(f"h{j + 1}").alias(c) for j, c in enumerate(names)], F.col("f").alias(f"{side}{i}"))
                    rows = rows.join(part, names)
                cuts.append(F.struct(_score("a", f"l{i}", f"r{i}").alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")))
            best = F.array_min(F.array(*cuts))
            longer = [known[m].select(*[F.col(f"h{s + j + 1}").alias(f"h{j + 1}") for j in range(k)], "f") for m in range(k + 1, longest + 1) for s in range(m - k + 1)]
            if longer:
                names = [f"h{j + 1}" for j in range(k)]
                most = reduce(DataFrame.unionAll, longer).groupBy(*names).agg(F.max("f").alias("most"))
                rows = rows.join(most, names, "left").where("most is null or 100 * most < 50 * a")
            scored.append(rows.select("lang", F.concat_ws(" ", *[f"w{i + 1}" for i in range(k)]).alias("phrase"), "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = reduce(DataFrame.unionAll, scored).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        result = ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        return out.table(result, "ranked")
