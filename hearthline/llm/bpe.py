"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece (one match of the splitting pattern) is a row of bytes. Leaf i of a segment tree holds the rank
of the pair that starts at live position i, joined with i, so that the root is the leftmost minimum.
A merge changes the leaves of three live neighbours and their logarithmically many ancestors.

Pieces of up to SHORT bytes run side by side: their trees are the rows of one array and every step merges
once in each row. Longer pieces run one by one over the same tree. Spark deals the documents out; the
vocabulary is a constant that the driver reads and broadcasts.

Defined cases: null counts as empty; an empty text has no tokens, and both digests are of no bytes; very long texts and pieces are
encoded whole; of equal pair ranks the leftmost merges first; equal rows give equal results; an empty table gives an empty result; other columns pass through unless their name is an output's, which replaces it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import slices

#: Bytes of the pieces that are merged side by side.
SHORT = 64
#: Pieces whose ids a task keeps; beyond that it starts anew, with the same results.
CACHE = 400_000
NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a line has base64 and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Merger:
    """Merges of one vocabulary. Ranks are ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.width = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of up to SHORT bytes."""
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
        for size, members in by_size.items():
            for i, ids in zip(members, self._side_by_side([pieces[i] for i in members], size), strict=True):
                out[i] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], size: int) -> list[list[int]]:
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(n, size)
        ids = self.byte_ids[raw]
        at = np.arange(size)
        after = np.where(at + 1 < length[:, None], at + 1, size)  # size: none
        before = np.broadcast_to(at - 1, (n, size)).copy()  # -1: none
        tree = np.full((n, 2 * size), NONE * size, dtype=np.int64)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        rank = np.where((rank < NONE) & (at[1:] < length[:, None]), rank, NONE)
        tree[:, size : 2 * size - 1] = np.where(rank < NONE, rank * size + at[:-1], NONE * size)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        live = at < length[:, None]
        rows = np.flatnonzero(tree[:, 1] < NONE * size)
        while len(rows):
            best = tree[rows, 1]
            i, new = best % size, best // size
            j = after[rows, i]
            k = after[rows, j]  # j is a live position: a pair starts at i
            ids[rows, i] = new
            live[rows, j] = False
            after[rows, i] = k
            has_k = k < size
            before[rows[has_k], k[has_k]] = i[has_k]
            h = before[rows, i]
            has_h = h >= 0
            right = np.full(len(rows), NONE * size)
            r, x = rows[has_k], i[has_k]
            got = self.rank_of(new[has_k], ids[r, k[has_k]])
            right[has_k] = np.where(got < NONE, got * size + x, NONE * size)
            self._update(tree, rows, i, right, size)
            self._update(tree, rows, j, np.full(len(rows), NONE * size), size)
            r, x = rows[has_h], h[has_h]
            got = self.rank_of(ids[r, x], new[has_h])
            self._update(tree, r, x, np.where(got < NONE, got * size + x, NONE * size), size)
            rows = rows[tree[rows, 1] < NONE * size]
        flat, counts = ids[live].tolist(), live.sum(axis=1).tolist()
        out, start = [], 0
        for c in counts:
            out.append(flat[start : start + c])
            start += c
        return out

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, size: int) -> None:
        node = leaf + size
        tree[rows, node] = value
        while size > 1:
            node, size = node >> 1, size >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of a piece of any length, in O(n log n)."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none, get, width = int(NONE) * size, self.pairs.get, self.width
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (rank := get(ids[i] * width + ids[i + 1])) is not None:
                tree[size + i] = rank * size + i
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def update(leaf: int, value: int) -> None:
            node = leaf + size
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                if tree[node] == (least := a if a < b else b):
                    break  # the ancestors stay as they are
                tree[node] = least

        while (best := tree[1]) < none:
            i, ids_i = best % size, best // size
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = ids_i, -1, k
            update(j, none)
            right = None
            if k >= 0:
                before[k] = i
                right = get(ids_i * width + ids[k])
            update(i, none if right is None else right * size + i)
            if (h := before[i]) >= 0:
                left = get(ids[h] * width + ids_i)
                update(h, none if left is None else left * size + h)
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of different pieces; a piece that is a token itself is that token."""
        out, short = {}, []
        for p in pieces:
            if (rank := self.ranks.get(p)) is not None:
                out[p] = (rank,)
            elif len(p) <= SHORT:
                short.append(p)
            else:
                out[p] = tuple(self.merge_long(p))
        for start in range(0, len(short), 20_000):
            part = short[start : start + 20_000]
            out.update(zip(part, map(tuple, self.merge_many(part)), strict=True))
        return out


class Codec:
    """Texts to ids and back, one task's worth at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger, self.find = Merger(ranks), regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.find(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        fresh = {p for pieces in split for p in pieces if p not in self.known}
        ids = self.merger.encode_pieces([p.encode() for p in fresh])
        self.known.update((p, ids[p.encode()]) for p in fresh)
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merger.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs and n_tokens, ids_sha256, decoded_sha256 (and ids with keep_ids). No shuffle: one pass over the rows.

    ranks_path is read by the driver alone; its content, a file of bounded size, goes to the tasks as a broadcast.
    """
    table = read_ranks(ranks_path)
    ranks = docs.sparkSession.sparkContext.broadcast(table)
    key = (hashlib.sha256(repr(sorted(table.items())).encode()).hexdigest(), pattern)  # a worker that lives on takes no vocabulary of before
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    rest = [c for c in docs.columns if c not in made]
    carried = [c for c in rest if c != text]
    source = docs.select(*[docs[c] for c in carried], F.coalesce(docs[text], F.lit("")).alias("__text"), *([docs[text]] if text in rest else []))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    order = [*carried, *([text] if text in rest else [])]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    schema = ", ".join([*(f"{quoted(c)} {types[c]}" for c in order), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>"] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (codec := _codecs.get(key)) is None:
            codec = _codecs[key] = Codec(ranks.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, "__text"):
            ids = codec.encode_batch(batch.column("__text").to_pylist())
            columns = [batch.column(c) for c in order]
            columns.append(pa.array([len(x) for x in ids], pa.int64()))
            columns.append(pa.array([sha(" ".join(map(str, x)).encode()) for x in ids], pa.string()))
            columns.append(pa.array([sha(codec.decode(x)) for x in ids], pa.string()))
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*order, *made])

    return source.mapInArrow(run, schema)
