import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from hearthline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
WANT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", " ", "a", "hello world", "don't  stop\n\n now", "x" * 500, "ab" * 3000, "日本語テキスト 🎉", "\u0000 \t", "aaaaaaaaa bbbbbbbbb",
    "ered*** reed*** &&&$$$%%%", "  leading", "trailing   ", "Éâü" * 90, "<|endoftext|>", "".join(random.Random(1).choice("abcdef. \nXYZé") for _ in range(20_000)),
]


@pytest.mark.parametrize("short", [0, 4, 64])
def test_ids_equal_the_library(monkeypatch, short):
    monkeypatch.setattr(bpe, "SHORT", short)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(TEXTS, codec.encode_batch(TEXTS), strict=True):
        assert ids == WANT.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_cache_starts_anew_with_equal_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in TEXTS:
        assert codec.encode_batch([text]) == [WANT.encode_ordinary(text)]


def test_frame_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "x", 5), (2, "", "y", 6), (3, TEXTS[5], None, 7), (3, TEXTS[5], None, 7), (None, "a b", "z", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a b` string, n_tokens long")
    got = sorted(bpe.encode(df, PATH, public_tokenizers.PATTERN, keep_ids=True).collect(), key=str)
    assert len(got) == 5
    for r in got:
        want = WANT.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids) == (len(want), want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
