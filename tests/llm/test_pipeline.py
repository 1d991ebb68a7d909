"""Stages against brute force: what each keeps of its own input."""

from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from hearthline.llm import bpe, quality
from hearthline.llm.common import persisted
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = persisted(stage(spark, docs, SF), "test")
        seen[name] = (docs.collect(), out.collect())
        assert out.columns == columns or name == "encode"
        docs = out

    rows, out = seen["quality_rules"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("kept").collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept)

    rows, out = seen["exact_dedup"]
    top = {}
    for r in rows:
        top[r.text] = max(top.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in out) == sorted(top.values())

    rows, out = seen["near_duplicates"]
    want = brute([(r.doc_id, r.text) for r in rows], 5, 80)
    assert sorted(r.doc_id for r in out) == sorted(d for d, (_, c) in want.items() if c == d)

    rows, out = seen["mix_sources"]
    times = Counter(r.doc_id for r in out)
    size = {r.doc_id: len(r.text.split()) for r in rows}
    assert set(times) <= set(size) and max(times.values()) <= 3
    assert abs(sum(size[d] * n for d, n in times.items()) - sum(size.values())) <= 0.05 * sum(size.values())

    rows, out = seen["encode"]
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, tuple(lib.encode_ordinary(r.text))) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want


def through(spark, docs):
    seen = {}
    for name, stage in cp.STAGES:
        docs = persisted(stage(spark, docs, SF), "test")
        seen[name] = docs
    return seen


def test_odd_rows_and_clashing_columns_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = {r.doc_id for r in through(spark, docs)["quality_rules"].collect()}
    some = docs.where(docs["doc_id"].isin(*sorted(clean)[:40]))
    texts = {r.doc_id: r.text for r in some.collect()}
    long = " ".join(f"{t}" for t in texts.values())
    first = sorted(texts)[0]
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, " \t\n", "en", "s", 3), (9004, (long + " ") * 3, "en", None, 0), (None, texts[first] + " and more words", "en", "s", 1)]
    odd += [(d, texts[d], "en", "s", 1) for d in sorted(texts)[:20] for _ in range(2)]
    clash = ["row", "times", "component_id", "digest", "at", "locator", "h", "size", "sig", "block", "n_tokens", "score", "kept", "whole", "__b"]
    both = some.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", *[f"'x' as {c}" for c in clash])
    seen = through(spark, both)
    for name in list(seen)[:-1]:
        assert seen[name].columns == both.columns
        assert {v for r in seen[name].select(*clash).distinct().collect() for v in r} == {"x"}
    kept = [r.doc_id for r in seen["quality_rules"].collect()]
    assert not {9001, 9002, 9003} & set(kept) and max(Counter(kept).values()) == 3
    assert sorted(Counter(r.doc_id for r in seen["exact_dedup"].collect()).values())[-1] == 1
    near = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert len(near) <= len(set(kept)) and near <= {r.doc_id for r in seen["exact_dedup"].collect()}
    assert {r.doc_id for r in seen["mix_sources"].select("doc_id").distinct().collect()} <= near
    assert seen["encode"].count() == seen["mix_sources"].count()


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [d.count() for d in through(spark, docs).values()] == [0] * 5
