"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Every word and every pair of neighbouring words of a text falls into one of BUCKETS hash buckets. Two
multinomials over the buckets are counted: one over all documents (raw), one over the trusted documents of
one part (target). A document's score is the sum of its n-grams' log-likelihood ratios divided by their number plus PRIOR. The
threshold is a fixed low quantile of the scores of all trusted documents of the other part, so that it is a number of the run and every
document gets the same rule. The parts are halves by hash of doc_id, and every trusted document is in one of them.

Everything here is DataFrame expressions. Counting explodes buckets under a map-side aggregate (at most BUCKETS
rows leave a task); scoring reads the weights, one array of fixed size, as a scalar subquery: no join, no shuffle.

Defined cases: null and empty texts have no words and all counts 0, so that they fail the base rule. With no
trusted documents every weight and the threshold are such that the method keeps all. A document with several label
rows is trusted if one of them says so. Repeated rows are counted each and judged alike; very long texts are read whole; a score equal to the threshold
is kept. An empty table gives an empty result. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import persisted, text_of, words_of

BUCKETS = 1 << 16
#: Added to the number of n-grams, so that a few words don't decide alone.
PRIOR = 16
#: Share of trusted documents under the threshold, and the steps in which their scores are counted for it.
QUANTILE = 0.004
STEPS = 10_000
WINDOW = 8
MIN_WORDS = 20


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more. hashes: of the windows in order."""

    def starts(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        same = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(at, lambda k: F.coalesce(same(k), F.lit(False))), lambda k: F.get(s, k)["i"]))

    def total(p: Column) -> Column:
        step = lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, k: a + step(k))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(_let(pairs, starts), total))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the words' hashes (w)."""
    text = text_of(docs["text"])
    count = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    first = docs.select(
        "doc_id",
        F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("w"),
        count(F.length(F.translate(text, " \t\n\x0b\f\r", ""))).alias("word_chars"),
        count(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        count(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
    )
    windows = _let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))))
    repeat = F.when(F.size("w") <= WINDOW, F.lit(0)).otherwise(_let(windows, _covered))
    n = count(F.size("w"))
    return first.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", count(repeat).alias("n_repeat_words"), "w"
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _grams(w: Column) -> Column:
    """Buckets of an array of word hashes: words, then pairs."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.when(
        F.size(w) > 1,
        F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: bucket(F.xxhash64(F.get(w, i), F.get(w, i + 1)))),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(w, bucket), pairs)


def _hashes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.transform(words_of(text_of(docs["text"])), lambda w: F.xxhash64(w)).alias("w"))


def trusted(labels: DataFrame) -> DataFrame:
    """All doc_ids of labels.quality = 1, with part 0 (counted) or 1 (threshold) by hash."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return ids.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(2)).alias("part"))


def _dealt(ids: DataFrame) -> DataFrame:
    """ids for a join by shuffle at every size. Their number grows with documents: a table that is broadcast while it is small is a cliff of memory and of shuffled bytes where it no longer is."""
    return ids.hint("shuffle_hash")


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weights (array of BUCKETS doubles) and threshold. Texts are shuffled to the ids of trusted documents twice, one after the other."""
    ids, texts = persisted(trusted(labels), "quality-trusted"), docs.select("doc_id", "text")
    marked = texts.join(_dealt(ids), "doc_id", "left").select("part", F.transform(words_of(text_of("text")), lambda w: F.xxhash64(w)).alias("w"))
    grams = marked.select(F.explode(_let(F.col("w"), _grams)).alias("bucket"), F.coalesce(F.col("part") == 0, F.lit(False)).alias("target"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("target").alias("target"))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    weights = persisted(
        full.agg(
            F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target")
        ).select(
            F.transform(
                "c",
                lambda x: F.when(F.col("all_target") == 0, F.lit(0.0)).otherwise(
                    F.log((x["target"] + 1.0) / (F.col("all_target") + BUCKETS)) - F.log((x["raw"] + 1.0) / (F.col("all_raw") + BUCKETS))
                ),
            ).alias("weights")
        ),
        "quality-weights",
    )
    held = _hashes(texts.join(_dealt(ids.where("part = 1")), "doc_id", "left_semi"))
    # scores are averages of logarithms, a few hundred thousand steps at most: the exact quantile of their steps, whatever the number of documents
    steps = _with_score(held, weights).groupBy((F.floor(F.col("score") * STEPS) / STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    threshold = steps.agg(F.coalesce(F.percentile("step", QUANTILE, F.col("n")), F.lit(float("-inf"))).alias("threshold"))
    return persisted(weights.select("weights", threshold.scalar().alias("threshold")), "quality-model")


def _with_score(df: DataFrame, weights: DataFrame) -> DataFrame:
    """df, which has w, and its score. The weights are one value of the plan, not a column that rows carry."""
    total = _let(F.col("w"), lambda x: F.aggregate(_grams(x), F.lit(0.0), lambda a, b: a + F.get(F.col("__weights"), b)))
    return (
        df.withColumn("__weights", weights.select("weights").scalar())
        .withColumn("score", total / (F.greatest(2 * F.size("w") - 1, F.lit(0)) + PRIOR)).drop("__weights")
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, score. docs is read three times."""
    model = fit(docs, labels)
    scored = _with_score(base_counts(docs), model)
    kept = ~F.col("base_failed") & (F.col("score") >= model.select("threshold").scalar())
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def quality_stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with its columns, judged row by row."""
    model = fit(docs, labels)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("doc_id"), docs["text"].alias("text"))
    scored = _with_score(base_counts(whole), model)
    kept = scored.where(~F.col("base_failed") & (F.col("score") >= model.select("threshold").scalar()))
    return kept.select(*[F.col("doc_id")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)])
