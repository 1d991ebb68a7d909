"""Queries and oracle SQL of the training-data operators, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import bpe, collocations, dedup, html, jaccard, language, lexical, licences, mixing, neighbours, quality, sharding, toxicity
from hearthline.llm.common import table


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("notice_ids", F.array_join("notice_ids", ","))


def op2_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("locator")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op3_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op5_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 4 THEN CASE WHEN len(ws) = 0 THEN [] ELSE [array_to_string(ws, ' ')] END ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u WHERE r.c < e.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.u = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("h", "times")


def op8_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("hilbert")


def op11_tiered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(of: str, columns: str) -> str:
    return f"""SELECT {columns}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {of}"""


OP11_SQL = f"""
WITH t AS (SELECT r, doc_id, term, count(*) AS tf FROM ({_terms_sql("(SELECT row_number() OVER () AS r, doc_id, text FROM documents)", "r, doc_id")}) GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT item_id, term, count(*) AS times FROM ({_terms_sql("(SELECT DISTINCT item_id, text FROM benchmark)", "item_id")}) GROUP BY ALL),
scored AS (SELECT item_id, r, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))))::BIGINT AS score
           FROM i JOIN t USING (term) JOIN n USING (r) JOIN df USING (term), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def op12_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op13_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM ws, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, cut, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, array_to_string(p[i:i + 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_digests": op1_license_digests,
        "op2_streaming_dedup": op2_streaming_dedup,
        "op3_ftrl_language": op3_ftrl_language,
        "op4_toxic_segments": op4_toxic_segments,
        "op5_partenum_jaccard": op5_partenum_jaccard,
        "op6_ngram_ratio": op6_ngram_ratio,
        "op7_subset_sum_mix": op7_subset_sum_mix,
        "op8_template_text": op8_template_text,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_hilbert_shards": op10_hilbert_shards,
        "op11_tiered_index": op11_tiered_index,
        "op12_dimension_scan": op12_dimension_scan,
        "op13_phrase_bitmaps": op13_phrase_bitmaps,
    }


def _canonical_sql(text: str) -> str:
    line, between = (p.replace("'", "''") for p in (licences.COPYRIGHT_LINE, licences.BETWEEN))
    out = f"' ' || regexp_replace(translate(regexp_replace({text}, '{line}', '', 'g'), '{licences.UPPER}', '{licences.LOWER}'), '{between}', '  ', 'g') || ' '"
    for old, new in licences.SPELLINGS.items():
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _op1_sql() -> str:
    values = lambda rows: ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)
    notices = [(i, t) for i, ts in licences.NOTICES.items() for t in ts]
    return f"""
    WITH known AS (SELECT d, min(i) AS license_id FROM (SELECT sha256({_canonical_sql("t")}) AS d, i FROM (VALUES {values(licences.LICENCES.items())}) k(i, t) UNION ALL VALUES {values(licences.DIGESTS.items())}) GROUP BY 1),
    notices AS (SELECT {_canonical_sql("t")} AS k, min(i) AS v FROM (VALUES {values(notices)}) n(i, t) GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
    hits AS (SELECT r, string_agg(DISTINCT v, ',' ORDER BY v) AS ids FROM lines JOIN notices ON {_canonical_sql("line")} = k
             WHERE regexp_matches(line, '(?i)licen[sc]e|public domain') GROUP BY r)
    SELECT doc_id, license_id, coalesce(ids, '') AS notice_ids, sha256({_canonical_sql("text")}) AS canonical_sha256
    FROM docs LEFT JOIN known ON d = sha256({_canonical_sql("text")}) LEFT JOIN hits USING (r)
    """


def oracle_sql() -> dict[str, str]:
    return {"op1_license_digests": _op1_sql(), "op2_streaming_dedup": OP2_SQL, "op5_partenum_jaccard": OP5_SQL, "op11_tiered_index": OP11_SQL, "op13_phrase_bitmaps": OP13_SQL}
