"""Text functions on literal rows and against plain loops."""

import random
import re

from pyspark.sql import functions as F

from hearthline.functions import extract, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def chunk_loop(t, size):
    lines = [re.sub(r"[ \t]+", " ", x).strip(" ") for x in (t or "").split("\n")]
    lines = [x for x in lines if x and not re.fullmatch(r"-\s*\d+\s*-", x)]
    out, cur, head, top = [], [], "", ""
    for x in lines:
        if re.match(text.HEADING, x) and len(x) < 60:
            head = x
        if cur and sum(map(len, cur)) + len(x) > size:
            out.append((top, "\n".join(cur)))
            cur = []
        if not cur:
            top = head
        cur.append(x)
    return out + ([(top, "\n".join(cur))] if cur else [])


def test_notice_chunks_against_a_loop(spark):
    rnd = random.Random(3)
    pieces = ["■ 공급", "1. 일정", "가. 대상", "- 3 -", "", " ", "x" * 30, "y z\t w", "w" * 130, "Ⅱ 자격", "● " + "긴 " * 40]
    rows = [(i, "\n".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 40)))) for i in range(60)] + [(99, None), (100, "")]
    out = text.notice_chunks(spark.createDataFrame(rows, "id int, body string"), "id", "body", 100).collect()
    for i, t in rows:
        assert [(r.h, r.t) for r in sorted((r for r in out if r.id == i), key=lambda r: r.pos)] == chunk_loop(t, 100), i


def test_excerpt_merges_windows(spark):
    t = "".join(f"{i:04d} " for i in range(400))
    got = one(spark, t, lambda c: text.excerpt(c, "0100|0104|0300", 20, 12, 200))
    a, b, d = t.index("0100"), t.index("0104"), t.index("0300")
    assert got == "\n…\n".join([t[:20], t[a - 12 : b + 16], t[d - 12 : d + 16]])
    assert one(spark, "short", lambda c: text.excerpt(c, "x", 2, 2, 10)) == "short"
    assert one(spark, t, lambda c: text.excerpt(c, "none", 20, 12, 200)) == t[:20]


def test_small_functions(spark):
    assert one(spark, "<p>a &amp; b</p>&nbsp;c", text.plain_html) == "a & b c"
    assert one(spark, "x?serviceKey=abc%3D&y=1 failed", text.without_keys) == "x?serviceKey=***&y=1 failed"
    assert one(spark, "a x b x c", lambda c: text.snippets(c, "x", 2, 2, 3)) == ["a x b", "b x c"]
    assert one(spark, "nothing", lambda c: text.snippets(c, "x")) == [] == one(spark, None, lambda c: text.snippets(c, "x"))
    assert [one(spark, v, text.year_month) for v in ("203005", "2030.05", "20300512", "20", None)] == ["2030-05", "2030-05", "2030-05", None, None]
    terms = one(spark, "계약금은 언제 내나요?", text.query_terms)
    assert terms["계약금"] == 3 and terms["중도금"] == 1 and terms["언제"] == 3 and "내" not in terms
    df = spark.createDataFrame([("a b a a a a", "a")], "t string, h string").withColumn("m", F.create_map(F.lit("a"), F.lit(2), F.lit("zz"), F.lit(9)))
    assert df.select(text.score_by_terms(F.col("t"), F.col("h"), F.col("m")).alias("s")).first().s == 2 * 4 + 3 * 2


def test_loosened_patterns():
    assert text.loosened("세대주 요건") == r"세\s?대\s?주\s?요건"
    assert text.loosened("[가나다]라마?바") == "[가나다]라마?바"
    assert text.loosened(r"(?<!일반공급)특별공급\d{1,2}세") == r"(?<!일반공급)특\s?별\s?공\s?급\d{1,2}세"
    assert re.search(text.loosened("전용면적 (?:이하|초과)"), "전 용면 적이하")


def test_answers_from_elsewhere_need_their_quote(spark):
    df = spark.createDataFrame([("3", "의무 3년", "실거주 의무\n3년 적용"), ("5", "의무 3년", "실거주 의무 3년"), ("3", "의무 4년", "실거주 의무 3년"), ("3", None, "3")], "v string, q string, t string")
    assert [r.ok for r in df.select(extract.verbatim(F.col("v"), F.col("q"), F.col("t")).alias("ok")).collect()] == [True, False, False, False]
