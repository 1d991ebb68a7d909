"""Text functions: normalisation, money and dates, redaction, links, chunks, retrieval scores and intents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is redacted, in this order, by what it is called; a run of digits has no ASCII letter or digit beside it.
REDACTIONS = (
    ("주민등록번호", r"(?<![A-Za-z0-9_])\d{6}\s*-\s*[1-8]\d{6}(?![A-Za-z0-9_])"),
    ("전화번호", r"(?<![A-Za-z0-9_])01[016789][\s-]?\d{3,4}[\s-]?\d{4}(?![A-Za-z0-9_])"),
    ("전화번호", r"(?<![A-Za-z0-9_])0\d{1,2}-\d{3,4}-\d{4}(?![A-Za-z0-9_])"),
    ("이메일", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("동·호수", r"\d{1,4}\s*동\s*\d{1,4}\s*호"),
    ("계좌번호", r"(?<![A-Za-z0-9_])(?!(?:19|20)\d{2}-\d{1,2}-\d{1,2}(?![A-Za-z0-9_]))\d{2,6}-\d{2,6}-\d{2,8}(?:-\d{1,4})?(?![A-Za-z0-9_])"),
)
HIDDEN = "[{} 가림]"
HREF = r"""href\s*=\s*["']([^"'#]+)["']"""


def squeeze(text: Column) -> Column:
    """Runs of white space, of any script, as one space."""
    return F.trim(F.regexp_replace(F.translate(text, "\u0000", " "), r"(?U)\s+", " "))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def redact(text: Column, rules=REDACTIONS, hidden: str = HIDDEN) -> Column:
    """struct(text, kinds): personal data replaced by its kind's name, and the kinds found. Every rule runs once over the text."""

    def step(i: int, t: Column, kinds: list[Column]) -> Column:
        if i == len(rules):
            return F.struct(t.alias("text"), F.array_distinct(F.array_compact(F.array(*kinds))).alias("kinds"))
        kind, pattern = rules[i]
        return let(F.regexp_replace(t, pattern, hidden.format(kind)), lambda out: step(i + 1, out, [*kinds, F.when(out != t, kind)]))

    return let(F.coalesce(text, F.lit("")), lambda t: step(0, t, []))


def number(text: Column) -> Column:
    """A number with thousands separators; null for dashes, marks and blanks."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def money(text: Column) -> Column:
    """Amounts such as 15억5천, 8000만 and 7.5억 in 100 million won."""
    part = lambda p: F.regexp_extract(text, p, 1)
    big, thousand, small = part(r"([\d.]+)\s*억"), part(r"억\s*([\d.]+)\s*천"), part(r"([\d.,]+)\s*만")
    value = lambda s: F.when(s != "", F.regexp_replace(s, ",", "").try_cast("double"))
    found = (big != "") | (small != "")
    return F.when(found, F.coalesce(value(big), F.lit(0.0)) + F.coalesce(value(thousand), F.lit(0.0)) / 10 + F.coalesce(value(small), F.lit(0.0)) / 10_000)


def date_of(text: Column) -> Column:
    """Dates written with dashes, dots, slashes or nothing between; null for others."""
    digits = F.regexp_replace(F.trim(text), r"[./]", "-")
    return F.coalesce(F.try_to_date(digits, "yyyy-M-d"), F.try_to_date(digits, "yyyyMMdd"))


def content_id(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def links(html: Column) -> Column:
    """Different link targets in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)))


def last_consonant(word: Column) -> Column:
    """Whether a word ends in a syllable with a final consonant; null where its last character is no Hangul syllable."""
    point = F.ascii(F.right(word, F.lit(1)))
    return F.when(point.between(0xAC00, 0xD7A3), (point - 0xAC00) % 28 > 0)


def with_particle(word: Column, after_consonant: str, otherwise: str) -> Column:
    return F.concat(word, F.when(F.coalesce(last_consonant(word), F.lit(False)), after_consonant).otherwise(otherwise))


def keyword_score(text: Column, heading: Column, terms: dict[str, float]) -> Column:
    """The sum over terms of weight times occurrences (four at most), and three weights more where the heading has it."""
    total = F.lit(0.0)
    for term, weight in terms.items():
        n = (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)
        total = total + F.when(n > 0, weight * F.least(n, F.lit(4)) + F.when(F.contains(heading, F.lit(term)), 3 * weight).otherwise(0)).otherwise(0)
    return total


def intent(question: Column, rules: list[tuple[str, str, str | None]], otherwise: str) -> Column:
    """The first intent whose pattern the question has and whose exception it hasn't."""
    out = F.lit(otherwise)
    for name, pattern, unless in reversed(rules):
        hit = question.rlike(pattern) if unless is None else question.rlike(pattern) & ~question.rlike(unless)
        out = F.when(hit, name).otherwise(out)
    return out


def chunks(docs: DataFrame, key: str, text: str, size: int = 800) -> DataFrame:
    """key, pos, t: paragraphs packed in order into chunks of at most size characters; a longer paragraph is cut.

    A fold over one text's paragraphs, so every text is one expression and nothing is shuffled.
    """
    pieces = F.flatten(F.transform(
        F.filter(F.split(text, r"\n+"), lambda p: F.trim(p) != ""),
        lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(F.trim(p)) - 1) / size).cast("int")), lambda i: F.substr(F.trim(p), i * size + 1, F.lit(size))),
    ))

    def pack(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(F.try_element_at(done, F.lit(-1))) + 1 + F.length(piece) <= size)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws("\n", F.try_element_at(done, F.lit(-1)), piece)))).otherwise(F.concat(done, F.array(piece)))

    packed = F.aggregate(pieces, F.array().cast("array<string>"), pack)
    return docs.select(key, F.posexplode(packed).alias("pos", "t"))


def budgeted_pick(scored: DataFrame, group: str, most: int = 5, chars: int = 4500) -> DataFrame:
    """Of each group (a question) the best chunks by score, then position, skipping one that would exceed the budget; group, pos, t, score.

    A group is one question's matching chunks of one notice, so that it is bounded by the notice's length.
    Skip-and-continue is no prefix sum, so the greedy choice itself is a small pandas step per group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], 0
        for i, t in zip(pdf.index, pdf["t"], strict=True):
            if len(out) < most and used + len(t) <= chars:
                out.append(i)
                used += len(t)
        return pdf.loc[out]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return choose(pdf.sort_values(["score", "pos"], ascending=[False, True], kind="stable")).sort_values("pos")

    rows = scored.where("score > 0").select(group, "pos", "t", "score")
    return rows.groupBy(group).applyInPandas(run, rows.schema)


def documents_text(files: DataFrame) -> DataFrame:
    """path, text of zipped XML documents (HWPX) read with the binaryFile source; null where a file can't be read."""
    import io
    import re
    import zipfile

    def text_of(content: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = sorted(n for n in z.namelist() if re.search(r"section\d+\.xml$", n))
                sections = [z.read(n).decode("utf-8", "replace") for n in names]
        except (zipfile.BadZipFile, KeyError):
            return None
        paragraphs = [re.sub(r"<[^>]*>", "", p) for s in sections for p in re.findall(r"<\w*:?p[ >].*?</\w*:?p>", s, re.S)]
        return "\n".join(p for p in paragraphs if p.strip())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [text_of(c) for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


# --- notices' chunks, excerpts and quotes ------------------------------------------------------------------------------------------

# Lines that head a part of a notice, and page numbers.
HEADING = r"^\s*(?:[■□◆◇●○▶▣※]|\d{1,2}\s*[.)]|[가-하]\s*[.)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\s*[.)]?)"
PAGE_NUMBER = r"^-\s*\d+\s*-$"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&amp;": "&"}


def notice_chunks(docs: DataFrame, key: str, text: str, size: int = 800) -> DataFrame:
    """key, pos, h, t: whole lines packed into chunks of about size characters, each with the last heading before its first line; no page numbers.

    A line longer than size is a chunk of its own. A fold over one text's lines, so every text is one expression and nothing is shuffled.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER))
    none = F.array().cast("array<string>")
    start = F.struct(
        F.array().cast("array<struct<h:string,t:string>>").alias("done"), none.alias("lines"), F.lit(0).alias("n"), F.lit("").alias("head"), F.lit("").alias("h"),
    )
    closed = lambda s: F.concat(s["done"], F.array(F.struct(s["h"].alias("h"), F.array_join(s["lines"], "\n").alias("t"))))

    def step(s: Column, x: Column) -> Column:
        head = F.when(x.rlike(HEADING) & (F.length(x) < 60), x).otherwise(s["head"])
        full, empty = (s["n"] + F.length(x) > size) & (F.size(s["lines"]) > 0), F.size(s["lines"]) == 0
        return F.struct(
            F.when(full, closed(s)).otherwise(s["done"]).alias("done"), F.when(full, F.array(x)).otherwise(F.concat(s["lines"], F.array(x))).alias("lines"),
            F.when(full, F.length(x)).otherwise(s["n"] + F.length(x)).alias("n"), head.alias("head"), F.when(full | empty, head).otherwise(s["h"]).alias("h"),
        )

    packed = F.aggregate(lines, start, step, lambda s: F.when(F.size(s["lines"]) > 0, closed(s)).otherwise(s["done"]))
    return docs.select(key, F.posexplode(packed).alias("pos", "c")).select(key, "pos", "c.h", "c.t")


def plain_html(html: Column) -> Column:
    """Text of a piece of HTML: no tags, common references decoded, single spaces."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def without_keys(message: Column, most: int = 200) -> Column:
    """An error's text without the service key in its address."""
    return F.substring(F.regexp_replace(message, r"(serviceKey=)[^&\s']+", "$1***"), 1, most)


def snippets(text: Column, word: str, n: int = 2, before: int = 20, width: int = 90) -> Column:
    """The first n pieces of a text around a word, white space as one space."""

    def of(t: Column) -> Column:
        parts = F.split(t, re.escape(word), -1)
        # where each occurrence starts: the lengths of all parts and words before it
        ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.size(parts) - 1)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * len(word))
        at = lambda i: F.greatest(F.lit(0), i - before)
        return F.when(F.size(parts) > 1, F.transform(ends, lambda i: F.trim(F.substr(t, at(i) + 1, i + width - at(i))))).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), of)


def excerpt(text: Column, pattern: str, head: int = 12_000, around: int = 700, most: int = 45_000) -> Column:
    """A long text's start and the windows around a pattern's matches, merged where they overlap, until they would exceed most characters; shorter texts whole.

    Pieces are joined by a line of dots, so that a quote never runs over two of them.
    """

    def of(t: Column) -> Column:
        parts, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        start = F.struct(F.lit(0).alias("at"), F.array(F.struct(F.lit(0).alias("a"), F.lit(head).alias("b"))).alias("w"))

        def step(s: Column, i: Column) -> Column:
            at = s["at"] + F.length(F.get(parts, i))
            end = at + F.length(F.get(found, i))
            a, b, last = F.greatest(F.lit(0), at - around), F.least(F.length(t), end + around), F.element_at(s["w"], -1)
            joined = F.concat(F.slice(s["w"], F.lit(1), F.size(s["w"]) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))
            return F.struct(end.alias("at"), F.when(a <= last["b"], joined).otherwise(F.concat(s["w"], F.array(F.struct(a.alias("a"), b.alias("b"))))).alias("w"))

        windows = F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["w"])).otherwise(start["w"])
        first = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

        def take(s: Column, w: Column) -> Column:
            n = w["b"] - w["a"]
            full = s["full"] | (s["n"] + n > most)
            return F.struct(F.when(full, s["n"]).otherwise(s["n"] + n).alias("n"), full.alias("full"), F.when(full, s["out"]).otherwise(F.concat(s["out"], F.array(F.substr(t, w["a"] + 1, n)))).alias("out"))

        return F.when(F.length(t) <= most, t).otherwise(F.array_join(F.aggregate(windows, first, take, lambda s: s["out"]), "\n…\n"))

    return let(text, of)


def attachment(url: Column) -> Column:
    """What of an attachment's address says which file it is: struct(house, file, number); null without a file."""
    part = lambda name: F.nullif(F.regexp_extract(url, rf"(?<![A-Za-z]){name}=([^&]+)", 1), F.lit(""))
    return F.when(part("atchmnflSeqNo").isNotNull(), F.struct(part("houseManageNo").alias("house"), part("atchmnflSeqNo").alias("file"), part("atchmnflSn").alias("number")))


def year_month(text: Column) -> Column:
    """yyyy-MM of a month written with or without marks, or of a whole date."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 6, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2)))


def stale(updated: Column, now: Column, limit: float) -> Column:
    """struct(hours, stale): a snapshot's age with one decimal; an unknown time is stale."""
    hours = F.round((F.unix_timestamp(now) - F.unix_timestamp(updated)) / 3600, 1)
    return F.struct(hours.alias("hours"), F.coalesce(hours > limit, F.lit(True)).alias("stale"))


def walking_minutes(metres: Column) -> Column:
    """Minutes on foot, a third more than the straight way at 67 metres a minute; one at least, halves to the even number."""
    return F.greatest(F.lit(1), F.bround(metres * 1.3 / 67, 0).cast("int"))


def loosened(pattern: str) -> str:
    """A pattern that also matches where white space stands inside runs of three or more Hangul syllables, or is missing where the pattern has a space.

    Classes, escapes, look-behinds and repeated characters stay as they are.
    """
    pieces = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?<[=!]|.(?=[?*+]|\{\d*,?\d*\})|\{\d*,?\d*\}|[가-힣]|.", pattern, re.S)
    out, run, depth, fixed = [], [], 0, []

    def close() -> None:
        out.append((r"\s?" if len(run) > 2 else "").join(run))
        run.clear()

    for i, piece in enumerate(pieces):
        repeated = i + 1 < len(pieces) and re.fullmatch(r"[?*+]|\{\d*,?\d*\}", pieces[i + 1]) is not None
        free = not fixed and not repeated
        if free and re.fullmatch("[가-힣]", piece):
            run.append(piece)
            continue
        close()
        if piece.startswith("("):
            depth += 1
            if piece.startswith("(?<"):
                fixed.append(depth)
        elif piece == ")":
            if fixed and fixed[-1] == depth:
                fixed.pop()
            depth -= 1
        out.append(r"\s?" if free and piece == " " else piece)
    close()
    return "".join(out)


# What questions are widened by, and words and endings that say nothing.
SYNONYMS = (
    (r"서류|준비물|제출|구비", ("서류", "제출", "증명서", "등본", "확인서", "구비서류", "발급")), (r"일정|언제|접수|발표|계약일|기간", ("일정", "접수", "발표", "계약", "기간")),
    (r"계약금|중도금|잔금|납부|대출", ("계약금", "중도금", "잔금", "납부", "대출")), (r"1순위|순위", ("순위", "1순위", "제1순위", "2순위")),
    (r"가점|점수", ("가점", "무주택기간", "부양가족", "가입기간", "별표")), (r"특공|특별공급", ("특별공급",)), (r"신혼", ("신혼부부",)), (r"생애|생초", ("생애최초",)), (r"다자녀", ("다자녀",)),
    (r"노부모", ("노부모",)), (r"신생아|출산", ("신생아", "출산")), (r"재당첨|당첨\s*제한", ("재당첨", "당첨")), (r"무주택|집이?\s*있|주택\s*소유|유주택", ("무주택", "소유", "주택")),
    (r"통장|예치금|청약저축", ("주택청약종합저축", "예치", "가입", "청약통장")), (r"전매|팔", ("전매",)), (r"거주|실거주|전입", ("거주", "해당지역")), (r"세대주", ("세대주",)),
    (r"무순위|잔여|줍줍", ("무순위", "사후접수", "잔여")), (r"부적격", ("부적격",)), (r"추첨", ("추첨",)), (r"분양가|금액|가격", ("분양가", "공급금액")), (r"발코니|옵션", ("발코니", "선택품목")),
)
ENDINGS = r"(은|는|이|가|을|를|에|의|도|요|야|해|나요|인가요|이에요|예요)$"
EMPTY_WORDS = (
    "이거", "이건", "뭐야", "뭐예요", "알려줘", "알려주세요", "어떻게", "나는", "제가", "저는", "공고", "이번", "그럼", "근데", "해줘", "되나요", "돼요", "있나요", "있어", "필요한",
)


def query_terms(question: Column, own: int = 3, widened: int = 1) -> Column:
    """Map from term to weight: the question's own words without endings weigh more than those that it is widened by."""
    q = F.coalesce(question, F.lit(""))
    wide = F.flatten(F.array(*[F.when(q.rlike(p), F.lit(list(ws))).otherwise(F.array().cast("array<string>")) for p, ws in SYNONYMS]))
    words = F.transform(F.split(q, r"[\s?!.,·]+"), lambda w: F.regexp_replace(w, ENDINGS, ""))
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*EMPTY_WORDS)))

    def made(ws: Column) -> Column:
        others = F.array_except(wide, ws)
        entry = lambda n: lambda w: F.struct(w.alias("term"), F.lit(n).alias("weight"))
        return F.map_from_entries(F.concat(F.transform(others, entry(widened)), F.transform(ws, entry(own))))

    return let(words, made)


def score_by_terms(text: Column, heading: Column, terms: Column) -> Column:
    """keyword_score for a map of terms that is a column itself."""
    def one(e: Column) -> Column:
        n = (F.length(text) - F.length(F.replace(text, e["key"], F.lit("")))) / F.length(e["key"])
        return F.when(n > 0, e["value"] * F.least(n, F.lit(4)) + F.when(F.contains(heading, e["key"]), 3 * e["value"]).otherwise(0)).otherwise(0.0)

    return F.aggregate(F.map_entries(terms), F.lit(0.0), lambda a, e: a + one(e))


# Kinds of questions, the first that fits: its pattern, and a pattern that rules it out.
INTENTS = (
    ("out_of_scope", r"(사\s*(도|둬도)\s*(돼|될까|되나)|오를까|떨어질까|투자|매수|매도|팔아야|시세\s*전망|양도세|취득세\s*얼마|종부세|세금\s*얼마|대출\s*(한도|금리)\s*얼마|주식|코인)", None),
    ("docs", r"(서류|증빙|제출)", None),
    ("schedule", r"(언제|일정|마감|발표|접수일|계약일|잔금|입주)", r"(가능|되나|돼\?|될까)"),
    ("rule", r"(왜|기준이|기준은|뜻이|뭐야|무슨\s*뜻|어떻게\s*계산|조건이\s*뭐)", r"(나|내가|저|제가).{0,6}(가능|돼|될까|되나)"),
)
