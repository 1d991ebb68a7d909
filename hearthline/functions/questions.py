"""Questions in words read as constraints, and conversations as constraints that hold from turn to turn.

A question is cut into clauses. In each, an automaton finds all words of a gazetteer (places, lines, kinds of supply, marks of wish and refusal) in one pass; of overlapping ones the
one that begins first and is longest stays, and a place counts only where a word may begin and end. Numbers with their units are read beside them. What is found are tokens with spans, and a
constraint is made of a token, what compares it and how strongly it is meant, by the marks around it in its clause. So each constraint has a quote, and words that nothing is made of are left alone.

In a conversation a turn adds constraints, replaces those of their key, or drops a key. A constraint holds from its turn until a turn that replaces or drops its key, or begins anew: that is an
interval, which a window over a conversation's changes tells, whatever their number.

Constraint: struct(key, low, high, names, weight, start, stop, quote). Keys are those of operators.conditions; `cash` and `income` are what somebody says of themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSTRAINT = "struct<key: string, low: double, high: double, names: array<string>, weight: string, start: int, stop: int, quote: string>"

# Words of questions.
CLAUSE = re.compile(r"[!?\n·;]|(?<!\d)[,.]|[,.](?!\d)|그리고|그런데|하고 |이고 |인데 |은데 |는데 |이면서 |면서 |지만 ")
AMOUNT = re.compile(r"(\d+(?:\.\d+)?)\s?억(?:\s?(\d+(?:,\d{3})?)\s?(천\s?만?|만))?\s?(?:원)?|(\d+(?:,\d{3})*)\s?만\s?원?")
AREA = re.compile(r"(?:전용\s?)?(\d{2,3}(?:\.\d+)?)\s?(㎡|m2|제곱미터|타입|평)")
HOMES = re.compile(r"(\d{1,3}(?:,\d{3})+|\d{2,5})\s?세대")
MINUTES, PLACES = re.compile(r"(\d{1,3})\s?분"), re.compile(r"(\d{1,2})\s?(?:곳|개)")
AT_MOST, AT_LEAST, ABOUT = ("이하", "이내", "까지", "미만", "안쪽", "아래", "넘지"), ("이상", "부터", "초과", "넘는"), ("정도", "내외", "선에서", "안팎")
OWN = {"현금": "cash", "자금": "cash", "모은": "cash", "보유": "cash", "연봉": "income", "소득": "income"}
PARTICLES = ("에서", "에", "쪽", "권", "이나", "나", "이랑", "랑", "이", "가", "은", "는", "도", "만", "을", "를", "으로", "로", "과", "와", "하고", "근처", "말고", "빼고", "제외", "까지", "역")
MARKS = {
    "required": ("꼭", "반드시", "필수", "무조건", "절대", "여야"), "preferred": ("좋겠", "선호", "가능하면", "웬만하면", "되도록", "희망", "면 좋", "싶"),
    "explore": ("고려", "아니어도", "상관없", "괜찮", "근처", "주변", "인접"), "without": ("제외", "빼고", "말고", "싫"), "drop": ("빼줘", "빼 줘", "없애", "지워", "상관없어졌"), "add": ("추가", "도 봐", "도 넣"),
    "anew": ("처음부터", "새로 찾", "다시 찾"),
}
TOPICS = {"가격": ("price_max", "price_min", "price_range"), "예산": ("price_max", "price_min", "price_range"), "면적": ("area",), "평형": ("area",), "지역": ("region_in", "region_out"), "세대": ("households_min",), "역세권": ("station_walk",), "노선": ("line",)}
WORDS = {
    "국평": ("area", 75.0, 86.0), "국민평형": ("area", 75.0, 86.0), "소형": ("area", 0.0, 60.0), "대형": ("area", 85.0001, 400.0), "대단지": ("households_min", 1000.0, None), "나홀로": ("not_single", None, None),
    "역세권": ("station_walk", 10.0, None), "초품아": ("school_walk", 10.0, None), "초등학교": ("school_walk", 10.0, None), "무순위": ("supply", "remainder", None), "줍줍": ("supply", "remainder", None),
    "신혼희망타운": ("supply", "town", None), "공공분양": ("supply", "public", None), "민영": ("supply", "private", None), "임대": ("supply", "rental", None), "접수 중": ("status", "open", None), "접수 예정": ("status", "upcoming", None),
    "시세차익": ("margin", None, None), "로또": ("margin", None, None), "신축": ("new_build", None, None), "자격 되는": ("eligible_only", None, None),
}
SPECIAL = {"신혼부부": "newlywed", "생애최초": "first", "다자녀": "multichild", "노부모": "elder", "신생아": "newborn", "청년": "youth"}
DEFAULT = {"price_min": "preferred", "station_walk": "preferred", "school_walk": "preferred", "margin": "preferred", "new_build": "preferred"}
PYEONG = 3.3058 * 0.76  # square metres of use for a unit of supply, about


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any
    start: int
    stop: int


def gazetteer(places: dict[str, str], lines: list[str]):
    """An automaton over words. places: a written name and the region that it means. The size is that of the lists given."""
    import ahocorasick

    words = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, Any]]] = {}
    for kind, named in (("place", places.items()), ("line", ((x, x) for x in lines)), ("word", WORDS.items()), ("special", SPECIAL.items()), ("own", OWN.items()), ("topic", TOPICS.items())):
        for surface, value in named:
            entries.setdefault(surface, []).append((kind, value))
    for mark, surfaces in MARKS.items():
        for surface in surfaces:
            entries.setdefault(surface, []).append(("mark", mark))
    for surface, found in entries.items():
        words.add_word(surface, (surface, found))
    words.make_automaton()
    return words


_hangul = re.compile("[가-힣]")
_after = re.compile("|".join(sorted(PARTICLES, key=len, reverse=True)))


def _stands_alone(text: str, start: int, stop: int) -> bool:
    before = start == 0 or not _hangul.match(text[start - 1])
    after = stop == len(text) or not _hangul.match(text[stop]) or bool(_after.match(text, stop))
    return before and after


def found_words(words, text: str) -> list[Token]:
    """Tokens of the gazetteer: leftmost, longest, not overlapping. Marks may stand anywhere, also within what follows a place."""
    hits: list[Token] = []
    for end, (surface, kinds) in words.iter(text):
        start, stop = end - len(surface) + 1, end + 1
        hits += [Token(kind, value, start, stop) for kind, value in kinds if kind != "place" or _stands_alone(text, start, stop)]
    hits.sort(key=lambda t: (t.start, -t.stop))
    out, reach = [t for t in hits if t.kind == "mark"], 0
    for t in hits:
        if t.kind != "mark" and (t.start >= reach or (out and any(o.start == t.start and o.stop == t.stop and o.kind != t.kind for o in out))):
            out.append(t)
            reach = t.stop
    return sorted(out, key=lambda t: t.start)


def amount(m: re.Match) -> float:
    """Hundreds of millions of won."""
    number = lambda x: float(x.replace(",", ""))
    if m[4]:
        return round(number(m[4]) / 10_000, 6)
    return round(number(m[1]) + (0 if not m[2] else number(m[2]) / (10 if m[3].startswith("천") else 10_000)), 6)


def _compared(text: str, stop: int) -> str | None:
    rest = text[stop : stop + 8].lstrip(" 원의로")
    for name, ways in (("most", AT_MOST), ("least", AT_LEAST), ("about", ABOUT)):
        if rest.startswith(ways):
            return name
    return "range" if rest.startswith("대") and not rest.startswith("대출") else None


def clauses(text: str) -> Iterator[tuple[int, str]]:
    start = 0
    for m in CLAUSE.finditer(text):
        yield start, text[start : m.start()]
        start = m.end()
    yield start, text[start:]


def _numbers(clause: str, tokens: list[Token]) -> Iterator[tuple[str, float | None, float | None, int, int, str | None]]:
    """(key, low, high, start, stop, weight) of the numbers with units."""
    said = lambda kind, stop: next((t for t in reversed(tokens) if t.kind == kind and t.stop <= stop and stop - t.stop <= 12), None)
    amounts = list(AMOUNT.finditer(clause))
    skip = set()
    for i, m in enumerate(amounts):
        if i in skip:
            continue
        v, own = amount(m), said("own", m.start())
        budget = said("topic", m.start())
        if own and not (budget and budget.start > own.start):
            yield own.value, v, None, m.start(), m.end(), "assumed"
            continue
        following = amounts[i + 1] if i + 1 < len(amounts) else None
        if following and re.fullmatch(r"\s?[~∼\-]\s?|\s?에서\s?|\s?부터\s?", clause[m.end() : following.start()]) and v < amount(following):
            skip.add(i + 1)
            yield "price_max", amount(following), None, m.start(), following.end(), "required"
            continue
        way = _compared(clause, m.end())
        if way == "range":
            yield "price_range", v, v + 1, m.start(), m.end(), None
        elif way == "least":
            yield "price_min", v, None, m.start(), m.end(), None
        elif way or (budget and budget.value[0] == "price_max"):
            yield "price_max", v, None, m.start(), m.end(), "preferred" if way == "about" else None
    sizes = list(AREA.finditer(clause))
    between = re.search(r"(\d{2,3})\s?(?:㎡|타입|평)?\s?[~∼\-]\s?(\d{2,3})\s?(㎡|m2|타입|평)", clause)
    if between and float(between[1]) < float(between[2]):
        unit, slack = (PYEONG, 6) if between[3] == "평" else (1, 3)
        low, high = float(between[1]) * unit - slack, float(between[2]) * unit + slack
        yield "area", round(low, 2), round(high, 2), between.start(), between.end(), None
    elif sizes:
        m = sizes[0]
        a, way = float(m[1]) * (PYEONG if m[2] == "평" else 1), _compared(clause, m.end())
        slack = 6 if m[2] == "평" else 3
        low, high = (a, 400.0) if way == "least" else (0.0, a + 0.99) if way == "most" else (a - slack, a + slack)
        if way == "range" and m[2] == "평":
            tens = float(m[1]) // 10 * 10
            low, high = tens * PYEONG, (tens + 10) * PYEONG
        yield "area", round(low, 2), round(high, 2), m.start(), m.end(), None
    for m in HOMES.finditer(clause):
        if _compared(clause, m.end()) == "least":
            yield "households_min", float(m[1].replace(",", "")), None, m.start(), m.end(), None


def _weight(key: str, clause: str, start: int, stop: int, tokens: list[Token]) -> str:
    """By the marks near a token, else by its key."""
    near = [t.value for t in tokens if t.kind == "mark" and start - 6 <= t.start <= stop + 14]
    return next((w for w in ("required", "explore", "preferred") if w in near), DEFAULT.get(key, "required"))


def parse(words, text: str | None) -> dict[str, Any]:
    """constraints, drops (keys), anew and add of a question, and how many answers it asks for."""
    text = re.sub(r"\s", " ", text or "")
    out: list[dict[str, Any]] = []
    drops: list[str] = []
    anew = add = False
    for offset, clause in clauses(text):
        tokens = found_words(words, clause)
        marks = {t.value for t in tokens if t.kind == "mark"}
        anew, add = anew or "anew" in marks, add or "add" in marks
        if "drop" in marks:
            dropped = [k for t in tokens if t.kind == "topic" for k in t.value] + [t.value[0] for t in tokens if t.kind == "word"]
            if dropped:
                drops += [k for k in dropped if k not in drops]
                continue

        def put(key, low, high, names, start, stop, weight=None, clause=clause, tokens=tokens, offset=offset):
            weight = weight or _weight(key, clause, start, stop, tokens)
            out.append({"key": key, "low": low, "high": high, "names": names, "weight": weight, "start": offset + start, "stop": offset + stop, "quote": clause[start:stop]})

        numbers = list(_numbers(clause, tokens))
        for key, low, high, start, stop, weight in numbers:
            put(key, low, high, None, start, stop, weight)
        without = [t for t in tokens if t.kind == "mark" and t.value == "without"]
        places = [t for t in tokens if t.kind == "place"]
        for key, group in (("region_out", [p for p in places if any(0 <= w.start - p.stop for w in without)]), ("region_in", [p for p in places if not any(0 <= w.start - p.stop for w in without)])):
            if group:
                put(key, None, None, list(dict.fromkeys(p.value for p in group)), group[0].start, group[-1].stop, "required" if key == "region_out" else None)
        minutes = MINUTES.search(clause)
        has_line = any(t.kind == "line" for t in tokens)
        for t in tokens:
            if t.kind == "line":
                put("line", None, None, [t.value], t.start, t.stop)
            elif t.kind == "special" and re.match(r"\s?(특공|특별공급|으로|자격|전형)", clause[t.stop :]):
                put("supply", None, None, [f"sp:{t.value}"], t.start, t.stop, "preferred")
            elif t.kind == "word":
                key, a, b = t.value
                if key == "station_walk" and has_line or any(n[0] == key for n in numbers):
                    continue
                if key in ("station_walk", "school_walk") and minutes:
                    a = float(minutes[1])
                put(key, a if isinstance(a, float) else None, b, [a] if isinstance(a, str) else None, t.start, t.stop, "required" if key == "not_single" else None)
    wanted = PLACES.search(text)
    return {"constraints": out, "drops": drops, "anew": anew, "add": add, "wanted": min(10, int(wanted[1])) if wanted else None}


PARSED = f"constraints array<{CONSTRAINT}>, drops array<string>, anew boolean, add boolean, wanted int"


def read_questions(turns: DataFrame, text: str, places: dict[str, str], lines: list[str]) -> DataFrame:
    """turns with constraints, drops, anew, add and wanted of the question in the column text."""
    members = [("key", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("names", pa.list_(pa.string())), ("weight", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("quote", pa.string())]
    kinds = [("constraints", pa.list_(pa.struct(members))), ("drops", pa.list_(pa.string())), ("anew", pa.bool_()), ("add", pa.bool_()), ("wanted", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = gazetteer(places, lines)
        for batch in batches:
            found = [parse(words, x) for x in batch.column(text).to_pylist()]
            columns = [pa.array([f[n] for f in found], t) for n, t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _ in kinds)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    return turns.mapInArrow(run, f"{schema}, {PARSED}")


def conversation_state(parsed: DataFrame, conversation: str, turn: str) -> DataFrame:
    """conversation, turn, constraints: what holds after each turn, ordered by key and by when it was said.

    Constraints of a turn that adds join those of their key; else they take their place, all at once. One price is another's end, whatever kind it is.
    """
    family = lambda k: F.when(k.startswith("price_"), "price").otherwise(k)
    c = F.col
    base = parsed.select(c(conversation).alias("__c"), c(turn).alias("__t"), "constraints", "drops", "anew", "add")
    sets = base.select("__c", "__t", F.explode("constraints").alias("x"), "add").withColumn("family", family(c("x.key"))).withColumn("ends", ~(c("add") & c("x.key").isin("region_in", "region_out", "line", "supply")))
    drops = base.select("__c", "__t", F.explode("drops").alias("k")).select("__c", "__t", family(c("k")).alias("family"), F.lit(None).cast(CONSTRAINT).alias("x"), F.lit(True).alias("ends"))
    changes = sets.select("__c", "__t", "family", "x", "ends").unionAll(drops)
    later = Window.partitionBy("__c", "family").orderBy("__t").rangeBetween(1, Window.unboundedFollowing)
    anew = base.where("anew").groupBy("__c").agg(F.array_sort(F.collect_list("__t")).alias("anews"))
    held = changes.withColumn("until", F.min(F.when(c("ends"), c("__t"))).over(later)).where("x is not null").join(anew, "__c", "left")
    held = held.withColumn("until", F.least("until", F.array_min(F.filter("anews", lambda a: a > c("__t")))))
    # a row for each turn at which a constraint begins or ends, with all that hold then
    turns = base.select("__c", "__t")
    said = held.select(c("__c").alias("c2"), c("__t").alias("since"), "until", "x")
    holding = turns.join(said, (c("__c") == c("c2")) & (c("since") <= c("__t")) & (c("until").isNull() | (c("until") > c("__t"))), "left")
    at = F.when(c("x").isNotNull(), F.struct(c("x.key").alias("key"), c("since").alias("since"), c("x.start").alias("start"), c("x").alias("x")))
    grouped = holding.groupBy("__c", "__t").agg(F.transform(F.array_sort(F.collect_list(at)), lambda a: a["x"]).alias("constraints"))
    return grouped.select(c("__c").alias(conversation), c("__t").alias(turn), "constraints")


def search_terms(constraints: list[Any], regions: dict[str, dict[str, Any]], lines: dict[str, list[tuple[float, float]]], metres: float = 1000.0) -> tuple[list[tuple[str, Any]], list[tuple[str, Any]]]:
    """(required, preferred) as operators.conditions.search takes them, of one conversation's constraints. regions and lines: what names mean."""
    required, preferred = [], []
    for x in constraints:
        key, names = x["key"], x["names"] or []
        if key in ("region_in", "region_out"):
            value: Any = [regions[n] for n in names if n in regions]
        elif key == "line":
            value = (names[0], lines.get(names[0], []), metres)
        elif key in ("area", "price_range"):
            value = (x["low"], x["high"])
        elif key == "supply":
            value = names[0]
        elif key == "status":
            value = names
        else:
            value = x["low"]
        if x["weight"] == "required":
            required.append((key, value))
        elif x["weight"] == "preferred":
            preferred.append((key, value))
    return required, preferred
