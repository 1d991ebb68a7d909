"""Merges of several readings against a walk over dictionaries, for several schemas."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthline.operators import readings

TOOLS = ["one", "two", "three"]
SCHEMAS = [
    "struct<basis: string, price: long, phrase: boolean, known: boolean, words: array<string>, local: struct<city: string, months: int>, tiers: array<struct<key: string, pct: int, asset: long>>>",
    "struct<a: struct<b: struct<c: int, phrase: boolean>, d: array<int>>, tiers: array<struct<key: int, x: string>>>",
]


def vote(values):
    known = [v for v in values if v is not None]
    counts = Counter(map(str, known))
    if len(counts) <= 1:
        return (known[0] if known else None), ("filled" if known and len(known) < len(values) else "agreed")
    (top, n), (_, m) = counts.most_common(2)
    return (next(v for v in known if str(v) == top), "majority") if n >= 2 and n > m else (None, "conflict")


def walk(values, kind, path, log):
    name = path.rsplit(".", 1)[-1]
    simple = kind.simpleString()
    if simple.startswith("struct"):
        return {f.name: walk([None if v is None else v[f.name] for v in values], f.dataType, f"{path}.{f.name}" if path else f.name, log) for f in kind.fields}
    known = [v for v in values if v is not None]
    if simple.startswith("array<struct"):
        out = []
        for k in dict.fromkeys(e["key"] for v in known for e in v):
            value, how = vote([next((e for e in v or [] if e["key"] == k), None) for v in values])
            if how != "agreed":
                log.append((f"{path}[{k}]", how))
            if value is not None:
                out.append(value)
        return out if known else None
    if simple.startswith("array"):
        if len(set(map(str, known))) > 1:
            log.append((path, "union"))
        return list(dict.fromkeys(x for v in known for x in v)) if known else None
    if name == "phrase":
        if any(values) and not all(values):
            log.append((path, "either"))
        return True if any(values) else False if known else None
    value, how = vote(values)
    if how != "agreed":
        log.append((path, how))
    return value


def made(rnd, kind):
    simple = kind.simpleString()
    if simple.startswith("struct"):
        return {f.name: made(rnd, f.dataType) for f in kind.fields}
    if rnd.random() < 0.25:
        return None
    if simple.startswith("array<struct"):
        return [{f.name: k if f.name == "key" else made(rnd, f.dataType) for f in kind.elementType.fields} for k in (([1, 2, 3] if "key:int" in simple else ["y", "e", "w"])[: rnd.randrange(0, 4)])]
    if simple.startswith("array"):
        return [made_leaf(rnd, kind.elementType.simpleString()) for _ in range(rnd.randrange(0, 3))]
    return made_leaf(rnd, simple)


def made_leaf(rnd, simple):
    return rnd.choice({"string": ["u", "m"], "boolean": [True, False]}.get(simple, [1, 2, 3]))


def plain(x):
    return {k: plain(v) for k, v in x.asDict().items()} if hasattr(x, "asDict") else [plain(v) for v in x] if isinstance(x, list) else x


@pytest.mark.parametrize("schema", SCHEMAS)
def test_any_schema(spark, schema):
    kind = spark.createDataFrame([], f"t {schema}").schema["t"].dataType
    rnd, rows, want = random.Random(7), [], {}
    for i in range(120):
        base = made(rnd, kind)
        read = {t: (base if rnd.random() < 0.5 else made(rnd, kind)) for t in TOOLS if rnd.random() < 0.9}
        rows += [(i, t, x) for t, x in read.items()]
        if read:
            log = []
            want[i] = (walk([read.get(t) for t in TOOLS], kind, "", log), sorted(log))
    df = spark.createDataFrame(rows, f"id int, tool string, terms {schema}").repartition(3)
    got = {r.id: (plain(r.terms), sorted((x.path, x.how) for x in r.log)) for r in readings.merge(df, "id", "tool", "terms", TOOLS, either=("phrase",), keys={"tiers": "key"}).collect()}
    assert got == want


def test_a_second_rendition_fills_and_is_compared(spark):
    schema = "struct<a: int, b: struct<c: string, d: int>>"
    rows = [({"a": None, "b": {"c": "x", "d": None}}, {"a": 1, "b": {"c": "y", "d": 2}}), ({"a": 3, "b": {"c": None, "d": 4}}, {"a": 3, "b": None})]
    df = spark.createDataFrame(rows, f"one {schema}, two {schema}")
    kind = df.schema["one"].dataType
    out = df.select(readings.filled(F.col("one"), F.col("two"), kind).alias("f"), readings.differing(F.col("one"), F.col("two"), kind).alias("d")).collect()
    assert [plain(r.f) for r in out] == [{"a": 1, "b": {"c": "x", "d": 2}}, {"a": 3, "b": {"c": None, "d": 4}}] and [r.d for r in out] == [["b.c"], []]
