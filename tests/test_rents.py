"""Rows of rent tables against a plain loop, and on texts as notices have them."""

import random
import re

import pytest

from hearthline.functions import rents


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    out = {}
    for r in sorted(rents.rent_rows(df, "id", "body").collect(), key=lambda r: (r["id"], r["line"])):
        out.setdefault(r["id"], []).append((r["type"], r["tier"], r["deposit"], r["contract"], r["rent"]))
    return [out.get(i, []) for i in range(len(texts))]


def loop(numbers, type_at, tier_at):
    """The same by a loop over numbers; type_at and tier_at: what holds at a number."""
    out, i, kept = [], 0, None
    fits = lambda a, b, r: 1_000_000 <= a <= 500_000_000 and 10_000 <= r <= 3_000_000 and b < a
    fours = [i + 3 < len(numbers) and numbers[i] == numbers[i + 1] + numbers[i + 2] and min(numbers[i + 1 : i + 3]) > 0 and fits(numbers[i], numbers[i + 1], numbers[i + 3]) for i in range(len(numbers))]
    last = [None] * len(numbers)
    for i in range(1, len(numbers)):
        last[i] = numbers[i] if fours[i - 1] else last[i - 1]
    i = 0
    while i < len(numbers):
        row = None
        if fours[i]:
            row, used = (numbers[i], numbers[i + 1], numbers[i + 3]), 4
        elif last[i] is not None and i + 2 < len(numbers) and numbers[i + 1] > 0 and numbers[i] == numbers[i + 1] + last[i] and fits(numbers[i], last[i], numbers[i + 2]):
            row, used = (numbers[i], last[i], numbers[i + 2]), 3
        if row and type_at[i]:
            found = (type_at[i], tier_at[i], *row)
            if found not in out:
                out.append(found)
            i += used
        else:
            i += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_long_streams_against_a_loop(spark, seed):
    rnd, words, numbers, type_at, tier_at, kind, tier = random.Random(seed), [], [], [], [], None, None
    while len(numbers) < 12_000:
        if rnd.random() < 0.2:
            kind = rnd.choice(["26", "36A", "59.98B"])
            words.append(kind)
        if rnd.random() < 0.2:
            tier = rnd.choice(["고령자", "대학생", "청년(소득 있음)"])
            words.append(tier)
        b, c = rnd.randrange(1, 9) * 500_000, rnd.randrange(1, 9) * 500_000
        new = rnd.choice([[b + c, b, c, rnd.randrange(10_000, 400_000)], [b + c, b, c], [b], [b + c, c, 55_000], [b + c, b, c, c - b if c > b else c, 77_000, 66_000]])
        for x in new:
            words.append(f"{x:,}")
            numbers.append(x)
            type_at.append(kind)
            tier_at.append(tier)
    assert read(spark, [" ".join(words)])[0] == loop(numbers, type_at, tier_at)


def test_texts_of_notices(spark):
    table = "공급형별 임대보증금(원) 계약금 잔금 월임대료 26A 청년(소득 있음) 20,000,000 1,000,000 19,000,000 101,000 (+) 10,000,000 30,000,000 60,000 청년(소득없음) 18,000,000 1,000,000 17,000,000 95,000"
    merged = "59 고령자 12,000,000 600,000 11,400,000 80,000 신혼부부 13,000,000 12,400,000 85,000 (-) 6,600,000 6,000,000 90,000"
    thousands = "(단위: 천원) 49 가군 9,000 900 8,100 50,000"
    in_thousands = "단위 천원 49 가 군 9,500 1,500 8,000 50,000 나군 12,500 2,500 10,000 61,000"
    wrong = "36 대학생 10,000,000 1,000,000 9,000,001 50,000"
    dated = "2026.10.05 36 대학생 5% 10,000,000 500,000 9,500,000 50,000 36 대학생 10,000,000 500,000 9,500,000 50,000"
    got = read(spark, [table, merged, thousands, in_thousands, wrong, dated, "20,000,000 1,000,000 19,000,000 101,000", "", None, "없음"])
    assert got[0] == [("26A", "청년(소득 있음)", 20_000_000, 1_000_000, 101_000), ("26A", "청년(소득 없음)", 18_000_000, 1_000_000, 95_000)]
    assert got[1] == [("59", "고령자", 12_000_000, 600_000, 80_000), ("59", "신혼부부·한부모", 13_000_000, 600_000, 85_000)]
    assert got[2] == []  # 900 isn't an amount with a comma
    assert got[3] == [("49", "가군", 9_500_000, 1_500_000, 50_000), ("49", "나군", 12_500_000, 2_500_000, 61_000)]
    assert got[4] == [] and got[5] == [("36", "대학생", 10_000_000, 500_000, 50_000)] and got[6:] == [[], [], [], []]
    assert re.search(rents.TYPE, "59.98B")


def test_tables_are_dealt_over_tasks_by_their_rows(spark, monkeypatch):
    """More rows are more tasks, not larger ones."""
    from hearthline.operators import lineage
    from hearthline.plans import catalog

    sf, parts = "/root/testdata/sf0.001", {}
    want = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for rows in (1000, 100):
        monkeypatch.setattr(lineage, "ROWS", rows)
        plan = catalog.queries()["rent_tables"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan
        parts[rows] = lineage.dealt(spark.range(want), want, "id").rdd.getNumPartitions()
    assert parts[100] >= 9 * want / 1000 and parts[100] > parts[1000]
