"""Registered queries of questions: turns of conversations ask in words for what their keys say, and what holds after each turn is also SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import questions
from hearthline.plans.registry import cases, facts, query

_REGIONS = ["강남구", "송파구", "광명시", "성남시 분당구", "인천", "수원시"]
_SAID = ["강남", "송파구", "광명시", "분당", "인천", "수원"]
_LINES = ["2호선", "9호선", "신분당선"]
_ASKED = f"""SELECT conv_id, turn, (conv_id * 5 + turn * 3) % 8 AS form, {cases('(conv_id + turn)', _REGIONS)} AS region, {cases('(conv_id + turn)', _SAID)} AS said, 3 + (conv_id * 7 + turn) % 12 AS whole, 1 + (conv_id + turn * 5) % 9 AS tenths,
  30 + (conv_id * 11 + turn * 17) % 80 AS area, 300 + 100 * ((conv_id + turn) % 30) AS homes, text FROM (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY conv_id, turn) t"""


@query(f"""WITH f AS ({_ASKED}),
changes AS (SELECT conv_id, turn, 'region_in' AS family, 'region_in' AS key, NULL AS low, NULL AS high, region AS name, form = 0 AS ends FROM f WHERE form IN (0, 1)
  UNION ALL SELECT conv_id, turn, 'region_out', 'region_out', NULL, NULL, region, true FROM f WHERE form = 6
  UNION ALL SELECT conv_id, turn, 'price', CASE WHEN form = 4 THEN NULL ELSE 'price_max' END, CASE form WHEN 2 THEN whole * 10 + tenths WHEN 3 THEN whole * 10 END, NULL, NULL, true FROM f WHERE form IN (2, 3, 4)
  UNION ALL SELECT conv_id, turn, 'area', 'area', area * 10 - 30, area * 10 + 30, NULL, true FROM f WHERE form = 5 UNION ALL SELECT conv_id, turn, 'homes', 'households_min', homes * 10, NULL, NULL, true FROM f WHERE form = 5),
held AS (SELECT f.conv_id, f.turn, c.key, c.turn AS since, c.key || ':' || coalesce(CAST(low AS VARCHAR), '') || ':' || coalesce(CAST(high AS VARCHAR), '') || ':' || coalesce(name, '') AS x
  FROM f LEFT JOIN changes c ON c.conv_id = f.conv_id AND c.turn <= f.turn AND c.key IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM changes e WHERE e.conv_id = c.conv_id AND e.family = c.family AND e.ends AND e.turn > c.turn AND e.turn <= f.turn))
SELECT conv_id, turn, coalesce(string_agg(x, ' ' ORDER BY key, since), '') AS holds FROM held GROUP BY conv_id, turn""")
def conversation_constraints(spark, sf_dir):
    """What somebody asks for after each turn of a conversation, read out of its words."""
    f, c = facts(spark, sf_dir, _ASKED, "conversations"), F.col
    area, amount = c("area").cast("string"), c("whole").cast("string")
    forms = [
        F.concat("said", F.lit("에서 찾아줘")), F.concat("said", F.lit("도 추가로 봐줘")), F.concat(amount, F.lit("억 "), "tenths", F.lit("천만원 이하")), F.concat(F.lit("예산은 "), amount, F.lit("억으로 바꿔줘")), F.lit("가격 조건은 빼줘"),
        F.concat(F.lit("전용 "), area, F.lit("㎡ 안팎, "), F.format_number("homes", 0), F.lit("세대 이상이면 좋겠어")), F.concat("said", F.lit(" 빼고")), c("text"),
    ]
    asked = f.select("conv_id", "turn", F.coalesce(*[F.when(c("form") == i, x) for i, x in enumerate(forms)]).alias("asked"))
    read = questions.read_questions(asked, "asked", dict(zip(_SAID, _REGIONS, strict=True)), _LINES)
    tenfold = lambda x: F.coalesce(F.bround(x * 10).cast("long").cast("string"), F.lit(""))
    text = lambda x: F.concat(x["key"], F.lit(":"), tenfold(x["low"]), F.lit(":"), tenfold(x["high"]), F.lit(":"), F.coalesce(F.array_join(x["names"], "·"), F.lit("")))
    return questions.conversation_state(read, "conv_id", "turn").select("conv_id", "turn", F.array_join(F.transform("constraints", text), " ").alias("holds"))
