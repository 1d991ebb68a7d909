"""Questions against hand-marked ones, conversations against a loop, and a search with what was asked."""

import random

import pytest
from pyspark.sql import functions as F

from hearthline.functions import questions
from hearthline.operators import conditions

PLACES = {"서울": "서울", "강남구": "강남구", "강남": "강남구", "송파구": "송파구", "송파": "송파구", "분당": "성남시 분당구", "광명시": "광명시", "광명": "광명시", "수원": "수원시", "경기": "경기", "인천": "인천"}
LINES = ["2호선", "9호선", "신분당선", "분당선"]
#: A question and its slots: key, low, high, names, weight.
MARKED = [
    ("강남에서 15억 이하로 찾아줘", [("price_max", 15, None, None, "required"), ("region_in", None, None, ["강남구"], "required")]),
    ("송파나 강남 쪽, 예산은 9억 5천만원", [("region_in", None, None, ["송파구", "강남구"], "required"), ("price_max", 9.5, None, None, "required")]),
    ("광명시 빼고 서울에서 10억대", [("price_range", 10, 11, None, "required"), ("region_out", None, None, ["광명시"], "required"), ("region_in", None, None, ["서울"], "required")]),
    ("현금 3억 2,000만 있고 7억~9억 사이", [("cash", 3.2, None, None, "assumed"), ("price_max", 9, None, None, "required")]),
    ("전용 59㎡ 이상이면 좋겠어요", [("area", 59, 400, None, "preferred")]),
    ("전용 84㎡, 1,000세대 이상", [("area", 81, 87, None, "required"), ("households_min", 1000, None, None, "required")]),
    ("국평 대단지 역세권", [("area", 75, 86, None, "required"), ("households_min", 1000, None, None, "required"), ("station_walk", 10, None, None, "preferred")]),
    ("신분당선 역세권 꼭", [("line", None, None, ["신분당선"], "required")]),
    ("분당선 근처도 괜찮아", [("line", None, None, ["분당선"], "explore")]),
    ("역세권 5분 안이면 좋겠고 무순위만", [("station_walk", 5, None, None, "preferred"), ("supply", None, None, ["remainder"], "preferred")]),
    ("신혼부부 특공 가능한 수원 아파트", [("region_in", None, None, ["수원시"], "required"), ("supply", None, None, ["sp:newlywed"], "preferred")]),
    ("59㎡ ~ 74㎡ 민영", [("area", 56, 77, None, "required"), ("supply", None, None, ["private"], "required")]),
    ("6억 정도로 나홀로 아닌 곳", [("price_max", 6, None, None, "preferred"), ("not_single", None, None, None, "required")]),
    ("연봉 7,000만원인데 8억 이내", [("income", 0.7, None, None, "assumed"), ("price_max", 8, None, None, "required")]),
    ("동대문구 이야기 말고 그냥 궁금해", []), ("강남스타일 노래 좋아", []), ("서울대 근처", []), ("", []), (None, []), ("7억 이상", [("price_min", 7, None, None, "preferred")]),
]


def test_marked_questions(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(MARKED)], "id int, q string")
    for r in questions.read_questions(df, "q", PLACES, LINES).collect():
        got = sorted((x.key, x.low, x.high, x.names, x.weight) for x in r.constraints)
        assert got == sorted(MARKED[r.id][1]), r.q
        assert all(r.q[x.start : x.stop] == x.quote for x in r.constraints)


def test_edits_and_counts():
    words = questions.gazetteer(PLACES, LINES)
    assert questions.parse(words, "가격 조건은 빼줘")["drops"] == ["price_max", "price_min", "price_range"]
    assert questions.parse(words, "송파도 추가로 봐줘")["add"] and questions.parse(words, "처음부터 다시 찾아줘")["anew"]
    assert questions.parse(words, "5곳만 추천해줘")["wanted"] == 5 and questions.parse(words, "99곳")["wanted"] == 10


@pytest.mark.parametrize("seed", range(3))
def test_conversations_against_a_loop(spark, seed):
    rnd, rows, want = random.Random(seed), [], {}
    says = ["강남에서 찾아줘", "송파도 추가로 봐줘", "광명 빼고", "9억 이하", "예산 7억", "8억 이상", "가격은 빼줘", "국평", "면적은 지워줘", "처음부터 새로 찾자 수원에서", "고마워", "2호선 역세권", "9호선도 추가", None]
    words = questions.gazetteer(PLACES, LINES)
    family = lambda k: "price" if k.startswith("price_") else k
    for conv in range(30):
        held = []
        for turn in range(rnd.randrange(1, 15)):
            q = rnd.choice(says)
            rows.append((conv, turn, q))
            p = questions.parse(words, q)
            if p["anew"]:
                held = []
            keep = {family(x["key"]) for x in p["constraints"] if p["add"] and x["key"] in ("region_in", "region_out", "line", "supply")}
            gone = {family(k) for k in p["drops"]} | ({family(x["key"]) for x in p["constraints"]} - keep)
            held = [h for h in held if family(h[0]) not in gone] + [(x["key"], turn, x["start"], x["low"], x["names"]) for x in p["constraints"]]
            want[conv, turn] = sorted([h[0], h[1], h[2], h[3], h[4]] for h in held)
    df = questions.read_questions(spark.createDataFrame(rows, "conv int, turn int, q string"), "q", PLACES, LINES)
    got = {(r.conv, r.turn): [(x.key, x.low, x.names) for x in r.constraints] for r in questions.conversation_state(df, "conv", "turn").collect()}
    assert got == {k: [(h[0], h[3], h[4]) for h in v] for k, v in want.items()}


def test_a_search_with_what_was_asked(spark):
    words = questions.gazetteer(PLACES, LINES)
    asked = questions.parse(words, "강남에서 10억 이하, 국평이면 좋겠어")["constraints"]
    required, preferred = questions.search_terms(asked, {"강남구": {"sido": "서울", "district": "강남구", "label": "강남구"}}, {})
    assert required == [("price_max", 10.0), ("region_in", [{"sido": "서울", "district": "강남구", "label": "강남구"}])] and preferred == [("area", (75.0, 86.0))]
    rows = [(1, "서울", "강남구", 9.0, 84.0), (2, "서울", "강남구", 11.0, 84.0), (3, "서울", "송파구", 9.0, 59.0), (4, "서울", "강남구", 10.0, 59.0)]
    facts = spark.createDataFrame(rows, "id int, sido string, district string, price double, area double").withColumns(
        {"address": F.lit(""), "name": F.lit(""), "grade": F.lit("flat"), "eligible": F.lit("ok"), "lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")})
    found = {r.id: (r.result, r.score) for r in conditions.search(facts, required, preferred).collect()}
    assert {i: x[0] for i, x in found.items()} == {1: "ok", 2: "excluded", 3: "excluded", 4: "ok"} and found[1][1] > found[4][1]
