"""Registered queries of facts out of notice texts: documents carry notices in turn, and what each says is given by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import extract
from hearthline.plans.registry import cases, facts, query

_RATIO = "전용면적별 1순위 가점제/추첨제 적용비율 구분 가점제 추첨제 "
SCORES = [
    (_RATIO + "전용면적 60㎡ 이하 40% 60% 전용면적 60㎡ 초과 85㎡ 이하 70% 30% 전용면적 85㎡ 초과 - 100% ■ 다음",
     '{"rows":[{"over":0,"upto":60,"score":40,"lottery":60},{"over":60,"upto":85,"score":70,"lottery":30},{"over":85,"score":0,"lottery":100}],"unknown":false}'),
    (_RATIO.replace("추첨제 ", "추 첨제 ") + "전용 면적 60㎡ 초 과 85㎡ 이하 71, 84A, 84B 40% 60%", '{"rows":[{"over":60,"upto":85,"score":40,"lottery":60}],"unknown":false}'),
    (_RATIO + "전용면적 60㎡ 이하 40% 50%", '{"unknown":true}'),
    (_RATIO + "전용면적 60㎡ 이하 40% 60% 전용면적 85㎡ 초과 0% 100%", '{"unknown":true}'),
    ("가점제·추첨제 적용비율은 표를 보세요", '{"unknown":true}'), ("다른 글", None), ("", None), (None, None),
]
PAYMENTS = [
    ("공급금액 (단위: 원) 구분 계약금(10%) 중도금(60%) 잔금(30%)\n500,000,000 50,000,000 50,000,000\n610,000,000 61,000,000 61,000,000", '{"contract":10,"mid":60,"balance":30,"rows":2}', '{"10":2}', "fine"),
    ("주택가격 단위 : 천원 계약금 20% 잔금 80%\n805,000 161,000 644,000", '{"contract":20,"mid":0,"balance":80,"rows":1}', '{"20":1}', "fine"),
    ("공급금액 계약금(10%) 중도금(60%) 잔금(20%) 500,000,000 50,000,000 50,000,000", None, '{"10":1}', "fine"),
    ("공급금액 계약금(5%) 중도금(60%) 잔금(35%) 500,000,000 50,000,000 50,000,000 1 600,000,000 60,000,000 60,000,000 1 700,000,000 70,000,000 70,000,000", None, '{"10":3}', "missed"),
    ("발코니 확장 계약금(10%) 잔금(90%) 12,000,000 1,200,000 10,800,000", None, "{}", "fine"), (None, None, None, "fine"),
]
RESUPPLIES = [
    ("공급규모 : 총 157세대 중 불법행위 재공급 1세대 [특별공급 1세대(신혼부부 1세대)]", '{"total":1,"special_total":1,"special":{"newlywed":1}}'),
    ("공급규모: 불법행위재공급 6세대(노부모부양 특별공급 4세대, 일반공급 2세대)", '{"total":6,"special_total":4,"special":{"elder":4},"general":2}'),
    ("공급규모: 불법행위재공급 3세대 [특별공급 2세대, 일반공급 2세대]", None), ("공급규모: 불법행위 재공급 1세대 [일반공급 1세대]", '{"total":1,"special_total":0,"special":{},"general":1}'),
    ("공급규모: 불법행위재공급 3세대 [특별공급 1세대(노부모부양 2세대)]", None), ("불법행위 재공급 2세대", None), (None, None),
]
COMPLEXES = [
    ("공급규모 : 아파트 지하 2층, 지상 22층 6개동 총 426세대 중 일반분양 426세대", '{"households":426,"buildings":6}', "no"), ("공급규모 지하 층 지상 층 개동 총 세대 중 : 3, 30 공급 규모 총 80세대", '{"households":80}', "maybe"),
    ("공급규모 총 1,191세대", '{"households":1191}', "unknown"), ("공급규모 1개동 총 120 세대", '{"households":120,"buildings":1}', "maybe"), ("공급규모 총 9세대", None, "unknown"), (None, None, "unknown"),
]
SCHEDULES = [
    ("신청시간 : (특별공급) 2026.10.05. 10:00 ~ 10.06. 17:00 (일반공급) 2026.10.07. ~ 2026.10.08.\n다음", '{"special":{"first":"2026-10-05","last":"2026-10-06"},"general":{"first":"2026-10-07","last":"2026-10-08"}}'),
    ("신청시간 : (일반공급) 2026.10.07.", None), ("신청시간 : (특별공급) 10.05.", None), (None, None),
]
_AREAS = "84.7450 25.5789 110.3239 53.6674 163.9913 55.1901"
TABLES = [
    (f"특별공급 세대수 주거 전용면적 소계 노부모부양 신혼부부 계 2026930036 01 084.7450D 84D {_AREAS} 2 1 1 2 02 084.7450E 84E {_AREAS} 5 - 1 1", '{"084.7450D":{"elder":1,"newlywed":1,"total":2},"084.7450E":{"elder":0,"newlywed":1,"total":1}}'),
    (f"특별공급 세대수 소계 기관 추천 생애 최초 계 2026930036 01 059.1234A 59A {_AREAS} 9 2 3 6", None), ("특별공급 세대수", None), (None, None),
]
_RENT = "토지임대료 전용면적(㎡) 토지임대료(원/월) 비 고 49 426,000 전용 49㎡ 전체 주택형에 동일 적용 [토지임대료 보증금 전환 예시] 전용면적(㎡) 전환 전 토지임대료(원/월) 보증금 전환율 전환이율 전환보증금 전환 후 토지임대료 49 426,000 60% 2.5% 122,000,000 "
RENTS = [(_RENT + "171,830", '{"by_area":{"49":426000},"rate":0.025}'), (_RENT + "199,999", None), ("토지임대료", None), (None, None)]
YOUTHS = [
    ("청년 특별공급 소득기준 1인 도시근로자 가구원수별 가구당 월평균소득액의 140% 5,338,708 (청년 특별공급은 신청자 본인 276,000천원 이하 및 부모 1,035,000천원 이하)",
     '{"income":5338708,"own_assets":276000000,"parents_assets":1035000000,"partial":false}'),
    ("청년 특별공급은 신청자 본인 276백만원 이하 및 부모 1,035백만원 이하", '{"own_assets":276000000,"parents_assets":1035000000,"partial":true}'), ("청년", None), (None, None),
]


def _texts(table: list) -> str:
    return f"SELECT doc_id, {cases('doc_id', [row[0] for row in table])} AS text FROM documents"


def _said(table: list, **columns: int) -> str:
    return "SELECT doc_id, " + ", ".join(f"{cases('doc_id', [row[i] for row in table])} AS {name}" for name, i in columns.items()) + " FROM documents"


def _json(spark, sf_dir, table, f):
    return facts(spark, sf_dir, _texts(table), "documents").select("doc_id", F.to_json(f(F.col("text"))).alias("found"))


@query(_said(SCORES, found=1))
def extract_score_ratio(spark, sf_dir):
    return _json(spark, sf_dir, SCORES, extract.score_ratio)


@query(_said(PAYMENTS, found=1, rows=2, audit=3))
def extract_payment(spark, sf_dir):
    f = facts(spark, sf_dir, _texts(PAYMENTS), "documents").select("doc_id", extract.payment(F.col("text")).alias("p"), extract.payment_rows(F.col("text")).alias("r"))
    return f.select("doc_id", F.to_json("p").alias("found"), F.to_json("r").alias("rows"), extract.payment_audit(F.col("p"), F.col("r")).alias("audit"))


@query(_said(RESUPPLIES, found=1))
def extract_resupply(spark, sf_dir):
    return _json(spark, sf_dir, RESUPPLIES, extract.resupply_scale)


@query(_said(COMPLEXES, found=1, single=2))
def extract_complex(spark, sf_dir):
    f = facts(spark, sf_dir, _texts(COMPLEXES), "documents").select("doc_id", extract.complex_scale(F.col("text")).alias("c"))
    return f.select("doc_id", F.to_json("c").alias("found"), extract.single_building(F.col("c")).alias("single"))


@query(_said(SCHEDULES, found=1))
def extract_schedule(spark, sf_dir):
    return _json(spark, sf_dir, SCHEDULES, extract.schedule)


@query(_said(TABLES, found=1))
def extract_special_units(spark, sf_dir):
    return _json(spark, sf_dir, TABLES, extract.special_table)


@query(_said(RENTS, found=1))
def extract_land_rent(spark, sf_dir):
    return _json(spark, sf_dir, RENTS, extract.land_rent)


@query(_said(YOUTHS, found=1))
def extract_youth_limits(spark, sf_dir):
    return _json(spark, sf_dir, YOUTHS, extract.youth_limits)


PERIODS = [
    ("접수기간 : 2026. 10. 13.(화) 10:00 ~ 10. 15.(목)", '{"first":"2026-10-13","last":"2026-10-15","rank1":false}'), ("1순위 우편 접수 2026.10.01 ~ 10.02 인터넷 접수 2026.12.30. ~ 1.3.", '{"first":"2026-12-30","last":"2027-01-03","rank1":false}'),
    ("청약신청 접수 1순위 2026.10.05 ~ 2026.10.01", None), ("신청 접수 ▶ 2026.10.05 ~ 10.06", None), ("접수기간 2025.01.05 ~ 2025.01.06", None), ("", None), (None, None),
]
INCOMES = [
    ("3인 8,168,429원 이하 100% 4인 8,802,202원 이하 100%", '{"3":8168429,"4":8802202}', None),
    ("소득구간 ~30% ~50% ~70% ~100% 1인 769,271 1,282,119 1,794,966 2,564,238 인2 1,259,7882,099,646 2,939,505 4,199,292 3인 1 2 3 4 8인을 초과하는 가구의 기준 중위소득(100%)은 1인 증가 시마다, 959,198원씩 증가", '{"1":2564238,"2":4199292}', 959198),
    ("소득구간 ~30% ~50% ~70% ~100% 1인 769,271 1,282,119 1,794,966 3,564,238", None, None), ("", None, None), (None, None, None),
]
QUOTAS = [
    ("다자녀가구 특별공급 해당시·도(광명시 및 경기도) 거주자(50%) … 기타지역(서울특별시 및 인천광역시) 거주자(50%)",
     '{"buckets":[{"name":"해당 시·도","percent":50,"regions":["광명","경기"]},{"name":"기타지역","percent":50,"regions":["서울","인천"]}],"unknown":false}'),
    ("다자녀가구 특별공급 해당시·도(광명시) 거주자(50%) 끝", '{"unknown":true}'), ("다자녀가구 특별공급 해당시도(서울) 거주자(50%) 기타지역(인천) 거주자(40%)", '{"unknown":true}'), ("다자녀", None), (None, None),
]


@query(_said(PERIODS, found=1))
def extract_application_period(spark, sf_dir):
    return _json(spark, sf_dir, PERIODS, lambda t: extract.application_period(t, F.lit("2026-10-07").cast("date")))


@query(_said(INCOMES, found=1, added=2))
def extract_income_table(spark, sf_dir):
    f = facts(spark, sf_dir, _texts(INCOMES), "documents")
    return f.select("doc_id", F.to_json(extract.income_table(F.col("text"))).alias("found"), extract.income_added(F.col("text")).cast("int").alias("added"))


@query(_said(QUOTAS, found=1))
def extract_child_quota(spark, sf_dir):
    return _json(spark, sf_dir, QUOTAS, extract.child_quota)
