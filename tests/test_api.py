"""The HTTP data sources against a server that fails, pages and refuses filters."""

import datetime
import http.server
import json
import threading
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthline.operators import listing
from hearthline.sources import api, notices

DEALS = {("trade", "11110", "202608"): 7, ("trade", "11110", "202609"): 4, ("rent", "11110", "202608"): 1, ("trade", "11140", "202609"): 9}
NOTICES = [
    {"PBLANC_NO": f"20269{i:02d}", "HOUSE_NM": f"집{i}", "HSSPLY_ADRES": "서울특별시 강남구 역삼동 1", "RCRIT_PBLANC_DE": f"2026-{9 - i // 4:02d}-{28 - i % 4:02d}", "SUBSCRPT_RCEPT_BGNDE": "20261006", "RCEPT_ENDDE": "",
     "SUBSCRPT_RCEPT_ENDDE": "2026.10.07", "PRZWNER_PRESNATN_DE": "2026-10-12", "MVN_PREARNGE_YM": "203005", "TOT_SUPLY_HSHLDCO": 35, "SPECLT_RDN_EARTH_AT": "y", "NSPRC_NM": None}
    for i in range(10)
]


def item(i: int, cancelled: bool) -> str:
    return f"<item><aptNm>A{i}</aptNm><excluUseAr>84.98</excluUseAr><dealAmount> {100 + i},000</dealAmount><dealYear>2026</dealYear><dealMonth>8</dealMonth><dealDay>{i + 1}</dealDay><cdealType>{'O' if cancelled else ''}</cdealType></item>"


class Handler(http.server.BaseHTTPRequestHandler):
    asked: Counter = Counter()
    failures: dict = {}
    refuse_filter = False

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        self.asked[(url.path, q.get("LAWD_CD"), q.get("DEAL_YMD"), q.get("pageNo") or q.get("page"), q.get("cond[PBLANC_NO::EQ]"))] += 1
        status, body = self.answer(url.path, q)
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def answer(self, path, q):
        kind = next((k for k, p in api.TRADE_PATHS.items() if p == path), None)
        fail = self.failures.get((kind, q.get("LAWD_CD"), q.get("DEAL_YMD"), q.get("pageNo")))
        if fail:
            return fail.pop(0) if isinstance(fail, list) else fail
        if kind:
            n, size, page = DEALS.get((kind, q["LAWD_CD"], q["DEAL_YMD"]), 0), int(q["numOfRows"]), int(q["pageNo"])
            items = "".join(item(i, i % 3 == 1) for i in range((page - 1) * size, min(n, page * size)))
            return 200, f"<response><header><resultCode>000</resultCode></header><body><items>{items}</items></body></response>"
        if path == api.NOTICE_PATHS["general"][0]:
            since = q.get("cond[RCRIT_PBLANC_DE::GTE]")
            if since and self.refuse_filter:
                return 400, "no"
            found = [d for d in NOTICES if not since or d["RCRIT_PBLANC_DE"] >= since]
            size, page = int(q["perPage"]), int(q["page"])
            return 200, json.dumps({"data": found[(page - 1) * size : page * size]})
        if path.endswith("Mdl"):
            no = q["cond[PBLANC_NO::EQ]"]
            return 200, json.dumps({"data": [{"PBLANC_NO": no, "HOUSE_TY": t, "LTTOT_TOP_AMOUNT": "122,202", "SUPLY_HSHLDCO": "1", "NWBB_HSHLDCO": "2"} for t in ("084.9811C", "059.9900A")]})
        return 200, '{"data": []}'

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    Handler.asked, Handler.failures, Handler.refuse_filter = Counter(), {}, False
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def trades(spark, url, **options):
    api.register(spark)
    return spark.read.format("housing_trades").options(url=url, key="SECRET", pause="0.01", rows="3", districts="11110,11140", months="202608,202609", **options).load()


def pages(kind):
    return {k[1:4] for k in Handler.asked if k[0] == api.TRADE_PATHS[kind]}


def test_paging_is_decided_before_cancelled_deals_go(spark, server):
    rows = trades(spark, server)
    assert Counter((r.kind, r.district, r.month) for r in rows.collect()) == DEALS
    # 7 deals are three pages of 3, 4 are two; of 9 three are full and a fourth is asked for
    assert {p for p in pages("trade") if p[:2] == ("11140", "202609")} == {("11140", "202609", str(i)) for i in range(1, 5)}
    live = notices.live(notices.typed(rows))
    assert live.count() == sum(n - len(range(1, n, 3)) for n in DEALS.values())
    assert live.agg(F.max("amount"), F.max("date")).first()[:] == (108000.0, datetime.date(2026, 8, 9))


def test_filters_leave_out_partitions(spark, server):
    rows = trades(spark, server).where("kind = 'trade' and month in ('202609', '202601') and district = '11110' and aptNm <> 'A0'")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = rows._jdf.queryExecution().explainString(mode)
    print(plan)
    pushed = next(line for line in plan.splitlines() if "Pushed" in line)
    assert "kind" in pushed and "month" in pushed and "district" in pushed and "aptNm" not in pushed
    assert rows.count() == 3 and {k[:3] for k in Handler.asked} == {(api.TRADE_PATHS["trade"], "11110", "202609")}


def test_what_helps_is_asked_again(spark, server):
    Handler.failures = {
        ("trade", "11110", "202608", "2"): [(503, ""), (200, "<html>gateway")], ("rent", "11110", "202608", "1"): [(429, "")],
        ("trade", "11140", "202609", "1"): [(200, "<r><resultCode>99</resultCode><resultMsg>BUSY</resultMsg></r>")],
    }
    assert Counter((r.kind, r.district, r.month) for r in trades(spark, server).collect()) == DEALS
    assert Handler.asked[(api.TRADE_PATHS["trade"], "11110", "202608", "2", None)] == 3


def test_what_does_not_help_is_not(spark, server):
    Handler.failures = {
        ("trade", "11110", "202608", "2"): (503, ""), ("trade", "11110", "202609", "1"): (401, ""),
        ("rent", "11110", "202608", "1"): (200, "<r><resultCode>22</resultCode><resultMsg>LIMITED NUMBER OF REQUESTS</resultMsg></r>"),
    }
    rows = trades(spark, server, onerror="report").cache()
    failed = {(r.kind, r.district, r.month, r.page): r.error for r in rows.where("error is not null").collect()}
    assert failed.keys() == set(Handler.failures) and not any("SECRET" in e for e in failed.values())
    asked = {k[1:4]: n for k, n in Handler.asked.items()}
    assert asked["11110", "202609", "1"] >= 1 and Handler.asked[(api.TRADE_PATHS["trade"], "11110", "202608", "2", None)] == api.TRIES
    assert Handler.asked[(api.TRADE_PATHS["trade"], "11110", "202609", "1", None)] == 1 == Handler.asked[(api.TRADE_PATHS["rent"], "11110", "202608", "1", None)]
    assert rows.where("error is null").count() == 3 + 9  # what came before the error stays
    rows.unpersist()
    with pytest.raises(Exception, match="answers 401"):
        trades(spark, server).where("month = '202609' and kind = 'trade'").collect()


def test_after_the_deadline_nothing_is_asked(spark, server):
    rows = trades(spark, server, onerror="report", deadline="1").collect()
    assert len(rows) == 12 and all("time was over" in r.error for r in rows) and not Handler.asked


def test_months_as_a_stream(spark, server, tmp_path):
    api.register(spark)

    def run(until):
        stream = spark.readStream.format("housing_trades").options(url=server, pause="0.01", rows="3", districts="11110,11140", kinds="trade", start="202608", until=until).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return Counter((r.district, r.month) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("202608") == {("11110", "202608"): 7}
    first = dict(Handler.asked)
    assert run("202609") == {("11110", "202608"): 7, ("11110", "202609"): 4, ("11140", "202609"): 9}  # a restart
    assert all(Handler.asked[k] == n for k, n in first.items() if k[2] == "202608")
    assert api.next_month("202612") == "202701"


@pytest.mark.parametrize("refuse", [False, True])
def test_notices_with_and_without_the_filter(spark, server, refuse):
    Handler.refuse_filter = refuse
    api.register(spark)
    found = spark.read.format("housing_notices").options(url=server, pause="0.01", rows="3").load().where("announced >= '2026-09-26'")
    assert sorted(r.notice_no for r in found.collect()) == [f"20269{i:02d}" for i in range(3)]
    general = [k for k in Handler.asked if k[0] == api.NOTICE_PATHS["general"][0]]
    # the filter leaves one full page and an empty one; without it pages end with the first that has nothing new
    assert len(general) == 2


def test_listings_of_what_the_services_say(spark, server):
    api.register(spark)
    options = {"url": server, "pause": "0.01"}
    found = spark.read.format("housing_notices").options(**options).load().where("category = 'general'")
    raw = notices.normalised(found, api.units_of(found, options, 2))
    assert raw.count() == 20 and raw.where("price = 12.2202 and households = 1 and special_units.newborn = 2 and special_units.youth is null").count() == 20
    out = listing.listings(raw, F.lit("2026-09-30").cast("date"))
    row = out.where("notice_no = '2026900' and house_ty = '084.9811C'").first()
    assert (row.id, row.unit, row.area, row.lawd, row.move_in, str(row.apply), str(row.apply_end), row.regulated) == ("2026900-084.9811C", "84C", 84.9811, "11680", "2030-05", "2026-10-06", "2026-10-07", True)


def test_recent_months_and_origins(spark):
    rows = spark.createDataFrame([(m, 1) for m in ("202601", "202512", "202511")], "month string, n int")
    assert sorted(r.month for r in notices.recent(rows, "month", F.lit("2026-01-05").cast("date"), 2).collect()) == ["202512", "202601"]
    both = notices.with_origin(trade=rows, presale=rows.drop("n").withColumn("x", F.lit(2)))
    assert Counter(r.origin for r in both.collect()) == {"trade": 3, "presale": 3} and both.columns == ["month", "n", "origin", "x"]
