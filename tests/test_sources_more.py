"""Readers of rental notices and boards, places and sinks on literal rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from hearthline.operators import audit, listing
from hearthline.sources import rentals, sinks

DAY = "2026-11-01"
d = lambda s: dt.date.fromisoformat(s)


def test_rental_notices_are_nested(spark):
    lists = spark.createDataFrame([("1", "행복주택", "행복주택", "경기", "2026.10.02", "20261105", "공고중"), ("2", "x", None, None, None, None, None)], "PAN_ID string, PAN_NM string, AIS_TP_CD_NM string, CNP_CD_NM string, PAN_NT_ST_DT string, CLSG_DT string, PAN_SS string")
    detail = [{"dsSch": []}, {"dsSplScdl": [{"SBD_LGO_NM": "A", "ACP_DTTM": "2026.10.27 10:00 ~ 2026.10.29 17:00"}], "dsSbd": [{"LCC_NT_NM": "A", "LGDN_ADR": "경기", "LGDN_DTL_ADR": " 1", "HSH_CNT": "1,200"}]},
              {"dsAhflInfo": [{"SL_PAN_AHFL_DS_CD_NM": "공고문(PDF)", "CMN_AHFL_NM": "n.pdf", "AHFL_URL": "http://f/1"}, {"AHFL_URL": "no"}]}]
    supply = {"dsList01": [{"SBD_LGO_NM": "A", "HTY_NNA": "26A", "DDO_AR": "26.5", "HSH_CNT": "10", "LS_GMY": "15,000,000", "RFE": "공고문 참조"}]}
    answers = lambda a: spark.createDataFrame([("1", json.dumps(a, ensure_ascii=False))], "PAN_ID string, answer string")
    one, two = rentals.rental_notices(lists, answers(detail), answers(supply)).orderBy("id").collect()
    assert (one.posted, one.close, one.notice_pdf) == (d("2026-10-02"), d("2026-11-05"), "http://f/1")
    assert [tuple(s) for s in one.schedule] == [("A", d("2026-10-27"), d("2026-10-29"), None)] and tuple(one.complexes[0]) == ("A", "경기 1", 1200)
    assert tuple(one.units[0]) == ("A", "26A", 26.5, 10, 15_000_000, None, "공고문 참조") and len(one.files) == 1
    assert two.schedule is None and two.notice_pdf is None


def test_welfare_and_local_lists(spark):
    rows = [("06", "행복주택", "[정정공고] 갑 주택", "공고중", "2026.12.01"), ("06", "행복주택", "갑주택", "공고중", "2026.12.01"), ("06", "행복주택", "을", "접수마감", None), ("06", "상가", "병", "공고중", None),
            ("06", "행복주택", "정", "공고중", "2026.10.01"), ("06", "행복주택", "기관공급 대상기업 모집", "공고중", None), ("06", "행복주택", "무", None, None)]
    df = spark.createDataFrame(rows, "UPP_AIS_TP_CD string, AIS_TP_CD_NM string, PAN_NM string, PAN_SS string, CLSG_DT string")
    assert sorted(r.PAN_NM for r in rentals.welfare_open(df, {"06": ["행복주택"]}, F.lit(DAY).cast("date"), listing.for_organisations).collect()) == ["[정정공고] 갑 주택", "무"]
    cols = "pblancId suplyInsttNm beforePblancId rcritPblancDe endDe beginDe przwnerPresnatnDe pblancNm hsmpNm houseTyNm sumSuplyCo rentGtn mtRntchrg".split()
    raw = [("1", "부산", "0", "20261001", "20261110", "20261105", None, "n", "가", "29", "5", "1000", "0"), ("1", "부산", None, "20261001", "20261111", "20261105", None, "n", "나", "36", "6", None, None),
           ("0", "부산", None, "20261001", "20261110", None, None, "old", None, None, None, None, None), ("2", "LH", None, "20261001", "20261110", None, None, "x", None, None, None, None, None),
           ("3", "대구", None, "20261001", "20261010", None, "20261010", "past", None, None, None, None, None), (" ", "대구", None, None, None, None, None, None, None, None, None, None, None)]
    got = rentals.local_notices(spark.createDataFrame(raw, ", ".join(f"{c} string" for c in cols)), F.lit(DAY).cast("date")).collect()
    assert [(r.id, r.close, r.complexes, r.households, len(r.schedule), [tuple(x) for x in r.rents]) for r in got] == [("LOC-1", d("2026-11-11"), ["가", "나"], 11, 2, [("가", "29", 1000, None)])]
    opens = spark.createDataFrame([("2026-10-01", None, "2026-10-20"), ("2026-10-01", "2026-11-02", None), ("2026-10-01", None, None), ("2026-01-01", "2026-11-02", None)], "p string, c string, w string")
    day = lambda c: F.col(c).cast("date")
    assert [r.o for r in opens.select(rentals.still_open(day("p"), day("c"), day("c"), day("w"), F.lit("2026-09-01").cast("date"), F.lit(DAY).cast("date")).alias("o")).collect()] == [True, True, False, False]


def test_boards_and_files(spark):
    page = "<a href=\"#\" onclick=\"fnView('12345', 1)\">청년 <b>매입</b>&amp;임대</a><td>2026-10-01</td><a onclick=\"View(12345)\">again</a> 2026-10-02 <a onclick=\"View('67890')\">둘</a>"
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id int, html string")
    assert sorted((r.seq, r.title, str(r.date)) for r in rentals.script_board(df).collect()) == [("12345", "청년 매입 &임대", "2026-10-01"), ("67890", "둘", "None")]
    files = 'var downList = [{"oriFileNm":"신청서 공고.pdf","seq":"1"},{"oriFileNm":"a.hwp"},{"oriFileNm":"입주자 모집공고.PDF","seq":"2"},{"oriFileNm":"x.pdf"}]; end'
    best = spark.createDataFrame([(files,), ("none",)], "html string").select(rentals.best_file(rentals.script_files(F.col("html")), "oriFileNm").alias("f")).collect()
    assert best[0].f.seq == "2" and best[1].f is None
    table = ('<tr><td class="title"><a href="?mode=view&amp;articleNo=77" x>행복 <i>주택</i></a></td><td class="date">26.10.05</td><td class="category">임대</td>'
             '<td><a class=f href="?mode=download&amp;articleNo=77&amp;attachNo=9"><img alt="GH 공고.pdf - 다운로드"></a><a href="?mode=download&articleNo=77&attachNo=9">dup</a></td></tr><tr><td>no</td></tr>')
    row = rentals.table_board(spark.createDataFrame([(1, table)], "page_id int, html string")).first()
    assert (row.no, row.title, row.date, row.category, [tuple(f) for f in row.files]) == ("77", "행복 주택", d("2026-10-05"), "임대", [("공고.pdf", "9")])


def test_places_and_stations(spark):
    homes = spark.createDataFrame([(1, 37.5, 127.0), (2, 35.0, 129.0)], "id int, lat double, lng double")
    places = spark.createDataFrame([("가", 37.501, 127.0, "station"), ("가역", 37.502, 127.0, "station"), ("나역", 37.51, 127.0, "station"), ("다역", 37.505, 127.0, "station"), ("라초등학교", 37.5, 127.01, "school"),
                                    ("마초등학교", 37.5, 127.005, "school"), ("바학원", 37.5, 127.0, "school"), ("사역", 37.6, 127.0, "station"), (None, 37.5, 127.0, "station")], "name string, lat double, lng double, kind string")
    got = sorted((r.kind, r.name, r.metres, r.walk) for r in rentals.nearby_places(homes, places).collect())
    assert got == [("역", "가역", 111, 2), ("역", "다역", 556, 11), ("초등학교", "마초등학교", 441, 9)]
    points = spark.createDataFrame([("2", "강남역", 1.0, 2.0), ("2", "강남", 3.0, 4.0), ("3", "강남", 5.0, 6.0)], "line string, station string, lat double, lng double")
    assert sorted(map(tuple, rentals.line_stations(points).collect())) == [("2", "강남", 2.0, 3.0), ("3", "강남", 5.0, 6.0)]


def test_sinks_keep_what_an_empty_source_gives(spark, tmp_path):
    path = str(tmp_path / "out.json")
    one = spark.createDataFrame([(1, "a")], "id int, t string")
    assert sinks.publish_guarded(one, path) and not sinks.publish_guarded(one.limit(0), path)
    assert [tuple(r) for r in spark.read.schema(one.schema).json(path).collect()] == [(1, "a")]
    assert sinks.publish(one.withColumn("t", F.lit("b")), path) == 1 and spark.read.json(path).first().t == "b"
    chunks = spark.createDataFrame([("n1", 1, "y"), ("n1", 0, "x"), ("n2", 0, "z")], "nid string, pos int, t string")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    sinks.write_chunks(chunks.where("nid = 'n2'").withColumn("t", F.lit("w")), str(tmp_path / "chunks"))
    back = spark.read.json(str(tmp_path / "chunks"))
    assert sorted((r.nid, r.pos, r.t) for r in back.collect()) == [("n1", 0, "x"), ("n1", 1, "y"), ("n2", 0, "w")]


def test_archive_locks_and_forgets(spark, tmp_path):
    path, schema = str(tmp_path / "archive"), "id int, closes date, noticed date, v string"
    first = spark.createDataFrame([(1, d("2026-10-01"), None, "a"), (2, d("2026-12-01"), None, "a"), (3, d("2025-01-01"), None, "a"), (4, None, None, "a")], schema)
    assert sinks.archive(first, path, "id", "closes", "noticed", F.lit(DAY).cast("date")) == 3
    second = spark.createDataFrame([(1, d("2026-10-01"), None, "b"), (2, d("2026-12-01"), None, "b")], schema)
    assert sinks.archive(second, path, "id", "closes", "noticed", F.lit(DAY).cast("date")) == 3
    assert sorted((r.id, r.v, r.locked_at is not None) for r in spark.read.parquet(path).collect()) == [(1, "a", True), (2, "b", False), (4, "a", False)]


def test_strengths_against_a_loop(spark):
    games = [("a", "b", "a"), ("b", "a", "a"), ("a", "c", "tie"), ("b", "c", "c"), ("c", "a", "a"), ("b", "c", "b")]
    got = {r.id: (r.strength, r.wins) for r in audit.strengths(spark.createDataFrame(games, "a string, b string, winner string")).collect()}
    ids, p = ["a", "b", "c"], dict.fromkeys("abc", 1.0)
    wins = {i: sum(w == i for _, _, w in games) + 0.5 * sum(w == "tie" and i in (a, b) for a, b, w in games) for i in ids}
    n = lambda i, j: sum({i, j} == {a, b} for a, b, _ in games)
    for _ in range(200):
        for i in ids:
            p[i] = max(1e-6, wins[i] / sum(n(i, j) / (p[i] + p[j]) for j in ids if j != i))
        g = (p["a"] * p["b"] * p["c"]) ** (1 / 3)
        p = {i: v / g for i, v in p.items()}
    from math import log
    assert {i: (round(s, 9), w) for i, (s, w) in got.items()} == {i: (round(log(p[i]), 9), wins[i]) for i in ids}
