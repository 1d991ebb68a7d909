"""Readers of rental notices: nested JSON answers, two kinds of boards in HTML, lists of several agencies. Files stand in for their servers.

Every reader is a DataFrame of one row a notice (or a row a board entry) made with expressions; absent values stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.text import date_of, let, number, plain_html

# Fixed values.
OTHER_AGENCIES = ("LH", "SH", "GH")
LOOKBACK_DAYS, KEEP_AFTER_WINNERS = 90, 14
CORRECTION = r"^\s*\[\s*정정\s*(?:공고)?\s*\]\s*"
PREFERRED, LATER = "공고", "목록|서식|신청서|안내|명단"

_yes = lambda c: F.coalesce(c, F.lit(False))


def part(answer: Column, name: str, fields: str) -> Column:
    """All rows of the lists of one name in an answer, which is a JSON object or an array of objects. fields: a struct's DDL."""
    schema = f"struct<{name}:array<struct<{fields}>>>"
    listed = F.when(F.trim(answer).startswith("["), answer).otherwise(F.concat(F.lit("["), answer, F.lit("]")))
    return F.flatten(F.filter(F.transform(F.from_json(listed, f"array<{schema}>"), lambda p: p[name]), lambda x: x.isNotNull()))


def rental_notices(lists: DataFrame, details: DataFrame, supplies: DataFrame) -> DataFrame:
    """One nested row a notice of list rows (PAN_ID, PAN_NM, ...), detail answers and supply answers (PAN_ID, answer as JSON text)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    d, s = F.col("detail"), F.col("supply")
    joined = lists.join(details.select("PAN_ID", F.col("answer").alias("detail")), "PAN_ID", "left").join(supplies.select("PAN_ID", F.col("answer").alias("supply")), "PAN_ID", "left")
    span = r"^\s*(\d{4}\.\d{2}\.\d{2})[^~]{0,12}~\s*(\d{4}\.\d{2}\.\d{2})[^~]{0,12}$"

    def scheduled(x: Column) -> Column:
        first, last = date_of(x["SBSC_ACP_ST_DT"]), date_of(x["SBSC_ACP_CLSG_DT"])
        written = lambda i: F.when(first.isNull() & last.isNull(), date_of(F.regexp_extract(x["ACP_DTTM"], span, i)))
        return F.struct(blank(x["SBD_LGO_NM"]).alias("complex"), F.coalesce(first, written(1)).alias("apply_start"), F.coalesce(last, written(2)).alias("apply_end"), date_of(x["PZWR_ANC_DT"]).alias("winner"))

    def unit(x: Column) -> Column:
        deposit, rent = number(x["LS_GMY"]).cast("long"), number(x["RFE"]).cast("long")
        note = F.when(deposit.isNull(), x["LS_GMY"]).when(rent.isNull(), x["RFE"])
        return F.struct(blank(x["SBD_LGO_NM"]).alias("complex"), blank(x["HTY_NNA"]).alias("type"), number(x["DDO_AR"]).alias("area"), number(x["HSH_CNT"]).cast("int").alias("households"), deposit.alias("deposit"), rent.alias("rent"), note.alias("money_note"))

    schedule = F.transform(part(d, "dsSplScdl", "SBD_LGO_NM:string,SBSC_ACP_ST_DT:string,SBSC_ACP_CLSG_DT:string,ACP_DTTM:string,PZWR_ANC_DT:string"), scheduled)
    complexes = F.transform(part(d, "dsSbd", "LCC_NT_NM:string,LGDN_ADR:string,LGDN_DTL_ADR:string,HSH_CNT:string"), lambda x: F.struct(
        blank(x["LCC_NT_NM"]).alias("name"), blank(F.concat_ws(" ", blank(x["LGDN_ADR"]), blank(x["LGDN_DTL_ADR"]))).alias("address"), number(x["HSH_CNT"]).cast("int").alias("households")))
    units = F.transform(part(s, "dsList01", "SBD_LGO_NM:string,HTY_NNA:string,DDO_AR:string,HSH_CNT:string,LS_GMY:string,RFE:string"), unit)
    files = F.filter(part(d, "dsAhflInfo", "SL_PAN_AHFL_DS_CD_NM:string,CMN_AHFL_NM:string,AHFL_URL:string"), lambda x: _yes(x["AHFL_URL"].startswith("http")))
    pdf = F.get(F.filter(files, lambda x: _yes(F.contains(F.upper(x["SL_PAN_AHFL_DS_CD_NM"]), F.lit("PDF")) & F.contains(x["SL_PAN_AHFL_DS_CD_NM"], F.lit("공고")))), F.lit(0))
    return joined.select(
        F.col("PAN_ID").alias("id"), F.col("PAN_NM").alias("name"), F.col("AIS_TP_CD_NM").alias("type"), F.col("CNP_CD_NM").alias("region"), date_of(F.col("PAN_NT_ST_DT")).alias("posted"),
        date_of(F.col("CLSG_DT")).alias("close"), F.col("PAN_SS").alias("status"), schedule.alias("schedule"), complexes.alias("complexes"), units.alias("units"),
        F.transform(files, lambda x: F.struct(blank(x["SL_PAN_AHFL_DS_CD_NM"]).alias("kind"), blank(x["CMN_AHFL_NM"]).alias("name"), x["AHFL_URL"].alias("url"))).alias("files"), pdf["AHFL_URL"].alias("notice_pdf"),
    )


def welfare_open(rows: DataFrame, wanted: dict[str, list[str]], today: Column, for_organisations) -> DataFrame:
    """List rows of wanted kinds that aren't closed nor for organisations, without originals that a correction of the same title replaces."""
    kinds = [f"{up}|{t}" for up, ts in wanted.items() for t in ts]
    name, closes = F.coalesce("PAN_NM", F.lit("")), date_of(F.col("CLSG_DT"))
    kept = rows.where(_yes(F.concat_ws("|", "UPP_AIS_TP_CD", "AIS_TP_CD_NM").isin(*kinds)))
    kept = kept.where(~_yes(F.col("PAN_SS") == "접수마감") & ~_yes(closes < today) & ~for_organisations(F.col("PAN_NM")))
    marked = kept.withColumn("__t", F.regexp_replace(F.regexp_replace(name, CORRECTION, ""), r"(?U)\s", "")).withColumn("__c", name.rlike(CORRECTION))
    fixed = marked.where("__c").select(F.col("__t").alias("__f")).distinct()
    return marked.where("__c").unionByName(marked.where("not __c").join(fixed, F.col("__t") == F.col("__f"), "left_anti")).drop("__t", "__c")


def local_notices(rows: DataFrame, today: Column) -> DataFrame:
    """Rows of a notice and a complex as nested notices: id, inst, name, posted, close, schedule, complexes, households, rents.

    Notices of the national agencies, those that a correction names as the one before, and past ones are left out.
    """
    day = lambda c: F.try_to_date(F.trim(F.col(c)), "yyyyMMdd")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    won = lambda c: F.when(F.col(c).try_cast("double") > 0, F.col(c).try_cast("double").cast("long"))
    gone = rows.where(blank("beforePblancId").isNotNull()).select(F.trim("beforePblancId").alias("pblancId")).distinct()
    until = F.coalesce(F.date_add(day("przwnerPresnatnDe"), KEEP_AFTER_WINNERS), day("endDe"))
    kept = rows.where(blank("pblancId").isNotNull() & ~_yes(F.trim("suplyInsttNm").isin(*OTHER_AGENCIES))).join(gone, "pblancId", "left_anti")
    kept = kept.where(~_yes(day("rcritPblancDe") < F.date_sub(today, LOOKBACK_DAYS)) & ~_yes(until < today))
    dated = day("beginDe").isNotNull() | day("endDe").isNotNull()
    return kept.groupBy(F.concat(F.lit("LOC-"), F.col("pblancId")).alias("id")).agg(
        F.min(F.trim("suplyInsttNm")).alias("inst"), F.min(F.trim("pblancNm")).alias("name"), F.min(day("rcritPblancDe")).alias("posted"), F.max(day("endDe")).alias("close"),
        F.array_sort(F.collect_set(F.when(dated, F.struct(blank("hsmpNm").alias("complex"), day("beginDe").alias("apply_start"), day("endDe").alias("apply_end"), day("przwnerPresnatnDe").alias("winner"))))).alias("schedule"),
        F.array_sort(F.collect_set(blank("hsmpNm"))).alias("complexes"), F.sum(won("sumSuplyCo")).alias("households"),
        F.array_sort(F.collect_list(F.when(won("rentGtn").isNotNull() | won("mtRntchrg").isNotNull(), F.struct(blank("hsmpNm").alias("complex"), F.col("houseTyNm").alias("type"), won("rentGtn").alias("deposit"), won("mtRntchrg").alias("rent"))))).alias("rents"),
    )


def still_open(posted: Column, opens: Column, closes: Column, winners: Column, since: Column, today: Column) -> Column:
    """Posted since a day, and until some days after its winners, or until it closes, not over; without any such day it isn't open."""
    return _yes(posted >= since) & _yes(F.coalesce(F.date_add(winners, KEEP_AFTER_WINNERS), closes, opens) >= today)


# --- boards ---------------------------------------------------------------------------------------------------------------------------

def best_file(files: Column, name: str, suffix: str = ".pdf") -> Column:
    """Of an array of structs the file that most likely is the notice: named so first, lists and forms last, otherwise the first."""
    of = F.filter(files, lambda f: F.lower(F.coalesce(f[name], F.lit(""))).endswith(suffix))
    rank = F.transform(of, lambda f, i: F.struct((~f[name].rlike(PREFERRED)).alias("a"), f[name].rlike(LATER).alias("b"), i.alias("i"), f.alias("f")))
    return F.array_min(rank)["f"]


def script_board(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, seq, title, date of the entries of a board whose links call a script; of a number that comes twice the first."""
    link = r"(?s)[A-Za-z_]*[Vv]iew\(\s*'?(\d{5,})'?[^)]*\)[^>]*>(.*?)</a>"
    # each entry with what follows it, in which its date is
    pieces = F.regexp_extract_all(F.col(html), F.lit(rf"{link}(?=(.{{0,1500}}))"), F.lit(0))
    after = F.regexp_extract_all(F.col(html), F.lit(rf"{link}(?=(.{{0,1500}}))"), F.lit(3))
    rows = pages.select(key, F.posexplode(F.arrays_zip(pieces.alias("p"), after.alias("a"))).alias("pos", "x"))
    rows = rows.select(
        key, "pos", F.regexp_extract("x.p", link, 1).alias("seq"), plain_html(F.regexp_extract("x.p", link, 2)).alias("title"),
        F.try_to_date(F.nullif(F.regexp_extract("x.a", r"(20\d\d-\d\d-\d\d)", 1), F.lit("")), "yyyy-MM-dd").alias("date"),
    ).where("title <> ''")
    first = rows.groupBy(key, "seq").agg(F.min_by(F.struct("title", "date"), "pos").alias("r"))
    return first.select(key, "seq", "r.title", "r.date")


def script_files(html: Column) -> Column:
    """The files that a page's script lists: array of struct(oriFileNm, brdId, seq, fileSeq, fileTp); null where there is no such list."""
    return F.from_json(F.nullif(F.regexp_extract(html, r"(?s)downList\s*=\s*(\[.*?\]);", 1), F.lit("")), "array<struct<oriFileNm:string,brdId:string,seq:string,fileSeq:string,fileTp:string>>")


def table_board(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, no, title, date, category, files (array of struct(name, attach)) of the rows of a board that is a table."""
    row = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r")
    title = r"(?s)<td class=\"title\">.*?<a href=\"\?mode=view&(?:amp;)?articleNo=(\d+)[^\"]*\"[^>]*>(.*?)</a>"
    cell = lambda name: F.nullif(plain_html(F.regexp_extract("r", rf"(?s)<td class=\"{name}\">(.*?)</td>", 1)), F.lit(""))
    link = r"(?s)<a[^>]+href=\"(?:\?mode=download&(?:amp;)?articleNo=\d+&(?:amp;)?attachNo=(\d+))\"[^>]*>(.*?)</a>"

    def file(m: Column) -> Column:
        alt = F.nullif(F.regexp_extract(m, r'alt="(?:GH\s)?(.*?)\s?-\s?다운로드"', 1), F.lit(""))
        return F.struct(F.coalesce(alt, plain_html(F.regexp_extract(m, link, 2))).alias("name"), F.regexp_extract(m, link, 1).alias("attach"))

    files = let(F.transform(F.regexp_extract_all(F.col("r"), F.lit(link), F.lit(0)), file), lambda fs: F.filter(fs, lambda f, i: ~F.exists(F.slice(fs, F.lit(1), i), lambda g: g["attach"] == f["attach"])))
    dated = F.regexp_replace(cell("date"), r"^(\d{2})\.", "20$1.")
    rows = pages.select(key, row).where(F.col("r").rlike(title))
    return rows.select(
        key, F.regexp_extract("r", title, 1).alias("no"), plain_html(F.regexp_extract("r", title, 2)).alias("title"), date_of(F.regexp_extract(dated, r"(\d{4}\.\d{1,2}\.\d{1,2})", 1)).alias("date"),
        cell("category").alias("category"), files.alias("files"),
    )


def line_stations(members: DataFrame) -> DataFrame:
    """line, station, lat, lng: the middle of a station's points on each line. members: line, station, lat, lng."""
    name = F.regexp_replace(F.trim("station"), "역$", "")
    return members.where("lat is not null and lng is not null").groupBy(F.trim("line").alias("line"), name.alias("station")).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def nearby_places(homes: DataFrame, places: DataFrame, station_metres: int = 2000, school_metres: int = 1500) -> DataFrame:
    """id, kind, name, metres, walk: the two nearest stations (of one name the nearest) and of each kind of school the nearest.

    homes: id, lat, lng; places: name, lat, lng, kind (station or school). Joined by cells of about station_metres and those around.
    """
    from pyspark.sql import Window

    from hearthline.functions.text import walking_minutes
    from hearthline.operators.market import metres

    step = station_metres / 111_000
    cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
    around = F.explode(F.array(*[F.struct((cell("lat", step) + i).alias("x"), (cell("lng", step / 0.75) + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = places.where("name is not null and lat is not null and lng is not null").select(F.trim("name").alias("name"), F.col("lat").alias("plat"), F.col("lng").alias("plng"), "kind", cell("lat", step).alias("x"), cell("lng", step / 0.75).alias("y"))
    school = F.regexp_extract("name", "(초등학교|중학교|고등학교)$", 1)
    p = p.withColumn("kind", F.when(F.col("kind") == "station", "역").otherwise(F.nullif(school, F.lit("")))).where("kind is not null")
    p = p.withColumn("name", F.when((F.col("kind") == "역") & ~F.col("name").endswith("역"), F.concat("name", F.lit("역"))).otherwise(F.col("name")))
    pairs = homes.select("id", "lat", "lng", around.alias("c")).join(p, (F.col("c.x") == F.col("x")) & (F.col("c.y") == F.col("y")))
    pairs = pairs.withColumn("metres", metres(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))).where(F.col("metres") <= F.when(F.col("kind") == "역", station_metres).otherwise(school_metres))
    each = pairs.groupBy("id", "kind", F.regexp_replace("name", r"(?U)\s+", "").alias("key")).agg(F.min(F.struct("metres", "name")).alias("m"))
    ranked = each.withColumn("rn", F.row_number().over(Window.partitionBy("id", "kind").orderBy("m", "key"))).where(F.col("rn") <= F.when(F.col("kind") == "역", 2).otherwise(1))
    return ranked.select("id", "kind", "m.name", "m.metres", walking_minutes(F.col("m.metres")).alias("walk"))
