"""Paged HTTP services as Spark data sources: transactions by kind, district and month, and notices with their house types.

    register(spark)
    spark.read.format("housing_trades").option("url", ..).option("key", ..).option("districts", "11110,11140").option("months", "202608,202609").load()

A partition is what the service is asked for by itself, and Spark's tasks are the parallel requests: a task that is lost asks again. Filters on kind, district and month
leave out whole partitions; a filter on a notice's day goes to the service, and is applied here where the service refuses it. Whether there is another page is told by the rows
that a page holds before any are dropped. Errors of the connection, of the server (5xx), of too many requests (429) and answers that can't be read are asked again after a
pause that grows; a refused key (401, 403) and a used-up quota aren't. `onerror` fail (the default) fails the query; `report` gives a row that has nothing but the partition and
the error, so that what is missing can be counted. After `deadline` (seconds since 1970) no request is begun, and what is left is reported or fails.

`housing_trades` also streams: an offset is a month, and each batch reads the months that came since, so that a restart neither loses nor repeats one.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

from hearthline.sources.notices import TRANSACTION_NUMBER, TRANSACTION_OTHER, TRANSACTION_TEXT

# Names of the services' paths and parameters.
TRADE_PATHS = {
    "trade": "/RTMSDataSvcAptTrade/getRTMSDataSvcAptTrade", "presale": "/RTMSDataSvcSilvTrade/getRTMSDataSvcSilvTrade", "rent": "/RTMSDataSvcAptRent/getRTMSDataSvcAptRent",
}
NOTICE_PATHS = {
    "general": ("/getAPTLttotPblancDetail", "/getAPTLttotPblancMdl"), "remainder": ("/getRemndrLttotPblancDetail", "/getRemndrLttotPblancMdl"),
}
TAGS = [*TRANSACTION_TEXT, *TRANSACTION_NUMBER, *TRANSACTION_OTHER]
FINE = (None, "00", "000")

#: Rows of a full page, and most pages of a partition.
TRADE_ROWS, TRADE_PAGES = 1000, 19
NOTICE_ROWS, NOTICE_PAGES = 100, 30
TRIES, PAUSE = 3, 1.5


class ServiceError(RuntimeError):
    """again: whether asking again may help. refused: whether the service refused what it was asked for."""

    def __init__(self, message: str, again: bool = False, refused: bool = False):
        super().__init__(re.sub(r"(serviceKey=)[^&\s']+", r"\1***", message)[:200])
        self.again, self.refused = again, refused


class Service:
    """Requests to a service, with its key, its pauses and its deadline."""

    def __init__(self, options: dict[str, str]):
        self.url, self.key = options["url"].rstrip("/"), options.get("key", "")
        self.pause, self.timeout = float(options.get("pause", PAUSE)), float(options.get("timeout", 15))
        self.deadline = float(options["deadline"]) if "deadline" in options else None
        self.report = options.get("onerror", "fail") == "report"

    def _once(self, path: str, asked: dict) -> bytes:
        query = urllib.parse.urlencode({"serviceKey": self.key, **asked})
        try:
            with urllib.request.urlopen(f"{self.url}{path}?{query}", timeout=self.timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            raise ServiceError(f"{path} answers {e.code}", again=e.code == 429 or e.code >= 500, refused=400 <= e.code < 500 and e.code not in (401, 403, 429)) from None
        except OSError as e:
            raise ServiceError(f"{path}: {e}", again=True) from None

    def ask(self, path: str, asked: dict, parse):
        for i in range(TRIES):
            if self.deadline is not None and time.time() > self.deadline:
                raise ServiceError("not asked for: the time was over")
            try:
                return parse(self._once(path, asked))
            except ServiceError as e:
                if not e.again or i == TRIES - 1:
                    raise
            time.sleep(self.pause * (i + 1))


def parse_trades(body: bytes) -> list[list[str | None]]:
    """The items of a page by TAGS, cancelled ones too."""
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        raise ServiceError(f"no XML: {body[:80]!r}", again=True) from None
    code = root.findtext(".//resultCode")
    if code not in FINE:
        said = root.findtext(".//resultMsg") or ""
        raise ServiceError(f"error {code}: {said}", again="LIMITED" not in said)
    return [[item.findtext(t) for t in TAGS] for item in root.iter("item")]


def parse_rows(body: bytes) -> list[dict]:
    try:
        return json.loads(body).get("data", [])
    except (ValueError, AttributeError):
        raise ServiceError(f"no JSON: {body[:80]!r}", again=True) from None


def _listed(options: dict[str, str], name: str, default: str = "") -> list[str]:
    return [x for x in re.split(r"[\s,]+", options.get(name, default)) if x]


def _narrowed(values: dict[str, list[str]], filters: list[Filter]) -> Iterator[Filter]:
    """Narrows the values of partition columns by equality and lists; the other filters are left to Spark."""
    for f in filters:
        name = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else ""
        if name not in values:
            yield f
            continue
        wanted = set(map(str, f.value if isinstance(f, In) else [f.value]))
        values[name] = [v for v in values[name] if v in wanted]


def _batch(columns: list[str], rows: list[list[str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], names=columns)


# --- transactions ------------------------------------------------------------------------------------------------------------------

TRADE_COLUMNS = ["kind", "district", "month", "page", *TAGS, "error"]


@dataclass
class Month(InputPartition):
    kind: str
    district: str
    month: str

    def __post_init__(self):
        super().__init__(None)


def read_month(options: dict[str, str], m: Month) -> Iterator[pa.RecordBatch]:
    service, size = Service(options), int(options.get("rows", TRADE_ROWS))
    for page in range(1, int(options.get("pages", TRADE_PAGES)) + 1):
        at = [m.kind, m.district, m.month, str(page)]
        try:
            found = service.ask(TRADE_PATHS[m.kind], {"LAWD_CD": m.district, "DEAL_YMD": m.month, "numOfRows": size, "pageNo": page}, parse_trades)
        except ServiceError as e:
            if not service.report:
                raise
            yield _batch(TRADE_COLUMNS, [[*at, *[None] * len(TAGS), str(e)]])
            return
        if found:
            yield _batch(TRADE_COLUMNS, [[*at, *row, None] for row in found])
        if len(found) < size:
            return


class TradeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.values = {"kind": _listed(options, "kinds", ",".join(TRADE_PATHS)), "district": _listed(options, "districts"), "month": _listed(options, "months")}

    def pushFilters(self, filters):
        return list(_narrowed(self.values, filters))

    def partitions(self):
        return [Month(k, d, m) for k in dict.fromkeys(self.values["kind"]) for d in dict.fromkeys(self.values["district"]) for m in dict.fromkeys(self.values["month"])]

    def read(self, partition):
        return read_month(self.options, partition)


def next_month(month: str) -> str:
    return f"{int(month) + 1}" if month[4:] != "12" else f"{int(month[:4]) + 1}01"


class TradeStream(DataSourceStreamReader):
    """Months from `start`; the newest is `until`, or the month that it is."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self):
        return {"next": self.options["start"]}

    def latestOffset(self):
        return {"next": next_month(self.options.get("until") or time.strftime("%Y%m", time.gmtime()))}

    def partitions(self, start, end):
        out, month = [], start["next"]
        while month < end["next"]:
            out += [Month(k, d, month) for k in _listed(self.options, "kinds", ",".join(TRADE_PATHS)) for d in _listed(self.options, "districts")]
            month = next_month(month)
        return out

    def read(self, partition):
        return read_month(self.options, partition)

    def commit(self, end):
        pass


class Trades(DataSource):
    @classmethod
    def name(cls):
        return "housing_trades"

    def schema(self):
        return ", ".join(f"`{c}` string" for c in TRADE_COLUMNS)

    def reader(self, schema):
        return TradeReader(dict(self.options))

    def streamReader(self, schema):
        return TradeStream(dict(self.options))


# --- notices and house types ---------------------------------------------------------------------------------------------------------

NOTICE_COLUMNS = ["category", "notice_no", "announced", "body", "error"]


@dataclass
class Category(InputPartition):
    category: str
    since: str | None = None

    def __post_init__(self):
        super().__init__(None)


def day_of(value) -> str | None:
    digits = re.sub("[^0-9]", "", str(value or ""))
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}" if len(digits) >= 8 else None


def read_notices(options: dict[str, str], c: Category) -> Iterator[pa.RecordBatch]:
    """Overviews, the newest first. Where the service refuses the filter, pages are read until one has nothing that is new enough."""
    service, size, path, filtering, page = Service(options), int(options.get("rows", NOTICE_ROWS)), NOTICE_PATHS[c.category][0], c.since is not None, 1
    held: list[list[list[str | None]]] = []
    while page <= int(options.get("pages", NOTICE_PAGES)):
        asked = {"page": page, "perPage": size, "returnType": "JSON"} | ({"cond[RCRIT_PBLANC_DE::GTE]": c.since} if filtering else {})
        try:
            found = service.ask(path, asked, parse_rows)
        except ServiceError as e:
            if filtering and e.refused:  # from the first page again, without the filter
                filtering, page, held = False, 1, []
                continue
            if not service.report:
                raise
            held.append([[c.category, None, None, None, str(e)]])
            break
        fresh = [d for d in found if c.since is None or (day_of(d.get("RCRIT_PBLANC_DE")) or "") >= c.since]
        held.append([[c.category, str(d.get("PBLANC_NO") or d.get("HOUSE_MANAGE_NO") or ""), day_of(d.get("RCRIT_PBLANC_DE")), json.dumps(d, ensure_ascii=False), None] for d in fresh])
        if len(found) < size or (c.since is not None and not filtering and not fresh):
            break
        page += 1
    for rows in held:
        if rows:
            yield _batch(NOTICE_COLUMNS, rows)


class NoticeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.since = options, options.get("since")
        self.values = {"category": _listed(options, "categories", ",".join(NOTICE_PATHS))}

    def pushFilters(self, filters):
        for f in _narrowed(self.values, filters):
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("announced",):
                self.since = max(self.since or "", str(f.value))
            yield f  # a day is compared by Spark too: a service may not filter as it should

    def partitions(self):
        return [Category(c, self.since) for c in dict.fromkeys(self.values["category"])]

    def read(self, partition):
        return read_notices(self.options, partition)


class Notices(DataSource):
    @classmethod
    def name(cls):
        return "housing_notices"

    def schema(self):
        return ", ".join(f"{c} string" for c in NOTICE_COLUMNS)

    def reader(self, schema):
        return NoticeReader(dict(self.options))


def units_of(notices: DataFrame, options: dict[str, str], tasks: int = 8) -> DataFrame:
    """category, notice_no, body, error: the house types of each notice, asked for by number, with as many requests at once as tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = Service(options)
        for batch in batches:
            for category, number in zip(*(batch.column(c).to_pylist() for c in ("category", "notice_no")), strict=True):
                try:
                    found = service.ask(NOTICE_PATHS[category][1], {"page": 1, "perPage": NOTICE_ROWS, "returnType": "JSON", "cond[PBLANC_NO::EQ]": number}, parse_rows)
                    rows = [[category, number, json.dumps(d, ensure_ascii=False), None] for d in found]
                except ServiceError as e:
                    if not service.report:
                        raise
                    rows = [[category, number, None, str(e)]]
                if rows:
                    yield _batch(["category", "notice_no", "body", "error"], rows)

    wanted = notices.where("error is null and notice_no <> ''").select("category", "notice_no").distinct()
    return wanted.repartition(tasks, "notice_no").mapInArrow(run, "category string, notice_no string, body string, error string")


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Trades, Notices):
        spark.dataSource.register(source)

