"""The registry of queries: each under its name, with the SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthline.operators import lineage

Query = Callable[[SparkSession, str], DataFrame]
found_queries: dict[str, Query] = {}
found_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL of its oracle."""

    def register(f: Query) -> Query:
        found_queries[f.__name__] = f
        if sql is not None:
            found_sql[f.__name__] = sql
        return f

    return register


def facts(spark: SparkSession, sf_dir: str, sql: str, *tables: str, dealt: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows of a SELECT that both engines read alike; tables are named in it as they are. dealt: tables that are dealt by keys over tasks of a bounded number of rows."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    frames |= {t: lineage.dealt(frames[t], frames[t].count(), *keys) for t, keys in (dealt or {}).items()}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)


def quoted(value) -> str:
    """A literal of both engines."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def cases(key: str, values: list) -> str:
    """The value at key modulo their number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"
