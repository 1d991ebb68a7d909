"""Cutting lineage between rounds of an iteration, and spreading few rows with much work each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The shared folder that spark.checkpoint.dir names; only where the setting is unset (tests), a local one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="hearthline-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, cut by way of files, whose size the planner knows; of a checkpoint it knows what its joins might have made."""
    path = f"{_folder(df)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, times: int = 4) -> DataFrame:
    """df over several tasks for each core, by its keys. A small file is one task, and what a join or a rule makes of each row of it would be that task's alone."""
    return df.repartition(times * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows of a task where each makes many of sorts and windows.
ROWS = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys over so many tasks that each has about ROWS of its rows, however many there are: what windows and sorts over the keys hold doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)
