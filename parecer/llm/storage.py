"""Intermediate tables in the shared folder, and bounded batches for Python tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parecer.session import _file_system, scratch_path

#: Rows that one Arrow batch carries to Python. Tasks cut batches further by bytes.
BATCH_ROWS = 1024
#: Stands for a missing doc_id where rows are matched by it.
NO_ID = -(2**63)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave and nothing reads any more."""
    paths = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for path in paths:
        files, where = _file_system(df.sparkSession, path)
        files.delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Keeps what a Python worker holds at once to ``BATCH_ROWS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identity() -> tuple[Column, Column]:
    """Two columns that tell rows of documents apart by id and text, so that a repeated id
    with another text is another document and a missing id is no special case."""
    return (
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_key"),
        F.xxhash64(F.col("text")).alias("text_key"),
    )


def once_per_process(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a worker process and kept for its later tasks; the
    code of a task itself arrives anew each time."""
    kept = sys.modules.setdefault("_parecer_process", types.ModuleType("_parecer_process"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)
