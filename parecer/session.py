"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MB = 1024 * 1024
#: Bytes that one shuffle partition is planned for, and what a scan split has at most.
SHUFFLE_PARTITION_BYTES = 512 * MB
LEAST_SPLIT_BYTES, MOST_SPLIT_BYTES = 128 * MB, 512 * MB
#: The driver keeps the sizes of map times reduce blocks, so more do not help.
MOST_PARTITIONS = 40_000
#: What column pruning leaves of an input, by default.
KEPT_SHARE = 0.25


def settings_for(input_bytes: int, cores: int, kept_share: float = KEPT_SHARE) -> dict[str, str]:
    """Session settings for an input of this size on this many cores.

    Shuffles are planned for about half a gigabyte per partition of what pruning leaves, and
    AQE merges what turns out small, so one setting serves a filtered and an unfiltered query.
    Scan splits grow with the input, so that a scan of many terabytes has a bounded number of
    map tasks per core.
    """
    shuffled = -(-int(input_bytes * kept_share) // SHUFFLE_PARTITION_BYTES)
    split = min(max(input_bytes // (cores * 64), LEAST_SPLIT_BYTES), MOST_SPLIT_BYTES)
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(min(max(cores, shuffled), MOST_PARTITIONS)),
        "spark.sql.files.maxPartitionBytes": str(split),
    }


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, whatever store it is in."""
    files, where = _file_system(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


def apply_settings(spark: SparkSession, *paths: str) -> None:
    """Sets the session up for the tables under ``paths`` and the cluster's cores."""
    size = sum(stored_bytes(spark, p) for p in paths)
    for key, value in settings_for(size, spark.sparkContext.defaultParallelism).items():
        spark.conf.set(key, value)


def local_session(
    cores: int | str = 8,
    app: str = "parecer",
    memory: str = "8g",
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    width = int(cores) if str(cores).isdigit() else (os.cpu_count() or 8)
    for key, value in {**settings_for(0, width), **(settings or {})}.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="parecer-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    if sc.applicationId not in _ending:
        _ending.add(sc.applicationId)
        _delete_at_end(spark, sc.getCheckpointDir())  # a folder of this application alone
    return folder


#: Applications whose checkpoints are deleted when they end.
_ending: set[str] = set()


def _delete_at_end(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)


#: The folder of each application's intermediate tables.
_scratch: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same one. What is written there
    is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark).rstrip('/')}/parecer-{uuid.uuid4().hex}"
        _delete_at_end(spark, _scratch[app])
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder, so that two passes see the same rows
    in the same partitions and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
