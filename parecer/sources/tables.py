"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parecer.sources.schemas import (
    MULTI_LINE_TABLES,
    ROLLUPS,
    TABLES,
    TIMESTAMP_COLUMNS,
)
from parecer.sources.split_csv import read_split


class LazyTables(Mapping):
    """Tables by name, each opened on first use."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._openers[name]()
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


def _typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    plain = {c: F.col(c).cast(t) for c, t in types.items() if c in df.columns and t != "timestamp"}
    times = [c for c, t in types.items() if c in df.columns and t == "timestamp"]
    return parse_timestamps(df.withColumns(plain) if plain else df, times)


def parse_timestamps(
    df: DataFrame, columns: Iterable[str] = TIMESTAMP_COLUMNS, bad_as_null: bool = False
) -> DataFrame:
    """Text to timestamp. Text that is no time stops the job unless ``bad_as_null``."""
    parse = F.try_to_timestamp if bad_as_null else F.to_timestamp
    parsed = {c: parse(F.col(c)) for c in columns}
    return df.withColumns(parsed) if parsed else df


def _exceeds_a_split(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than what a scan gives one task."""
    largest = spark.read.format("binaryFile").load(path).select(F.max("length")).first()[0] or 0
    return largest > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _csv(
    spark: SparkSession, path: str, multi_line: bool, split: bool | None = None
) -> DataFrame:
    """A CSV file or folder as text columns named by the first header. Files with line breaks
    inside quotes are read by as many tasks as others if ``split``, by default if one of them
    is large enough for two.

    A further file whose header has other names or another order stops the job, since its
    values would be taken for those of other columns. A byte-order mark is no part of a name.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    names = [c.lstrip("\ufeff") for c in spark.read.options(**options).csv(path).columns]
    if multi_line and (_exceeds_a_split(spark, path) if split is None else split):
        return read_split(spark, path, names, {"escape": '"'})
    schema = StructType([StructField(name, StringType()) for name in names])
    return spark.read.options(enforceSchema=False, **options).schema(schema).csv(path)


def read_csv(
    spark: SparkSession, path: str, table: str, split: bool | None = None
) -> DataFrame:
    """One CSV table. Columns are matched by header name; nothing is inferred from rows.

    A table with free text is read by splits where a file has several; ``split`` on or off
    settles it. Off, a file goes to one task, which also takes quotes inside unquoted fields.
    """
    return _typed(_csv(spark, path, table in MULTI_LINE_TABLES, split), TABLES.get(table, {}))


def read_tables(
    spark: SparkSession, folder: str, files: Mapping[str, str] | None = None,
    split: bool | None = None,
) -> LazyTables:
    """The nine tables from CSV files or folders; ``files`` maps table to file name."""
    files = files or {name: f"{name}.csv" for name in TABLES}
    openers = {
        name: (lambda n=name, f=file: read_csv(spark, f"{folder}/{f}", n, split))
        for name, file in files.items()
    }
    openers.setdefault("text_reviews", lambda: tables["reviews"])
    tables = LazyTables(openers)
    return tables


def read_parquet_tables(spark: SparkSession, folder: str) -> LazyTables:
    """The tables that ``write_tables`` wrote."""
    openers = {
        name: (lambda n=name: spark.read.parquet(f"{folder}/{n}")) for name in TABLES
    }
    openers["text_reviews"] = lambda: tables["reviews"]
    tables = LazyTables(openers)
    return tables


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Write a table in parallel, replacing what is there."""
    df.write.mode("overwrite").options(**options).format(fmt).save(path)
    return path


def save_table(df: DataFrame, name: str) -> str:
    """Write a catalog table, replacing what is there."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return name


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """All tables as Parquet. Done once, it spares every later step the CSV scan."""
    return {name: write_table(tables[name], f"{folder}/{name}") for name in TABLES}


def read_rollup(spark: SparkSession, path: str, rollup: str) -> DataFrame:
    """One dashboard roll-up file: its known columns, found by name."""
    raw = _csv(spark, path, multi_line=False)
    known = StructType.fromDDL(ROLLUPS[rollup])
    return raw.select(*[F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in known])
