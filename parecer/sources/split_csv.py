"""CSV with line breaks inside quotes, read by many tasks.

Where a record begins depends on all quotes before it, so Spark reads such a file in one task.
Here a first pass counts the quotes of every scan split; the running parity over the splits of
a file says which of them begin inside quotes. Then every split joins its own lines to records.
What straddles splits, one piece at either end of a split at most, is put together in a
grouping of those pieces alone. The fields are parsed by Spark's own CSV expression.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Functions sent to executors carry their code along, so executors need no copy of this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A record whose quotes are either around a whole field or doubled inside one.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
WELL_FORMED = rf"^{_FIELD}(?:,{_FIELD})*\r?$"
BYTE_ORDER_MARK = "\ufeff"
#: What a text of a split is: a record, a file's first record, or the piece of a record that
#: goes on from another split, or that begins here and goes on in another.
WHOLE, HEADER, GOES_ON, BEGINS, HEADER_BEGINS = range(5)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of their split, with the split they lie in."""
    return (
        spark.read.text(path, lineSep="\n")
        .select(
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            "value",
        )
    )


def splits_inside_quotes(lines: DataFrame) -> dict[tuple[int, int], bool]:
    """Whether each split begins inside quotes; one flag for each split of the scan."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    found = (
        lines.groupBy("file", "split").agg(F.sum(quotes).alias("n"))
        .select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).alias("odd"))
    )
    return {(r["file"], r["split"]): bool(r["odd"]) for r in found.collect()}


def _check(texts: pa.Array) -> None:
    bad = texts.filter(pc.invert(pc.match_substring_regex(texts, WELL_FORMED)))
    if len(bad):
        raise ValueError(f"a quote inside an unquoted field; read it unsplit: {bad[0]}"[:500])


class _Split:
    """The lines of one split, joined to records as they come."""

    def __init__(self, file: int, start: int, inside: bool):
        self.file, self.start, self.odd, self.goes_on = file, start, inside, inside
        self.first = start == 0
        self.fresh = self.first
        self.open: list[pa.Array] = []

    def _sent(self, kinds: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        _check(texts.filter(pa.array(kinds <= HEADER)))
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n, pa.int64()), pa.array([self.start] * n, pa.int64()),
             pa.array(kinds, pa.int32()), texts.cast(pa.string())],
            names=["file", "split", "kind", "text"],
        )

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.fresh:
            bare = lines[0].as_py().removeprefix(BYTE_ORDER_MARK)
            lines = pa.concat_arrays([pa.array([bare], lines.type), lines.slice(1)])
            self.fresh = False
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        parity = (np.cumsum(quotes) + self.odd) % 2
        ends = np.flatnonzero(parity == 0)
        self.odd = bool(parity[-1])
        if len(ends):
            last = int(ends[-1]) + 1
            limits = np.concatenate(([0], ends + 1 + sum(map(len, self.open))))
            joined = pa.concat_arrays([*self.open, lines.slice(0, last)])
            lists = pa.LargeListArray.from_arrays(pa.array(limits.astype(np.int64)), joined)
            kinds = np.full(len(ends), WHOLE)
            if self.goes_on or self.first:
                kinds[0] = GOES_ON if self.goes_on else HEADER
            self.goes_on = self.first = False
            self.open, lines = [], lines.slice(last)
            yield self._sent(kinds, pc.binary_join(lists, pa.scalar("\n", joined.type)))
        if len(lines):
            self.open.append(lines)

    def end(self) -> Iterator[pa.RecordBatch]:
        """What is left open. Where no record ended, all of it goes on from another split."""
        if self.open:
            lines = pa.concat_arrays(self.open)
            lists = pa.LargeListArray.from_arrays(pa.array([0, len(lines)], pa.int64()), lines)
            begins = HEADER_BEGINS if self.first else BEGINS
            yield self._sent(
                np.array([GOES_ON if self.goes_on else begins]),
                pc.binary_join(lists, pa.scalar("\n", lines.type)),
            )


def _records(batches: Iterator[pa.RecordBatch], inside: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (file, split, kind, text) of a task's splits."""
    now: _Split | None = None
    for batch in batches:
        files, starts = (batch.column(k).to_numpy() for k in range(2))
        values = batch.column(2).cast(pa.large_string())
        change = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        limits = [0, *change.tolist(), batch.num_rows]
        for i, j in zip(limits, limits[1:]):
            if i == j:
                continue
            key = (int(files[i]), int(starts[i]))
            if now is None or (now.file, now.start) != key:
                if now:
                    yield from now.end()
                if key not in inside.value:
                    raise ValueError("the splits of the scan changed between the two passes")
                now = _Split(*key, inside.value[key])
            yield from now.add(values.slice(i, j - i))
    if now:
        yield from now.end()


def _put_together(pieces: DataFrame) -> DataFrame:
    """Records that lie in several splits, from their pieces."""
    order = Window.partitionBy("file").orderBy("split", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    parts = F.array_sort(F.collect_list(F.struct("split", "kind", "text")))
    return (
        pieces.withColumn("record", F.count_if(F.col("kind") >= BEGINS).over(order))
        .groupBy("file", "record").agg(parts.alias("parts"))
        .select(
            F.when(F.col("parts")[0]["kind"] == HEADER_BEGINS, HEADER).otherwise(WHOLE)
            .alias("kind"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
        )
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _check(batch.column(1))
        yield batch


def records(spark: SparkSession, path: str) -> DataFrame:
    """``kind`` (``WHOLE`` or ``HEADER``) and ``text`` of every record of a file or folder."""
    lines = _lines(spark, path)
    inside = spark.sparkContext.broadcast(splits_inside_quotes(lines))
    found = lines.mapInArrow(
        lambda batches: _records(batches, inside), "file long, split long, kind int, text string"
    )
    whole = found.where(F.col("kind") <= HEADER).select("kind", "text")
    pieces = _put_together(found.where(F.col("kind") > HEADER))
    return whole.unionByName(pieces.mapInArrow(_checked, "kind int, text string"))


def read_split(
    spark: SparkSession, path: str, names: Sequence[str], options: Mapping[str, str]
) -> DataFrame:
    """A CSV file or folder as text columns of the given names, its header's.

    A file with another header stops the job, as does a quote inside an unquoted field, since
    nobody can tell then where records begin without reading from the start. Line breaks
    inside fields come out as single line feeds, and empty lines are skipped.
    """
    text = F.replace(F.rtrim(F.col("text"), F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = records(spark, path).select("kind", text.alias("text")).withColumn(
        "row", F.from_csv("text", F.lit(schema), dict(options))
    )
    header = F.array(*[F.col("row").getField(n) for n in names])
    same = header == F.array(*[F.lit(n) for n in names])
    other = F.raise_error(F.concat(F.lit("a file has another header: "), "text")).cast("boolean")
    # Part of the filter, so that no plan leaves the headers unread.
    kept = F.when(F.col("kind") == HEADER, F.when(same, F.lit(False)).otherwise(other)).otherwise(
        F.col("text") != ""
    )
    return parsed.where(kept).select(*[F.col("row").getField(n).alias(n) for n in names])
