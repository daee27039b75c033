"""Shards of near-equal size: a minimax contiguous partition of ordered atomic groups.

Equal texts stay together: they share a hash, and the hash decides their unit, one of
``UNITS`` ranges. The units' sizes are summed in Spark; the search over their ordered array,
bounded by ``UNITS`` whatever the corpus, is a SQL expression on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parecer.llm.storage import written

SHARDS = 24
#: Ranges of the text hash, each an atomic group of whole groups of equal texts.
UNITS = 1 << 16
#: Parts of a shard in which rows are numbered by themselves.
CELLS = 1024
#: Bytes a row costs beside its text.
ROW_BYTES = 8

#: Units as (size, unit). A unit above the fair share of what the larger ones leave gets a
#: shard of its own; ``fair`` settles within as many steps as there are shards.
_FAIR = """aggregate(sequence(1, {n}), total / {n}D, (fair, i) ->
  (total - aggregate(filter(units, u -> u.size > fair), 0L, (s, u) -> s + u.size))
  / ({n}D - size(filter(units, u -> u.size > fair))))"""
#: Shards that a greedy pass needs at a capacity.
_NEEDED = """aggregate(light, struct(1 as shards, 0L as fill), (s, u) ->
  if(s.fill + u.size <= {cap}, struct(s.shards as shards, s.fill + u.size as fill),
     struct(s.shards + 1 as shards, u.size as fill)), s -> s.shards)"""
_CAPACITY = """aggregate(sequence(1, 63),
  struct(greatest(array_max(transform(light, u -> u.size)), 0L) as low, total as high),
  (r, i) -> if(r.low >= r.high, r, if({fits} <= places,
    struct(r.low as low, (r.low + r.high) div 2 as high),
    struct((r.low + r.high) div 2 + 1 as low, r.high as high))), r -> r.low)"""
_CUTS = """aggregate(light, struct(0L as fill, cast(array() as array<int>) as cuts), (s, u) ->
  if(s.fill + u.size <= capacity, struct(s.fill + u.size as fill, s.cuts as cuts),
     struct(u.size as fill, concat(s.cuts, array(u.unit)) as cuts)), s -> s.cuts)"""


def cut_points(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row of ``unit``, ``size`` rows: ``heavy`` (units with a shard of their own),
    ``capacity`` (the smallest with which the others fit the remaining shards, in unit order)
    and ``cuts`` (the units at which a new shard begins)."""
    fits = _NEEDED.format(cap="(r.low + r.high) div 2")
    return (
        sizes.agg(
            F.array_sort(F.collect_list(F.struct("unit", "size"))).alias("units"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("total"),
        )
        .withColumn("fair", F.expr(_FAIR.format(n=shards)))
        .withColumn("heavy", F.expr("transform(filter(units, u -> u.size > fair), u -> u.unit)"))
        .withColumn("light", F.expr("filter(units, u -> u.size <= fair)"))
        .withColumn("places", F.lit(shards) - F.size("heavy"))
        .withColumn("capacity", F.expr(_CAPACITY.format(fits=fits)))
        .select("heavy", "capacity", F.expr(_CUTS).alias("cuts"))
    )


def _shard(unit: Column, heavy: list[int], cuts: list[int]) -> Column:
    out = F.lit(len(heavy))
    for cut in cuts:
        out = out + (unit >= cut).cast("int")
    for i, own in enumerate(heavy):
        out = F.when(unit == own, i).otherwise(out)
    return out.cast("int")


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``documents``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the largest shard is as small as contiguous units allow. Equal texts
    are in one shard, a null text with the empty ones. Slots number a shard's rows from 0
    without gaps; repeated rows get a slot each, and so do rows without doc_id. Other columns
    are not read. An empty table gives none.

    Only sizes and checksums are kept of the texts. Rows are numbered in ``CELLS`` parts of
    each shard, dealt by id, so neither a shard nor a group of equal texts meets in one task.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(
        documents.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - UNITS.bit_length() + 1).cast("int")
            .alias("unit"),
        ),
        "sizes",
    )
    # At most ``shards`` numbers in either list.
    found = cut_points(rows.groupBy("unit").agg(F.sum("size").alias("size")), shards).first()
    placed = rows.withColumn("shard", _shard(F.col("unit"), found["heavy"], found["cuts"]))
    celled = placed.withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most ``shards * CELLS`` rows.
    offsets = (
        celled.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")
    return (
        celled.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
