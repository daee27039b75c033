"""Sorting, top-k, shares, histograms and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parecer.functions.ladders import position
from parecer.functions.measures import share
from parecer.session import materialize


def sort_topk(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; the order should end in a key so that ties are settled."""
    return df.orderBy(*order).limit(k)


def nlargest(df: DataFrame, k: int, column: str, *ties: str) -> DataFrame:
    """The k rows with the largest value, nulls left out."""
    return sort_topk(df.where(F.col(column).isNotNull()), k, F.col(column).desc(), *ties)


def manual_sort(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows in the listed order of a column, with their place; unlisted values last."""
    place = position(F.col(column), order)
    return df.withColumn("ord", F.when(place > 0, place).otherwise(len(order) + 1)).orderBy(
        "ord", column
    )


def with_share(df: DataFrame, count: str = "n", name: str = "pct") -> DataFrame:
    """Adds each row's percentage of the column total.

    For grouped results with few rows (scores, statuses, payment types): the total is a
    window over all rows.
    """
    total = F.sum(count).over(Window.partitionBy())
    return df.withColumn(name, share(F.col(count), total))


def literal_rows(spark: SparkSession, name: str, values: Sequence) -> DataFrame:
    """One row per listed value."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per distinct value, with map-side combining; nulls form a group of their own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def histogram(counts: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed.

    ``counts`` holds whole-number values and how often each occurs (``n``), so this works on
    one row per distinct value, in one pass. Empty bins are listed with 0. A single value
    gives a range of width 1 around it.
    """
    everything = Window.partitionBy()
    x, low, high = F.col(value), F.col("low"), F.col("high")
    span = high - low
    bounded = counts.where(x.isNotNull()).select(
        x.alias(value),
        "n",
        F.min(x).over(everything).alias("low"),
        F.max(x).over(everything).alias("high"),
    )
    place = F.when(span == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((x - low) * bins / F.when(span != 0, span)), F.lit(bins - 1))
    )
    # As many entries as bins.
    filled = (
        bounded.groupBy(place.cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"), F.max(low).alias("low"), F.max(high).alias("high"))
        .agg(
            F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"),
            F.max(low).cast("double").alias("low"),
            F.max(high).cast("double").alias("high"),
        )
        .where(low.isNotNull())
    )
    start = F.when(span == 0, low - 0.5).otherwise(low)
    width = F.when(span == 0, 1.0).otherwise(span) / bins
    bin_no = F.col("bin")
    return filled.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        start.alias("start"),
        width.alias("width"),
        "by_bin",
    ).select(
        "bin",
        (F.col("start") + bin_no * F.col("width")).alias("lo"),
        (F.col("start") + (bin_no + 1) * F.col("width")).alias("hi"),
        F.coalesce(F.try_element_at("by_bin", bin_no), F.lit(0)).alias("n"),
    )


def sums_of_largest(
    df: DataFrame, amount: str, ks: Sequence[int], ranges: int = 4096
) -> list[int]:
    """For each k the sum of the k largest values of a whole-number column, or of all if there
    are fewer; nulls count nowhere.

    Nothing is ranked: the range that holds the k-th largest value is cut into ``ranges``
    equal ones again and again by counts and sums, until it is one value, of which as many
    are taken as fit, or all in it belong. A round is one aggregate over ``df``, which should
    be kept or stored; there are at most six, whatever the number of rows. One row per k
    returns from each.
    """
    x = F.col(amount)
    low, high = df.agg(F.min(x), F.max(x)).first()
    # What is above the range of the k-th value, and the range: [low, low + span).
    found = [0] * len(ks)
    search = {
        i: (k, 0, 0, low, high - low + 1) for i, k in enumerate(ks) if k > 0 and low is not None
    }
    while search:
        steps = {i: -(-s[4] // ranges) for i, s in search.items()}
        places = [
            F.when(
                (x >= start) & (x < start + span),
                F.struct(F.lit(i).alias("i"),
                         F.expr(f"({amount} - {start}) div {steps[i]}").alias("place")),
            )
            for i, (_, _, _, start, span) in search.items()
        ]
        inside = F.filter(F.array(*places), lambda p: p.isNotNull())
        # At most ``ranges`` rows for each k from here on.
        counts = (
            df.select(x.cast("long").alias("x"), F.explode(inside).alias("p"))
            .groupBy("p.i", "p.place").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"))
        )
        above = Window.partitionBy("i").orderBy(F.desc("place")).rowsBetween(
            Window.unboundedPreceding, -1
        )
        needed = F.create_map(*[F.lit(v) for i, s in search.items() for v in (i, s[0] - s[1])])
        counts = counts.select(
            "*", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
            F.coalesce(F.sum("sum").over(above), F.lit(0)).alias("sum_above"),
            F.min("place").over(Window.partitionBy("i")).alias("least"),
            needed[F.col("i")].alias("needed"),
        ).where(
            (F.col("n_above") < F.col("needed"))
            & ((F.col("n_above") + F.col("n") >= F.col("needed"))
               | (F.col("place") == F.col("least")))
        )
        for r in counts.collect():
            i = r["i"]
            k, n, total, start, span = search[i]
            n, total = n + r["n_above"], total + r["sum_above"]
            end, start = start + span, start + r["place"] * steps[i]
            if n + r["n"] <= k:
                found[i] = total + r["sum"]
            elif steps[i] == 1:
                found[i] = total + (k - n) * start
            else:
                search[i] = (k, n, total, start, min(steps[i], end - start))
                continue
            del search[i]
    return found


def running_share(df: DataFrame, amount: str, key: str) -> DataFrame:
    """Rank, cumulative share and rank percentile of every row, largest amount first.

    A window over all rows would sort them in one task. Instead the rows are split into
    ranges of (amount, key), each range is ranked by itself, and the totals of the ranges
    before it are added. The key takes part in the split, so any number of rows with the
    same amount still spread over the ranges. The split is written once, since both passes
    must see the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(amount).desc(), F.col(key).asc()]
    split = materialize(
        df.select(key, amount)
        .repartitionByRange(parts, *ordered)
        .withColumn("part", F.spark_partition_id())
    )
    # One row per range, at most ``parts`` of them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = (
        split.groupBy("part")
        .agg(F.sum(amount).alias("part_sum"), F.count(F.lit(1)).alias("part_n"))
        .select(
            "part",
            F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("sum_before"),
            F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("n_before"),
            F.sum("part_sum").over(everything).alias("total"),
            F.sum("part_n").over(everything).alias("n_total"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*ordered)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        split.join(offsets, "part")
        .withColumn("rank", F.row_number().over(inside) + F.col("n_before"))
        .withColumn("cum", F.sum(amount).over(upto) + F.col("sum_before"))
        .select(
            key,
            amount,
            "rank",
            "n_total",
            "total",
            share(F.col("cum"), F.col("total")).alias("cum_pct"),
            share(F.col("rank"), F.col("n_total")).alias("rank_pct"),
        )
    )
