"""Which categories turn delay into bad reviews.

One conditional group-by gives a row per category; every report below reads that row set,
which has as many rows as there are categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parecer.functions.measures import (
    flag,
    money_mean,
    money_sum,
    rate_among,
    rate_of,
    rounded_even,
    share,
)
from parecer.operators.ranking import sort_topk

LATE, BAD = "is_delayed", "is_bad"


def category_stats(facts: DataFrame, category: str = "category") -> DataFrame:
    """Counts, rates and value per category, split by late and on time."""
    late, bad = F.col(LATE) == 1, F.col(BAD) == 1
    return facts.groupBy(category).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(LATE).alias("delayed_orders"),
        F.sum(BAD).alias("bad_orders"),
        F.sum(flag(late & bad)).alias("delayed_bad"),
        F.sum(flag(~late & bad)).alias("ontime_bad"),
        rate_of(late).alias("delay_rate"),
        rate_of(bad).alias("bad_rate"),
        rate_among(bad, late).alias("bad_delayed"),
        rate_among(bad, ~late).alias("bad_ontime"),
        money_sum(F.col("gmv")).alias("total_gmv"),
        money_mean(F.col("gmv")).alias("avg_gmv"),
    )


def _overall(column: str) -> Column:
    everything = Window.partitionBy()
    return share(F.sum(column).over(everything), F.sum("orders").over(everything))


def pp_vs_overall(rate: Column, overall: Column, name: str) -> list[Column]:
    """Distance of a rate to the overall rate in points, and on which side it lies."""
    return [
        F.abs(rate - overall).alias(f"{name}_gap_pp"),
        F.when(rate > overall, "↑").otherwise("↓").alias(f"{name}_flag"),
    ]


def category_gaps(stats: DataFrame, min_orders: int = 100) -> DataFrame:
    """Late and bad rate of each category against the overall rates.

    Rates are rounded half to even before they are compared. The overall rates come from
    the category counts, before small categories go.
    """
    rated = (
        stats.withColumns(
            {"overall_delay": _overall("delayed_orders"), "overall_bad": _overall("bad_orders")}
        )
        .where(F.col("orders") >= min_orders)
        .withColumns(
            {
                "delay_rate": rounded_even(F.col("delay_rate"), 1),
                "bad_rate": rounded_even(F.col("bad_rate"), 1),
            }
        )
    )
    return rated.select(
        "category",
        "orders",
        "delay_rate",
        "bad_rate",
        "avg_gmv",
        *pp_vs_overall(F.col("delay_rate"), F.col("overall_delay"), "delay"),
        *pp_vs_overall(F.col("bad_rate"), F.col("overall_bad"), "bad"),
    )


def category_rates(stats: DataFrame, min_orders: int = 100, k: int = 10) -> DataFrame:
    """R1: the categories with the highest late rate, against the overall rates."""
    gaps = category_gaps(stats, min_orders)
    return sort_topk(gaps, k, F.desc("delay_rate"), F.col("category"))


def delay_lift(
    stats: DataFrame,
    min_orders: int = 200,
    min_delay_rate: float = 3.0,
    min_delayed: int = 10,
    k: int = 15,
) -> DataFrame:
    """R2: the categories whose bad rate grows most when late, with the overall pair. Without
    an eligible category one row has the overall pair alone."""
    everything = Window.partitionBy()

    def total(column: str) -> Column:
        return F.sum(column).over(everything)

    on_time = total("orders") - total("delayed_orders")
    base = F.col("bad_ontime")
    eligible = F.coalesce(
        (F.col("orders") >= min_orders)
        & (F.col("delay_rate") > min_delay_rate)
        & (F.col("delayed_orders") >= min_delayed),
        F.lit(False),
    )
    shown = {
        "category": F.col("category"),
        "orders": F.col("orders"),
        "delay_rate": F.col("delay_rate"),
        "bad_ontime": base,
        "bad_delayed": F.col("bad_delayed"),
        "delta_pp": F.col("bad_delayed") - base,
        "lift": F.col("bad_delayed") / F.when(base > 0, base),
        "lift_is_infinite": F.coalesce(base <= 0, F.lit(True)),
    }
    # One row per category, so windows over all of them stay small.
    rows = (
        stats.withColumns(
            {
                "base_ontime": share(total("ontime_bad"), on_time),
                "base_delayed": share(total("delayed_bad"), total("delayed_orders")),
                "eligible": eligible,
                "n_eligible": F.sum(flag(eligible)).over(everything),
                "is_first": F.col("category") == F.min("category").over(everything),
            }
        )
        .where(F.col("eligible") | ((F.col("n_eligible") == 0) & F.col("is_first")))
        .select(
            *[F.when(F.col("eligible"), column).alias(name) for name, column in shown.items()],
            "base_ontime",
            "base_delayed",
        )
    )
    return sort_topk(rows, k, F.desc_nulls_last("delta_pp"), F.col("category"))


def _scored(stats: DataFrame, min_orders: int, min_delayed: int) -> DataFrame:
    gap = F.col("bad_delayed") - F.col("bad_ontime")
    return stats.where(F.col("orders") >= min_orders).select(
        "category",
        "orders",
        "bad_orders",
        "delay_rate",
        "bad_ontime",
        "bad_delayed",
        F.when(F.col("delayed_orders") >= min_delayed, gap).otherwise(0.0).alias("delta_pp"),
        (F.col("delay_rate") * gap / 100.0).alias("risk_score"),
    )


def risk_score(
    stats: DataFrame, min_orders: int = 200, min_delayed: int = 10, k: int = 12
) -> DataFrame:
    """R3: late rate times growth of the bad rate, highest first.

    The score uses the growth as it is; the growth shown is 0 when few orders were late.
    """
    ranked = sort_topk(
        _scored(stats, min_orders, min_delayed),
        k,
        F.desc_nulls_last("risk_score"),
        F.col("category"),
    )
    return ranked.drop("bad_orders")


def bad_volume(stats: DataFrame, min_orders: int = 200, k: int = 12) -> DataFrame:
    """R4: the categories with most bad reviews of late orders."""
    counted = stats.where(F.col("orders") >= min_orders).select(
        "category",
        "orders",
        "delayed_orders",
        "bad_orders",
        "delayed_bad",
        "ontime_bad",
        "total_gmv",
        F.coalesce(share(F.col("delayed_bad"), F.col("bad_orders")), F.lit(0.0)).alias(
            "bad_from_delayed_pct"
        ),
    )
    return sort_topk(counted, k, F.desc("delayed_bad"), F.col("category"))


def tiers(
    stats: DataFrame, min_orders: int = 200, min_delayed: int = 10, k: int = 12, most: int = 5
) -> DataFrame:
    """R5: of the k riskiest categories, A high risk and volume, B risk only, C volume only.

    Risk is high above the median of the k; volume above the median of all categories with
    enough orders. B and C list the first ``most`` by risk; the rest has no tier.
    """
    everything = Window.partitionBy()
    by_risk = Window.orderBy(F.desc_nulls_last("risk_score"), F.col("category"))
    top = (
        _scored(stats, min_orders, min_delayed)
        .withColumns(
            {
                "place": F.row_number().over(by_risk),
                "median_bad": F.percentile("bad_orders", 0.5).over(everything),
            }
        )
        .where(F.col("place") <= k)
        .withColumn("median_risk", F.percentile("risk_score", 0.5).over(everything))
    )
    high = F.col("risk_score") > F.col("median_risk")
    low = F.col("risk_score") <= F.col("median_risk")
    many = F.col("bad_orders") > F.col("median_bad")
    few = F.col("bad_orders") <= F.col("median_bad")
    tiered = top.withColumn(
        "tier", F.when(high & many, "A").when(high & few, "B").when(low & many, "C")
    ).where(F.col("tier").isNotNull())
    inside = Window.partitionBy("tier").orderBy("place")
    return (
        tiered.withColumn("tier_place", F.row_number().over(inside))
        .where((F.col("tier") == "A") | (F.col("tier_place") <= most))
        .select(
            "tier",
            "tier_place",
            "category",
            "delay_rate",
            "delta_pp",
            "risk_score",
            F.col("bad_orders").alias("share_of_bad"),
        )
        .orderBy("tier", "tier_place")
    )
