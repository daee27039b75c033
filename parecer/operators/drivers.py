"""Six questions on what goes with a bad review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions.ladders import Ladder
from parecer.functions.measures import flag, money_mean, rate_of, rounded, share
from parecer.operators.facts import order_core
from parecer.operators.orders import (
    filter_delivered,
    join_items_products,
    join_orders_reviews,
    named_products,
    order_freight_agg,
    order_pay_agg,
    order_review_avg,
    with_truncated_delay,
)
from parecer.operators.ranking import literal_rows, sort_topk


def _score_columns():
    return [
        F.count(F.lit(1)).alias("orders"),
        rounded(F.avg("avg_score"), 2).alias("avg_score"),
        rounded(rate_of(F.col("avg_score") <= 2), 1).alias("bad_rate_pct"),
    ]


def delay_dose(
    orders: DataFrame, reviews: DataFrame, ladder: Ladder = fv.DELAY_LADDER
) -> DataFrame:
    """Q1: orders, mean score and bad rate by delay bucket, earliest first."""
    scored = join_orders_reviews(with_truncated_delay(filter_delivered(orders)), reviews)
    delay = F.col("delay_days")
    return (
        scored.groupBy(ladder.label(delay).alias("delay_bucket"))
        .agg(
            F.count(F.lit(1)).alias("order_cnt"),
            rounded(F.avg("avg_score"), 2).alias("avg_review_score"),
            rounded(rate_of(F.col("avg_score") <= 2), 1).alias("bad_rate_pct"),
            F.min(delay).alias("first_delay"),
        )
        .orderBy("first_delay")
        .drop("first_delay")
    )


def freight_ratio(
    items: DataFrame, reviews: DataFrame, ladder: Ladder = fv.FREIGHT_LADDER
) -> DataFrame:
    """Q2: the same by freight per price; an order of price 0 falls in the last bucket."""
    priced = order_freight_agg(items).join(order_review_avg(reviews), "order_id", "inner")
    ratio = F.col("freight_ratio")
    return (
        priced.groupBy(ladder.label(ratio).alias("freight_ratio_bucket"))
        .agg(
            *_score_columns(),
            rounded(money_mean(F.col("total_price")), 0).alias("avg_order_value"),
            F.min(ratio).alias("first_ratio"),
        )
        .orderBy("first_ratio")
        .drop("first_ratio")
    )


def category_bad_rate(
    items: DataFrame,
    products: DataFrame,
    category_trans: DataFrame,
    reviews: DataFrame,
    min_orders: int = 100,
    k: int = 15,
) -> DataFrame:
    """Q3: worst categories. Orders are counted once; score and rate weigh each item.

    Items shrink to one weighted row per order and category before they meet the reviews.
    """
    weighted = (
        join_items_products(items, named_products(products, category_trans), "category")
        .groupBy("order_id", "category")
        .agg(F.count(F.lit(1)).alias("n_items"))
        .join(order_review_avg(reviews).select("order_id", "avg_score"), "order_id", "inner")
    )
    n_items = F.col("n_items")
    scored = F.when(F.col("avg_score").isNotNull(), n_items)
    by_category = (
        weighted.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("n_items").alias("n_items"),
            rounded(share(F.sum(F.col("avg_score") * n_items), F.sum(scored), 1.0), 2).alias(
                "avg_score"
            ),
            rounded(
                share(
                    F.sum(F.when(F.col("avg_score") <= 2, n_items).otherwise(0)), F.sum("n_items")
                ),
                1,
            ).alias("bad_rate_pct"),
        )
        .where(F.col("orders") >= min_orders)
    )
    return sort_topk(by_category, k, F.desc("bad_rate_pct"), F.col("category"))


def payment_installments(
    payments: DataFrame,
    reviews: DataFrame,
    types: tuple[str, ...] = ("credit_card", "boleto"),
    ladder: Ladder = fv.INSTALLMENT_LADDER,
) -> DataFrame:
    """Q4: by payment type and installments, for the given types."""
    paid = order_pay_agg(payments).where(F.col("pay_type").isin(*types))
    installments = F.col("installments")
    return (
        paid.join(order_review_avg(reviews), "order_id", "inner")
        .groupBy("pay_type", ladder.label(installments).alias("installment_bucket"))
        .agg(*_score_columns(), F.min(installments).alias("first"))
        .orderBy("pay_type", "first")
        .drop("first")
    )


def segment_tags(high_freight_over: float = 20.0):
    """The overlapping segments an order belongs to, as an array."""
    everyone, late, on_time, freight = fv.SEGMENT_LABELS
    return F.array_compact(
        F.array(
            F.lit(everyone),
            F.when(F.col("is_delayed") == 1, F.lit(late)).otherwise(F.lit(on_time)),
            F.when(F.col("freight_ratio") > high_freight_over, F.lit(freight)),
        )
    )


def segments(
    orders: DataFrame, items: DataFrame, reviews: DataFrame, high_freight_over: float = 20.0
) -> DataFrame:
    """Q5: bad rate, late rate and freight ratio of overlapping segments.

    Orders are read once; each is counted in every segment that fits, before the shuffle.
    """
    core = order_core(filter_delivered(orders, promise=False), items, reviews)
    found = (
        core.select(
            "is_delayed",
            "is_bad",
            "freight_ratio",
            rounded(F.col("avg_score"), 2).alias("avg_score"),
            F.explode(segment_tags(high_freight_over)).alias("segment"),
        )
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            rounded(F.avg("avg_score"), 2).alias("avg_score"),
            rounded(share(F.sum("is_bad"), F.count(F.lit(1))), 1).alias("bad_rate"),
            rounded(share(F.sum("is_delayed"), F.count(F.lit(1))), 1).alias("delay_rate"),
            rounded(F.avg("freight_ratio"), 1).alias("avg_freight_ratio"),
        )
    )
    listed = literal_rows(orders.sparkSession, "segment", fv.SEGMENT_LABELS)
    # Four rows at most on either side; a segment without orders still gets its row.
    return listed.join(F.broadcast(found), "segment", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def review_group_delay(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Q6: delay of badly, neutrally and well reviewed orders."""
    bad, good, neutral = fv.REVIEW_GROUP_LABELS
    score, delay = F.col("avg_score"), F.col("delay_days")
    scored = join_orders_reviews(
        with_truncated_delay(filter_delivered(orders, promise=False)), reviews
    )
    group = F.when(score <= 2, bad).when(score >= 4, good).otherwise(neutral)
    return (
        scored.groupBy(group.alias("review_group"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            rounded(F.avg(delay), 1).alias("avg_delay_days"),
            rounded(F.avg(F.when(delay > 0, delay)), 1).alias("avg_delay_when_late"),
            rounded(share(F.sum(flag(delay > 0)), F.count(F.lit(1))), 1).alias("delay_rate_pct"),
            F.min(score).alias("first"),
        )
        .orderBy("first")
        .drop("first")
    )
