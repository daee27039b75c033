"""One row per order: the tables the statistics and the category steps start from.

Items, reviews and payments are each reduced to one row per order before they are joined.
The item rows of an order are never multiplied by its reviews: with ``fanout="reference"``
the sums are multiplied by the number of reviews instead, which gives the same figures as
summing over the joined rows without ever producing them. ``fanout="dedup"`` counts each
item once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parecer.functions.measures import cents, flag, from_cents, money_sum, rounded, share
from parecer.operators.orders import (
    filter_delivered,
    join_items_products,
    left_join_top_payment,
    named_products,
    order_review_avg,
    with_delay_flags,
    with_truncated_delay,
)

FANOUTS = ("reference", "dedup")


def _times_reviews(amount: Column, fanout: str) -> Column:
    if fanout not in FANOUTS:
        raise ValueError(f"fanout must be one of {FANOUTS}")
    return amount * F.col("n_reviews") if fanout == "reference" else amount


def _scored(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Orders with their delay, flags, mean score and number of reviews."""
    dated = with_delay_flags(with_truncated_delay(orders)).select(
        "order_id", "delay_days", "is_delayed", "is_severely_delayed"
    )
    return dated.join(order_review_avg(reviews), "order_id", "inner").withColumn(
        "is_bad", flag(F.col("avg_score") <= 2)
    )


def order_core(orders: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Delay, score and freight ratio of each order that has items and reviews."""
    sums = items.groupBy("order_id").agg(
        money_sum(F.col("freight_value")).alias("freight"),
        money_sum(F.col("price")).alias("price"),
    )
    return _scored(orders, reviews).join(sums, "order_id", "inner").withColumn(
        "freight_ratio", share(F.col("freight"), F.col("price"))
    )


def _first_category() -> Column:
    """Aggregate: category of the item with the smallest product_id."""
    return F.min(F.struct("product_id", "category"))["category"]


def order_facts(
    orders: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    category_trans: DataFrame,
    payments: DataFrame,
    fanout: str = "reference",
) -> DataFrame:
    """The wide table: delay, score, value, freight, items, payment and main category."""
    # Distinct products per order are counted by grouping on (order, product) first, so
    # an order with very many lines is spread over tasks by its products. Joining first would
    # save one of the three shuffles, but a very large order would meet in one task, and
    # grouping in place after a join on the product would pin a much-sold product to one.
    lines = items.groupBy("order_id", "product_id").agg(
        F.sum(cents(F.col("price"))).alias("price"),
        F.sum(cents(F.col("freight_value"))).alias("freight"),
    )
    named = join_items_products(lines, named_products(products, category_trans), "category")
    sums = named.groupBy("order_id").agg(
        from_cents(F.sum("price")).alias("price"),
        from_cents(F.sum("freight")).alias("freight"),
        F.count(F.lit(1)).alias("item_count"),
        _first_category().alias("main_category"),
    )
    joined = _scored(filter_delivered(orders), reviews).join(sums, "order_id", "inner")
    return left_join_top_payment(joined, payments).select(
        "order_id",
        "delay_days",
        "is_delayed",
        "is_severely_delayed",
        rounded(F.col("avg_score"), 2).alias("avg_score"),
        "is_bad",
        _times_reviews(F.col("price"), fanout).alias("total_price"),
        _times_reviews(F.col("freight"), fanout).alias("total_freight"),
        share(F.col("freight"), F.col("price")).alias("freight_ratio"),
        "item_count",
        "pay_type",
        "installments",
        "main_category",
    )


def order_facts_category(
    orders: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    category_trans: DataFrame,
    fanout: str = "reference",
) -> DataFrame:
    """The narrower wide table of the category step."""
    sums = (
        join_items_products(items, named_products(products, category_trans), "category")
        .groupBy("order_id")
        .agg(
            money_sum(F.col("price")).alias("price"),
            money_sum(F.col("freight_value")).alias("freight"),
            F.count(F.lit(1)).alias("lines"),
            _first_category().alias("category"),
        )
    )
    return (
        _scored(filter_delivered(orders), reviews)
        .join(sums, "order_id", "inner")
        .select(
            "order_id",
            "is_delayed",
            "is_bad",
            "category",
            _times_reviews(F.col("price"), fanout).alias("gmv"),
            _times_reviews(F.col("freight"), fanout).alias("freight"),
            _times_reviews(F.col("lines"), fanout).alias("items"),
        )
    )


def facts_summary(facts: DataFrame, category: str = "main_category") -> DataFrame:
    """Orders, bad, late and severely late percentages, and number of categories.

    Counted per category first, so the distinct count needs no second pass over orders.
    """
    severe = (
        F.col("is_severely_delayed") if "is_severely_delayed" in facts.columns else F.lit(None)
    )
    by_category = facts.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("is_bad").alias("bad"),
        F.sum("is_delayed").alias("late"),
        F.sum(severe.cast("int")).alias("severe"),
    )
    n = F.sum("n")
    return by_category.agg(
        F.coalesce(n, F.lit(0)).alias("n_orders"),
        share(F.sum("bad"), n).alias("bad_pct"),
        share(F.sum("late"), n).alias("delayed_pct"),
        share(F.sum("severe"), n).alias("severe_pct"),
        F.count(category).alias("n_categories"),
    )
