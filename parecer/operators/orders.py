"""Per-order building blocks: filters, delays, and one-row-per-order summaries.

Every summary is aggregated before it is joined. An order with very many items, reviews
or payments therefore shrinks to one row per map task before anything is shuffled, and
all summaries leave their last shuffle partitioned by order_id, which is what the joins
of ``facts`` and ``drivers`` need: no table is shuffled twice on that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions.measures import days_floored, days_truncated, flag, money_sum, share

PURCHASED = "order_purchase_timestamp"
ARRIVED = "order_delivered_customer_date"
PROMISED = "order_estimated_delivery_date"


def filter_delivered(
    orders: DataFrame, arrival: bool = True, promise: bool = True
) -> DataFrame:
    """Delivered orders, with the arrival and the promised date present where asked."""
    keep = F.col("order_status") == "delivered"
    if arrival:
        keep = keep & F.col(ARRIVED).isNotNull()
    if promise:
        keep = keep & F.col(PROMISED).isNotNull()
    return orders.where(keep)


def with_floored_delay(orders: DataFrame) -> DataFrame:
    """Whole days taken, whole days promised, and their difference."""
    days = orders.withColumns(
        {
            "actual_delivery_days": days_floored(F.col(ARRIVED), F.col(PURCHASED)),
            "estimated_delivery_days": days_floored(F.col(PROMISED), F.col(PURCHASED)),
        }
    )
    return days.withColumn(
        "delay_days", F.col("actual_delivery_days") - F.col("estimated_delivery_days")
    )


def with_truncated_delay(orders: DataFrame) -> DataFrame:
    """Days between promise and arrival, cut toward zero."""
    return orders.withColumn("delay_days", days_truncated(F.col(ARRIVED), F.col(PROMISED)))


def with_delay_flags(df: DataFrame, severe_over: int = 4) -> DataFrame:
    """1 when late, 1 when later than ``severe_over`` days; unknown delay counts as 0."""
    return df.withColumns(
        {
            "is_delayed": flag(F.col("delay_days") > 0),
            "is_severely_delayed": flag(F.col("delay_days") > severe_over),
        }
    )


def order_review_avg(reviews: DataFrame) -> DataFrame:
    """Mean score and number of reviews per order."""
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("avg_score"), F.count(F.lit(1)).alias("n_reviews")
    )


def order_freight_agg(items: DataFrame) -> DataFrame:
    """Freight, price and freight per 100 of price per order; null ratio on price 0."""
    return (
        items.groupBy("order_id")
        .agg(
            money_sum(F.col("freight_value")).alias("total_freight"),
            money_sum(F.col("price")).alias("total_price"),
        )
        .withColumn("freight_ratio", share(F.col("total_freight"), F.col("total_price")))
    )


def order_pay_agg(payments: DataFrame) -> DataFrame:
    """Alphabetically last payment type and largest number of installments per order."""
    return payments.groupBy("order_id").agg(
        F.max("payment_type").alias("pay_type"),
        F.max("payment_installments").alias("installments"),
    )


def row_number_top1(payments: DataFrame, *sums: Column) -> DataFrame:
    """The largest payment of each order; ties go to the lower type, then fewer installments.
    ``sums`` are further aggregates over the order's payments, under their own names.

    The smallest struct per order is the first row of the sorted order, found with map-side
    combining instead of a window over all payments of an order.
    """
    first = F.min(
        F.struct(
            (-F.col("payment_value")).alias("neg_value"),
            F.col("payment_type"),
            F.col("payment_installments"),
        )
    ).alias("first")
    return (
        payments.groupBy("order_id")
        .agg(first, *sums)
        .select(
            "*",
            F.col("first.payment_type").alias("payment_type"),
            F.col("first.payment_installments").alias("payment_installments"),
            (-F.col("first.neg_value")).alias("payment_value"),
        )
        .drop("first")
    )


def join_items_products(items: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    """Items with the named columns of their product; items without product go.

    No hint: Spark broadcasts products when their measured size allows it, and otherwise
    AQE splits the partition of a product that holds a large part of the items.
    """
    return items.join(products.select("product_id", *columns), "product_id", "inner")


def left_join_products(items: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    """All items, with the named product columns where the product is known."""
    return items.join(products.select("product_id", *columns), "product_id", "left")


def left_join_category(df: DataFrame, category_trans: DataFrame) -> DataFrame:
    """Adds the English category name, null where there is no translation.

    The grouping tells Spark that a name has one translation, so it drops the whole join
    from queries that do not use the category.
    """
    names = category_trans.groupBy("product_category_name").agg(
        F.min("product_category_name_english").alias("product_category_name_english")
    )
    return df.join(names, "product_category_name", "left")


def left_join_top_payment(df: DataFrame, payments: DataFrame, *sums: Column) -> DataFrame:
    """Adds type and installments of the largest payment, null where there is none, and
    ``sums`` over the order's payments out of the same shuffle."""
    top = (
        row_number_top1(payments, *sums)
        .withColumnsRenamed({"payment_type": "pay_type", "payment_installments": "installments"})
        .drop("payment_value")
    )
    return df.join(top, "order_id", "left")


def join_orders_reviews(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Orders that were reviewed, with their mean score and number of reviews."""
    return orders.join(order_review_avg(reviews), "order_id", "inner")


def category_or_original(english: str, original: str) -> Column:
    """English name, else the original name; null when both are missing."""
    return F.coalesce(F.col(english), F.col(original))


def category_or_unknown(english: str) -> Column:
    """English name, else the label for unknown categories."""
    return F.coalesce(F.col(english), F.lit(fv.UNKNOWN_CATEGORY))


def named_products(products: DataFrame, category_trans: DataFrame) -> DataFrame:
    """Products with both category names: original or English, and English or unknown.

    Names are looked up once per product. The items, of which there are far more, then meet
    one table instead of two, and never shuffle on a category that many of them share.
    """
    english, original = "product_category_name_english", "product_category_name"
    return left_join_category(products, category_trans).select(
        "product_id",
        category_or_original(english, original).alias("category_en"),
        category_or_unknown(english).alias("category"),
    )


def map_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the value of a one-row-per-key table under ``name``, 0 where the key is missing."""
    found = lookup.select(F.col(key), F.col(value).alias(name))
    return df.join(found, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
