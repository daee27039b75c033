"""Descriptive statistics of the tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions.ladders import cut, level
from parecer.functions.measures import (
    cents,
    clip,
    flag,
    from_cents,
    money_mean,
    money_sum,
    rate_of,
    rounded_even,
    share,
)
from parecer.operators.orders import (
    filter_delivered,
    left_join_products,
    named_products,
    with_floored_delay,
)
from parecer.operators.ranking import (
    histogram,
    nlargest,
    running_share,
    sort_topk,
    sums_of_largest,
    value_counts,
    with_share,
)


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and empty cells of each table, one pass per table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        empty = reduce(lambda a, b: a + b, [flag(F.col(c).isNull()) for c in df.columns])
        return df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).alias("n_cols"),
            F.coalesce(F.sum(empty), F.lit(0)).alias("n_null"),
        )

    return reduce(DataFrame.unionAll, [one(n, df) for n, df in tables.items()])


def time_span(orders: DataFrame) -> DataFrame:
    """First and last purchase."""
    return orders.agg(
        F.min("order_purchase_timestamp").alias("min_ts"),
        F.max("order_purchase_timestamp").alias("max_ts"),
    )


def monthly_orders(orders: DataFrame) -> DataFrame:
    """Orders per month of purchase."""
    month = F.date_format("order_purchase_timestamp", "yyyy-MM").alias("month")
    return orders.groupBy(month).agg(F.count(F.lit(1)).alias("n")).orderBy("month")


def status_dist(orders: DataFrame) -> DataFrame:
    """Orders per status and their share."""
    return with_share(value_counts(orders, "order_status")).orderBy(F.desc("n"), "order_status")


def _delivered_delay(orders: DataFrame) -> DataFrame:
    return with_floored_delay(filter_delivered(orders, arrival=False, promise=False))


def delivery_stats(orders: DataFrame) -> DataFrame:
    """Mean days taken, mean days promised, and the median delay.

    The exact median comes from the counts per day, which are few whatever the order count;
    the means come from the same counts.
    """
    days = ["actual_delivery_days", "estimated_delivery_days", "delay_days"]
    counts = value_counts(_delivered_delay(orders), *days)
    actual, promised, delay = (F.col(c) for c in days)

    def mean(x):
        known = F.when(x.isNotNull(), F.col("n"))
        return share(F.sum(x * F.col("n")), F.sum(known), 1.0)

    return counts.agg(
        mean(actual).alias("mean_actual"),
        mean(promised).alias("mean_estimated"),
        F.percentile(delay, F.lit(0.5), F.col("n")).alias("median_delay"),
    )


def delay_rates(orders: DataFrame, severe_over: int = 10) -> DataFrame:
    """Late, on-time and severely late percentages; orders without dates count as neither."""
    delay = F.col("delay_days")
    return _delivered_delay(orders).agg(
        rate_of(delay > 0).alias("delayed_pct"),
        rate_of(delay <= 0).alias("on_time_pct"),
        rate_of(delay > severe_over).alias("severe_pct"),
    )


def delay_hist(
    orders: DataFrame, bounds: Sequence[int] = fv.DELAY_CLIP, bins: int = fv.DELAY_BINS
) -> DataFrame:
    """Histogram of the delay, clipped to the bounds."""
    clipped = _delivered_delay(orders).select(clip(F.col("delay_days"), *bounds).alias("x"))
    return histogram(value_counts(clipped, "x"), "x", bins)


def delay_box(
    orders: DataFrame,
    edges: Sequence[int] = fv.DELAY_LEVEL_EDGES,
    labels: Sequence[str] = fv.DELAY_LEVEL_LABELS,
) -> DataFrame:
    """Quartiles and whiskers of the delay per level.

    A whisker ends at the farthest value within 1.5 interquartile ranges of the box.
    """
    delay = F.col("delay_days")
    counts = value_counts(
        _delivered_delay(orders)
        .where(delay.isNotNull())
        .select(level(delay, edges, labels).alias("level"), "delay_days"),
        "level",
        "delay_days",
    )
    # The window runs over one row per level and day.
    quartiles = F.percentile(
        delay, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")
    ).over(Window.partitionBy("level"))
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    reach = (q3 - q1) * 1.5
    return (
        counts.withColumn("q", quartiles)
        .groupBy("level")
        .agg(
            F.sum("n").alias("n"),
            F.max(q1).alias("q1"),
            F.max(median).alias("median"),
            F.max(q3).alias("q3"),
            F.min(F.when(delay >= q1 - reach, delay)).alias("whisker_low"),
            F.max(F.when(delay <= q3 + reach, delay)).alias("whisker_high"),
        )
        .withColumn("whisker_low", F.least("whisker_low", "q1"))
        .withColumn("whisker_high", F.greatest("whisker_high", "q3"))
    )


def score_dist(reviews: DataFrame) -> DataFrame:
    """Reviews per score and their share."""
    return with_share(value_counts(reviews, "review_score")).orderBy("review_score")


def sentiment(
    reviews: DataFrame,
    edges: Sequence[int] = fv.SCORE_CUT_EDGES,
    labels: Sequence[str] = fv.SCORE_CUT_LABELS,
) -> DataFrame:
    """Reviews per sentiment class and their share of all reviews."""
    classed = reviews.select(cut(F.col("review_score"), edges, labels).alias("label"))
    return with_share(value_counts(classed, "label")).where(F.col("label").isNotNull())


def category_gmv(items: DataFrame, products: DataFrame, category_trans: DataFrame) -> DataFrame:
    """Lines, value, mean price and freight per category; lines without category go.

    Items are summed per product before the join, so a much-sold product is one row in it.
    """
    per_product = items.groupBy("product_id").agg(
        F.count("order_id").alias("n_items"),
        F.sum(cents(F.col("price"))).alias("cents"),
        F.count("price").alias("n_prices"),
        F.sum(cents(F.col("freight_value"))).alias("freight_cents"),
    )
    named = left_join_products(per_product, named_products(products, category_trans), "category_en")
    return (
        named.where(F.col("category_en").isNotNull())
        .groupBy("category_en")
        .agg(
            F.sum("n_items").alias("n_items"),
            from_cents(F.sum("cents")).alias("gmv"),
            share(from_cents(F.sum("cents")), F.sum("n_prices"), 1.0).alias("mean_price"),
            from_cents(F.sum("freight_cents")).alias("freight"),
        )
        .withColumn("freight_pct", rounded_even(share(F.col("freight"), F.col("gmv")), 1))
        .withColumn("mean_freight", rounded_even(share(F.col("freight"), F.col("n_items"), 1.0), 1))
    )


def category_top_gmv(gmv: DataFrame, k: int = 10) -> DataFrame:
    """The k categories with the largest value."""
    return sort_topk(gmv, k, F.desc("gmv"), F.col("category_en"))


def category_top_freight(gmv: DataFrame, k: int = 15) -> DataFrame:
    """The k categories with the largest freight share."""
    return nlargest(gmv, k, "freight_pct", "category_en")


def payment_types(payments: DataFrame) -> DataFrame:
    """Payments per type, their share, and mean installments."""
    by_type = payments.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("n"),
        rounded_even(F.avg("payment_installments"), 1).alias("mean_installments"),
    )
    return with_share(by_type).orderBy(F.desc("n"), "payment_type")


def installment_hist(
    payments: DataFrame, upto: int = fv.INSTALLMENT_MAX, bins: int = fv.INSTALLMENT_BINS
) -> DataFrame:
    """Histogram of the installments up to a bound."""
    kept = payments.where(F.col("payment_installments") <= upto)
    return histogram(value_counts(kept, "payment_installments"), "payment_installments", bins)


def seller_stats(items: DataFrame) -> DataFrame:
    """Lines, value and mean price per seller."""
    return items.groupBy("seller_id").agg(
        F.count("order_id").alias("n_items"),
        money_sum(F.col("price")).alias("gmv"),
        money_mean(F.col("price")).alias("mean_price"),
    )


def seller_gmv(items: DataFrame) -> DataFrame:
    """Value per seller."""
    return items.groupBy("seller_id").agg(money_sum(F.col("price")).alias("gmv"))


def seller_lorenz(items: DataFrame) -> DataFrame:
    """Sellers from largest to smallest with rank and cumulative share of value."""
    return running_share(seller_gmv(items), "gmv", "seller_id")


def pareto(sellers: DataFrame, percents: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Share of value held by the top p % of sellers, whole sellers only, rounded down.

    ``sellers`` has one row each with ``gmv``. They are not ranked: the amount at the edge is
    found from counts per range of amounts. They are kept, on disk where memory is short, over
    those passes.
    """
    spark = sellers.sparkSession
    whole = sellers.select((F.col("gmv") * 100).cast("long").alias("cents"))
    whole.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, total = whole.agg(F.count(F.lit(1)), F.sum("cents")).first()
        tops = [n * p // 100 for p in percents]
        sums = sums_of_largest(whole, "cents", tops)
    finally:
        whole.unpersist()
    rows = [(p, k, s, total) for p, k, s in zip(percents, tops, sums)]
    return (
        spark.createDataFrame(rows, "top_pct int, n_sellers long, held long, total long")
        .select(
            "top_pct", "n_sellers",
            share(from_cents(F.col("held")), from_cents(F.col("total"))).alias("gmv_pct"),
        )
        .orderBy("top_pct")
    )


def seller_order_hist(
    items: DataFrame, upper: int = fv.SELLER_ORDER_CLIP, bins: int = fv.SELLER_ORDER_BINS
) -> DataFrame:
    """Histogram of lines per seller, clipped from above."""
    lines = items.groupBy("seller_id").agg(F.count("order_id").alias("n_items"))
    clipped = lines.select(clip(F.col("n_items"), high=upper).alias("x"))
    return histogram(value_counts(clipped, "x"), "x", bins)


def summary(
    orders: DataFrame, reviews: DataFrame, items: DataFrame, sellers: DataFrame | None = None
) -> DataFrame:
    """The headline percentages in one row; ``sellers`` with ``gmv`` if they are at hand."""
    score = F.col("review_score")
    scores = F.struct(
        rate_of(score >= 4).alias("good_pct"), rate_of(score <= 2).alias("bad_pct")
    )
    top = pareto(seller_gmv(items) if sellers is None else sellers, [10]).select("gmv_pct")
    return (
        delay_rates(orders)
        .withColumn("scores", reviews.agg(scores.alias("scores")).scalar())
        .select(
            "delayed_pct",
            "severe_pct",
            "scores.good_pct",
            "scores.bad_pct",
            top.scalar().alias("top10_gmv_pct"),
        )
    )
