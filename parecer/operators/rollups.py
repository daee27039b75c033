"""The small tables a dashboard reads, and the queries it puts to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions.ladders import Ladder
from parecer.functions.measures import (
    flag,
    money_mean,
    money_sum,
    rate_among,
    rate_of,
    rounded,
    share,
)
from parecer.operators.orders import (
    filter_delivered,
    left_join_products,
    left_join_top_payment,
    named_products,
    order_review_avg,
    with_floored_delay,
)
from parecer.operators.ranking import manual_sort, nlargest


def rollup_facts(
    orders: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    category_trans: DataFrame,
    payments: DataFrame,
) -> DataFrame:
    """Every delivered order, reviewed or not, with what the roll-ups count.

    An order without review is not bad; one not yet arrived is not late.
    """
    delivered = with_floored_delay(filter_delivered(orders, arrival=False, promise=False)).select(
        "order_id",
        F.date_format("order_purchase_timestamp", "yyyy-MM").alias("purchase_month"),
        "actual_delivery_days",
        "estimated_delivery_days",
        "delay_days",
        flag(F.col("delay_days") > 0).alias("late"),
    )
    # Items of unknown products still count; they carry no category.
    named = left_join_products(
        items, named_products(products, category_trans), "category"
    ).withColumn("category", F.coalesce("category", F.lit(fv.UNKNOWN_CATEGORY)))
    sums = named.groupBy("order_id").agg(
        money_sum(F.col("price")).alias("price"),
        money_sum(F.col("freight_value")).alias("freight"),
        F.min(F.struct("product_id", "category"))["category"].alias("category"),
    )
    joined = (
        delivered.join(order_review_avg(reviews).select("order_id", "avg_score"), "order_id", "left")
        .join(sums, "order_id", "left")
    )
    paid = money_sum(F.col("payment_value")).alias("paid")
    return left_join_top_payment(joined, payments, paid).select(
        "order_id",
        "purchase_month",
        "actual_delivery_days",
        "estimated_delivery_days",
        "delay_days",
        "late",
        "avg_score",
        flag(F.col("avg_score") <= 2).alias("bad"),
        "price",
        share(F.col("freight"), F.col("price")).alias("freight_ratio"),
        F.coalesce("category", F.lit(fv.UNKNOWN_CATEGORY)).alias("category"),
        F.coalesce("pay_type", F.lit(fv.UNKNOWN_PAYMENT)).alias("pay_type"),
        "installments",
        "paid",
    )


def _count() -> Column:
    return F.count(F.lit(1))


def _late_pct() -> Column:
    return rounded(rate_of(F.col("late") == 1), 1)


def _bad_pct() -> Column:
    return rounded(rate_of(F.col("bad") == 1), 1)


def rollup_kpi(facts: DataFrame, rows: Sequence[tuple[str, str]] = fv.KPI_ROWS) -> DataFrame:
    """Orders, bad rate, late rate and mean score as rows (metric, value, format)."""
    values = [
        _count().cast("double"),
        _bad_pct(),
        _late_pct(),
        rounded(F.avg("avg_score"), 2),
    ]
    one_row = facts.agg(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    listed = [
        F.struct(
            F.lit(metric).alias("metric"), F.col(f"v{i}").alias("value"), F.lit(fmt).alias("format")
        )
        for i, (metric, fmt) in enumerate(rows)
    ]
    return one_row.select(F.inline(F.array(*listed)))


def rollup_monthly(facts: DataFrame) -> DataFrame:
    """Orders, late, bad, rates, mean delay and mean score per month."""
    return (
        facts.groupBy("purchase_month")
        .agg(
            _count().alias("to"),
            F.sum("late").alias("do"),
            F.sum("bad").alias("br"),
            _late_pct().alias("dr"),
            _bad_pct().alias("brr"),
            rounded(F.avg("delay_days"), 1).alias("add"),
            rounded(F.avg("avg_score"), 2).alias("asc"),
        )
        .orderBy("purchase_month")
    )


def rollup_delay_dose(facts: DataFrame, ladder: Ladder = fv.DOSE_LADDER) -> DataFrame:
    """Orders, bad ones and bad rate per delay bucket; unknown delay in the last one."""
    return facts.groupBy(ladder.label(F.col("delay_days")).alias("delay_bucket")).agg(
        _count().alias("ords"), F.sum("bad").alias("bads"), _bad_pct().alias("brate")
    )


def rollup_group_compare(facts: DataFrame, labels: Sequence[str] = fv.GROUP_LABELS) -> DataFrame:
    """Bad orders against all others."""
    group = F.when(F.col("bad") == 1, labels[0]).otherwise(labels[1])
    return facts.groupBy(group.alias("rg")).agg(
        _count().alias("to"),
        _late_pct().alias("dr"),
        rounded(F.avg("delay_days"), 1).alias("add"),
        rounded(money_mean(F.col("price")), 2).alias("ap"),
        rounded(F.avg("freight_ratio"), 1).alias("afr"),
        rounded(F.avg("installments"), 1).alias("ai"),
        rounded(F.avg("actual_delivery_days"), 1).alias("aad"),
        rounded(F.avg("estimated_delivery_days"), 1).alias("aed"),
    )


def rollup_category_risk(facts: DataFrame, min_orders: int = 50) -> DataFrame:
    """Rates per category, late against on time, for categories with enough orders."""
    late, bad = F.col("late") == 1, F.col("bad") == 1
    d, o = F.col("d_rate"), F.col("o_rate")
    return (
        facts.groupBy(F.col("category").alias("product_category_name_english"))
        .agg(
            _count().alias("to"),
            F.sum("late").alias("do"),
            F.sum("bad").alias("br"),
            _late_pct().alias("dr"),
            _bad_pct().alias("brr"),
            rounded(F.avg("delay_days"), 1).alias("add"),
            rounded(money_mean(F.col("price")), 2).alias("ap"),
            rounded(F.avg("freight_ratio"), 1).alias("afr"),
            rate_among(bad, late).alias("d_rate"),
            rate_among(bad, ~late).alias("o_rate"),
        )
        .where(F.col("to") >= min_orders)
        .withColumns(
            {
                "d_br": rounded(d, 1),
                "o_br": rounded(o, 1),
                "lift": rounded(d / F.when(o > 0, o), 1),
            }
        )
        .drop("d_rate", "o_rate")
    )


def rollup_payment(facts: DataFrame) -> DataFrame:
    """Orders, bad, rates, mean installments and mean amount paid per payment type."""
    return facts.groupBy(F.col("pay_type").alias("pt")).agg(
        _count().alias("to"),
        F.sum("bad").alias("br"),
        _bad_pct().alias("brr"),
        _late_pct().alias("dr"),
        rounded(F.avg("installments"), 1).alias("ai"),
        rounded(money_mean(F.col("paid")), 2).alias("av"),
    )


def unpivot_metrics(
    group_compare: DataFrame, metrics: Sequence[str] = fv.PIVOT_METRICS
) -> DataFrame:
    """The named metrics as rows (rg, metric, value)."""
    return group_compare.unpivot("rg", list(metrics), "metric", "value")


def kpi_member_filter(kpi: DataFrame, metric: str) -> DataFrame:
    """The row of one metric."""
    return kpi.where(F.col("metric") == metric)


def dash_top_bad(category_risk: DataFrame, k: int = 10) -> DataFrame:
    """The k categories with most bad orders, with their bad rate."""
    name = "product_category_name_english"
    summed = category_risk.groupBy(name).agg(
        F.sum("br").alias("sum_br"), F.sum("brr").alias("sum_brr")
    )
    return nlargest(summed, k, "sum_br", name)


def dash_dose_sum(delay_dose: DataFrame, order: Sequence[str] = fv.DOSE_ORDER) -> DataFrame:
    """Bad rate per delay bucket, in the listed order."""
    summed = delay_dose.groupBy("delay_bucket").agg(F.sum("brate").alias("sum_brate"))
    return manual_sort(summed, "delay_bucket", order)


def dash_monthly_series(monthly: DataFrame) -> DataFrame:
    """Bad rate, late rate and mean score per month."""
    return (
        monthly.groupBy("purchase_month")
        .agg(
            F.sum("brr").alias("sum_brr"),
            F.sum("dr").alias("sum_dr"),
            F.sum("asc").alias("sum_asc"),
        )
        .orderBy("purchase_month")
    )


def dash_risk_matrix(
    category_risk: DataFrame,
    delay_rate: float = fv.PARAM_DELAY_RATE,
    bad_rate: float = fv.PARAM_BAD_RATE,
) -> DataFrame:
    """Categories by late rate and bad rate, placed around the two reference lines."""
    summed = category_risk.groupBy("product_category_name_english").agg(
        *[F.sum(c).alias(f"sum_{c}") for c in ("dr", "brr", "lift", "to")]
    )
    late = F.when(F.col("sum_dr") > delay_rate, "late").otherwise("punctual")
    bad = F.when(F.col("sum_brr") > bad_rate, "bad").otherwise("good")
    return summed.withColumn("quadrant", F.concat_ws("/", late, bad))
