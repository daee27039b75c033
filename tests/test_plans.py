"""The shape of the plans: what is read, what is shuffled, what may meet in one task."""

import re

import pytest
from pyspark.sql import functions as F

from parecer.operators import drivers, eda, facts, orders, rollups, texts
from parecer.plans import catalog
from parecer.sources.star_schema import star_schema_tables

FOLDER = "/root/testdata/sf0.01"
# These write or fit before they return; their parts are covered by the others.
EAGER = {
    "read_tables", "table_sink", "read_rollups", "t3_odds_ratios", "t3_standardize", "t5_model", "t5_auc",
    "l0_vocabulary", "l1_lda_topics", "l2_topic_share", "l3_topic_by_delay",
    "l1_grouped_topics", "l2_grouped_topic_share", "l3_grouped_topic_by_delay",
}


@pytest.fixture
def no_small_tables(spark):
    """As on data where no table is small enough to broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df):
    return [re.sub(r"^[ :+\-]*(\*\(\d+\) )?", "", x) for x in plan_of(df).splitlines()]


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in EAGER])
def test_no_cross_joins_and_only_grouped_rows_in_one_task(no_small_tables, name):
    plan = lines(catalog.run(name, no_small_tables, FOLDER))
    text = "\n".join(plan)
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    for line, below in zip(plan, plan[1:]):
        if "SinglePartition" in line:
            rest = plan[plan.index(line) + 1:]
            grouped = next(x for x in rest if "Aggregate" in x or "FileScan" in x)
            assert "Aggregate" in grouped, below


def test_tables_meet_on_order_id_without_a_second_shuffle(no_small_tables):
    t = star_schema_tables(no_small_tables, FOLDER)
    plan = lines(orders.join_orders_reviews(t["orders"], t["reviews"]))
    exchanges = [x for x in plan if x.startswith("Exchange hashpartitioning(order_id")]
    assert len(exchanges) == 2  # one per table; reviews are combined before theirs
    assert len([x for x in plan if x.startswith("Exchange")]) == 2


def test_only_needed_columns_are_read(no_small_tables):
    t = star_schema_tables(no_small_tables, FOLDER)
    text = plan_of(drivers.delay_dose(t["orders"], t["reviews"]))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(len(s.split(",")) for s in schemas) == [3, 3]


def test_parquet_filters_are_pushed_to_the_scan(spark, tmp_path):
    t = star_schema_tables(spark, FOLDER)
    t["orders"].write.parquet(str(tmp_path / "orders"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan_of(orders.filter_delivered(spark.read.parquet(str(tmp_path / "orders"))))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(order_status,delivered)" in text
    assert "IsNotNull(order_delivered_customer_date)" in text


def test_texts_do_not_travel_to_the_orders(no_small_tables, tmp_path):
    t = star_schema_tables(no_small_tables, FOLDER)
    t["text_reviews"].write.parquet(str(tmp_path / "reviews"))
    reviews = no_small_tables.read.parquet(str(tmp_path / "reviews"))
    measures = texts.measure_reviews(reviews, t["orders"])
    df = texts.bad_sources(measures)
    plan = lines(df)
    join = next(i for i, x in enumerate(plan) if "SortMergeJoin" in x)
    assert "arrays_overlap" not in "\n".join(plan[:join])
    assert "arrays_overlap" in "\n".join(plan[join:])


def test_top_words_are_cut_before_the_shuffle(no_small_tables):
    t = star_schema_tables(no_small_tables, FOLDER)
    text = plan_of(texts.top_words(t["text_reviews"], t["orders"]))
    assert text.count("WindowGroupLimit") == 2


def test_unused_parts_of_the_wide_table_are_not_computed(no_small_tables):
    t = star_schema_tables(no_small_tables, FOLDER)
    wide = facts.order_facts(
        t["orders"], t["order_items"], t["reviews"], t["products"], t["category_trans"],
        t["payments"],
    )
    text = plan_of(wide.groupBy("is_delayed").agg(F.avg("is_bad")))
    assert "payment" not in text
    assert "category" not in text
    assert "SortAggregate" not in text


def test_item_heavy_product_is_split_by_adaptive_execution(spark):
    """A third of all items on one product: its join partition is cut into several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        items = spark.range(0, 120_000, 1, 8).select(
            (F.col("id") % 50_000).alias("order_id"),
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000).alias("product_id"),
            F.lit("s").alias("seller_id"),
            F.lit(1).cast("decimal(12,2)").alias("price"),
            F.lit(1).cast("decimal(12,2)").alias("freight_value"),
        )
        products = spark.range(2000).select(
            F.col("id").alias("product_id"),
            F.concat(F.lit("c"), F.col("id") % 9).alias("product_category_name"),
        )
        trans = products.select(
            "product_category_name",
            F.upper("product_category_name").alias("product_category_name_english"),
        ).distinct()
        reviews = spark.range(50_000).select(
            F.col("id").alias("order_id"), (F.col("id") % 5 + 1).cast("int").alias("review_score")
        )
        df = drivers.category_bad_rate(items, products, trans, reviews)
        got = {r["category"]: r["n_items"] for r in df.collect()}
        assert sum(got.values()) == 120_000
        assert "skew=true" in plan_of(df)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_items_are_summed_per_product_before_they_meet_categories(no_small_tables):
    t = star_schema_tables(no_small_tables, FOLDER)
    plan = lines(eda.category_gmv(t["order_items"], t["products"], t["category_trans"]))
    items = [x for x in plan if x.startswith("Exchange hashpartitioning(product_id")]
    assert len(items) == 2  # one per side of the join
    join = next(i for i, x in enumerate(plan) if "SortMergeJoin" in x and "product_id" in x)
    assert any("partial_sum" in x for x in plan[join:])


def test_payments_are_shuffled_once_for_the_roll_ups(no_small_tables):
    t = star_schema_tables(no_small_tables, FOLDER)
    names = ("orders", "order_items", "reviews", "products", "category_trans", "payments")
    text = plan_of(rollups.rollup_facts(*[t[n] for n in names]))
    scans = re.findall(r"ReadSchema: struct<[^>]*l_linestatus", text)
    assert len(scans) == 1
