"""The marketplace tables as views on the star-schema test tables.

``ADAPTER_SQL`` gives the same tables in plain SQL, for checks by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parecer.sources.tables import LazyTables


def _plus(unit: str, amount: Column, start: Column) -> Column:
    return F.timestamp_add(unit, amount.cast("int"), start)


def _money(x: Column) -> Column:
    return x.cast("decimal(12,2)")


def _orders(raw: DataFrame) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    reached = key % 97 != 0
    return raw.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("canceled")
        .alias("order_status"),
        day.alias("order_purchase_timestamp"),
        _plus("HOUR", key % 5, day).alias("order_approved_at"),
        F.when(reached, _plus("DAY", key % 4, day)).alias("order_delivered_carrier_date"),
        F.when(reached, _plus("HOUR", (key * 37 % 45) * 24 + key * 7 % 24, day)).alias(
            "order_delivered_customer_date"
        ),
        _plus("DAY", 15 + key * 11 % 25, day).alias("order_estimated_delivery_date"),
    )


def _items(raw: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    return raw.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        _money(F.when(F.col("l_orderkey") % 211 == 0, F.lit(0.0)).otherwise(price)).alias("price"),
        _money(F.floor(price * (F.col("l_discount") + F.col("l_tax")) * 3)).alias("freight_value"),
    )


def _payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_linestatus") == "O", "credit_card")
        .when(F.col("l_discount") < 0.05, "boleto")
        .otherwise("voucher")
        .alias("payment_type"),
        (F.col("l_quantity").cast("int") % 13).alias("payment_installments"),
        _money(F.col("l_extendedprice")).alias("payment_value"),
    )


def _reviews(raw: DataFrame) -> DataFrame:
    score = 1 + (F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber")) % 5
    return raw.select(
        F.col("l_orderkey").alias("order_id"), score.cast("int").alias("review_score")
    )


def _products(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 53 != 0, F.lower("p_brand")).alias("product_category_name"),
    )


def _category_trans(raw: DataFrame) -> DataFrame:
    # One brand has no English name, so that the fallback to the original one is exercised.
    translated = F.when(F.col("p_brand") != "Brand#2", F.upper("p_brand"))
    return raw.select(
        F.lower("p_brand").alias("product_category_name"),
        translated.alias("product_category_name_english"),
    ).distinct()


def _text_reviews(documents: DataFrame, labels: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    score = (
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1 + doc % 2)
        .when(F.col("quality") == 1, 4 + doc % 2)
        .otherwise(F.lit(3))
    )
    return documents.select("doc_id", "text").join(labels, "doc_id", "left").select(
        doc.alias("review_id"),
        doc.alias("order_id"),
        score.cast("int").alias("review_score"),
        F.col("text").alias("review_comment_message"),
    )


def star_schema_tables(spark: SparkSession, folder: str) -> LazyTables:
    """The tables of ``parecer.sources.schemas`` read off the star schema."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    return LazyTables(
        {
            "orders": lambda: _orders(raw("orders")),
            "order_items": lambda: _items(raw("lineitem")),
            "payments": lambda: _payments(raw("lineitem")),
            "reviews": lambda: _reviews(raw("lineitem")),
            "products": lambda: _products(raw("part")),
            "category_trans": lambda: _category_trans(raw("part")),
            "customers": lambda: raw("customer").select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_nationkey").alias("customer_zip_code_prefix"),
                F.col("c_mktsegment").alias("customer_city"),
            ),
            "sellers": lambda: raw("supplier").select(
                F.col("s_suppkey").alias("seller_id"),
                F.col("s_nationkey").alias("seller_zip_code_prefix"),
            ),
            "geolocation": lambda: raw("nation").select(
                F.col("n_nationkey").alias("geolocation_zip_code_prefix"),
                F.col("n_name").alias("geolocation_state"),
            ),
            "text_reviews": lambda: _text_reviews(raw("documents"), raw("labels")),
        }
    )


ADAPTER_SQL: dict[str, str] = {
    "a_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
          CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
               ELSE 'canceled' END AS order_status,
          o_orderdate AS order_purchase_timestamp,
          o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 5 AS INT) AS order_approved_at,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL
               ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 4 AS INT)
          END AS order_delivered_carrier_date,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL
               ELSE o_orderdate + INTERVAL '1' HOUR
                    * CAST((o_orderkey*37 % 45)*24 + (o_orderkey*7 % 24) AS INT)
          END AS order_delivered_customer_date,
          o_orderdate + INTERVAL '1' DAY * CAST(15 + (o_orderkey*11 % 25) AS INT)
            AS order_estimated_delivery_date
        FROM orders""",
    "a_items": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
          CAST(CASE WHEN l_orderkey % 211 = 0 THEN 0 ELSE l_extendedprice END
               AS DECIMAL(12,2)) AS price,
          CAST(floor(l_extendedprice * (l_discount + l_tax) * 3) AS DECIMAL(12,2))
            AS freight_value
        FROM lineitem""",
    "a_payments": """
        SELECT l_orderkey AS order_id,
          CASE WHEN l_linestatus = 'O' THEN 'credit_card'
               WHEN l_discount < 0.05 THEN 'boleto' ELSE 'voucher' END AS payment_type,
          CAST(l_quantity AS INT) % 13 AS payment_installments,
          CAST(l_extendedprice AS DECIMAL(12,2)) AS payment_value
        FROM lineitem""",
    "a_reviews": """
        SELECT l_orderkey AS order_id,
          1 + (CAST(l_quantity AS INT)*7 + l_linenumber) % 5 AS review_score
        FROM lineitem""",
    "a_products": """
        SELECT p_partkey AS product_id,
          CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE lower(p_brand) END
            AS product_category_name
        FROM part""",
    "a_category_trans": """
        SELECT DISTINCT lower(p_brand) AS product_category_name,
          CASE WHEN p_brand <> 'Brand#2' THEN upper(p_brand) END
            AS product_category_name_english
        FROM part""",
    "a_customers": """
        SELECT c_custkey AS customer_id, c_nationkey AS customer_zip_code_prefix,
          c_mktsegment AS customer_city
        FROM customer""",
    "a_sellers": """
        SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix FROM supplier""",
    "a_geolocation": """
        SELECT n_nationkey AS geolocation_zip_code_prefix, n_name AS geolocation_state
        FROM nation""",
    "a_text_reviews": """
        SELECT d.doc_id AS review_id, d.doc_id AS order_id,
          CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 + d.doc_id % 2
               WHEN l.quality = 1 THEN 4 + d.doc_id % 2 ELSE 3 END AS review_score,
          d.text AS review_comment_message
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
