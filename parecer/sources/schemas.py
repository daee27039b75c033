"""The nine tables: the columns the operators use and their types.

``orders`` has one row per order_id, ``products`` one per product_id and
``category_trans`` one per product_category_name. The other tables may hold any
number of rows per order. Columns not listed here stay text.
"""

TABLES: dict[str, dict[str, str]] = {
    "orders": {
        "order_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp",
        "order_approved_at": "timestamp",
        "order_delivered_carrier_date": "timestamp",
        "order_delivered_customer_date": "timestamp",
        "order_estimated_delivery_date": "timestamp",
    },
    "order_items": {
        "order_id": "string",
        "product_id": "string",
        "seller_id": "string",
        "price": "decimal(12,2)",
        "freight_value": "decimal(12,2)",
    },
    "payments": {
        "order_id": "string",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "decimal(12,2)",
    },
    "reviews": {
        "order_id": "string",
        "review_score": "int",
        "review_comment_title": "string",
        "review_comment_message": "string",
    },
    "products": {"product_id": "string", "product_category_name": "string"},
    "category_trans": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
    "customers": {},
    "sellers": {},
    "geolocation": {},
}

TIMESTAMP_COLUMNS = tuple(
    name for name, kind in TABLES["orders"].items() if kind == "timestamp"
)

# Free text may hold line breaks, and such a file cannot be split over tasks.
MULTI_LINE_TABLES = frozenset({"reviews"})

# Columns of the dashboard roll-up files.
ROLLUPS: dict[str, str] = {
    "kpi_summary": "metric STRING, value DOUBLE, format STRING",
    "monthly_trend": (
        "purchase_month STRING, `to` INT, `do` INT, br INT, dr DOUBLE, brr DOUBLE, "
        "`add` DOUBLE, `asc` DOUBLE"
    ),
    "delay_dose": "delay_bucket STRING, ords INT, bads INT, brate DOUBLE",
    "group_compare": (
        "rg STRING, `to` INT, dr DOUBLE, `add` DOUBLE, ap DOUBLE, afr DOUBLE, ai DOUBLE, "
        "aad DOUBLE, aed DOUBLE"
    ),
    "category_risk": (
        "product_category_name_english STRING, `to` INT, `do` INT, br INT, dr DOUBLE, "
        "brr DOUBLE, `add` DOUBLE, ap DOUBLE, afr DOUBLE, d_br DOUBLE, o_br DOUBLE, lift DOUBLE"
    ),
    "payment": "pt STRING, `to` INT, br INT, brr DOUBLE, dr DOUBLE, ai DOUBLE, av DOUBLE",
}
