import os
import sys
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parecer.session import local_session  # noqa: E402

BASE = datetime(2018, 1, 1)

SCHEMAS = {
    "orders": (
        "order_id string, order_status string, order_purchase_timestamp timestamp, "
        "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp"
    ),
    "order_items": (
        "order_id string, product_id string, seller_id string, price decimal(12,2), "
        "freight_value decimal(12,2)"
    ),
    "payments": (
        "order_id string, payment_type string, payment_installments int, "
        "payment_value decimal(12,2)"
    ),
    "reviews": "order_id string, review_score int",
    "products": "product_id string, product_category_name string",
    "category_trans": "product_category_name string, product_category_name_english string",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "tests", settings={"spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Tables from plain rows: make(orders=[...], reviews=[...])."""

    def build(**rows):
        out = {}
        for name, schema in SCHEMAS.items():
            data = rows.get(name, [])
            out[name] = spark.createDataFrame([tuple(map(_plain, r)) for r in data], schema)
        return out

    return build


def _plain(x):
    return Decimal(str(x)) if isinstance(x, float) else x


def order(key, delay=0.0, status="delivered", arrived=True, promised_in=20):
    """An order bought on the base day, promised after some days, arriving delay days later."""
    promised = BASE + timedelta(days=promised_in)
    arrival = promised + timedelta(days=delay) if arrived else None
    return (key, status, BASE, arrival, promised)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]
