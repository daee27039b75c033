import pytest
from pyspark.sql import functions as F

from parecer.operators import drivers, facts, orders
from tests.conftest import order, rows

PRODUCTS = [("p1", "bebes"), ("p2", None), ("p3", "raro")]
TRANS = [("bebes", "baby")]


@pytest.fixture
def shop(make):
    return make(
        orders=[order("a", 3.0), order("b", -5.0), order("c", 1.0), order("d", arrived=False)],
        order_items=[
            ("a", "p1", "s1", 10.0, 1.0), ("a", "p2", "s1", 30.0, 3.0), ("a", "p1", "s1", 10.0, 1.0),
            ("b", "p3", "s2", 0.0, 5.0),
            ("c", "p2", "s1", 7.0, 1.0), ("c", "unknown", "s1", 100.0, 1.0),
            ("d", "p1", "s1", 9.0, 1.0),
        ],
        reviews=[("a", 1), ("a", 2), ("b", 5), ("c", 3), ("d", 1)],
        products=PRODUCTS,
        category_trans=TRANS,
        payments=[
            ("a", "voucher", 1, 5.0), ("a", "credit_card", 3, 49.0),
            ("b", "voucher", 2, 5.0), ("b", "boleto", 1, 5.0),
        ],
    )


def wide(t, **options):
    return facts.order_facts(
        t["orders"], t["order_items"], t["reviews"], t["products"], t["category_trans"],
        t["payments"], **options
    )


def test_fanout_multiplies_sums_by_reviews(shop):
    got = {r["order_id"]: r for r in wide(shop).collect()}
    assert set(got) == {"a", "b", "c"}
    assert float(got["a"]["total_price"]) == 100.0  # 50 of price, two reviews
    assert float(got["a"]["total_freight"]) == 10.0
    assert got["a"]["freight_ratio"] == 10.0
    assert got["a"]["item_count"] == 2
    dedup = {r["order_id"]: r for r in wide(shop, fanout="dedup").collect()}
    assert float(dedup["a"]["total_price"]) == 50.0
    assert dedup["a"]["freight_ratio"] == 10.0
    with pytest.raises(ValueError):
        wide(shop, fanout="twice")


def test_fanout_equals_the_plain_join(shop):
    t = shop
    joined = (
        orders.filter_delivered(t["orders"])
        .join(t["order_items"], "order_id")
        .join(t["reviews"], "order_id")
        .join(t["products"], "product_id")
        .groupBy("order_id")
        .agg(F.sum("price"), F.sum("freight_value"), F.count(F.lit(1)))
    )
    narrow = facts.order_facts_category(
        t["orders"], t["order_items"], t["reviews"], t["products"], t["category_trans"]
    ).select("order_id", "gmv", "freight", "items")
    assert sorted(rows(joined)) == sorted(rows(narrow))


def test_items_of_unknown_products_do_not_count(shop):
    got = {r["order_id"]: r for r in wide(shop).collect()}
    assert float(got["c"]["total_price"]) == 7.0


def test_main_category_is_that_of_the_first_product(shop):
    got = dict(rows(wide(shop), "order_id", "main_category"))
    assert got == {"a": "baby", "b": "Unknown", "c": "Unknown"}


def test_largest_payment_and_ties(shop):
    got = {r[0]: r[1:] for r in rows(orders.row_number_top1(shop["payments"]))}
    assert got["a"][0] == "credit_card"
    assert got["b"][:2] == ("boleto", 1)
    left = dict(rows(wide(shop), "order_id", "pay_type"))
    assert left["c"] is None


def test_flags_and_scores(shop):
    got = {r["order_id"]: r for r in wide(shop).collect()}
    assert (got["a"]["is_delayed"], got["a"]["is_severely_delayed"]) == (1, 0)
    assert (got["a"]["avg_score"], got["a"]["is_bad"]) == (1.5, 1)
    assert (got["b"]["is_delayed"], got["b"]["is_bad"]) == (0, 0)


def test_summary(shop):
    r = facts.facts_summary(wide(shop)).first()
    assert (r["n_orders"], r["n_categories"]) == (3, 2)
    assert r["bad_pct"] == pytest.approx(100 / 3)
    assert r["delayed_pct"] == pytest.approx(200 / 3)


def test_zero_price_has_no_ratio_and_falls_in_the_last_bucket(shop):
    ratio = dict(rows(orders.order_freight_agg(shop["order_items"]), "order_id", "freight_ratio"))
    assert ratio["b"] is None
    q2 = {r[0]: r[1] for r in rows(drivers.freight_ratio(shop["order_items"], shop["reviews"]))}
    assert q2["30%+"] == 1


def test_mixed_payments_take_the_last_type_by_name(shop):
    pay = {r["order_id"]: r for r in orders.order_pay_agg(shop["payments"]).collect()}
    assert pay["a"]["pay_type"] == "voucher"
    assert drivers.payment_installments(shop["payments"], shop["reviews"]).count() == 0


def test_category_question_weighs_items(shop):
    got = drivers.category_bad_rate(
        shop["order_items"], shop["products"], shop["category_trans"], shop["reviews"],
        min_orders=1,
    )
    by_name = {r["category"]: r for r in got.collect()}
    assert (by_name["baby"]["orders"], by_name["baby"]["n_items"]) == (2, 3)
    assert by_name["Unknown"]["orders"] == 3
    assert by_name["Unknown"]["bad_rate_pct"] == 33.3


def test_segments_overlap_and_empty_ones_stay(shop):
    got = {r["segment"]: r for r in drivers.segments(
        shop["orders"], shop["order_items"], shop["reviews"], high_freight_over=1000
    ).collect()}
    assert got["All Orders"]["n"] == got["Delayed"]["n"] + got["Not Delayed"]["n"]
    assert got["High Freight(>20%)"]["n"] == 0


def test_rates_do_not_change_when_all_rows_are_doubled(spark, shop):
    once = drivers.review_group_delay(shop["orders"], shop["reviews"])
    again = drivers.review_group_delay(
        shop["orders"], shop["reviews"].unionAll(shop["reviews"]).repartition(5)
    )
    assert rows(once) == rows(again)
