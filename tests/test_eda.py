import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parecer.operators import eda, ranking
from tests.conftest import order, rows


def test_histogram_matches_numpy(spark):
    values = [-30, -30, 3, 7, 7, 7, 12, 50]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = rows(ranking.histogram(ranking.value_counts(df, "x"), "x", 16).orderBy("bin"))
    counts, edges = np.histogram(values, bins=16)
    assert [r[3] for r in got] == list(counts)
    assert [r[1] for r in got] == pytest.approx(edges[:-1])
    assert [r[2] for r in got] == pytest.approx(edges[1:])


def test_histogram_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(4,), (4,), (None,)], "x int")
    got = rows(ranking.histogram(ranking.value_counts(one, "x"), "x", 10).orderBy("bin"))
    counts, edges = np.histogram([4, 4], bins=10)
    assert [r[3] for r in got] == list(counts)
    assert (got[0][1], got[-1][2]) == (edges[0], edges[-1])
    assert ranking.histogram(ranking.value_counts(one.where("x > 9"), "x"), "x", 10).count() == 0


def test_running_share_equals_one_window_and_ends_at_100(spark):
    # A third of the rows share one amount.
    df = spark.range(3000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.hash("id") % 500 + 500).cast(
            "decimal(12,2)").alias("v"),
    )
    got = ranking.running_share(df, "v", "k").select("k", "rank", "cum_pct", "rank_pct")
    w = Window.orderBy(F.desc("v"), "k")
    total = df.agg(F.sum("v")).first()[0]
    plain = df.select(
        "k",
        F.row_number().over(w).alias("rank"),
        (F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double") * 100
         / float(total)).alias("cum_pct"),
        (F.row_number().over(w) * 100 / 3000).alias("rank_pct"),
    )
    a, b = sorted(rows(got)), sorted(rows(plain))
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert np.allclose([r[2] for r in a], [r[2] for r in b])
    last = max(a, key=lambda r: r[1])
    assert last[2] == pytest.approx(100) and last[3] == 100


def test_pareto_counts_whole_sellers(make):
    items = [("o", "p", f"s{i:03d}", float(200 - i), 0.0) for i in range(150)]
    lorenz = eda.seller_lorenz(make(order_items=items)["order_items"])
    got = {r["top_pct"]: r for r in eda.pareto(lorenz).collect()}
    assert [got[p]["n_sellers"] for p in (1, 5, 10)] == [1, 7, 15]
    total = sum(200 - i for i in range(150))
    assert got[1]["gmv_pct"] == pytest.approx(200 / total * 100)


def test_delay_rates_leave_unknown_in_the_denominator(make):
    t = make(orders=[order("a", 2.0), order("b", -2.0), order("c", 12.0), order("d", arrived=False)])
    r = eda.delay_rates(t["orders"]).first()
    assert (r["delayed_pct"], r["on_time_pct"], r["severe_pct"]) == (50.0, 25.0, 25.0)


def test_box_matches_numpy(make):
    delays = [-40.0, -9.0, -8.0, -7.0, -7.0, -6.0, 0.0, 1.0, 3.0, 9.0, 11.0]
    t = make(orders=[order(str(i), d, promised_in=60) for i, d in enumerate(delays)])
    got = {r["level"]: r for r in eda.delay_box(t["orders"]).collect()}
    x = np.array([d for d in delays if d <= 0])
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    r = got["按时/提前"]
    assert (r["q1"], r["median"], r["q3"]) == (q1, q2, q3)
    assert (r["whisker_low"], r["whisker_high"]) == (x[x >= low].min(), x[x <= high].max())


def test_category_without_name_is_dropped_but_original_kept(make):
    t = make(
        order_items=[("a", "p1", "s", 10.0, 1.0), ("a", "p2", "s", 20.0, 2.0),
                     ("a", "p3", "s", 30.0, 3.0), ("a", "p9", "s", 1.0, 1.0)],
        products=[("p1", "bebes"), ("p2", "raro"), ("p3", None)],
        category_trans=[("bebes", "baby")],
    )
    got = eda.category_gmv(t["order_items"], t["products"], t["category_trans"])
    assert {r["category_en"]: float(r["gmv"]) for r in got.collect()} == {"baby": 10.0, "raro": 20.0}


def test_shares_sum_to_100(make):
    t = make(reviews=[("a", 1), ("b", 1), ("c", 4), ("d", 5), ("e", None)])
    assert sum(r["pct"] for r in eda.score_dist(t["reviews"]).collect()) == pytest.approx(100)
    labels = {r["label"]: r["n"] for r in eda.sentiment(t["reviews"]).collect()}
    assert labels == {"差评(1-2)": 2, "好评(4-5)": 2}


def test_manual_sort_puts_unlisted_last(spark):
    df = spark.createDataFrame([("x",), ("b",), ("a",)], "k string")
    assert [r["k"] for r in ranking.manual_sort(df, "k", ["b", "a"]).collect()] == ["b", "a", "x"]


@pytest.mark.parametrize("ranges", [2, 3, 4096])
def test_sums_of_largest_against_a_sort(spark, ranges):
    draw = random.Random(ranges)
    for top in (3, 1000, 10**12):
        values = [draw.randint(-top, top) for _ in range(200)] + [top] * 30 + [None] * 5
        df = spark.createDataFrame([(v,) for v in values], "x long").cache()
        known = sorted((v for v in values if v is not None), reverse=True)
        ks = [0, 1, 29, 31, 115, 230, 999]
        got = ranking.sums_of_largest(df, "x", ks, ranges)
        assert got == [sum(known[:k]) for k in ks]
    assert ranking.sums_of_largest(df.where("false"), "x", [1, 2]) == [0, 0]


def test_pareto_ranks_no_sellers(spark, make, monkeypatch):
    """Ties at the edge count as whole sellers, and no rank is worked out."""
    items = [(str(i), "p", f"s{i}", float(10 + i % 2), 1.0) for i in range(40)]
    t = make(order_items=items)
    monkeypatch.setattr(eda, "running_share", None)
    got = {r["top_pct"]: r for r in eda.pareto(eda.seller_gmv(t["order_items"]), (10, 55)).collect()}
    assert got[10]["n_sellers"] == 4 and got[10]["gmv_pct"] == pytest.approx(4400 / 420)
    assert got[55]["gmv_pct"] == pytest.approx((20 * 11 + 2 * 10) * 100 / 420)
    assert eda.pareto(eda.seller_gmv(make()["order_items"])).first()["gmv_pct"] is None
