import numpy as np
import pandas as pd
import pytest

from parecer.operators import risk, rollups
from parecer.plans import catalog
from tests.conftest import order, rows


@pytest.fixture(scope="module")
def sold(spark):
    """Orders in 20 categories of very different sizes; the first holds a third."""
    rng = np.random.default_rng(11)
    n = 9000
    cat = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 20, n))
    late = (rng.random(n) < 0.05 + 0.01 * cat).astype(int)
    bad = (rng.random(n) < 0.1 + late * (0.2 + 0.02 * (cat % 7))).astype(int)
    pdf = pd.DataFrame(
        {"order_id": np.arange(n).astype(str), "is_delayed": late, "is_bad": bad,
         "category": [f"c{c:02d}" for c in cat], "gmv": rng.integers(1, 500, n)}
    )
    return pdf, risk.category_stats(spark.createDataFrame(pdf)).cache()


def per_category(pdf):
    g = pdf.groupby("category")
    out = pd.DataFrame({
        "orders": g.size(), "late": g.is_delayed.sum(), "bad": g.is_bad.sum(),
        "bl": pdf[pdf.is_delayed == 1].groupby("category").is_bad.mean(),
        "bo": pdf[pdf.is_delayed == 0].groupby("category").is_bad.mean(),
    })
    out["dr"] = out.late / out.orders
    out["risk"] = out.dr * (out.bl - out.bo) * 100
    return out.reset_index()


def test_lift(sold):
    pdf, stats = sold
    want = per_category(pdf)
    want = want[(want.orders >= 200) & (want.dr > 0.03) & (want.late >= 10)]
    want = want.assign(delta=(want.bl - want.bo) * 100).sort_values("delta", ascending=False)[:15]
    got = risk.delay_lift(stats).collect()
    assert [r["category"] for r in got] == list(want.category)
    assert [r["lift"] for r in got] == pytest.approx(list(want.bl / want.bo))
    base = pdf[pdf.is_delayed == 0].is_bad.mean() * 100
    assert got[0]["base_ontime"] == pytest.approx(base)


def test_risk_score(sold):
    pdf, stats = sold
    want = per_category(pdf)
    want = want[want.orders >= 200].sort_values("risk", ascending=False)[:12]
    got = risk.risk_score(stats).collect()
    assert [r["category"] for r in got] == list(want.category)
    assert [r["risk_score"] for r in got] == pytest.approx(list(want.risk))


def test_few_late_orders_show_no_growth_but_keep_the_score(spark):
    pdf = pd.DataFrame({"order_id": [str(i) for i in range(300)], "category": "c", "gmv": 1,
                        "is_delayed": [1] * 5 + [0] * 295, "is_bad": [1] * 5 + [0] * 295})
    r = risk.risk_score(risk.category_stats(spark.createDataFrame(pdf))).first()
    assert r["delta_pp"] == 0.0 and r["risk_score"] == pytest.approx(5 / 300 * 100)


def test_category_without_late_orders_comes_last(spark):
    pdf = pd.DataFrame({"order_id": [str(i) for i in range(600)], "gmv": 1,
                        "category": ["a"] * 300 + ["b"] * 300,
                        "is_delayed": [0] * 300 + [1] * 20 + [0] * 280,
                        "is_bad": [1] * 10 + [0] * 590})
    got = risk.risk_score(risk.category_stats(spark.createDataFrame(pdf))).collect()
    assert [r["category"] for r in got] == ["b", "a"] and got[1]["risk_score"] is None


def test_tiers_against_medians(sold):
    pdf, stats = sold
    want = per_category(pdf)
    want = want[want.orders >= 200]
    bad_median = want.bad.median()
    top = want.sort_values("risk", ascending=False)[:12]
    high, many = top.risk > top.risk.median(), top.bad > bad_median
    tiers = {
        "A": list(top[high & many].category),
        "B": list(top[high & ~many].category)[:5],
        "C": list(top[~high & many].category)[:5],
    }
    got = {}
    for r in risk.tiers(stats).collect():
        got.setdefault(r["tier"], []).append(r["category"])
    assert got == {k: v for k, v in tiers.items() if v}


def test_rates_compare_with_all_orders(sold):
    pdf, stats = sold
    got = risk.category_rates(stats).collect()
    overall = pdf.is_delayed.mean() * 100
    assert got[0]["delay_gap_pp"] == pytest.approx(abs(got[0]["delay_rate"] - overall))
    assert got[0]["delay_flag"] == "↑"
    assert len(got) == 10


def test_volume(sold):
    pdf, stats = sold
    got = risk.bad_volume(stats).first()
    both = pdf[(pdf.is_delayed == 1) & (pdf.is_bad == 1)].groupby("category").size()
    assert got["delayed_bad"] == both.max()
    assert got["bad_orders"] == got["delayed_bad"] + got["ontime_bad"]


@pytest.fixture
def delivered(make):
    t = make(
        orders=[order("a", 3.0), order("b", -5.0), order("c", -1.0), order("d", arrived=False),
                order("e", 3.0, status="shipped"), order("f", -20.0)],
        order_items=[("a", "p1", "s", 10.0, 1.0), ("b", "p1", "s", 20.0, 1.0)],
        reviews=[("a", 1), ("b", 5), ("b", 4), ("d", 2)],
        products=[("p1", "bebes")],
        category_trans=[("bebes", "baby")],
        payments=[("a", "credit_card", 3, 11.0), ("b", "boleto", 1, 21.0)],
    )
    return rollups.rollup_facts(
        t["orders"], t["order_items"], t["reviews"], t["products"], t["category_trans"],
        t["payments"],
    )


def test_totals_agree_over_the_roll_ups(delivered):
    n, bad = 5, 2
    monthly = rollups.rollup_monthly(delivered).collect()
    groups = rollups.rollup_group_compare(delivered).collect()
    dose = rollups.rollup_delay_dose(delivered).collect()
    payment = rollups.rollup_payment(delivered).collect()
    kpi = {r["metric"]: r["value"] for r in rollups.rollup_kpi(delivered).collect()}
    assert sum(r["to"] for r in monthly) == n == sum(r["to"] for r in groups)
    assert sum(r["ords"] for r in dose) == n == sum(r["to"] for r in payment)
    assert sum(r["br"] for r in monthly) == bad == sum(r["bads"] for r in dose)
    assert kpi == {"总订单数": 5.0, "差评率": 40.0, "延迟率": 20.0, "平均评分": 2.5}


def test_order_not_arrived_falls_in_the_last_bucket(delivered):
    got = {r["delay_bucket"]: r["ords"] for r in rollups.rollup_delay_dose(delivered).collect()}
    assert got == {"delay_1_3": 1, "early_3_10": 1, "on_time": 1, "delay_10plus": 1,
                   "early_10plus": 1}


def test_order_without_review_is_not_bad(delivered):
    groups = {r["rg"]: r["to"] for r in rollups.rollup_group_compare(delivered).collect()}
    assert groups == {"bad(1-2)": 2, "not_bad(3-5)": 3}
    kinds = {r["pt"]: r["to"] for r in rollups.rollup_payment(delivered).collect()}
    assert kinds == {"credit_card": 1, "boleto": 1, "unknown": 3}


def test_dashboard_queries(delivered):
    kpi = rollups.kpi_member_filter(rollups.rollup_kpi(delivered), "差评率")
    assert rows(kpi, "value") == [(40.0,)]
    long = rollups.unpivot_metrics(rollups.rollup_group_compare(delivered))
    assert long.count() == 8
    dose = rollups.dash_dose_sum(rollups.rollup_delay_dose(delivered)).collect()
    assert [r["delay_bucket"] for r in dose] == [
        "early_10plus", "early_3_10", "on_time", "delay_1_3", "delay_10plus"]
    categories = rollups.rollup_category_risk(delivered, min_orders=1)
    names = [r[0] for r in rows(rollups.dash_top_bad(categories))]
    assert names == ["Unknown", "baby"]
    quadrants = {r["product_category_name_english"]: r["quadrant"]
                 for r in rollups.dash_risk_matrix(categories).collect()}
    assert quadrants["baby"] == "late/bad"


def test_map_lookup_has_no_top_k(spark, monkeypatch):
    n = 1003
    stats = spark.range(n).selectExpr(
        "format_string('c%04d', id) as category", "100L as orders", "id % 7 + 1 as delayed_orders",
        "1L as bad_orders", "cast(id % 7 + 1 as double) as delay_rate", "1.0D as bad_rate",
        "5.0D as avg_gmv",
    )
    monkeypatch.setattr(catalog, "_category_stats", lambda t: stats)
    named = stats.selectExpr("category as product_category_name_english")
    found = catalog.map_lookup({"category_trans": named}).collect()
    assert len(found) == n and all(r["delay_rate_or_0"] > 0 for r in found)
