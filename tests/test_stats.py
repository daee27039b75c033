import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parecer.operators import models, stats
from tests.conftest import rows


def cells(spark, table, factor="f"):
    """Rows for a table given as {(level, outcome): n}."""
    data = [(a, b) for (a, b), n in table.items() for _ in range(n)]
    return spark.createDataFrame(data, f"{factor} int, is_bad int")


def test_yates_on_a_two_by_two_table(spark):
    df = cells(spark, {(0, 0): 30, (0, 1): 10, (1, 0): 15, (1, 1): 25})
    r = stats.chi2_test(stats.contingency(df, ["f"])).first()
    a, b, c, d, n = 30, 10, 15, 25, 80
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert r["chi2"] == pytest.approx(want)
    assert r["dof"] == 1
    assert r["cramers_v"] == pytest.approx(math.sqrt(want / n))


def test_correction_never_turns_the_gap_around(spark):
    df = cells(spark, {(0, 0): 2, (0, 1): 2, (1, 0): 2, (1, 1): 2})
    assert stats.chi2_test(stats.contingency(df, ["f"])).first()["chi2"] == 0.0


def test_wide_table_counts_unobserved_cells(spark):
    table = {(0, 0): 8, (0, 1): 2, (1, 0): 5, (2, 0): 1, (2, 1): 9}
    o = np.array([[8, 2], [5, 0], [1, 9]], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    r = stats.chi2_test(stats.contingency(cells(spark, table), ["f"])).first()
    assert r["chi2"] == pytest.approx(((o - e) ** 2 / e).sum())
    assert r["dof"] == 2


def test_empty_margin_gives_null(spark):
    r = stats.chi2_test(stats.contingency(cells(spark, {(0, 0): 3, (1, 0): 4}), ["f"])).first()
    assert (r["chi2"], r["cramers_v"], r["dof"]) == (None, None, 0)


def test_test_does_not_depend_on_row_order_or_partitions(spark):
    df = cells(spark, {(0, 0): 31, (0, 1): 7, (1, 0): 12, (1, 1): 22, (2, 0): 5, (2, 1): 6})
    first = stats.chi2_test(stats.contingency(df, ["f"])).first()
    again = stats.chi2_test(stats.contingency(df.orderBy(F.rand(3)).repartition(5), ["f"])).first()
    assert first == again


@pytest.mark.parametrize(
    ("chi2", "dof", "p"),
    [(3.841459, 1, 0.05), (6.634897, 1, 0.01), (5.991465, 2, 0.05), (7.814728, 3, 0.05),
     (9.487729, 4, 0.05), (11.070498, 5, 0.05), (31.410433, 20, 0.05), (0.0, 3, 1.0)],
)
def test_p_values_from_tables(chi2, dof, p):
    assert stats.chi_square_survival(chi2, dof) == pytest.approx(p, rel=1e-5)


def test_p_value_column(spark):
    df = spark.createDataFrame(
        [(3.841459, 1), (15087.0, 1), (None, 0)], "chi2 double, dof int"
    )
    got = [r["p_value"] for r in stats.with_p_value(df).collect()]
    assert got[0] == pytest.approx(0.05, rel=1e-5) and got[1] == 0.0 and got[2] is None


@pytest.fixture(scope="module")
def planted(spark):
    """10,000 orders whose outcome follows known log-odds."""
    rng = np.random.default_rng(5)
    n = 10_000
    delay = rng.integers(-20, 20, n)
    price = rng.gamma(2.0, 50.0, n).round(2)
    items = rng.integers(1, 5, n)
    logit = -2.0 + 0.12 * delay + 0.4 * items
    bad = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    data = [
        (str(i), int(delay[i]), int(delay[i] > 0), float(price[i]), float(price[i] % 37),
         int(items[i]), None if i % 50 == 0 else int(items[i]),
         "credit_card" if i % 3 else None, int(bad[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(
        data,
        "order_id string, delay_days int, is_delayed int, total_price double, "
        "freight_ratio double, item_count int, installments int, pay_type string, is_bad int",
    ).cache()


def test_gradient_vanishes_at_the_fitted_odds(planted):
    names = list(models.FEATURES)
    x = np.array(rows(models.standardize(models.features(planted)), *names), dtype=float)
    y = np.array([r[0] for r in rows(models.features(planted), "is_bad")], dtype=float)
    scaled = models.standardize(models.features(planted)).withColumn(
        "label", F.col("is_bad").cast("double")
    )
    model = models.fit_logit(scaled, names, "label")
    w, b = np.array([model.coefficients[n] for n in names]), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = w + x.T @ (p - y)
    assert np.abs(gradient).max() < 1e-6
    assert abs((p - y).sum()) < 1e-6
    assert model.passes <= 12


def test_a_fit_reads_the_rows_once_per_step(spark, planted):
    """Far columns, where a full step overshoots, and one outcome only."""
    rows_ = [(float(x), float(x > 40 or x == 3), 0.0) for x in range(100)] * 5
    df = spark.createDataFrame(rows_, "x double, y double, never double")
    model = models.fit_logit(df, {"far": F.col("x") * 100, "same": F.lit(2.0)}, "y")
    x, y = np.array([r[0] for r in rows_]) * 100, np.array([r[1] for r in rows_])
    p = 1 / (1 + np.exp(-(x * model.coefficients["far"] + 2 * model.coefficients["same"]
                          + model.intercept)))
    assert abs((p - y) @ x + model.coefficients["far"]) < 1e-3 and abs((p - y).sum()) < 1e-6
    one = models.fit_logit(df, ["x"], "never")
    assert (one.coefficients, one.intercept) == ({"x": 0.0}, -math.inf)
    none = models.fit_logit(df.where("false"), ["x"], "y")
    assert (none.coefficients, none.intercept) == ({"x": 0.0}, 0.0)


def test_odds_recover_the_planted_signs(planted):
    got = {r["feature"]: r for r in models.odds_ratios(planted).collect()}
    assert set(got) == set(models.FEATURES)
    assert got["delay_days"]["or_per_std"] > 2
    assert got["item_count"]["or_per_unit"] == pytest.approx(math.exp(0.4), rel=0.15)
    assert got["delay_days"]["interpretation"].startswith("延迟每+1天, 差评风险×")


def test_standardized_columns_have_mean_0_and_population_std_1(planted):
    z = models.standardize(models.features(planted).withColumn("total_price", F.lit(3.0)))
    m = {r["column"]: r for r in models.moments(z, list(models.FEATURES)).collect()}
    assert m["delay_days"]["mean"] == pytest.approx(0, abs=1e-9)
    assert m["delay_days"]["std"] == pytest.approx(1)
    assert rows(z.select(F.max("total_price")))[0][0] == 0.0


def test_missing_features_become_zero(planted):
    first = models.features(planted).where("order_id = '0'").first()
    assert (first["installments"], first["pay_type_credit"]) == (0.0, 0.0)


def brute_auc(x, y):
    pos, neg = x[y == 1], x[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def test_auc_against_all_pairs_and_its_mirror(planted):
    x = np.array([r[0] for r in rows(planted, "delay_days")])
    y = np.array([r[0] for r in rows(planted, "is_bad")])
    r = stats.auc(planted).first()
    assert r["auc"] == pytest.approx(brute_auc(x, y))
    mirrored = stats.auc(planted.withColumn("delay_days", -F.col("delay_days"))).first()
    assert mirrored["auc"] == pytest.approx(r["auc"])


@pytest.mark.parametrize("sign", [1, -1])
def test_auc_direction_is_that_of_the_fitted_coefficient(planted, sign):
    df = planted.withColumn("delay_days", sign * F.col("delay_days"))
    assert math.copysign(1, models.single_feature_logit(df).first()["coef"]) == sign


def test_weighted_fit_equals_the_fit_on_rows(planted):
    by_rows = models.fit_logit(
        planted.select(F.col("delay_days").cast("double").alias("x"),
                       F.col("is_bad").cast("double").alias("y")), ["x"], "y"
    )
    compact = models.single_feature_logit(planted).first()
    assert compact["coef"] == pytest.approx(by_rows.coefficients["x"], rel=1e-4)
    assert compact["intercept"] == pytest.approx(by_rows.intercept, rel=1e-4)


def test_relative_risk_lists_all_groups(planted):
    got = {r["delay_group"]: r for r in stats.relative_risk(planted).collect()}
    assert got["准时/提前1-3天"]["rr"] == pytest.approx(1.0)
    assert sum(r["n"] for r in got.values()) == planted.count()
    none_on_time = stats.relative_risk(planted.where("delay_days > 5")).collect()
    assert all(r["rr"] is None and r["rr_is_infinite"] for r in none_on_time)


def test_thresholds_split_all_orders(planted):
    got = {r["threshold"]: r for r in stats.threshold_scan(planted).collect()}
    assert list(got) == [1, 2, 3, 4, 5, 7, 10]
    above = planted.where("delay_days > 3")
    assert got[3]["n_above"] == above.count()
    assert got[3]["bad_above_pct"] == pytest.approx(above.agg(F.avg("is_bad")).first()[0] * 100)
    assert stats.threshold_scan(planted, more_than=10**6).count() == 0


def test_strata(planted):
    got = stats.stratified(planted).collect()
    assert sum(r["n"] for r in got) == planted.count()


@pytest.mark.parametrize(
    "chi2, dof, p",
    [
        (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
        (0.0, 4, 1.0), (1600, 1601, 0.5023514), (3094, 3094, 0.4966192), (40.0, 2, 2.0611536e-9),
    ],
)
def test_tail_of_chi_square(chi2, dof, p):
    assert stats.chi_square_survival(chi2, dof) == pytest.approx(p, rel=2e-3)


def test_infinite_risk_is_marked_high(spark):
    facts = spark.createDataFrame(
        [(0, 0)] * 5 + [(6, 1)] * 3 + [(6, 0)], "delay_days int, is_bad int"
    )
    got = {r["delay_group"]: r for r in stats.relative_risk(facts).collect() if r["n"]}
    marks = {name: (r["mark"], r["base_pct"]) for name, r in got.items()}
    assert sorted(marks.values()) == [("", 0.0), ("high", 0.0)]
