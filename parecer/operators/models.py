"""Logistic models of a bad review, fitted by Newton steps on sums over the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The features in their order, each with the unit its phrase names.
FEATURES = {
    "delay_days": "延迟每+1天",
    "is_delayed": "延迟(vs准时)",
    "total_price": "客单价每+1std",
    "freight_ratio": "运费占比每+1std",
    "item_count": "商品数每+1std",
    "installments": "分期每+1std",
    "pay_type_credit": "信用卡(vs其他)",
}
PHRASE = ", 差评风险×"
CREDIT = "credit_card"


def features(facts: DataFrame) -> DataFrame:
    """The features as doubles, missing ones 0, with the outcome."""
    credit = F.coalesce((F.col("pay_type") == CREDIT).cast("double"), F.lit(0.0))
    numbers = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
        for c in FEATURES
        if c != "pay_type_credit"
    ]
    return facts.select("order_id", *numbers, credit.alias("pay_type_credit"), "is_bad")


def _moment_columns(columns: Sequence[str]) -> list[Column]:
    return [F.avg(c).alias(f"mean_{c}") for c in columns] + [
        F.stddev_pop(c).alias(f"std_{c}") for c in columns
    ]


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per column, in one pass: (column, mean, std).

    A column that never varies gets 1, so that dividing leaves it at 0.
    """
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"mean_{c}").alias("mean"),
            F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}")).alias("std"),
        )
        for c in columns
    ]
    return df.agg(*_moment_columns(columns)).select(F.inline(F.array(*rows)))


def _scaled(df: DataFrame, columns: Sequence[str], scale: dict) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c) - scale[c]["mean"]) / scale[c]["std"] for c in columns}
    )


def _scale(df: DataFrame, columns: Sequence[str]) -> dict:
    return {r["column"]: r for r in moments(df, columns).collect()}


def standardize(df: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Each column less its mean, over its population standard deviation.

    The scale (one row per column) is the only thing that passes through the driver.
    """
    return _scaled(df, columns, _scale(df, columns))


@dataclass
class Logit:
    """Coefficients by column and the intercept; the number of passes over the rows."""

    coefficients: dict[str, float]
    intercept: float
    passes: int


def _sums(df: DataFrame, x: Mapping[str, Column], label: Column, weight: Column, point) -> tuple:
    """Loss, gradient and Hessian at a point, from one aggregate over the rows."""
    ones = [F.lit(1.0), *x.values()]
    z = reduce(add, (F.lit(float(w)) * c for w, c in zip(point, ones)))
    # Both parts are taken where the exponential is at most 1.
    small = F.exp(-F.abs("z"))
    p = F.when(F.col("z") >= 0, 1 / (1 + small)).otherwise(small / (1 + small))
    names = [f"x{i}" for i in range(len(x))]
    rows = df.select(
        z.alias("z"), label.cast("double").alias("y"), weight.alias("n"),
        *[c.alias(n) for c, n in zip(x.values(), names)],
    ).withColumn("p", p)
    loss = F.sum(F.col("n") * (F.log1p(small) + F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z")))
    off, spread = F.col("n") * (F.col("p") - F.col("y")), F.col("n") * F.col("p") * (1 - F.col("p"))
    columns = [F.lit(1.0), *map(F.col, names)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = rows.agg(
        loss,
        *[F.sum(off * c) for c in columns],
        *[F.sum(spread * columns[i] * columns[j]) for i, j in pairs],
    ).first()
    size = len(columns)
    hessian = np.zeros((size, size))
    for (i, j), value in zip(pairs, found[1 + size:]):
        hessian[i, j] = hessian[j, i] = value
    return found[0], np.array(found[1:1 + size]), hessian


def fit_logit(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    label: str,
    c: float = 1.0,
    max_iter: int = 100,
    weight: str | None = None,
    tolerance: float = 1e-9,
) -> Logit:
    """Logistic regression with penalty ½‖w‖² against c·Σ loss, intercept not penalised.

    Every pass is one aggregate, which gives the loss, its gradient and its Hessian; the step
    that they tell is solved on the driver, on one number per pair of columns. A step that does
    not lower the loss is halved. ``columns`` are names, or names with the expression to use.
    Without both outcomes the coefficients are 0 and the intercept is infinite, as the loss
    then has no least value; without rows it is 0.
    """
    x = columns if isinstance(columns, Mapping) else {n: F.col(n) for n in columns}
    n = F.col(weight) if weight else F.lit(1.0)
    point = np.zeros(len(x) + 1)
    step = np.zeros(len(x) + 1)
    penalty = np.append(0.0, np.ones(len(x)))
    least, passes = math.inf, 0
    while passes < max_iter:
        loss, gradient, hessian = _sums(df, x, F.col(label), n, point)
        passes += 1
        if passes == 1 and (loss is None or abs(gradient[0]) >= 2 * hessian[0, 0] * (1 - 1e-12)):
            # At 0 every row has probability one half: all rows on one side.
            sign = 0.0 if loss is None else -math.copysign(math.inf, gradient[0])
            return Logit(dict.fromkeys(x, 0.0), sign, passes)
        loss = c * loss + 0.5 * float(penalty @ point**2)
        if loss > least + 1e-12 * abs(least) and np.abs(step).max() > tolerance:
            step = step / 2
            point = point - step
            continue
        least = loss
        step = -np.linalg.solve(
            c * hessian + np.diag(penalty), c * gradient + penalty * point
        )
        point = point + step
        if np.abs(step).max() <= tolerance:
            break
    return Logit(dict(zip(x, point[1:].tolist())), float(point[0]), passes)


def odds_ratios(facts: DataFrame, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """Odds ratio of each standardized feature, largest first, also per unit.

    The features are kept, on disk where memory is short, over the passes of the fit; lost
    blocks are computed again from the tables. What returns is one row per feature.
    """
    spark = facts.sparkSession
    names = list(FEATURES)
    raw = features(facts).select(*names, F.col("is_bad").cast("double").alias("label"))
    raw.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scale = _scale(raw, names)
        x = {n: (F.col(n) - scale[n]["mean"]) / scale[n]["std"] for n in names}
        model = fit_logit(raw, x, "label", c, max_iter)
    finally:
        raw.unpersist()
    rows = [
        (name, model.coefficients[name], float(scale[name]["std"]), FEATURES[name] + PHRASE)
        for name in names
    ]
    table = spark.createDataFrame(rows, "feature string, coef double, std double, phrase string")
    per_std = F.exp("coef")
    return table.select(
        "feature",
        "coef",
        per_std.alias("or_per_std"),
        F.exp(F.col("coef") / F.col("std")).alias("or_per_unit"),
        F.concat("phrase", F.format_number(per_std, 2)).alias("interpretation"),
    ).orderBy(F.desc("or_per_std"), "feature")


def single_feature_logit(
    facts: DataFrame, feature: str = "delay_days", outcome: str = "is_bad", c: float = 1.0
) -> DataFrame:
    """Coefficient and intercept of the one-variable model.

    The rows shrink to one weighted row per distinct value and outcome before the fit.
    """
    counts = (
        facts.where(F.col(feature).isNotNull())
        .groupBy(F.col(feature).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_logit(counts, ["x"], "y", c, weight="w")
    finally:
        counts.unpersist()
    row = [(feature, model.coefficients["x"], model.intercept)]
    return facts.sparkSession.createDataFrame(
        row, "feature string, coef double, intercept double"
    )
