"""Tests and risk measures; all of them work on counts per distinct value."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parecer.functions import fixed_values as fv
from parecer.functions.ladders import cut
from parecer.functions.measures import rate_among, share
from parecer.operators.ranking import literal_rows, value_counts
from parecer.session import materialize


def contingency(df: DataFrame, factors: Sequence[str], outcome: str = "is_bad") -> DataFrame:
    """Rows per factor, level and outcome: (factor, level, outcome, n), one pass for all
    factors. Rows with a null in the factor or the outcome are left out."""
    levels = [
        F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors
    ]
    known = F.col("level").isNotNull() & F.col("outcome").isNotNull()
    return value_counts(
        df.select(F.col(outcome).alias("outcome"), F.inline(F.array(*levels))).where(known),
        "factor",
        "level",
        "outcome",
    )


def chi_square_survival(chi2: float, dof: int) -> float:
    """Probability of a χ² of at least this size, from the finite sums for whole dof.

    The terms are summed by their logarithms, as each alone may be too small for a double.
    """
    half = chi2 / 2.0
    odd = dof % 2
    if half <= 0:
        return 1.0
    # Term i is half**(i + odd/2) e**-half / gamma(i + 1 + odd/2).
    logs = [
        (i + odd / 2) * math.log(half) - half - math.lgamma(i + 1 + odd / 2)
        for i in range((dof - odd) // 2)
    ]
    top = max(logs, default=0.0)
    total = math.exp(top) * math.fsum(math.exp(x - top) for x in logs) if logs else 0.0
    return min(1.0, total + (math.erfc(math.sqrt(half)) if odd else 0.0))


@F.pandas_udf(DoubleType())
def _p_value(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(x) or pd.isna(d) or d < 1 else chi_square_survival(x, int(d))
            for x, d in zip(chi2, dof)
        ],
        dtype="float64",
    )


def chi2_test(cells: DataFrame) -> DataFrame:
    """χ² per factor, with Yates' correction for 2×2, degrees of freedom, and Cramér's V.

    Takes the cells of ``contingency`` and works on the observed ones with their margins;
    unobserved cells need no row, since Σ(O−E)²/E = N·(Σ O²/(R·C) − 1), and in a 2×2 table
    every cell has the same |O−E|. Null for a factor with a single level. The windows run
    over the cells of one factor, not over rows.
    """
    n = F.col("n").cast("double")
    by_row = Window.partitionBy("factor", "level")
    by_col = Window.partitionBy("factor", "outcome")
    margins = cells.select(
        "factor",
        "level",
        "outcome",
        n.alias("o"),
        F.sum(n).over(by_row).alias("r"),
        F.sum(n).over(by_col).alias("c"),
        F.sum(n).over(Window.partitionBy("factor")).alias("total"),
        F.count(F.lit(1)).over(by_row).alias("cells_in_row"),
        F.count(F.lit(1)).over(by_col).alias("cells_in_col"),
    )
    o, r, c, total = (F.col(x) for x in ("o", "r", "c", "total"))
    sums = margins.groupBy("factor").agg(
        F.max(total).alias("total"),
        F.count_distinct("level").alias("n_rows"),
        F.count_distinct("outcome").alias("n_cols"),
        F.sum(o * o / (r * c)).alias("s"),
        F.max(F.abs(o - r * c / total)).alias("gap"),
        F.sum(1.0 / (r * F.col("cells_in_row"))).alias("inv_r"),
        F.sum(1.0 / (c * F.col("cells_in_col"))).alias("inv_c"),
    )
    dof = ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("int")
    corrected = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    chi2 = F.when(
        dof == 1, corrected * corrected * total * F.col("inv_r") * F.col("inv_c")
    ).when(dof > 1, total * (F.col("s") - 1.0))
    fewest = F.least("n_rows", "n_cols") - 1
    return sums.select(
        "factor",
        total.cast("long").alias("n"),
        chi2.alias("chi2"),
        dof.alias("dof"),
        F.sqrt(chi2 / (total * F.when(fewest > 0, fewest))).alias("cramers_v"),
    )


def with_p_value(tests: DataFrame) -> DataFrame:
    """Adds the p-value to χ² rows."""
    return tests.withColumn("p_value", _p_value(F.col("chi2"), F.col("dof")))


def stratified(
    facts: DataFrame, split: float = 15.0, labels: Sequence[str] = fv.STRATUM_LABELS
) -> DataFrame:
    """Bad rate of late and on-time orders at low and at high freight, and the gap."""
    ratio = F.col("freight_ratio")
    late, bad = F.col("is_delayed") == 1, F.col("is_bad") == 1
    return (
        facts.where(ratio.isNotNull())
        .groupBy(F.when(ratio <= split, labels[0]).otherwise(labels[1]).alias("stratum"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            rate_among(bad, late).alias("bad_delayed_pct"),
            rate_among(bad, ~late).alias("bad_ontime_pct"),
        )
        .withColumn("gap_pp", F.abs(F.col("bad_delayed_pct") - F.col("bad_ontime_pct")))
    )


def _bad_by_delay(facts: DataFrame) -> DataFrame:
    """Orders and bad orders per day of delay: a few thousand rows at most, since delays
    are whole days between dates."""
    return facts.groupBy("delay_days").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_bad").alias("bad")
    )


def _ratio(rate: Column, base: Column) -> list[Column]:
    """rate / base, null with a flag where the base is 0."""
    return [
        (rate / F.when(base > 0, base)).alias("lift"),
        F.coalesce(base <= 0, F.lit(True)).alias("lift_is_infinite"),
    ]


def relative_risk(
    facts: DataFrame,
    edges: Sequence[int] = fv.DELAY_CUT_EDGES,
    labels: Sequence[str] = fv.DELAY_CUT_LABELS,
    baseline: str = fv.DELAY_CUT_BASELINE,
    high_over: float = 3.0,
    low_upto: float = 1.2,
) -> DataFrame:
    """Bad rate by delay group and its ratio to the baseline group; all groups listed."""
    counts = (
        _bad_by_delay(facts)
        .groupBy(cut(F.col("delay_days"), edges, labels).alias("delay_group"))
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )
    listed = literal_rows(facts.sparkSession, "delay_group", labels)
    rate = share(F.col("bad"), F.col("n"))
    base = F.max(F.when(F.col("delay_group") == baseline, F.col("rate_pct"))).over(
        Window.partitionBy()
    )
    rr = F.col("rr")
    # Some bad reviews against none; without a rate on either side there is no ratio to mark.
    infinite = (F.col("base_pct") <= 0) & (F.col("rate_pct") > 0)
    return (
        listed.join(F.broadcast(counts), "delay_group", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rate_pct", rate)
        .withColumn("base_pct", base)
        .select(
            "delay_group",
            "n",
            "rate_pct",
            (F.col("rate_pct") / F.when(F.col("base_pct") > 0, F.col("base_pct"))).alias("rr"),
            F.coalesce(F.col("base_pct") <= 0, F.lit(True)).alias("rr_is_infinite"),
            "base_pct",
        )
        .withColumn(
            "mark",
            F.when((rr > high_over) | infinite, "high").when(rr <= low_upto, "low").otherwise(""),
        )
    )


def auc(facts: DataFrame, feature: str = "delay_days", outcome: str = "is_bad") -> DataFrame:
    """In-sample AUC of a one-variable logistic model.

    The model's probability rises or falls with the feature, as the sign of its coefficient
    says, and that sign is the sign of the covariance with the outcome. So the AUC follows
    from the counts per distinct value: pairs ranked right, ties counted half.

    A feature may have as many values as there are rows, so the values are split into ranges,
    counted on within each, and the totals of the ranges below are added.
    """
    y = F.col(outcome)
    counts = (
        facts.where(F.col(feature).isNotNull())
        .groupBy(feature)
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = materialize(
        counts.repartitionByRange(parts, feature).withColumn("part", F.spark_partition_id())
    )
    # One row per range, at most ``parts`` of them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("part").agg(F.sum("neg").alias("part_neg")).select(
        "part", F.coalesce(F.sum("part_neg").over(before), F.lit(0)).alias("neg_before")
    )
    below = Window.partitionBy("part").orderBy(feature).rowsBetween(Window.unboundedPreceding, -1)
    x, pos, neg = (F.col(c).cast("double") for c in (feature, "pos", "neg"))
    neg_below = F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg_before")
    sums = split.join(offsets, "part").withColumn("neg_below", neg_below.cast("double")).agg(
        F.sum(pos).alias("pos"),
        F.sum(neg).alias("neg"),
        F.sum(pos * (F.col("neg_below") + neg / 2)).alias("won"),
        F.sum(x * (pos + neg)).alias("sx"),
        F.sum(x * pos).alias("sxy"),
    )
    pairs = F.col("pos") * F.col("neg")
    raw = F.col("won") / F.when(pairs > 0, pairs)
    cov = F.col("sxy") * (F.col("pos") + F.col("neg")) - F.col("sx") * F.col("pos")
    return sums.select(
        (F.col("pos") + F.col("neg")).cast("long").alias("n"),
        F.col("pos").cast("long").alias("n_bad"),
        F.when(pairs > 0, F.when(cov > 0, raw).when(cov < 0, 1.0 - raw).otherwise(0.5)).alias(
            "auc"
        ),
    )


def threshold_scan(
    facts: DataFrame,
    thresholds: Sequence[int] = fv.DELAY_THRESHOLDS,
    more_than: int = 100,
) -> DataFrame:
    """Bad rate above and up to each threshold, and their ratio; small groups left out."""
    above = F.col("delay_days") > F.col("threshold")
    counts = (
        _bad_by_delay(facts)
        .where(F.col("delay_days").isNotNull())
        .select(
            "*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
        )
        .groupBy("threshold")
        .agg(
            F.sum(F.when(above, F.col("n")).otherwise(0)).alias("n_above"),
            F.sum(F.when(above, F.col("bad")).otherwise(0)).alias("bad_above"),
            F.sum(F.when(~above, F.col("n")).otherwise(0)).alias("n_upto"),
            F.sum(F.when(~above, F.col("bad")).otherwise(0)).alias("bad_upto"),
        )
        .where(F.col("n_above") > more_than)
    )
    rated = counts.select(
        "threshold",
        "n_above",
        share(F.col("bad_above"), F.col("n_above")).alias("bad_above_pct"),
        share(F.col("bad_upto"), F.col("n_upto")).alias("bad_upto_pct"),
    )
    return rated.select(
        "*", *_ratio(F.col("bad_above_pct"), F.col("bad_upto_pct"))
    ).orderBy("threshold")
