"""The six analysis steps and the dashboard roll-ups, each as named results.

What several results of a step read (the wide tables, the narrow review rows, the cleaned
documents) is written once to the shared folder and read from there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from parecer.functions import fixed_values as fv
from parecer.operators import (
    drivers,
    eda,
    facts,
    models,
    risk,
    rollups,
    stats,
    texts,
    topics,
)
from parecer.session import materialize
from parecer.sources.schemas import TABLES
from parecer.sources.tables import write_table

Tables = Mapping[str, DataFrame]
Results = dict[str, DataFrame]


def explore(t: Tables) -> Results:
    """Step 1: the tables at a glance."""
    orders, reviews, items, payments = (
        t[n] for n in ("orders", "reviews", "order_items", "payments")
    )
    gmv = materialize(eda.category_gmv(items, t["products"], t["category_trans"]))
    lorenz = materialize(eda.seller_lorenz(items))
    return {
        "profile": eda.profile_tables({name: t[name] for name in TABLES}),
        "time_span": eda.time_span(orders),
        "monthly_orders": eda.monthly_orders(orders),
        "status": eda.status_dist(orders),
        "delivery": eda.delivery_stats(orders),
        "delay_rates": eda.delay_rates(orders),
        "delay_histogram": eda.delay_hist(orders),
        "delay_box": eda.delay_box(orders),
        "scores": eda.score_dist(reviews),
        "sentiment": eda.sentiment(reviews),
        "category_gmv": gmv,
        "category_top_gmv": eda.category_top_gmv(gmv),
        "category_top_freight": eda.category_top_freight(gmv),
        "payment_types": eda.payment_types(payments),
        "installments": eda.installment_hist(payments),
        "sellers": eda.seller_stats(items),
        "seller_lorenz": lorenz,
        "seller_pareto": eda.pareto(lorenz),
        "seller_orders": eda.seller_order_hist(items),
        "summary": eda.summary(orders, reviews, items, lorenz),
    }


def ask(t: Tables) -> Results:
    """Step 2: six questions on bad reviews."""
    orders, reviews, items = t["orders"], t["reviews"], t["order_items"]
    return {
        "q1_delay": drivers.delay_dose(orders, reviews),
        "q2_freight": drivers.freight_ratio(items, reviews),
        "q3_category": drivers.category_bad_rate(
            items, t["products"], t["category_trans"], reviews
        ),
        "q4_payment": drivers.payment_installments(t["payments"], reviews),
        "q5_segments": drivers.segments(orders, items, reviews),
        "q6_review_groups": drivers.review_group_delay(orders, reviews),
    }


def measure(t: Tables) -> Results:
    """Step 3: tests, odds and thresholds on the wide table."""
    wide = materialize(
        facts.order_facts(
            t["orders"], t["order_items"], t["reviews"], t["products"], t["category_trans"],
            t["payments"],
        )
    )
    factors = stats.contingency(wide, ["is_delayed", "is_severely_delayed"])
    return {
        "facts_summary": facts.facts_summary(wide),
        "t1_chi2": stats.with_p_value(stats.chi2_test(factors)),
        "t2_stratified": stats.stratified(wide),
        "t3_odds_ratios": models.odds_ratios(wide),
        "t4_relative_risk": stats.relative_risk(wide),
        "t5_auc": stats.auc(wide),
        "t6_thresholds": stats.threshold_scan(wide),
    }


def read_texts(t: Tables) -> Results:
    """Step 4: what bad reviews say."""
    reviews, orders = t["text_reviews"], t["orders"]
    measures = materialize(texts.measure_reviews(reviews, orders))
    return {
        "n0_groups": texts.group_counts(measures),
        "n1_words": texts.top_words(reviews, orders),
        "n2_themes": texts.theme_share(measures),
        "n3_late_samples": texts.sample_bad(measures, late=True),
        "n4_on_time_samples": texts.sample_bad(measures, late=False),
        "n5_sources": texts.bad_sources(measures),
    }


def find_topics(t: Tables, k: int = 6) -> Results:
    """Step 5: topics of bad reviews, and which of them come with delay."""
    documents = materialize(topics.ngrams(topics.corpus(t["text_reviews"], t["orders"])))
    model = topics.fit_topics(documents, k)
    words = model.topics(documents.sparkSession)
    assigned = materialize(model.assign(documents).select("topic", "is_delayed"))
    return {
        "l1_topics": words,
        "l2_shares": topics.labelled_share(assigned, words, k),
        "l3_by_delay": topics.topic_by_delay(assigned, words, k),
    }


def rank_categories(t: Tables) -> Results:
    """Step 6: the categories where delay costs most."""
    wide = materialize(
        facts.order_facts_category(
            t["orders"], t["order_items"], t["reviews"], t["products"], t["category_trans"]
        )
    )
    by_category = materialize(risk.category_stats(wide))
    return {
        "headline": facts.facts_summary(wide, "category"),
        "r1_rates": risk.category_rates(by_category),
        "r2_lift": risk.delay_lift(by_category),
        "r3_risk": risk.risk_score(by_category),
        "r4_volume": risk.bad_volume(by_category),
        "r5_tiers": risk.tiers(by_category),
    }


def roll_up(t: Tables) -> Results:
    """The dashboard's tables and the queries it puts to them."""
    wide = materialize(
        rollups.rollup_facts(
            t["orders"], t["order_items"], t["reviews"], t["products"], t["category_trans"],
            t["payments"],
        )
    )
    kpi, monthly = rollups.rollup_kpi(wide), rollups.rollup_monthly(wide)
    dose, groups = rollups.rollup_delay_dose(wide), rollups.rollup_group_compare(wide)
    categories = rollups.rollup_category_risk(wide)
    return {
        "kpi_summary": kpi,
        "monthly_trend": monthly,
        "delay_dose": dose,
        "group_compare": groups,
        "category_risk": categories,
        "payment": rollups.rollup_payment(wide),
        "dash_order_count": rollups.kpi_member_filter(kpi, fv.KPI_ROWS[0][0]),
        "dash_top_bad": rollups.dash_top_bad(categories),
        "dash_metrics": rollups.unpivot_metrics(groups),
        "dash_dose": rollups.dash_dose_sum(dose),
        "dash_monthly": rollups.dash_monthly_series(monthly),
        "dash_matrix": rollups.dash_risk_matrix(categories),
    }


STEPS: dict[str, Callable[[Tables], Results]] = {
    "explore": explore,
    "ask": ask,
    "measure": measure,
    "read_texts": read_texts,
    "find_topics": find_topics,
    "rank_categories": rank_categories,
    "roll_up": roll_up,
}


def run_steps(t: Tables, folder: str, names: list[str] | None = None) -> dict[str, str]:
    """Run the steps and write every result as Parquet; returns where each one lies."""
    written = {}
    for step in names or list(STEPS):
        for name, df in STEPS[step](t).items():
            written[f"{step}/{name}"] = write_table(df, f"{folder}/{step}/{name}")
    return written
