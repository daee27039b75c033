"""Every operator as a query on the star-schema tables.

Each entry takes the marketplace tables and returns a DataFrame over all of their rows.
``stable`` gives the result a form another engine can match value for value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parecer.functions import fixed_values as fv
from parecer.functions import ladders, measures, text
from parecer.operators import (
    drivers,
    eda,
    facts,
    models,
    orders,
    ranking,
    risk,
    rollups,
    stats,
    texts,
    topics,
)
from parecer.session import materialize, scratch_path
from parecer.sources import tables as io
from parecer.sources.star_schema import star_schema_tables

Tables = Mapping[str, DataFrame]

# Words that do occur in the test documents, for the operators that take word lists.
SAMPLE_THEMES = {
    "articles": ("the", "der", "die", "das", "les", "una"),
    "links": ("and", "und", "for", "pour", "con", "with"),
    "pointers": ("that", "this", "est", "ist", "los"),
}
SAMPLE_WORD_THEMES = {word: name for name, words in SAMPLE_THEMES.items() for word in words}
SAMPLE_WORDS = ("that", "und", "pour")

# Groups of reviews whose words make a topic matrix without learning.
TOPIC_GROUPS = 6
# Digits to which a fit by another method agrees.
MODEL_DIGITS = 3

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def stable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as long, other numbers as double rounded, times as text."""

    def plain(field: T.StructField):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            return measures.rounded(column.cast("double"), digits).alias(field.name)
        if isinstance(kind, T.IntegralType):
            return column.cast("long").alias(field.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        return column

    return df.select(*[plain(f) for f in df.schema.fields])


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """One query by name on the tables in a folder."""
    return stable(QUERIES[name](star_schema_tables(spark, folder)))


def _six(t: Tables) -> tuple[DataFrame, ...]:
    names = ("orders", "order_items", "reviews", "products", "category_trans", "payments")
    return tuple(t[n] for n in names)


def _facts(t: Tables) -> DataFrame:
    return facts.order_facts(*_six(t))


def _category_facts(t: Tables) -> DataFrame:
    return facts.order_facts_category(*_six(t)[:5])


def _category_stats(t: Tables) -> DataFrame:
    return risk.category_stats(_category_facts(t))


def _rollup_facts(t: Tables) -> DataFrame:
    return rollups.rollup_facts(*_six(t))


def _texts(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t["text_reviews"], t["orders"]


def _measures(t: Tables, **words) -> DataFrame:
    return texts.measure_reviews(*_texts(t), **words)


def _gmv(t: Tables) -> DataFrame:
    return eda.category_gmv(t["order_items"], t["products"], t["category_trans"])


def _truncated(t: Tables) -> DataFrame:
    return orders.with_truncated_delay(orders.filter_delivered(t["orders"]))


# --- sources, sinks, profiling -----------------------------------------------------------


@query
def read_tables(t: Tables) -> DataFrame:
    """The nine tables written as CSV, read back by the file map, and profiled."""
    spark = t["orders"].sparkSession
    folder = scratch_path(spark, "csv")
    # The review table carries the free text, line breaks and quotes included.
    sources = {
        name: t["text_reviews"] if name == "reviews" else t[name] for name in io.TABLES
    }
    files = {}
    for name, df in sources.items():
        files[name] = f"{name}_dataset.csv"
        io.write_table(df, f"{folder}/{files[name]}", "csv", header=True, escape='"')
    read = io.read_tables(spark, folder, files)
    return eda.profile_tables({name: read[name] for name in sources})


@query
def parse_timestamps(t: Tables) -> DataFrame:
    times = io.TIMESTAMP_COLUMNS
    as_text = t["orders"].select(
        "order_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in times]
    )
    return io.parse_timestamps(as_text, times)


@query
def table_sink(t: Tables) -> DataFrame:
    """All nine tables written twice, the second time over the first, and read back; orders
    go through the catalog as well, and are profiled from there."""
    spark = t["orders"].sparkSession
    folder = scratch_path(spark, "tables")
    for _ in range(2):
        io.write_tables({name: t[name] for name in io.TABLES}, folder)
    back = {name: spark.read.parquet(f"{folder}/{name}") for name in io.TABLES}
    name = f"sink_{folder.rsplit('-', 1)[-1]}"
    for _ in range(2):
        io.save_table(back["orders"], name)
    profile = materialize(eda.profile_tables({**back, "orders": spark.table(name)}))
    spark.sql(f"DROP TABLE {name}")
    return profile


@query
def profile_tables(t: Tables) -> DataFrame:
    return eda.profile_tables({name: t[name] for name in io.TABLES})


@query
def time_span(t: Tables) -> DataFrame:
    return eda.time_span(t["orders"])


@query
def read_rollups(t: Tables) -> DataFrame:
    """All roll-ups written as files, read back, and their numbers listed one per row."""
    spark = t["orders"].sparkSession
    wide = materialize(_rollup_facts(t))
    folder = scratch_path(spark, "rollups")
    made = {
        "kpi_summary": rollups.rollup_kpi(wide),
        "monthly_trend": rollups.rollup_monthly(wide),
        "delay_dose": rollups.rollup_delay_dose(wide),
        "group_compare": rollups.rollup_group_compare(wide),
        "category_risk": rollups.rollup_category_risk(wide),
        "payment": rollups.rollup_payment(wide),
    }
    parts = []
    for name, df in made.items():
        io.write_table(df, f"{folder}/{name}", "csv", header=True)
        read = io.read_rollup(spark, f"{folder}/{name}", name)
        key, *numbers = [c for c in read.columns if c != "format"]
        parts.append(
            read.select(F.col(key).alias("key"), *[F.col(f"`{c}`").cast("double") for c in numbers])
            .unpivot("key", numbers, "metric", "value")
            .where("value is not null")
            .select(F.lit(name).alias("rollup"), "key", "metric", "value")
        )
    return reduce(DataFrame.unionByName, parts)


# --- columns -----------------------------------------------------------------------------


@query
def filter_delivered(t: Tables) -> DataFrame:
    both = orders.filter_delivered(t["orders"]).select("order_id", F.lit("both").alias("kind"))
    one = orders.filter_delivered(t["orders"], promise=False)
    none = orders.filter_delivered(t["orders"], arrival=False, promise=False)
    return both.unionAll(one.select("order_id", F.lit("arrival"))).unionAll(
        none.select("order_id", F.lit("status"))
    )


@query
def delay_days_eda(t: Tables) -> DataFrame:
    return orders.with_floored_delay(
        orders.filter_delivered(t["orders"], arrival=False, promise=False)
    ).select("order_id", "actual_delivery_days", "estimated_delivery_days", "delay_days")


@query
def delay_days_sql(t: Tables) -> DataFrame:
    return _truncated(t).select("order_id", "delay_days")


@query
def delay_flags(t: Tables) -> DataFrame:
    return orders.with_delay_flags(_truncated(t)).select(
        "order_id", "is_delayed", "is_severely_delayed"
    )


@query
def delay_bucket_7(t: Tables) -> DataFrame:
    delay = F.col("delay_days")
    return _truncated(t).select(
        "order_id",
        fv.DELAY_LADDER.label(delay).alias("bucket"),
        fv.DELAY_LADDER.rank(delay).alias("bucket_ord"),
    )


@query
def delay_group_6(t: Tables) -> DataFrame:
    group = ladders.cut(F.col("delay_days"), fv.DELAY_CUT_EDGES, fv.DELAY_CUT_LABELS)
    return _truncated(t).select("order_id", group.alias("delay_group"))


@query
def delay_level_3(t: Tables) -> DataFrame:
    delayed = orders.with_floored_delay(
        orders.filter_delivered(t["orders"], arrival=False, promise=False)
    )
    name = ladders.level(F.col("delay_days"), fv.DELAY_LEVEL_EDGES, fv.DELAY_LEVEL_LABELS)
    return delayed.select("order_id", name.alias("level"))


@query
def sentiment_cut(t: Tables) -> DataFrame:
    label = ladders.cut(F.col("review_score"), fv.SCORE_CUT_EDGES, fv.SCORE_CUT_LABELS)
    return ranking.value_counts(
        t["reviews"].select("order_id", "review_score", label.alias("label")),
        "order_id",
        "review_score",
        "label",
    )


@query
def freight_ratio(t: Tables) -> DataFrame:
    return orders.order_freight_agg(t["order_items"]).select("order_id", "freight_ratio")


@query
def freight_bucket(t: Tables) -> DataFrame:
    ratio = F.col("freight_ratio")
    return orders.order_freight_agg(t["order_items"]).select(
        "order_id",
        fv.FREIGHT_LADDER.label(ratio).alias("bucket"),
        fv.FREIGHT_LADDER.rank(ratio).alias("bucket_ord"),
    )


@query
def installment_bucket(t: Tables) -> DataFrame:
    label = fv.INSTALLMENT_LADDER.label(F.col("payment_installments")).alias("bucket")
    return ranking.value_counts(
        t["payments"].select("payment_installments", label), "payment_installments", "bucket"
    )


@query
def purchase_month(t: Tables) -> DataFrame:
    month = F.date_format("order_purchase_timestamp", "yyyy-MM")
    return t["orders"].select("order_id", month.alias("month"))


@query
def category_fallback(t: Tables) -> DataFrame:
    english, original = "product_category_name_english", "product_category_name"
    return orders.left_join_category(t["products"], t["category_trans"]).select(
        "product_id",
        orders.category_or_original(english, original).alias("category_eda"),
        orders.category_or_unknown(english).alias("category_sql"),
    )


@query
def clip_values(t: Tables) -> DataFrame:
    delay = F.col("delay_days")
    return orders.with_floored_delay(t["orders"]).select(
        "order_id",
        measures.clip(delay, *fv.DELAY_CLIP).alias("both"),
        measures.clip(delay, high=10).alias("upper"),
    )


@query
def delay_to_text(t: Tables) -> DataFrame:
    return _truncated(t).select(
        "order_id", measures.delay_phrase(F.col("delay_days")).alias("phrase")
    )


@query
def text_prefix(t: Tables) -> DataFrame:
    return t["text_reviews"].select(
        "review_id", F.substring(texts.MESSAGE, 1, 200).alias("prefix")
    )


@query
def pp_vs_overall(t: Tables) -> DataFrame:
    return risk.category_gaps(_category_stats(t), min_orders=1).select("category", "delay_gap_pp", "delay_flag", "bad_gap_pp", "bad_flag")


# --- joins, windows, sorts ---------------------------------------------------------------


@query
def join_orders_reviews(t: Tables) -> DataFrame:
    joined = orders.join_orders_reviews(t["orders"], t["reviews"])
    return joined.select("order_id", "order_status", "avg_score", "n_reviews")


@query
def join_items_products(t: Tables) -> DataFrame:
    joined = orders.join_items_products(
        t["order_items"], t["products"], "product_category_name"
    )
    return joined.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("price")
    )


@query
def left_join_products(t: Tables) -> DataFrame:
    joined = orders.left_join_products(
        t["order_items"], t["products"], "product_category_name"
    )
    return joined.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("freight_value").alias("freight")
    )


@query
def left_join_category(t: Tables) -> DataFrame:
    return orders.left_join_category(t["products"], t["category_trans"]).select(
        "product_id", "product_category_name", "product_category_name_english"
    )


@query
def left_join_top_payment(t: Tables) -> DataFrame:
    joined = orders.left_join_top_payment(t["orders"], t["payments"])
    return joined.select("order_id", "pay_type", "installments")


@query
def map_lookup(t: Tables) -> DataFrame:
    """The late rate of categories with enough orders, 0 for the others."""
    rates = risk.category_gaps(_category_stats(t)).select("category", "delay_rate")
    named = t["category_trans"].select(F.col("product_category_name_english").alias("category"))
    return orders.map_lookup(named, rates, "category", "delay_rate", "delay_rate_or_0")


@query
def row_number_top1(t: Tables) -> DataFrame:
    return orders.row_number_top1(t["payments"])


@query
def running_share(t: Tables) -> DataFrame:
    return eda.seller_lorenz(t["order_items"]).select("seller_id", "cum_pct")


@query
def rank_percentile(t: Tables) -> DataFrame:
    return eda.seller_lorenz(t["order_items"]).select("seller_id", "rank", "rank_pct")


@query
def sort_topk(t: Tables) -> DataFrame:
    sums = orders.order_freight_agg(t["order_items"]).select("order_id", "total_price")
    return ranking.sort_topk(sums, 10, F.desc("total_price"), F.col("order_id"))


@query
def nlargest(t: Tables) -> DataFrame:
    ratios = orders.order_freight_agg(t["order_items"]).select("order_id", "freight_ratio")
    return ranking.nlargest(ratios, 15, "freight_ratio", "order_id")


@query
def order_by_bucket_min(t: Tables) -> DataFrame:
    delay = F.col("delay_days")
    return (
        _truncated(t)
        .groupBy(fv.DELAY_LADDER.label(delay).alias("delay_bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(delay).alias("first_delay"))
        .orderBy("first_delay")
    )


@query
def manual_sort(t: Tables) -> DataFrame:
    counts = rollups.rollup_delay_dose(_rollup_facts(t)).select("delay_bucket", "ords")
    return ranking.manual_sort(counts, "delay_bucket", fv.DOSE_ORDER)


@query
def union_segments(t: Tables) -> DataFrame:
    core = facts.order_core(
        orders.filter_delivered(t["orders"], promise=False), t["order_items"], t["reviews"]
    )
    return core.select("order_id", F.explode(drivers.segment_tags()).alias("segment"))


# --- descriptive queries -----------------------------------------------------------------


@query
def eda_monthly_orders(t: Tables) -> DataFrame:
    return eda.monthly_orders(t["orders"])


@query
def eda_status_dist(t: Tables) -> DataFrame:
    return eda.status_dist(t["orders"])


@query
def eda_delivery_stats(t: Tables) -> DataFrame:
    return eda.delivery_stats(t["orders"])


@query
def eda_delay_rates(t: Tables) -> DataFrame:
    return eda.delay_rates(t["orders"])


@query
def eda_delay_hist(t: Tables) -> DataFrame:
    return eda.delay_hist(t["orders"])


@query
def eda_delay_box(t: Tables) -> DataFrame:
    return eda.delay_box(t["orders"])


@query
def eda_score_dist(t: Tables) -> DataFrame:
    return eda.score_dist(t["reviews"])


@query
def eda_sentiment(t: Tables) -> DataFrame:
    return eda.sentiment(t["reviews"])


@query
def eda_category_gmv(t: Tables) -> DataFrame:
    return _gmv(t)


@query
def eda_category_top_gmv(t: Tables) -> DataFrame:
    return eda.category_top_gmv(_gmv(t))


@query
def eda_category_top_freight(t: Tables) -> DataFrame:
    return eda.category_top_freight(_gmv(t))


@query
def eda_payment_types(t: Tables) -> DataFrame:
    return eda.payment_types(t["payments"])


@query
def eda_installment_hist(t: Tables) -> DataFrame:
    return eda.installment_hist(t["payments"])


@query
def eda_seller_stats(t: Tables) -> DataFrame:
    return eda.seller_stats(t["order_items"])


@query
def eda_seller_lorenz(t: Tables) -> DataFrame:
    return eda.seller_lorenz(t["order_items"]).select(
        "seller_id", "gmv", "rank", "cum_pct", "rank_pct"
    )


@query
def eda_pareto(t: Tables) -> DataFrame:
    return eda.pareto(eda.seller_gmv(t["order_items"]))


@query
def eda_seller_order_hist(t: Tables) -> DataFrame:
    return eda.seller_order_hist(t["order_items"])


@query
def eda_summary(t: Tables) -> DataFrame:
    return eda.summary(t["orders"], t["reviews"], t["order_items"])


@query
def order_review_avg(t: Tables) -> DataFrame:
    return orders.order_review_avg(t["reviews"])


@query
def order_freight_agg(t: Tables) -> DataFrame:
    return orders.order_freight_agg(t["order_items"])


@query
def order_pay_agg(t: Tables) -> DataFrame:
    return orders.order_pay_agg(t["payments"])


@query
def q1_delay_dose(t: Tables) -> DataFrame:
    return drivers.delay_dose(t["orders"], t["reviews"])


@query
def q2_freight_ratio(t: Tables) -> DataFrame:
    return drivers.freight_ratio(t["order_items"], t["reviews"])


@query
def q3_category_bad_rate(t: Tables) -> DataFrame:
    return drivers.category_bad_rate(
        t["order_items"], t["products"], t["category_trans"], t["reviews"]
    )


@query
def q4_payment_installments(t: Tables) -> DataFrame:
    return drivers.payment_installments(t["payments"], t["reviews"])


@query
def q5_segments(t: Tables) -> DataFrame:
    return drivers.segments(t["orders"], t["order_items"], t["reviews"])


@query
def q6_review_group_delay(t: Tables) -> DataFrame:
    return drivers.review_group_delay(t["orders"], t["reviews"])


@query
def order_facts(t: Tables) -> DataFrame:
    return _facts(t)


@query
def order_facts_dedup(t: Tables) -> DataFrame:
    return facts.order_facts(*_six(t), fanout="dedup").select(
        "order_id", "total_price", "total_freight"
    )


@query
def order_facts_category(t: Tables) -> DataFrame:
    return _category_facts(t)


@query
def facts_summary(t: Tables) -> DataFrame:
    return facts.facts_summary(_facts(t))


@query
def facts_summary_category(t: Tables) -> DataFrame:
    """The headline of the category step."""
    return facts.facts_summary(_category_facts(t), "category")


# --- statistics and models ---------------------------------------------------------------


DELAY_FACTORS = ("is_delayed", "is_severely_delayed")


@query
def t1_contingency(t: Tables) -> DataFrame:
    return stats.contingency(_facts(t), DELAY_FACTORS)


@query
def t1_chi2(t: Tables) -> DataFrame:
    return stats.chi2_test(stats.contingency(_facts(t), DELAY_FACTORS))


@query
def t1_chi2_wide(t: Tables) -> DataFrame:
    """Factors with many levels: no correction, more degrees of freedom."""
    return stats.chi2_test(stats.contingency(_facts(t), ["main_category", "pay_type"]))


@query
def t1_p_value(t: Tables) -> DataFrame:
    tests = stats.with_p_value(stats.chi2_test(stats.contingency(_facts(t), DELAY_FACTORS)))
    return tests.withColumn("p_value", measures.rounded(F.col("p_value"), MODEL_DIGITS))


@query
def t2_stratified(t: Tables) -> DataFrame:
    return stats.stratified(_facts(t))


@query
def t3_features(t: Tables) -> DataFrame:
    return models.features(_facts(t))


@query
def t3_standardize(t: Tables) -> DataFrame:
    return models.standardize(models.features(_facts(t)))


@query
def t3_odds_ratios(t: Tables) -> DataFrame:
    return stable(models.odds_ratios(_facts(t)), MODEL_DIGITS)


@query
def t4_relative_risk(t: Tables) -> DataFrame:
    return stats.relative_risk(_facts(t))


@query
def t5_auc(t: Tables) -> DataFrame:
    return stats.auc(_facts(t))


@query
def t5_model(t: Tables) -> DataFrame:
    return stable(models.single_feature_logit(_facts(t)), MODEL_DIGITS)


@query
def t6_threshold_scan(t: Tables) -> DataFrame:
    return stats.threshold_scan(_facts(t))


# --- text and topics ---------------------------------------------------------------------


@query
def n0_review_texts(t: Tables) -> DataFrame:
    return texts.review_texts(*_texts(t)).select(
        "review_id", "review_score", "delay_days", F.length(texts.MESSAGE).alias("n_chars")
    )


@query
def n0_group_counts(t: Tables) -> DataFrame:
    return texts.group_counts(_measures(t))


@query
def clean_text(t: Tables) -> DataFrame:
    return t["text_reviews"].select(
        "review_id", text.clean_text(F.col(texts.MESSAGE)).alias("cleaned")
    )


@query
def tokenize(t: Tables) -> DataFrame:
    tokens = text.tokenize(F.col(texts.MESSAGE), fv.STOPWORDS)
    return t["text_reviews"].select(
        "review_id",
        F.size(tokens).alias("n_tokens"),
        F.array_join(tokens, " ").alias("tokens"),
    )


@query
def n1_top_words(t: Tables) -> DataFrame:
    return texts.top_words(*_texts(t))


@query
def n1_top_words_sample_themes(t: Tables) -> DataFrame:
    return texts.top_words(*_texts(t), themes=SAMPLE_WORD_THEMES)


@query
def n2_theme_share(t: Tables) -> DataFrame:
    return texts.theme_share(_measures(t))


@query
def n2_theme_share_sample_themes(t: Tables) -> DataFrame:
    return texts.theme_share(_measures(t, themes=SAMPLE_THEMES), SAMPLE_THEMES)


@query
def n3_sample_late(t: Tables) -> DataFrame:
    return texts.sample_bad(_measures(t), late=True)


@query
def n4_sample_on_time(t: Tables) -> DataFrame:
    return texts.sample_bad(_measures(t), late=False)


@query
def n5_bad_sources(t: Tables) -> DataFrame:
    return texts.bad_sources(_measures(t))


@query
def n5_bad_sources_sample_words(t: Tables) -> DataFrame:
    return texts.bad_sources(_measures(t, delay_words=SAMPLE_WORDS))


def _documents(t: Tables) -> DataFrame:
    return topics.ngrams(topics.corpus(*_texts(t)))


@query
def l0_corpus(t: Tables) -> DataFrame:
    return topics.corpus(*_texts(t))


@query
def l0_ngrams(t: Tables) -> DataFrame:
    return _documents(t).select(
        "review_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms")
    )


@query
def l0_vocabulary(t: Tables) -> DataFrame:
    return topics.vocabulary(materialize(_documents(t)))


def _model(t: Tables) -> tuple[topics.TopicModel, DataFrame]:
    documents = materialize(_documents(t))
    return topics.fit_topics(documents), documents


@query
def l1_lda_topics(t: Tables) -> DataFrame:
    return _model(t)[0].topics(t["orders"].sparkSession)


@query
def l2_topic_share(t: Tables) -> DataFrame:
    model, documents = _model(t)
    return topics.labelled_share(
        model.assign(documents), model.topics(documents.sparkSession)
    )


def _score_topics(t: Tables) -> DataFrame:
    """The most frequent words per score, standing in for topics that SQL can also find."""
    counts = texts.top_words(
        t["text_reviews"], k=8, labels=("1", "2"), stopwords=fv.TOPIC_STOPWORDS
    )
    return counts.select(F.col("label").cast("int").alias("topic"), "rank", "word")


@query
def l2_topic_label(t: Tables) -> DataFrame:
    return topics.topic_labels(_score_topics(t))


@query
def l2_topic_label_sample_themes(t: Tables) -> DataFrame:
    return topics.topic_labels(_score_topics(t), lexicons=SAMPLE_THEMES)


@query
def l3_topic_by_delay(t: Tables) -> DataFrame:
    model, documents = _model(t)
    words = model.topics(documents.sparkSession)
    return topics.topic_by_delay(model.assign(documents), words)


def _grouped_model(t: Tables) -> tuple[topics.TopicModel, DataFrame]:
    """A matrix that SQL can work out too: the words of six groups of reviews."""
    documents = materialize(_documents(t))
    group = (F.col("review_id") % TOPIC_GROUPS + 1).cast("int")
    return topics.grouped_topics(documents, group, TOPIC_GROUPS), documents


@query
def l1_grouped_topics(t: Tables) -> DataFrame:
    return _grouped_model(t)[0].topics(t["orders"].sparkSession)


@query
def l2_grouped_topic_share(t: Tables) -> DataFrame:
    model, documents = _grouped_model(t)
    return topics.labelled_share(
        model.assign(documents), model.topics(documents.sparkSession), TOPIC_GROUPS
    )


@query
def l3_grouped_topic_by_delay(t: Tables) -> DataFrame:
    model, documents = _grouped_model(t)
    words = model.topics(documents.sparkSession)
    return topics.topic_by_delay(model.assign(documents), words, TOPIC_GROUPS)


# --- category risk -----------------------------------------------------------------------


@query
def r1_category_rates(t: Tables) -> DataFrame:
    return risk.category_rates(_category_stats(t))


@query
def r2_delay_lift(t: Tables) -> DataFrame:
    return risk.delay_lift(_category_stats(t))


@query
def r2_delay_lift_small(t: Tables) -> DataFrame:
    return risk.delay_lift(_category_stats(t), min_orders=50)


@query
def r3_risk_score(t: Tables) -> DataFrame:
    return risk.risk_score(_category_stats(t))


@query
def r3_risk_score_small(t: Tables) -> DataFrame:
    return risk.risk_score(_category_stats(t), min_orders=50)


@query
def r4_bad_volume(t: Tables) -> DataFrame:
    return risk.bad_volume(_category_stats(t))


@query
def r4_bad_volume_small(t: Tables) -> DataFrame:
    return risk.bad_volume(_category_stats(t), min_orders=50)


@query
def r5_tiers(t: Tables) -> DataFrame:
    return risk.tiers(_category_stats(t))


@query
def r5_tiers_small(t: Tables) -> DataFrame:
    return risk.tiers(_category_stats(t), min_orders=50)


# --- roll-ups and dashboard --------------------------------------------------------------


@query
def rollup_kpi(t: Tables) -> DataFrame:
    return rollups.rollup_kpi(_rollup_facts(t))


@query
def rollup_monthly(t: Tables) -> DataFrame:
    return rollups.rollup_monthly(_rollup_facts(t))


@query
def rollup_delay_dose(t: Tables) -> DataFrame:
    return rollups.rollup_delay_dose(_rollup_facts(t))


@query
def rollup_group_compare(t: Tables) -> DataFrame:
    return rollups.rollup_group_compare(_rollup_facts(t))


@query
def rollup_category_risk(t: Tables) -> DataFrame:
    return rollups.rollup_category_risk(_rollup_facts(t))


@query
def rollup_payment(t: Tables) -> DataFrame:
    return rollups.rollup_payment(_rollup_facts(t))


@query
def unpivot_metrics(t: Tables) -> DataFrame:
    return rollups.unpivot_metrics(rollups.rollup_group_compare(_rollup_facts(t)))


@query
def kpi_member_filter(t: Tables) -> DataFrame:
    return rollups.kpi_member_filter(rollups.rollup_kpi(_rollup_facts(t)), fv.KPI_ROWS[1][0])


@query
def dash_top10_bad(t: Tables) -> DataFrame:
    return rollups.dash_top_bad(rollups.rollup_category_risk(_rollup_facts(t)))


@query
def dash_dose_sum(t: Tables) -> DataFrame:
    return rollups.dash_dose_sum(rollups.rollup_delay_dose(_rollup_facts(t)))


@query
def dash_monthly_series(t: Tables) -> DataFrame:
    return rollups.dash_monthly_series(rollups.rollup_monthly(_rollup_facts(t)))


@query
def dash_risk_matrix(t: Tables) -> DataFrame:
    return rollups.dash_risk_matrix(rollups.rollup_category_risk(_rollup_facts(t)))
