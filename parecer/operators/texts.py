"""What reviewers write: word counts, themes and samples.

Texts are by far the widest column, so they are reduced to what a report needs before the
join with the orders: ``measure_reviews`` reads each text once and keeps a few numbers and
the shown prefix, and only those are shuffled. The reports that need the words themselves
shuffle the kept words of the reviews they count, not the raw texts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions.measures import delay_phrase, flag, share
from parecer.functions.text import keep_word, tokenize, words
from parecer.operators.orders import filter_delivered, with_truncated_delay
from parecer.operators.ranking import literal_rows

MESSAGE = "review_comment_message"
BAD = "review_score <= 2"
GOOD = "review_score >= 4"


def written(reviews: DataFrame) -> DataFrame:
    """Reviews with a text."""
    return reviews.where(F.col(MESSAGE).isNotNull() & (F.col(MESSAGE) != ""))


def with_order_delay(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Reviews of delivered orders with the delay, null where not yet arrived."""
    delays = with_truncated_delay(
        filter_delivered(orders, arrival=False, promise=False)
    ).select("order_id", "delay_days")
    return reviews.join(delays, "order_id", "inner")


def review_texts(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """The non-empty texts themselves, with the delay of their order."""
    return with_order_delay(written(reviews), orders)


def _theme_column(i: int) -> str:
    return f"theme_{i}"


def _one_of(members: Sequence[str]) -> Callable[[Column], Column]:
    return lambda word: word.isin(*members)


def measure_reviews(
    reviews: DataFrame,
    orders: DataFrame,
    themes: Mapping[str, Sequence[str]] = fv.THEME_WORDS,
    stopwords: Sequence[str] = fv.STOPWORDS,
    delay_words: Sequence[str] = fv.DELAY_WORDS,
    prefix: int = 200,
    key: str = "review_id",
    strip_accents: bool = False,
) -> DataFrame:
    """One narrow row per non-empty text: score, delay, length, kept words, words per
    theme, whether it names a delay, and its first characters."""
    message = F.col(MESSAGE)
    kept = F.col("kept")
    per_theme = {
        _theme_column(i): F.size(F.filter(kept, _one_of(members)))
        for i, members in enumerate(themes.values())
    }
    measured = (
        written(reviews)
        .select(
            key, "order_id", "review_score", MESSAGE,
            words(message, strip_accents).alias("all_words"),
        )
        .withColumn("kept", F.filter("all_words", lambda w: keep_word(w, stopwords)))
        .select(
            key,
            "order_id",
            "review_score",
            F.length(message).alias("n_chars"),
            F.substring(message, 1, prefix).alias("shown"),
            F.md5(message.cast("binary")).alias("text_md5"),
            F.arrays_overlap(
                F.col("all_words"), F.array(*[F.lit(w) for w in delay_words])
            ).alias("names_delay"),
            F.size(kept).alias("n_words"),
            *[column.alias(name) for name, column in per_theme.items()],
        )
    )
    return with_order_delay(measured, orders)


def _counted(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(flag(condition)), F.lit(0)).alias(name)


def group_counts(measures: DataFrame) -> DataFrame:
    """Texts per sentiment, and bad ones of late and of on-time orders.

    Bad reviews of orders with unknown delay count in neither of the last two.
    """
    delay, bad = F.col("delay_days"), F.expr(BAD)
    return measures.agg(
        F.count(F.lit(1)).alias("n"),
        _counted(bad, "n_bad"),
        _counted(F.expr(GOOD), "n_good"),
        _counted(F.col("review_score") == 3, "n_neutral"),
        _counted(bad & (delay > 0), "n_bad_late"),
        _counted(bad & (delay <= 0), "n_bad_on_time"),
    ).withColumn("bad_pct", share(F.col("n_bad"), F.col("n")))


def top_words(
    reviews: DataFrame,
    orders: DataFrame | None = None,
    k: int = 20,
    stopwords: Sequence[str] = fv.STOPWORDS,
    themes: Mapping[str, str] = fv.WORD_THEMES,
    labels: Sequence[str] = fv.WORD_GROUP_LABELS,
    strip_accents: bool = False,
) -> DataFrame:
    """The k most frequent words of bad and of good reviews, each with its theme or itself.

    With ``orders``, only reviews of delivered ones count. Words are counted with map-side
    combining. The rank filter is pushed below the shuffle of the window, so each task
    passes on at most k words per label.
    """
    label = F.when(F.expr(BAD), labels[0]).when(F.expr(GOOD), labels[1])
    tokens = (
        written(reviews)
        .select(
            "order_id",
            label.alias("label"),
            tokenize(F.col(MESSAGE), stopwords, strip_accents).alias("words"),
        )
        .where(F.col("label").isNotNull())
    )
    if orders is not None:
        tokens = with_order_delay(tokens, orders)
    # The outer form keeps the optimizer from testing for empty lists first, which would
    # split every text twice.
    counts = (
        tokens.select("label", F.explode_outer("words").alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("label", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = Window.partitionBy("label").orderBy(F.desc("n"), F.asc("word"))
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    theme = F.create_map(*[F.lit(x) for pair in themes.items() for x in pair])
    return top.select(
        "label",
        "rank",
        "word",
        "n",
        F.coalesce(F.try_element_at(theme, F.col("word")), F.col("word")).alias("theme"),
    )


def theme_share(
    measures: DataFrame,
    themes: Mapping[str, Sequence[str]] = fv.THEME_WORDS,
    labels: Sequence[str] = fv.SOURCE_GROUP_LABELS,
) -> DataFrame:
    """Words per theme, and their share of all words, in late and in on-time bad reviews.

    Each task passes on one row per label. Every theme is listed.
    """
    delay = F.col("delay_days")
    label = F.when(delay > 0, labels[0]).when(delay <= 0, labels[1])
    counts = (
        measures.where(F.expr(BAD) & delay.isNotNull())
        .groupBy(label.alias("label"))
        .agg(
            F.sum("n_words").alias("total"),
            *[F.sum(_theme_column(i)).alias(_theme_column(i)) for i in range(len(themes))],
        )
    )
    pairs = [
        F.struct(
            F.lit(name).alias("theme"), F.coalesce(F.col(_theme_column(i)), F.lit(0)).alias("n")
        )
        for i, name in enumerate(themes)
    ]
    # Two labels at most on either side.
    return (
        literal_rows(measures.sparkSession, "label", labels)
        .join(F.broadcast(counts), "label", "left")
        .select("label", F.coalesce("total", F.lit(0)).alias("total"), F.inline(F.array(*pairs)))
        .select(
            "label",
            "theme",
            "n",
            "total",
            F.coalesce(share(F.col("n"), F.col("total")), F.lit(0.0)).alias("pct"),
        )
    )


def sample_bad(
    measures: DataFrame,
    late: bool,
    k: int = 5,
    longer_than: int = 50,
    seed: int = 42,
    key: str = "review_id",
) -> DataFrame:
    """k bad reviews drawn in hash order, the same ones in every run: a sampling report.
    A review id may repeat, so the draw and its ties take order and text as well."""
    delay = F.col("delay_days")
    chosen = (delay > 0) if late else (delay <= 0)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, "order_id")]
    order = F.md5(F.concat_ws("|", *parts, "text_md5", F.lit(str(seed))))
    return (
        measures.where(F.expr(BAD) & chosen & (F.col("n_chars") > longer_than))
        .select(
            key, "review_score", delay_phrase(delay).alias("delay_text"), "shown",
            order.alias("draw"), "order_id", "text_md5",
        )
        .orderBy("draw", key, "order_id", "text_md5", "review_score")
        .limit(k)
        .drop("draw", "order_id", "text_md5")
    )


def bad_sources(measures: DataFrame) -> DataFrame:
    """Bad reviews: how many came late, on time, and name a delay in so many words."""
    delay, n = F.col("delay_days"), F.col("n_bad")
    return (
        measures.where(F.expr(BAD))
        .agg(
            F.count(F.lit(1)).alias("n_bad"),
            _counted(delay > 0, "n_late"),
            _counted(delay <= 0, "n_on_time"),
            _counted(F.col("names_delay"), "n_named"),
        )
        .withColumns(
            {
                "late_pct": share(F.col("n_late"), n),
                "on_time_pct": share(F.col("n_on_time"), n),
                "named_pct": share(F.col("n_named"), n),
            }
        )
    )
