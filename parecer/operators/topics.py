"""Topics in bad reviews: vocabulary, topic model, labels, and topics by delay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions.measures import flag, share
from parecer.functions.text import tokenize, vector_words, with_bigrams
from parecer.operators import topic_model
from parecer.operators.ranking import sort_topk
from parecer.operators.texts import BAD, MESSAGE, with_order_delay, written


def corpus(
    reviews: DataFrame,
    orders: DataFrame,
    stopwords: Sequence[str] = fv.TOPIC_STOPWORDS,
    longer_than: int = 10,
    key: str = "review_id",
    strip_accents: bool = False,
) -> DataFrame:
    """Cleaned bad reviews of delivered orders, long enough to model; unknown delay counts
    as on time. Texts are cleaned and dropped before the join, so less is shuffled."""
    cleaned = F.array_join(tokenize(F.col(MESSAGE), stopwords, strip_accents), " ")
    kept = (
        written(reviews)
        .where(F.expr(BAD))
        # As a generator's output the text is cleaned once; the filter below would otherwise
        # be moved under the projection and clean it a second time.
        .select(key, "order_id", F.explode(F.array(cleaned)).alias("cleaned"))
        .where(F.length("cleaned") > longer_than)
    )
    return with_order_delay(kept, orders).select(
        key, "delay_days", flag(F.col("delay_days") > 0).alias("is_delayed"), "cleaned"
    )


def ngrams(docs: DataFrame) -> DataFrame:
    """Adds the words and word pairs of each document as ``terms``."""
    return docs.withColumn("terms", with_bigrams(vector_words(F.col("cleaned"))))


def vocabulary(
    docs: DataFrame, min_df: int = 10, max_df: float = 0.5, size: int = 2000
) -> DataFrame:
    """Terms in at least ``min_df`` documents and at most the share ``max_df`` of them,
    the most frequent ``size`` ones by total count; ties go to the lower term.

    Each document sends its terms and its distinct terms, so total count and document
    count come out of one shuffle keyed by the term alone, combined on the map side.
    """
    terms = F.col("terms")
    seen = F.transform(
        terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))
    )
    once = F.transform(
        F.array_distinct(terms),
        lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")),
    )
    counts = (
        docs.select(F.inline_outer(F.concat(seen, once)))
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_df)))
    return sort_topk(kept, size, F.desc("tf"), F.asc("term"))


@dataclass
class TopicModel:
    """A topic matrix (topics × words) with its words, at most ``vocabulary_size``. A model of
    a corpus without terms is empty: it has no words and assigns no topic."""

    words: list[str]
    matrix: np.ndarray | None
    k: int

    def topics(self, spark: SparkSession, n_words: int = 12) -> DataFrame:
        """The heaviest words of each topic with their weight: topic, rank, word, weight, prob."""
        matrix = self.matrix if self.words else np.zeros((0, 0))
        return topic_model.matrix_rows(spark, self.words, matrix, n_words)

    def assign(self, docs: DataFrame) -> DataFrame:
        """Adds each document's heaviest topic, the first one on ties; of an empty model null."""
        if not self.words:
            return docs.withColumn("topic", F.lit(None).cast("int"))
        return topic_model.fold_in(docs, self.words, self.matrix)


def _words(docs: DataFrame, min_df: int, max_df: float, size: int) -> list[str]:
    return [r["term"] for r in vocabulary(docs, min_df, max_df, size).collect()]


def fit_topics(
    docs: DataFrame,
    k: int = 6,
    batches: int = 17,
    passes: int = 20,
    seed: int = 42,
    min_df: int = 10,
    max_df: float = 0.5,
    vocabulary_size: int = 2000,
    offset: float = 10.0,
    decay: float = 0.7,
) -> TopicModel:
    """Online variational LDA over the documents' ``terms``.

    The documents are dealt once into ``batches`` stored mini-batches, and each update reads
    one of them, so a fit makes ``batches * passes`` updates and reads the corpus ``passes``
    times, for a corpus of any size; ``topic_model`` tells how. Without a term in the bounds
    the model is empty. Only the vocabulary and the topic matrix pass through the driver; both
    are bounded by ``vocabulary_size``.
    """
    words = _words(docs, min_df, max_df, vocabulary_size)
    if not words:
        return TopicModel([], None, k)
    shards = topic_model.stored_shards(docs, words, batches)
    matrix = topic_model.learn(shards, batches, len(words), k, passes, seed, offset, decay)
    return TopicModel(words, matrix, k)


def grouped_topics(
    docs: DataFrame,
    group: Column,
    k: int,
    min_df: int = 10,
    max_df: float = 0.5,
    vocabulary_size: int = 2000,
) -> TopicModel:
    """Topics given by groups of documents instead of learnt: a word's weight in topic t is how
    often the documents of group t (1 to k; others and null count nowhere) have it, plus 1/k."""
    words = _words(docs, min_df, max_df, vocabulary_size)
    if not words:
        return TopicModel([], None, k)
    number = {w: i for i, w in enumerate(words)}
    listed = docs.sparkSession.createDataFrame([(w,) for w in words], "term string")
    # At most ``vocabulary_size`` rows on the smaller side, and that times k in the result.
    counts = (
        docs.select(group.alias("topic"), F.explode("terms").alias("term"))
        .where(F.col("topic").between(1, k))
        .join(F.broadcast(listed), "term")
        .groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    matrix = np.full((k, len(words)), 1.0 / k)
    for r in counts:
        matrix[r["topic"] - 1, number[r["term"]]] += r["n"]
    return TopicModel(words, matrix, k)


def topic_share(assigned: DataFrame, k: int = 6) -> DataFrame:
    """Documents per topic and their share; empty topics listed."""
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    listed = assigned.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("topic"))
    # One row per topic on either side.
    return (
        listed.join(F.broadcast(counts), "topic", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn(
            "pct",
            F.coalesce(share(F.col("n"), F.sum("n").over(Window.partitionBy())), F.lit(0.0)),
        )
        .orderBy("topic")
    )


def labelled_share(
    assigned: DataFrame,
    topics: DataFrame,
    k: int = 6,
    lexicons: Mapping[str, Sequence[str]] = fv.TOPIC_LABEL_WORDS,
) -> DataFrame:
    """Share of each topic with the two labels that fit the model's own words best."""
    labels = (
        topic_labels(topics, lexicons=lexicons)
        .groupBy("topic")
        .agg(
            *[F.max(F.when(F.col("place") == i, F.col("label"))).alias(f"label_{i}") for i in (1, 2)]
        )
    )
    # One row per topic on either side.
    return topic_share(assigned, k).join(F.broadcast(labels), "topic", "left").orderBy("topic")


def topic_labels(
    topics: DataFrame,
    n_words: int = 8,
    keep: int = 2,
    lexicons: Mapping[str, Sequence[str]] = fv.TOPIC_LABEL_WORDS,
) -> DataFrame:
    """The lexicons that match most of a topic's first words: topic, place, label, score.

    Ties go to the lexicon listed first. ``topics`` has a few words per topic.
    """
    names = list(lexicons)
    word = F.col("word")
    scores = (
        topics.where(F.col("rank") <= n_words)
        .groupBy("topic")
        .agg(
            *[
                F.sum(flag(word.isin(*lexicons[name]))).alias(f"score_{i}")
                for i, name in enumerate(names)
            ]
        )
    )
    options = [
        F.struct((-F.col(f"score_{i}")).alias("minus"), F.lit(i).alias("i"),
                 F.lit(name).alias("label"))
        for i, name in enumerate(names)
    ]
    return (
        scores.select(
            "topic", F.posexplode(F.slice(F.array_sort(F.array(*options)), 1, keep))
        )
        .select(
            "topic",
            (F.col("pos") + 1).alias("place"),
            F.col("col.label").alias("label"),
            (-F.col("col.minus")).alias("score"),
        )
    )


def topic_by_delay(
    assigned: DataFrame,
    topics: DataFrame,
    k: int = 6,
    n_words: int = 6,
    late_over: float = 1.8,
    on_time_under: float = 0.5,
    lexicons: Mapping[str, Sequence[str]] = fv.TOPIC_LABEL_WORDS,
) -> DataFrame:
    """Each topic's share among late and among on-time reviews, and their ratio."""
    late = F.col("is_delayed") == 1
    counts = assigned.groupBy("topic").agg(
        F.sum(flag(late)).alias("n_late"), F.sum(flag(~late)).alias("n_on_time")
    )
    label = topic_labels(topics, n_words, 1, lexicons).select("topic", "label")
    everything = Window.partitionBy()
    listed = assigned.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("topic"))
    late_pct = F.coalesce(
        share(F.col("n_late"), F.sum("n_late").over(everything)), F.lit(0.0)
    )
    on_time_pct = F.coalesce(
        share(F.col("n_on_time"), F.sum("n_on_time").over(everything)), F.lit(0.0)
    )
    infinite = F.col("on_time_pct") == 0
    ratio = F.col("concentration")
    # One row per topic throughout.
    return (
        listed.join(F.broadcast(counts), "topic", "left")
        .join(F.broadcast(label), "topic", "left")
        .fillna(0, ["n_late", "n_on_time"])
        .select(
            "topic",
            "label",
            "n_late",
            "n_on_time",
            late_pct.alias("late_pct"),
            on_time_pct.alias("on_time_pct"),
        )
        .withColumn("concentration", F.try_divide("late_pct", "on_time_pct"))
        .withColumn("concentration_is_infinite", infinite)
        .withColumn(
            "mark",
            F.when(infinite | (ratio > late_over), "late")
            .when(ratio < on_time_under, "on_time")
            .otherwise(""),
        )
        .orderBy("topic")
    )
