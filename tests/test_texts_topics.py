import inspect
import random

import pytest
from pyspark.sql import functions as F

from parecer.operators import texts, topics
from tests.conftest import SCHEMAS, order, rows

MESSAGES = [
    ("r1", "late", 1, "Atraso enorme, atraso sem explicação! Prazo estourado e a caixa quebrado " * 2),
    ("r2", "late", 2, "a cor veio diferente http://x.y/atraso"),
    ("r3", "soon", 1, "Produto com defeito, quero reembolso do dinheiro e falar com o vendedor já"),
    ("r4", "soon", 5, "gostei demais recomendo recomendo"),
    ("r5", "none", 1, "nunca chegou, demorou"),
    ("r6", "soon", 3, "mais ou menos"),
    ("r7", "soon", 1, ""),
    ("r8", "soon", 1, None),
    ("r9", "lost", 1, "pedido cancelado atraso"),
]


@pytest.fixture(scope="module")
def spoken(spark):
    reviews = spark.createDataFrame(
        MESSAGES,
        "review_id string, order_id string, review_score int, review_comment_message string",
    )
    orders = spark.createDataFrame(
        [order("late", 5.0), order("soon", -5.0), order("none", arrived=False),
         order("lost", 5.0, status="canceled")], SCHEMAS["orders"]
    )
    return reviews, orders


def test_groups(spoken):
    r = texts.group_counts(texts.measure_reviews(*spoken)).first()
    assert (r["n"], r["n_bad"], r["n_good"], r["n_neutral"]) == (6, 4, 1, 1)
    assert (r["n_bad_late"], r["n_bad_on_time"]) == (2, 1)


def test_delay_words_are_looked_up_outside_urls(spoken):
    r = texts.bad_sources(texts.measure_reviews(*spoken)).first()
    assert (r["n_bad"], r["n_named"]) == (4, 2)  # r1 and r5; r2 has it in a URL only


def test_theme_counts_against_a_plain_count(spoken):
    got = {(r["label"], r["theme"]): r for r in
           texts.theme_share(texts.measure_reviews(*spoken)).collect()}
    assert len(got) == 12
    late, on_time = "差评-延迟订单", "差评-非延迟订单"
    assert got[late, "delivery_speed"]["n"] == 6  # atraso ×4, prazo ×2
    assert got[late, "packaging"]["n"] == 2
    assert got[on_time, "service"]["n"] == 3
    assert got[on_time, "payment"]["n"] == 0


def test_themes_without_any_review_are_listed_with_zero(spoken):
    reviews, orders = spoken
    got = texts.theme_share(texts.measure_reviews(reviews.where("review_score = 5"), orders))
    assert {(r["n"], r["total"], r["pct"]) for r in got.collect()} == {(0, 0, 0.0)}


def test_top_words(spoken):
    got = {(r["label"], r["rank"]): r for r in texts.top_words(*spoken).collect()}
    first = got["差评(1-2星)", 1]
    assert (first["word"], first["n"], first["theme"]) == ("atraso", 4, "delay")
    assert got["好评(4-5星)", 1]["word"] == "recomendo"
    assert got["好评(4-5星)", 1]["theme"] == "recomendo"


def test_samples_are_whole_and_repeatable(spoken):
    measures = texts.measure_reviews(*spoken)
    late = texts.sample_bad(measures, late=True)
    assert [r["review_id"] for r in late.collect()] == ["r1"]
    assert late.first()["delay_text"] == "+5天"
    again = texts.sample_bad(measures.repartition(3), late=True)
    assert rows(late) == rows(again)


def test_corpus_keeps_unknown_delay_as_on_time(spoken):
    got = {r["review_id"]: r for r in topics.corpus(*spoken).collect()}
    assert got["r5"]["is_delayed"] == 0 and got["r5"]["delay_days"] is None
    assert set(got) == {"r1", "r2", "r3", "r5"}
    assert got["r2"]["cleaned"] == "cor diferente"
    assert topics.corpus(*spoken, longer_than=13).where("review_id = 'r2'").count() == 0


def test_vocabulary_bounds(spark):
    docs = spark.createDataFrame(
        [(["a", "b", "a"],), (["a", "c"],), (["a", "b"],), (["d"],)], "terms array<string>"
    )
    got = {r["term"]: (r["tf"], r["df"]) for r in topics.vocabulary(docs, 2, 0.5).collect()}
    assert got == {"b": (2, 2)}  # a is in 3 of 4 documents, c and d in one
    wide = [r["term"] for r in topics.vocabulary(docs, 1, 1.0, size=3).collect()]
    assert wide == ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """Documents that each draw from one of six word sets; set 0 mostly late."""
    rng = random.Random(3)
    sets = [[f"{chr(97 + s)}word{chr(97 + i)}" for i in range(12)] for s in range(6)]
    data = []
    for i in range(360):
        s = i % 6
        late = 1 if (s == 0) == (rng.random() < 0.9) else 0
        data.append((str(i), s, late, rng.choices(sets[s], k=25)))
    docs = spark.createDataFrame(
        data, "review_id string, planted int, is_delayed int, terms array<string>"
    ).cache()
    return docs, topics.fit_topics(docs, batches=4, passes=8, min_df=2)


def test_topics_recover_the_planted_word_sets(spark, planted):
    docs, model = planted
    words = model.topics(spark)
    assert words.count() == 6 * 12
    per_topic = {}
    for r in words.where("rank <= 8").collect():
        per_topic.setdefault(r["topic"], []).append(r["word"][0])
    pure = sum(len(set(letters)) == 1 for letters in per_topic.values())
    assert pure >= 4
    assigned = model.assign(docs)
    together = assigned.groupBy("planted", "topic").count()
    best = together.groupBy("planted").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
    assert best >= 330


def test_topic_shares_sum_to_100_and_list_every_topic(planted):
    docs, model = planted
    got = topics.topic_share(model.assign(docs)).collect()
    assert len(got) == 6
    assert sum(r["pct"] for r in got) == pytest.approx(100)
    more = topics.topic_share(model.assign(docs), k=8).collect()
    assert [r["n"] for r in more[6:]] == [0, 0]


def test_topics_by_delay(spark, planted):
    docs, model = planted
    words = model.topics(spark)
    got = topics.topic_by_delay(model.assign(docs), words).collect()
    assert sum(r["n_late"] + r["n_on_time"] for r in got) == 360
    assert sum(r["late_pct"] for r in got) == pytest.approx(100)


def test_labels_break_ties_by_lexicon_order(spark):
    words = spark.createDataFrame(
        [(1, 1, "foto"), (1, 2, "troca"), (1, 3, "cor"), (1, 9, "atraso"), (2, 1, "xyz")],
        "topic int, rank int, word string",
    )
    got = rows(topics.topic_labels(words).orderBy("topic", "place"))
    assert got == [
        (1, 1, "📐 描述不符", 2), (1, 2, "📞 售后无响应", 1),
        (2, 1, "🚚 配送延迟", 0), (2, 2, "🔧 产品质量", 0),
    ]


def test_no_vocabulary_gives_an_empty_model(spark):
    docs = spark.createDataFrame([(["a"], 1)], "terms array<string>, is_delayed int")
    model = topics.fit_topics(docs)
    words, assigned = model.topics(spark), model.assign(docs)
    assert rows(words) == []
    assert [r["n"] for r in topics.topic_share(assigned).collect()] == [0] * 6
    assert [r["n"] for r in topics.labelled_share(assigned, words).collect()] == [0] * 6
    assert [r["n_late"] for r in topics.topic_by_delay(assigned, words).collect()] == [0] * 6


def test_the_schedule_does_not_depend_on_the_corpus():
    parameters = inspect.signature(topics.fit_topics).parameters
    assert (parameters["batches"].default, parameters["passes"].default) == (17, 20)
    assert not {"batch_size", "most_batches"} & set(parameters)
