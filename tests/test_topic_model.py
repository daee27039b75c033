"""The topic model's store, updates and assignment."""

import math
import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parecer.operators import topic_model as m
from parecer.operators import topics
from tests.conftest import rows

WORDS = ["ab", "cd", "ef", "gh"]


def docs_of(spark, lists):
    return spark.createDataFrame([(t,) for t in lists], "terms array<string>")


def drawn(n, seed=1):
    draw = random.Random(seed)
    lists = [draw.choices([*WORDS, "unknown"], k=draw.randint(0, 9)) for _ in range(n)]
    return [*lists, None, [], ["unknown"]]


def test_digamma():
    assert m.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-8)
    x = np.array([1e-3, 0.2, 3.7, 1e6])
    assert m.digamma(x + 1) - m.digamma(x) == pytest.approx(1 / x, rel=1e-6)


def counted(block):
    return [
        sorted((WORDS[i], int(c)) for i, c, d in zip(block.ids, block.counts, block.doc) if d == k)
        for k in range(block.n)
    ]


def counts(terms):
    return sorted((w, terms.count(w)) for w in set(terms or ()) & set(WORDS))


def test_documents_are_dealt_once_and_evenly(spark):
    lists = drawn(200)
    shards = m.stored_shards(docs_of(spark, lists).repartition(6), WORDS, 5, batch_docs=8)
    stored = shards.collect()
    assert shards.count() >= 1
    sizes = [[r[f"n{k}"] for k in range(5)] for r in stored]
    assert sum(map(sum, sizes)) == 203 and all(max(s) - min(s) <= 1 for s in sizes)
    got = []
    for r in stored:
        for k in range(5):
            block = m.Block.unpacked(bytes(r[f"b{k}"]))
            assert block.n == r[f"n{k}"]
            got += counted(block)
    assert sorted(got) == sorted(counts(t) for t in lists)


def test_an_update_reads_its_own_mini_batch(spark):
    shards = m.stored_shards(docs_of(spark, drawn(50)), WORDS, 17)
    plan = shards.select("b3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b3:binary>" in plan


def by_hand(terms, weights, prior, steps):
    """The variational update of one document, word by word."""
    own = [(w, c) for w, c in counts(terms)]
    n, k = sum(c for _, c in own), len(weights)
    topic = [prior + n / k] * k
    for _ in range(steps):
        mood = [math.exp(float(m.digamma(np.array([x]))[0])) for x in topic]
        new = [prior] * k
        for w, c in own:
            i = WORDS.index(w)
            total = sum(mood[t] * weights[t][i] for t in range(k))
            for t in range(k):
                new[t] += c * mood[t] * weights[t][i] / total
        topic = new
    return topic


def test_fold_in_as_by_hand(spark):
    matrix = np.array([[5.0, 1, 1, 2], [1, 6, 1, 2], [1, 1, 9, 2]])
    weights, lists = m.word_weights(matrix), drawn(60, seed=2)
    got, _ = m.Block(*m.encode(pa.array(lists, pa.list_(pa.string())), pa.array(WORDS))).infer(
        weights, 1 / 3, 20
    )
    want = [by_hand(t, weights, 1 / 3, 20) for t in lists]
    assert got == pytest.approx(np.array(want))
    docs = docs_of(spark, lists).withColumn("id", F.lit("x")).repartition(3)
    assigned = m.fold_in(docs, WORDS, matrix).collect()
    assert len(assigned) == 63 and {r["id"] for r in assigned} == {"x"}
    for r in assigned:
        topic = by_hand(r["terms"], weights, 1 / 3, 20)
        best = next(i for i, x in enumerate(topic) if x >= max(topic) * (1 - 1e-9))
        assert r["topic"] == best + 1


def test_the_sums_of_an_update_cover_all_documents(spark):
    lists = drawn(80, seed=4)
    shards = m.stored_shards(docs_of(spark, lists), WORDS, 4, batch_docs=5)
    weights = m.word_weights(np.array([[5.0, 1, 1, 2], [1, 6, 1, 2]]))
    for k in range(4):
        found = m._summed(
            shards.select(f"b{k}"), partial(m._one_batch, weights=weights, prior=0.5), 2, 4
        )
        words = sum(sum(c for _, c in d) for r in shards.collect()
                    for d in counted(m.Block.unpacked(bytes(r[f"b{k}"]))))
        assert found.sum() == pytest.approx(words)


def planted(seed, n):
    draw = random.Random(seed)
    sets = [[f"{chr(97 + s)}word{chr(97 + i)}" for i in range(12)] for s in range(4)]
    return [draw.choices(sets[i % 4], k=25) for i in range(n)]


def test_many_shards_learn_what_one_learns(spark, monkeypatch):
    """Shards that update by themselves agree on what a topic is about."""
    stored, learnt, shards = m.stored_shards, [], []
    docs = docs_of(spark, planted(1, 400)).repartition(1)
    for batch_docs in (2, 512, 512):
        made = []
        monkeypatch.setattr(
            m, "stored_shards", lambda d, w, p: made.append(stored(d, w, p, batch_docs)) or made[0]
        )
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        model = topics.fit_topics(docs, 4, batches=10, passes=6, min_df=2)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        shards.append(made[0].count())
        learnt.append(model.matrix)
    assert shards == [20, 1, 1] and np.allclose(learnt[1], learnt[2])
    for many, one in zip(learnt[0], learnt[1]):
        assert len(set(np.argsort(many)[-8:]) & set(np.argsort(one)[-8:])) >= 6
    first = [{model.words[i][0] for i in np.argsort(x)[-8:]} for x in learnt[1]]
    assert sum(len(x) == 1 for x in first) >= 2


def test_topics_given_by_groups(spark):
    docs = spark.createDataFrame(
        [(["ab", "ab", "cd"], 1), (["ef", "cd"], 2), (["gh"], 3), (["gh", "zz"], None)],
        "terms array<string>, g int",
    )
    model = topics.grouped_topics(docs, F.col("g"), 2, min_df=1, max_df=1.0)
    by_word = dict(zip(model.words, model.matrix.T.tolist()))
    assert by_word["ab"] == [2.5, 0.5] and by_word["cd"] == [1.5, 1.5]
    assert by_word["gh"] == [0.5, 0.5]
    got = dict(rows(model.assign(docs).select(F.element_at("terms", 1), "topic")))
    assert got["ab"] == 1 and got["ef"] == 2 and got["gh"] == 2  # topic 2 has fewer words
