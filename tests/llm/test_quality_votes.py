import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.common import ODD, documents, prose

from parecer.llm import quality_votes as m

GOOD = [(i, prose(i, 60 + i % 30)) for i in range(400)]
BAD = [(i, " | ".join([prose(i % 9, 4)] * 15)) for i in range(400, 500)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_held_out_rows_are_told_apart(spark):
    docs = documents(spark, GOOD + BAD + ODD)
    marked = labels(spark, [(i, int(i < 400)) for i, _ in GOOD + BAD] + [(None, 0), (3, None)])
    found = m.scored(docs, marked, F.col("doc_id")).select(
        F.col("row").alias("doc_id"), "score", m.held_out(F.col("row")).alias("held")
    ).collect()
    assert len(found) == 500 + len(ODD)
    assert all(0 <= r["score"] <= 1 for r in found)
    for r in found:
        if r["doc_id"] is not None:
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in found if r["held"] and (r["doc_id"] or 0) >= 8]
    right = [(r["score"] >= m.ACCEPTED) == (r["doc_id"] < 400) for r in held]
    assert np.mean(right) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = documents(spark, GOOD[:60] + BAD[:30])
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    true = [(i, int(i < 400)) for i, _ in GOOD[:60] + BAD[:30]]
    false = [(i, 1 - q if held(i) else q) for i, q in true]
    a, b = (
        {r["row"]: r["score"] for r in m.scored(docs, labels(spark, x), F.col("doc_id")).collect()}
        for x in (true, false)
    )
    assert a == b


def test_accepted_rows_keep_their_columns(spark):
    docs = documents(spark, GOOD + BAD)
    kept = m.accepted(docs, labels(spark, [(i, int(i < 400)) for i, _ in GOOD + BAD]))
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(400))) > 390 and len(ids & set(range(400, 500))) < 5


def test_without_labels_or_rows(spark):
    none = labels(spark, [])
    got = m.scored(documents(spark, ODD), none, F.col("doc_id")).collect()
    assert [r["score"] for r in got] == [0.5] * len(ODD)
    assert m.scored(documents(spark, []), none, F.col("doc_id")).collect() == []


@pytest.mark.parametrize("k", [1, 5, 900])
def test_blocked_neighbours_match_a_plain_search(k):
    draw = np.random.default_rng(2)
    rows = draw.random((300, m.TERMS)).astype(np.float32)
    voters = m.Voters(rows[:200], (draw.random(200) > 0.4).astype(float))
    got = voters.scores(rows[200:], k, 2)
    own = m.unit(m.weighted(rows[200:], voters.rarity) @ voters.basis)
    for x, score in zip(own, got):
        near = voters.vectors @ x
        best = np.argsort(-near)[:k]
        weight = np.clip(near[best], 0, 1) ** 2
        want = (weight @ voters.labels[best] + 0.05 * voters.prior) / (weight.sum() + 0.05)
        assert score == pytest.approx(want, abs=1e-3)
