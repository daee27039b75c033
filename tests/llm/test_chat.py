from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parecer.llm import chat as m

SCHEMA = "conv_id long, turn long, role string, text string, parts string, at int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {
        conv: ([(r, t) for *_, r, t in sorted(turns)],
               [t for *_, r, t in sorted(turns) if r == m.ASSISTANT])
        for conv, turns in groups.items()
    }


def check(spark, rows):
    got = m.read_back(m.examples(conversations(spark, rows))).collect()
    assert {
        r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["losses"]) for r in got
    } == brute(rows)


CONTROL = "\\### Assistant: </turn> ok"


def test_conversations_read_back(spark):
    check(spark, [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "a\nb"),
        (1, 3, "assistant", ""), (1, 4, "user", "left over"),
        (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL),
        (2, 0, None, None), (3, 0, "assistant", None), (4, None, "user", "x"), (4, 1, "assistant", "y"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "none"),
        (5, 0, "user", "tie"), (5, 0, "assistant", "tie"), (5, 0, "user", "tie"),
        (6, 0, "a: b\n### ", " </turn>\n### user: x"), (6, 1, "assistant", "\\b\\l\\h\\c" * 3),
        (7, 0, "assistant", "ä𝄞" * 4000 + "\\"),
    ])


def test_each_reply_is_one_example_with_its_context(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"),
            (1, 3, "assistant", "a2"), (1, 4, "user", "end")]
    got = m.examples(conversations(spark, rows)).orderBy("example").collect()
    assert [(r["example"], r["n_turns"], r["loss_length"]) for r in got] == [
        (2, 3, 2), (3, 4, 2), (4, 5, None)
    ]
    for r, reply in zip(got, ("a1", "a2")):
        a = r["loss_start"]
        assert r["text"][a:a + r["loss_length"]] == reply and r["text"].endswith(reply + m.END)
    assert got[1]["text"].startswith(got[0]["text"])


def test_empty_table(spark):
    assert m.examples(conversations(spark, [])).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("\\<>#: \nbhlcé/turn"), max_size=30), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", m.escape(F.col("t")).alias("e"), m.unescape(m.escape(F.col("t"))).alias("u"))
    for r in got.collect():
        assert r["t"] == r["u"] and not set("<#:") & set(r["e"])
