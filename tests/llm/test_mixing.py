import random
from collections import Counter, defaultdict

import pytest
from tests.llm.common import prose

from parecer.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, size long, number int, target string, `a b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x", 3) for i, t, s in rows], SCHEMA)


def shared(sizes, growth=1.5, most=2):
    """Targets by sharing again and again, as the rule is worded."""
    weights = [m.WEIGHTS[i % 3] for i in range(len(sizes))]
    kept: dict[int, int] = {}
    while True:
        left = growth * sum(sizes) - sum(kept.values())
        free = sum(w for i, w in enumerate(weights) if i not in kept)
        now = [kept.get(i, left * w / (free or 1)) for i, w in enumerate(weights)]
        above = [i for i in range(len(sizes)) if i not in kept and now[i] > most * sizes[i]]
        if not above:
            return now
        kept |= {i: most * sizes[i] for i in above}


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = [int(10 ** draw.uniform(0, 5)) for _ in range(12)] + [0]
    names = sorted(f"s{i}" for i in range(12)) + [None]
    rows = spark.createDataFrame(
        [(s is not None, s or "", x) for s, x in zip(names, sizes)],
        "named boolean, source string, source_size long",
    )
    got = {r["number"]: r["target"] for r in m.targets(rows).collect()}
    want = shared(sizes)
    assert [got[i] for i in range(13)] == pytest.approx(want)
    assert sum(want) == pytest.approx(1.5 * sum(sizes))


def test_mix(spark):
    draw = random.Random(5)
    rows = [
        (i, prose(i, draw.choice([3, 20, 60])), draw.choice(["é", "b", "a", "a", None]))
        for i in range(900)
    ]
    rows += [(901, None, "a"), (902, "", "b"), (None, "no id here", "a"), (903, "w " * 9000, "b")]
    got = m.mixed(table(spark, rows).repartition(3)).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    taken, words = defaultdict(int), Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
        words[source[r["doc_id"]]] += r["size"]
    want = dict(zip(["a", "b", "é", None], shared([words[s] for s in ["a", "b", "é", None]])))
    for r in got:
        assert r["source_size"] == words[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    longest = {"b": 4500}
    for s, t in taken.items():
        assert abs(t - want[s]) <= longest.get(s, 30) + 1e-6
    again = m.mixed(table(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_long_documents_are_likelier(spark):
    rows = [(i, "w " * (5 if i % 2 else 50), "c") for i in range(2000)]
    rows += [(2000, "w " * 60_000, "a"), (2001, "w " * 100_000, "b")]
    got = [r for r in m.mixed(table(spark, rows)).collect() if r["doc_id"] < 2000]
    assert 1.1 < got[0]["target"] / got[0]["source_size"] < 1.3
    extra = Counter(r["size"] for r in got if r["taken"] == 2 * r["size"])
    assert extra[5] and extra[50] > 4 * extra[5]


def test_a_third_of_all_rows_are_equal(spark, monkeypatch):
    monkeypatch.setattr(m, "LISTED", 7)
    rows = [(None, "one two three", "a")] * 200 + [(i, prose(i, 9), "ab"[i % 2]) for i in range(400)]
    got = m.mixed(table(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    for size in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4.5


def test_the_rank_needs_no_window_over_a_source(spark):
    """What is ranked in one task is what shares the range of the cut."""
    rows = [(i, "w " * 20, "a") for i in range(3000)] + [(9000, "w " * 99999, "b")]
    size = spark.createDataFrame(
        [(0, 30000.5, i, 20, 1, i / 100.0, int(i * 0.64), int(i * 0.64 % 1 * 4096)) for i in range(3000)],
        "number int, due double, id_key long, size long, copies long, odds double, range long, "
        "finer long",
    )
    cut = m._cuts(size).collect()
    assert [(r["last_id"], r["last"]) for r in cut] == [(1500, 0)]
    assert m.mixed(table(spark, rows)).count() == 3001


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, " \n", None)]])
def test_no_words(spark, rows):
    got = m.mixed(table(spark, rows)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * len(rows)
