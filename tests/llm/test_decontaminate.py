import numpy as np
import pytest
from tests.llm.common import ODD, PLAIN, documents, lower, prose

from parecer.llm import decontaminate as m

ITEM = prose(1, 25)
ITEMS = [(1, ITEM), (2, "Tiny item"), (3, None), (4, ""), (None, prose(2, 20)), (5, ITEM),
         (6, prose(3, 10))]
WORDS = ITEM.split()
TEXTS = ODD + [
    (30, prose(4, 50) + " " + "".join(c.upper() if c.isascii() else c for c in ITEM) + ". " + prose(5, 30)),
    (31, " ".join(WORDS[3:13])), (32, " ".join(WORDS[3:12])),
    (33, ITEM + " " + ITEM), (34, "x tiny, ITEM y tiny item"), (35, prose(2, 20)),
    (36, " ".join(WORDS[:12]) + " zz " + " ".join(WORDS[8:])),
]


def brute(text, window=10):
    words = PLAIN.findall(lower(text))
    hit, items = set(), set()
    for item, own in ITEMS:
        own = PLAIN.findall(lower(own))
        if item is None or not own:
            continue
        size = min(window, len(own))
        for k in range(len(own) - size + 1):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == own[k:k + size]:
                    hit.update(range(i, i + size))
                    items.add(str(item))
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("settings", [{}, {"pass_bytes": 100}, {"shard_words": 8}])
def test_hits_match_brute_force(spark, settings):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = m.contamination(documents(spark, TEXTS), benchmark, **settings)
    got = found.select("doc_id", "n_words", m.hit_words(), "items").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(i, *brute(t)) for i, t in TEXTS]))


def test_passages_are_cut(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, TEXTS)
    kept = m.decontaminated(docs, benchmark)
    assert kept.schema == docs.schema and kept.count() == len(TEXTS)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[1] is None and texts[32] == " ".join(WORDS[3:12])
    assert texts[30] == prose(4, 50) + " . " + prose(5, 30)
    assert m.contamination(kept, benchmark).where("size(items) > 0").count() == 0


def test_passes_cut_what_one_pass_cuts(spark):
    # Windows of different passes overlap, meet, and would arise at the seam of a cut.
    own = prose(7, 45).split()
    items = [(i, " ".join(own[i:i + 10])) for i in range(0, 36, 5)]
    items += [(90, " ".join(own[:6] + own[36:])), (91, " ".join(own[20:30]))]
    texts = TEXTS + [
        (60, prose(8, 20) + " " + " ".join(own) + ", " + prose(9, 20)), (61, " ".join(own[3:21])),
        (62, " ".join(own[:6] + own[10:20] + own[36:])), (None, " ".join(own)), (60, " ".join(own)),
    ]
    benchmark = spark.createDataFrame(ITEMS + items, "item_id long, text string")
    docs = documents(spark, texts)
    one, more = m.decontaminated(docs, benchmark), m.decontaminated(docs, benchmark, pass_bytes=100)
    assert more.schema == docs.schema
    assert sorted(map(str, more.collect())) == sorted(map(str, one.collect()))
    assert {r["text"] for r in more.where("doc_id = 60").collect()} == {
        "", prose(8, 20) + " , " + prose(9, 20)}


def test_passes_are_bounded_and_made_one_by_one(spark, monkeypatch):
    hot = [(1, prose(100 + i, 20)) for i in range(60)]
    benchmark = spark.createDataFrame(hot, "item_id long, text string")
    steps, sizes = [], []
    collected, written = m._collected, m.written

    def collect(items):
        got = collected(items)
        steps.append("collect")
        sizes.append(sum(len(text.encode()) for _, text in got))
        return got

    def write(df, name):
        steps.append("write")
        return written(df, name)

    monkeypatch.setattr(m, "_collected", collect)
    monkeypatch.setattr(m, "written", write)
    texts = [(1, hot[0][1]), (2, hot[41][1] + " x"), (3, "none of it"), (2, hot[41][1] + " x")]
    found = m.contamination(documents(spark, texts), benchmark, pass_bytes=2000)
    assert steps == ["collect", "write"] * len(sizes) and len(sizes) > 1
    assert max(sizes) < 2 * 2000
    got = found.select("doc_id", "n_words", m.hit_words(), "items").collect()
    assert sorted(map(tuple, got))[::3] == [(1, 20, 20, ["1"]), (3, 3, 0, [])]
    assert all(tuple(r) == (2, 21, 20, ["1"]) for r in got if r["doc_id"] == 2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert m.contamination(documents(spark, []), none).collect() == []
    got = m.contamination(documents(spark, TEXTS), none).collect()
    assert len(got) == len(TEXTS) and not any(r["items"] for r in got)


def test_index_finds_what_a_scan_finds():
    draw = np.random.default_rng(3)
    text = np.append(draw.integers(1, 4, 400), 0)
    index = m.Index(text, sample=7)
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))
    for symbols in ([1, 2], [3, 3, 1], [2, 1, 2, 1, 3]):
        phrases = m.Phrases([], 5)
        phrases.rows = np.array([[0] * (5 - len(symbols)) + symbols])
        low, high = index.search(phrases)
        want = [i for i in range(len(text)) if text[i:i + len(symbols)].tolist() == symbols]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want
