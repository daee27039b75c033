import hashlib
from collections import Counter

import pytest
from tests.llm.common import ODD, documents, prose

from parecer.llm import suffix_dedup as m

SHARED, OTHER = prose(1, 60), prose(2, 40)
TEXTS = ODD + [
    (60, prose(3, 50) + " " + SHARED + prose(4, 20)), (61, SHARED[5:] + prose(5, 30)),
    (62, prose(6, 20) + OTHER + prose(7, 10) + OTHER), (63, prose(8, 90)), (64, prose(8, 90)),
    (65, SHARED[:119]), (66, SHARED[:120]), (67, "ab" * 300), (68, prose(8, 90)[:-3]),
] + [(70 + i, prose(20 + i, 10) + SHARED[: 200 + i] + prose(40 + i, 10)) for i in range(12)]


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k:k + length] for _, t in texts for k in range(len(t) - length + 1))
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, y in zip(t, gone) if not y)
        yield i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most_regions", [2000, 1])
@pytest.mark.parametrize("length, gram", [(120, 16), (50, 9)])
def test_removed_bytes_match_brute_force(spark, length, gram, most_regions):
    docs = documents(spark, TEXTS).repartition(3)
    got = m.without_repeats(docs, length=length, gram=gram, most_regions=most_regions).collect()
    rows = [(*r[:4], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(map(str, rows)) == sorted(map(str, brute(TEXTS, length)))


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(m, "TEXT_BYTES", 70)
    got = m.without_repeats(documents(spark, TEXTS), length=60, gram=9).collect()
    rows = [(*r[:4], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(map(str, rows)) == sorted(map(str, brute(TEXTS, 60)))


def test_texts_keep_whole_characters(spark):
    rows = [(1, "ä" * 3 + SHARED), (2, "Ă" * 3 + SHARED), (3, None), (4, prose(9, 9))]
    docs = documents(spark, rows)
    cut = m.documents_without_repeats(docs, length=101, gram=16)
    assert cut.schema == docs.schema
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == {1: "ä" * 3, 2: "Ă" * 3, 3: None, 4: prose(9, 9)} or all(
        set(got[i] or "") <= set("äĂ") for i in (1, 2)
    )


def test_split_anchors_find_what_sorting_finds(spark):
    rows = [(i, prose(100 + i, 25) + SHARED[: 250 + i] + prose(200 + i, 25)) for i in range(40)]
    rows += [(50 + i, rows[0][1]) for i in range(3)] + [(60, rows[1][1][40:])]
    got = [
        sorted(map(tuple, m.without_repeats(
            documents(spark, rows), length=100, gram=12, most_regions=most
        ).collect())) for most in (1, 2000)
    ]
    assert got[0] == got[1]


def test_repeated_rows_are_one_region(spark, monkeypatch):
    made, write = {}, m.written
    monkeypatch.setattr(m, "written", lambda df, name: made.setdefault(name, write(df, name)))
    other = [(1, SHARED[:300] + prose(9, 30)), (2, prose(7, 9) + SHARED[:300])]
    counts = []
    for copies in (2, 300):
        made.clear()
        rows = [(None, SHARED + OTHER)] * copies + other
        m.repeated_spans(documents(spark, rows).repartition(3), length=120)
        counts.append([made[x].count() for x in ("regions", "region-texts")])
    assert counts[0] == counts[1]


def test_empty_table(spark):
    assert m.without_repeats(documents(spark, [])).collect() == []


def test_repeated_rows_collect_each_span_once(spark):
    rows = [(None, SHARED + OTHER)] * 6 + [(1, SHARED[:300] + prose(9, 30))]
    found = m.repeated_spans(documents(spark, rows).repartition(3), length=120).collect()
    assert len(found) == 2
    for r in found:
        spans = [(s["a"], s["b"]) for s in r["spans"]]
        assert len(spans) == len(set(spans))
