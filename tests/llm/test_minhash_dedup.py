import random

import pytest
from tests.llm.common import BLANK, ODD, documents, lower, prose

from parecer.llm import minhash_dedup as m
from parecer.llm.components import connected_components


def edited(seed, text, n):
    draw, words = random.Random(seed), text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = prose(draw.random(), 1)
    return " ".join(words)


BASE = [prose(i, 90) for i in range(4)]
TEXTS = ODD + [(200 + 40 * b + i, edited(i, BASE[b], i % 5)) for b in range(4) for i in range(40)] + [
    (90, "One TWO three four"), (91, BASE[0].upper()), (92, BASE[0] + "\n"), (93, None),
]


def brute(rows, size=5, percent=75):
    sets = []
    for _, text in rows:
        words = BLANK.findall(lower(text))
        sets.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}
                    if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    for a, (doc, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a)]
        least = min((i for i in ids if i is not None), default=None)
        yield doc, len(sets[a]), least, doc == least


def test_components_match_brute_force(spark):
    got = m.near_duplicates(documents(spark, TEXTS).repartition(3)).drop("text_key").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(TEXTS)))


def test_one_of_each_group_stays(spark):
    docs = documents(spark, TEXTS)
    kept = m.one_of_each_group(docs)
    assert kept.schema == docs.schema
    want = {row[0] for row in brute(TEXTS) if row[3]}
    got = [r["doc_id"] for r in kept.collect()]
    assert set(got) - {None} == want - {None} and len(got) == len(set(got))


def test_one_stays_without_ids_and_with_shared_ids(spark):
    def loud(text):
        return "".join(c.upper() if c.isascii() else c for c in text)

    texts = [
        (None, BASE[0]), (None, BASE[0]), (None, loud(BASE[0])), (None, BASE[0] + "\n"),
        (None, edited(1, BASE[0], 1)), (None, edited(2, BASE[0], 1)),
        (7, BASE[1]), (7, edited(3, BASE[1], 1)), (8, edited(4, BASE[1], 1)), (None, BASE[1]),
        (7, BASE[2]), (None, BASE[3]), (9, loud(BASE[3])), (None, None), (None, None), (10, ""),
    ]
    kept = [tuple(r) for r in
            m.one_of_each_group(documents(spark, texts)).select("doc_id", "text").collect()]

    def of(base):
        words = set(lower(base).split())
        return [row for row in kept if len(words & set(lower(row[1]).split())) > 50]

    assert [len(of(base)) for base in BASE] == [1] * 4 and len(kept) == 6
    assert [of(base)[0][0] for base in BASE] == [None, 7, 7, 9]
    assert (None, None) in kept and (10, "") in kept


def test_empty_table(spark):
    assert m.near_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_connected_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)]
    edges += [(i, i + 1) for i in range(400, 440)] + [(500, 600 + i) for i in range(50)]
    edges += [(7, 7), (None, 3), (3, None), (9, 9)] + edges[:5]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(frame).collect()}
    assert got == {i: find(i) for i in list(parent)}


@pytest.mark.parametrize("copies", [1, 300])
def test_repeated_rows_make_one_set(spark, monkeypatch, copies):
    """Two near texts without doc_id, each repeated: as many sets and pairs as of one copy."""
    stored, sizes = m.written, {}

    def told(df, name):
        out = stored(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(m, "written", told)
    texts = [(None, BASE[0]), (None, edited(1, BASE[0], 1))]
    got = m.near_duplicates(documents(spark, texts * copies)).collect()
    assert len(got) == 2 * copies and len({r["n_shingles"] for r in got}) <= 2
    assert sizes["shingle-sets"] == [2] and sizes["pairs"][0] == 1 and sizes["links"] == [1]
    assert len(m.one_of_each_group(documents(spark, texts * copies)).collect()) == 1


def test_tables_with_the_same_members_are_one(spark):
    rows = [(i, i % 2, t // 3, t % 3, t) for t in range(9) for i in (range(4) if t != 4 else range(3))]
    keys = spark.createDataFrame(rows, "id long, comp long, i int, j int, key long")
    got = m._tables(keys.union(keys.limit(0))).select("key").distinct().collect()
    assert sorted(r["key"] for r in got) == [0, 4]
    one = m._tables(keys.withColumn("comp", keys["i"] * 0))
    assert one.count() == 0


def test_values_of_many_classes_need_no_table_rows(spark, monkeypatch):
    """Components are those of brute force, and the group of copies makes no rows of tables."""
    stored, sizes = m.written, {}

    def told(df, name):
        out = stored(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    rows = TEXTS + [(1000 + i, edited(500 + i, BASE[0], 6 + i % 12)) for i in range(60)]
    monkeypatch.setattr(m, "written", told)
    monkeypatch.setattr(m, "TRIES", (1,))
    for many in (1 << 40, 3):
        monkeypatch.setattr(m, "MANY", many)
        got = m.near_duplicates(documents(spark, rows)).drop("text_key").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    (before, after), pairs = sizes["tables"], sizes["pairs"]
    assert after < before / 4 and pairs[1] == pairs[3]
