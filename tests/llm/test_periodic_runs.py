import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.common import BLANK, ODD, documents, prose

from parecer.llm import periodic_runs as m
from parecer.llm.words import BLANK_WORDS, Words, text_bytes


def brute(words):
    """Every maximal stretch for every period, those of a smaller period left out."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q):
                s = words[i:i + size]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_text(draw):
    n, letters = draw.randint(0, 70), "abcdefghij"[:draw.choice([1, 2, 3, 10])]
    words = [draw.choice(letters) for _ in range(n)]
    if n and draw.random() < 0.6:
        a = draw.randrange(n)
        p = 1 + (n - a) // draw.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return draw.choice(["", " ", "\n\t"]) + draw.choice([" ", "\n", " \x0b"]).join(words)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_odd_texts(seed):
    draw = random.Random(seed)
    texts = [odd_text(draw) for _ in range(8)]
    words = Words(*text_bytes(pa.array(texts)), BLANK_WORDS, lower=False)
    of_text = np.repeat(np.arange(8), np.diff(words.of_text))
    runs = m.runs_of(words.hashes(), of_text)
    data, limits = m.collapsed(words, runs)
    for k, text in enumerate(texts):
        a, b = words.of_text[k], words.of_text[k + 1]
        got = [(s - a, n, q) for s, n, q in runs.tolist() if a <= s < b]
        assert got == brute(text.split())
        assert data[limits[k]:limits[k + 1]].tobytes().decode() == left(text.split(), got)


def test_seeds_are_neighbours_of_the_same_period():
    words = "a b c".split() * 5
    at = np.arange(15)
    pairs = [(i, i + 3, 12 - i) for i in range(8)]
    assert m.seeds(*zip(*pairs)) == [(i, 3, 12 - i) for i in range(4)]
    assert m.runs_of(np.array([ord(w) for w in words], dtype=np.uint64), at * 0).tolist() == [[0, 15, 3]]


def test_documents(spark):
    draw = random.Random(3)
    rows = ODD + [(100 + i, odd_text(draw)) for i in range(60)] + [(200, prose(1, 300))] * 3
    rows += [(300, "é É " * 4 + "end"), (301, "A a " * 3), (302, "x " * 5), (303, "x " * 6)]
    got = m.periodic_runs(documents(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        words = BLANK.findall(texts[r["doc_id"]] or "")
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 2)]
        assert r["n_words"] == len(words)
        assert [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == left(words, runs)


@pytest.mark.parametrize("text, period", [("w " * 400_000, 1), ("a b c d e " * 90_000, 5)])
def test_texts_of_a_megabyte(spark, text, period):
    r = m.periodic_runs(documents(spark, [(1, text)])).first()
    assert [tuple(x) for x in r["runs"]] == [(0, len(text.split()), period)]
    assert r["collapsed"] == " ".join(text.split()[:period])


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None)]])
def test_no_text(spark, rows):
    got = m.periodic_runs(documents(spark, rows)).collect()
    assert [(r["n_words"], r["runs"], r["collapsed"]) for r in got] == [(0, [], "")] * len(rows)
