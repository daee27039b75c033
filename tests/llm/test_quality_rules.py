from collections import Counter

import numpy as np
import pytest
from tests.llm.common import BLANK, ODD, documents, prose

from parecer.llm import quality_rules as m

TEXTS = ODD + [
    (40, prose(1, 60)), (41, "é# ß$\n" * 5 + " \n\n" + "x|<>\n"), (42, prose(2, 12) + " " + prose(2, 12)),
    (43, prose(3, 8) + "\n" + prose(3, 8) + "\n" + prose(4, 30)), (44, "a b c d e f g h " * 3),
]


def brute(text):
    text = text or ""
    words = BLANK.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1
           for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit))


def test_counts_match_brute_force(spark):
    got = m.statistics(documents(spark, TEXTS)).collect()
    assert sorted(map(str, [tuple(r)[:6] for r in got])) == sorted(
        map(str, [(i, *brute(t)) for i, t in TEXTS])
    )


@pytest.mark.parametrize("sign", [-1, 1])
def test_constraints_hold_and_trees_learn(sign):
    draw = np.random.default_rng(1)
    rows = draw.random((3000, 3))
    labels = ((sign * rows[:, 0] + 0.3 * np.sin(9 * rows[:, 0]) + rows[:, 1]) > 0.5).astype(float)
    trees = m.grow(rows, labels, [sign, 0, 0])
    assert ((trees.scores(rows) > 0.5) == labels).mean() > 0.9
    line = np.repeat(draw.random((50, 1, 3)), 200, axis=1)
    line[:, :, 0] = np.linspace(0, 1, 200)
    along = trees.scores(line.reshape(-1, 3)).reshape(50, 200)
    assert (sign * np.diff(along, axis=1) >= -1e-12).all()


def test_bad_goes_and_good_stays(spark):
    good = [(i, prose(i, 80 + i % 40)) for i in range(300)]
    bad = [(i, " | ".join(prose(i, 60).split())) for i in range(300, 400)]
    labels = spark.createDataFrame(
        [(i, int(i < 300)) for i in range(0, 400, 2)] + [(None, 1), (0, None), (9999, 0)],
        "doc_id long, quality int",
    )
    got = {r["doc_id"]: r["kept"] for r in m.judged(documents(spark, good + bad), labels).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 400))


def test_odd_rows_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = m.judged(documents(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0.5 for r in got)
    assert {r["doc_id"] for r in got if r["kept"]} == set()
    assert m.judged(documents(spark, []), labels).collect() == []
