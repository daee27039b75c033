import pytest
from tests.llm.common import ODD, PLAIN, documents, lower

from parecer.llm import license_scan as m

TEXTS = ODD + [
    (20, "Licensed under CC BY-NC 4.0. All rights reserved, all RIGHTS reserved"),
    (21, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"),
    (22, "the GNU Lesser General Public License\nand the general, public license"),
    (23, "all rights reservedly; succ by; cc byes"),
    (24, "SPDX-License-Identifier: )( OR"),
]


def brute(text):
    words = PLAIN.findall(lower(text))
    found = [
        (i, label)
        for phrase, label in m.BASE_PHRASES.items()
        for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    return (len(words), len(found), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for _, x in found})))


def test_places_match_brute_force(spark):
    got = m.licenses(documents(spark, TEXTS)).collect()
    assert sorted(map(str, [(r[0], *r[1:6]) for r in got])) == sorted(
        map(str, [(i, *brute(t)) for i, t in TEXTS])
    )
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[20]["labels"] == "cc-by,cc-by-nc,reserved" and by_id[20]["score"] == 0.0
    assert by_id[2]["score"] == m.UNKNOWN
    assert by_id[24]["expressions"] == []
    assert all(0 <= r["score"] <= 1 for r in got)
    assert "mit" in by_id[21]["labels"].split(",")


@pytest.mark.parametrize(
    "text, postfix, value",
    [
        ("MIT", "mit", 0.9),
        ("MIT OR GPL-3.0 AND CC-BY-NC-4.0", "mit gpl-3.0 cc-by-nc-4.0 and or", 0.9),
        ("(MIT OR GPL-3.0) AND CC-BY-NC-4.0", "mit gpl-3.0 or cc-by-nc-4.0 and", 0.2),
        ("GPL-2.0 WITH x-exception", "gpl-2.0 x-exception with", 0.5),
        ("(MIT", "mit", 0.9),
        ("MIT)", "mit", 0.9),
        ("AND", "", m.UNKNOWN),
        ("", "", m.UNKNOWN),
        ("MIT AND", "mit", 0.9),
    ],
)
def test_expressions(text, postfix, value):
    assert " ".join(m.to_postfix(text)) == postfix
    assert m.evaluate(m.to_postfix(text)) == pytest.approx(value)


def test_empty_table(spark):
    assert m.licenses(documents(spark, [])).collect() == []
