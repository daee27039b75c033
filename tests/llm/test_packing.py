from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.common import ODD, documents, prose
from tokenizers import Tokenizer

from parecer.llm import packing as m

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ODD + [(i, prose(i, i % 90 * 20)) for i in range(100, 160)] + [
    (50, "ab  c"), (51, "á é İ ǅ ﬁ"), (52, "<|endoftext|> x <|ENDOFTEXT|>"),
    (53, "It's DON'T\x1cwe\x85’ll　​ 12 ½ ²"), (54, " ́x"),
]


def test_pieces_hold_every_id_once(spark):
    plain = Tokenizer.from_file(PATH)
    pieces = m.packed(documents(spark, TEXTS).repartition(3), PATH).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= m.WINDOW
    want = defaultdict(list)
    for i, text in TEXTS:
        want[i].append([*plain.encode(text or "", add_special_tokens=False).ids, 2])
    for i, texts in want.items():
        got = b"".join(ids for _, ids, _ in sorted(docs[i])[:: len(texts)])
        if len(texts) == 1:
            assert np.frombuffer(got, "<u4").tolist() == texts[0]
            assert {n for *_, n in docs[i]} == {len(texts[0])}
    padding = sum(m.WINDOW - sum(n for _, n in x) for x in sequences.values())
    assert padding < 3 * m.WINDOW


def test_words_are_forgotten_and_encoded_again():
    encoder, fresh = m.Encoder(PATH, remembered=5), m.Encoder(PATH)
    texts = [prose(i % 4, 9) for i in range(30)]
    assert [encoder.encode([t]) for t in texts] == [fresh.encode([t]) for t in texts]


def test_words_put_together_from_pieces_have_the_tokenizers_ids():
    plain, rng = Tokenizer.from_file(PATH), np.random.default_rng(4)
    signs = [chr(c) for c in range(256)] + [
        *"'stmdſİΣςé\u0301ﬁ日", "'s", "'LL", "<|endoftext|>", "<|", "\u0300", m._BETWEEN,
    ]
    texts = ["".join(rng.choice(signs, rng.integers(30))) for _ in range(3000)]
    texts += ["".join(rng.choice(list("abÉ'stm.,1½ "), 20)) for _ in range(3000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = m.Encoder(PATH, remembered=500)
    got = [ids for i in range(0, len(texts), 50) for ids in encoder.encode(texts[i:i + 50])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_placement_minimises_the_sum_of_squares(seed):
    draw = np.random.default_rng(seed)
    levels, n = m.Levels(20), 0
    for size in draw.integers(1, 20, 400).tolist():
        level = levels.place(size)

        def squares(at):
            counts = levels.counts.copy()
            counts[at] -= at > 0
            counts[at + size] += at + size < 20
            return (counts**2).sum()

        options = [0] + [h for h in range(1, 21 - size) if levels.counts[h]]
        assert squares(level) == min(map(squares, options))
        if level:
            levels.take(level)
        if level + size < 20:
            levels.put(level + size, n)
        n += 1


def test_empty_table(spark):
    assert m.packed(documents(spark, []), PATH).collect() == []
