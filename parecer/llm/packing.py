"""Packing documents into token windows: online sum-of-squares placement.

Each task packs the documents of its partition. ``levels[f]`` counts the open windows filled
to ``f`` tokens; a document goes to the level for which the sum of the squared counts grows
least, a new window included. A document of more tokens than a window has fills whole windows
first, and only its rest is placed. What is open at the end of a partition is closed by
cutting the documents of the emptiest windows into the gaps of the fullest, so a partition
pads one window at most, however the documents arrive. Nothing is shuffled.
"""

from __future__ import annotations

import os
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from parecer.llm.storage import once_per_process, small_batches

WINDOW = 4096
END_ID = 2
#: Different words whose ids a task remembers.
REMEMBERED = 600_000
#: Bytes of ids that one batch of pieces carries.
BATCH_BYTES = 1 << 23

#: White space as Unicode defines it, and what Python takes for white space besides.
_WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_OTHER_BLANKS = re.compile("[\\x1c-\\x1f]")
#: Stands between words that are encoded together; a character for private use.
_BETWEEN = "\ue000"
#: Lower-case letters and the numbers of Latin-1; what else it has but blanks counts as signs.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: How the tokenizer splits words of Latin-1: ends of English words, letters, single numbers, signs.
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+"
)
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The vocabulary writes bytes that are no visible character as those from U+0100 on.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _plain(word: str) -> bool:
    """Whether a word is Latin-1 and holds no special token."""
    return "<|" not in word and (word.isascii() or max(word) <= "\xff")


class Encoder:
    """Token ids of texts. The tokenizer drops white space and never joins what it separates,
    and no composed character spans it, so each word is encoded once and remembered. Two
    generations of words are kept; the older one goes when the younger is full. A word of
    Latin-1 is put together from its pieces, most of which are words met before; any other
    goes through the whole tokenizer."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.remembered = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.between = self._ids(_BETWEEN)

    def _ids(self, text: str) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(encoded.ids, dtype="<u4")

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece, which as a word is itself its only piece."""
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            if not (piece.isascii() and piece.isprintable()):
                shown = piece.encode().decode("latin-1").translate(_BYTES)
            else:
                shown = piece
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        self.young[piece] = ids
        return ids

    def _encode_words(self, words: list[str]) -> None:
        others = []
        for word in words:
            if _plain(word):
                low = word.lower()
                pieces = [low] if low.isalpha() else _PIECES.findall(low)
                self.young[word] = b"".join([self._piece(p) for p in pieces])
            else:
                others.append(word)
        plain = [w for w in others if _BETWEEN not in w]
        for i in range(0, len(plain), 4096):
            part = plain[i:i + 4096]
            ids = self._ids(f" {_BETWEEN} ".join(part))
            mark = self.between
            found = np.ones(len(ids) - len(mark) + 1, dtype=bool)
            for k, x in enumerate(mark):
                found &= ids[k:len(found) + k] == x
            cuts = np.flatnonzero(found).tolist()
            starts = [0, *(c + len(mark) for c in cuts)]
            for word, a, b in zip(part, starts, [*cuts, len(ids)], strict=True):
                self.young[word] = ids[a:b].tobytes()
        for word in others:
            if _BETWEEN in word:
                self.young[word] = self._ids(word).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        # Case is dropped anyway, but for the special tokens, which are matched as written.
        texts = [t if "<|" in t else t.encode().lower().decode() for t in texts]
        split = [_WORD.findall(t) if _OTHER_BLANKS.search(t) else t.split() for t in texts]
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old, unknown = self.young, self.old, []
        for word in set().union(*split).difference(young):
            if word in old:
                young[word] = old[word]
            else:
                unknown.append(word)
        self._encode_words(unknown)
        return [b"".join(map(young.__getitem__, words)) for words in split]


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        """The level to which ``size`` tokens are added, 0 for a new window. The squares grow
        by 2 * (count at the new level - count at the old) + 2; a window that is filled up or
        opened counts at one end only. Ties go to the fullest window."""
        top = self.window - size
        grows = self.counts[size:self.window + 1] - self.counts[:top + 1]
        grows = 2 * grows + 2
        grows[0] -= 1  # a new window leaves no level
        if top >= 0:
            grows[top] = 1 - 2 * self.counts[top] if top else 0
        grows[1:][self.counts[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(grows[::-1].argmin())

    def take(self, level: int) -> int:
        self.counts[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, sequence: int) -> None:
        self.counts[level] += 1
        self.open.setdefault(level, []).append(sequence)


class Packer:
    """Pieces: (row, start, ids, all tokens, sequence, offset)."""

    def __init__(self, window: int):
        self.window, self.levels, self.next, self.held = window, Levels(window), 0, {}

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, row, ids: bytes):
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            yield row, start, ids[4 * start:4 * (start + self.window)], total, self.sequence(), 0
            start += self.window
        size = total - start
        if not size:
            return
        level = self.levels.place(size)
        sequence = self.levels.take(level) if level else self.sequence()
        pieces = self.held.setdefault(sequence, [])
        pieces.append((row, start, ids[4 * start:], total, sequence, level))
        if level + size < self.window:
            self.levels.put(level + size, sequence)
        else:
            yield from self.held.pop(sequence)

    def close(self):
        """Fills the fullest open windows with pieces of the emptiest."""
        order = sorted(self.held, key=lambda s: (-self._filled(s), s))
        loose: list[tuple] = []
        while order:
            pieces = self.held.pop(fullest := order.pop(0))
            level = self.window - self._gap(pieces)
            while level < self.window and (loose or order):
                if not loose:
                    loose = self.held.pop(order.pop())[::-1]
                row, start, ids, total, _, _ = loose.pop()
                n = min(self.window - level, len(ids) // 4)
                pieces.append((row, start, ids[:4 * n], total, fullest, level))
                level += n
                if 4 * n < len(ids):
                    loose.append((row, start + n, ids[4 * n:], total, 0, 0))
            yield from pieces
        if loose:
            sequence, level = self.sequence(), 0
            for row, start, ids, total, _, _ in reversed(loose):
                yield row, start, ids, total, sequence, level
                level += len(ids) // 4

    def _filled(self, sequence: int) -> int:
        return self.window - self._gap(self.held[sequence])

    def _gap(self, pieces) -> int:
        return self.window - sum(len(p[2]) // 4 for p in pieces)


def _pack(batches, path: str, window: int, end_id: int, kind: pa.DataType):
    part = TaskContext.get().partitionId() << 40
    end = np.array([end_id], dtype="<u4").tobytes()

    def send(pieces):
        rows, start, ids, total, sequence, offset = zip(*pieces)
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, kind), long(start), long([len(x) // 4 for x in ids]),
             pa.array(ids, pa.binary()), long(total), long([part + s for s in sequence]),
             long(offset)],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def pieces():
        encoder = once_per_process(f"encoder of {path}", lambda: Encoder(path))
        packer = Packer(window)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 64):
                for row, ids in zip(rows[i:i + 64], encoder.encode(texts[i:i + 64])):
                    yield from packer.add(row, ids + end)
        yield from packer.close()

    out, size = [], 0
    for piece in pieces():
        out.append(piece)
        size += len(piece[2])
        if size >= BATCH_BYTES:
            yield send(out)
            out, size = [], 0
    if out:
        yield send(out)


def packed(
    documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit token ids, ``start`` those of the document
    before the piece, ``offset`` those of its sequence. A document ends with ``end_id``; a
    null or empty text is that id alone. No sequence has more than ``window`` ids. Repeated
    rows are packed each by itself; doc_id may be null. Other columns are not read. An empty
    table gives no pieces. The tokenizer file is opened where the tasks run.
    """
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType
    pack = partial(_pack, path=tokenizer, window=window, end_id=end_id, kind=to_arrow_type(kind))
    return documents.select("doc_id", "text").mapInArrow(
        pack,
        f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long",
    )
