"""Runs of repeating words in texts, found by a descending-LCP Kruskal pass.

Two suffixes of a text belong to one class at level L if they share their first L words. The
classes are united by decreasing LCP of neighbours in the suffix array, each holding its
positions in order. When two classes meet at level L, positions that become neighbours at a
distance d start with the same L words and none nearer does: if L is at least
``(exponent - 1) * d``, they lie in a run of smallest period d that ends where those L words
do. The first position that says so is where the run begins, so no run is ever extended
word by word.

Only classes of at least ``LEAST_LCP`` words can start a run, so only positions whose first
words occur again in their text are sorted and united; in prose that is next to none.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parecer.llm.storage import small_batches
from parecer.llm.words import (
    BLANK_WORDS,
    U,
    Words,
    batches_of,
    blocks,
    mix,
    sequence_hashes,
)

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Shorter common beginnings belong to no run: its L is at least LEAST_WORDS - d and
#: (LEAST_EXPONENT - 1) * d for some period d.
LEAST_LCP = min(
    max(LEAST_WORDS - d, (LEAST_EXPONENT - 1) * d) for d in range(1, LEAST_WORDS + 1)
)


def _again(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions whose first ``LEAST_LCP`` words occur again in the same text."""
    windows = sequence_hashes(hashes, LEAST_LCP)
    at = np.flatnonzero(text[:len(windows)] == text[LEAST_LCP - 1:LEAST_LCP - 1 + len(windows)])
    own = windows[at] ^ mix(text[at].astype(np.uint64) + U(1))
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    order = at[order]
    found = np.zeros(len(hashes), dtype=bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return np.flatnonzero(found)


class Suffixes:
    """Order and LCP of the suffixes at some positions, by prefix doubling over word numbers.

    ``numbers`` differ from text to text, so that nothing is common across texts, and 0 stands
    after the last text. ``ranks[k]`` orders all positions by their first 2**k words: one more
    than the number of those before the class. Only classes of several positions are split.
    """

    def __init__(self, numbers: np.ndarray, positions: np.ndarray):
        n, step = len(numbers), 1
        self.ranks = [np.append(numbers, 0)]
        at = np.arange(n)
        while len(at):
            rank = self.ranks[-1]
            now = rank[at]
            order = np.lexsort((rank[np.minimum(at + step, n)], now))
            at, now = at[order], now[order]
            further = rank[np.minimum(at + step, n)]
            index = np.arange(len(at))
            old = np.concatenate(([True], now[1:] != now[:-1]))
            new = old | np.concatenate(([True], further[1:] != further[:-1]))
            first = np.maximum.accumulate(np.where(new, index, 0))
            first_old = np.maximum.accumulate(np.where(old, index, 0))
            grown = rank.copy()
            grown[at] = first + 1 if step == 1 else now + first - first_old
            self.ranks.append(grown)
            single = new & np.append(new[1:], True)
            at = at[~single]
            step *= 2
        self.order = positions[np.argsort(self.ranks[-1][positions])]

    def lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        end = len(self.ranks[0]) - 1
        for k in reversed(range(len(self.ranks))):
            rank = self.ranks[k]
            same = (rank[np.minimum(a, end)] == rank[np.minimum(b, end)]) & (a < end) & (b < end)
            out += same.astype(np.int64) << k
            a += same.astype(np.int64) << k
            b += same.astype(np.int64) << k
        return out


def seeds(a: list[int], b: list[int], lcp: list[int]) -> list[tuple[int, int, int]]:
    """(position, distance, LCP) of positions that become neighbours in their class with an
    LCP of at least ``LEAST_EXPONENT - 1`` times their distance, as the pairs a, b are united
    in the given order."""
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []
    times = LEAST_EXPONENT - 1

    def top(x: int) -> int:
        way = []
        while (up := root.get(x, x)) != x:
            way.append(x)
            x = up
        for y in way:
            root[y] = x
        return x

    for x, y, level in zip(a, b, lcp):
        x, y = top(x), top(y)
        large, small = members.pop(x, None) or [x], members.pop(y, None) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        reach = level // times
        if len(small) * 8 < len(large):
            # Where each goes; of those that go to one place, the outer two meet the others.
            places = [bisect_left(large, p) for p in small]
            for k, (p, i) in enumerate(zip(small, places)):
                if i and (not k or places[k - 1] != i) and p - large[i - 1] <= reach:
                    found.append((large[i - 1], p - large[i - 1], level))
                last = k + 1 == len(small) or places[k + 1] != i
                if last and i < len(large) and large[i] - p <= reach:
                    found.append((p, large[i] - p, level))
            for p, i in zip(reversed(small), reversed(places)):
                large.insert(i, p)
        else:
            own = set(small)
            large = sorted(large + small)
            last, last_own = large[0], large[0] in own
            for p in large[1:]:
                now_own = p in own
                if now_own != last_own and p - last <= reach:
                    found.append((last, p - last, level))
                last, last_own = p, now_own
        root[y] = x
        members[x] = large
    return found


def runs_of(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in consecutive texts, by start and period;
    ``text`` numbers each word's text and starts are word numbers across texts."""
    none = np.zeros((0, 3), dtype=np.int64)
    positions = _again(hashes, text)
    if not len(positions):
        return none
    # Texts without such positions are left out.
    live = np.zeros(int(text[-1]) + 2, dtype=bool)
    live[text[positions]] = True
    kept = np.flatnonzero(live[text])
    shift = np.zeros(len(hashes), dtype=np.int64)
    shift[kept] = np.arange(len(kept))
    _, numbers = np.unique(hashes[kept], return_inverse=True)
    first = np.ones(len(kept), dtype=np.int64)
    first[1:] = text[kept[1:]] != text[kept[:-1]]
    wide = np.int64(numbers.max() + 1)
    suffixes = Suffixes(numbers + 1 + (np.cumsum(first) - 1) * wide, shift[positions])
    a, b = suffixes.order[:-1], suffixes.order[1:]
    lcp = suffixes.lcp(a, b)
    order = np.argsort(-lcp, kind="stable")
    order = order[:int((lcp >= LEAST_LCP).sum())]
    found = seeds(a[order].tolist(), b[order].tolist(), lcp[order].tolist())
    if not found:
        return none
    start, period, level = np.array(found, dtype=np.int64).T
    end = start + period + level
    ok = (level >= (LEAST_EXPONENT - 1) * period) & (end - start >= LEAST_WORDS)
    start, period, end = start[ok], period[ok], end[ok]
    # One run for each period and end; it begins at the first position that found it.
    order = np.lexsort((start, period, end))
    start, period, end = start[order], period[order], end[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (period[1:] != period[:-1]) | (end[1:] != end[:-1])
    start, period, end = start[new], period[new], end[new]
    order = np.lexsort((period, start))
    start, period, end = start[order], period[order], end[order]
    return np.stack((kept[start], end - start, period), axis=1)


def collapsed(words: Words, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of the texts without the words after the first period of a run, one
    space between words."""
    n = len(words.starts)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:n]) == 0
    # A kept word takes its bytes and the next one, which is made a space, but for the last
    # word of its text.
    upto = np.concatenate(([0], np.cumsum(kept)))
    spaced = kept & (upto[1:] < upto[words.of_text[1:]][_text_of(words)])
    starts, ends = words.starts[kept], words.ends[kept]
    mask = np.zeros(len(words.data) + 2, dtype=np.int8)
    mask[starts] += 1
    mask[ends + spaced[kept]] -= 1
    data = np.append(words.data, np.uint8(32))
    data[words.ends[spaced]] = 32
    taken = np.cumsum(mask[:len(data)], dtype=np.int8) > 0
    before = np.concatenate(([0], np.cumsum(taken)))
    return data[taken], before[words.at]


def _text_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.of_text) - 1), np.diff(words.of_text))


def _list_of(limits: np.ndarray, runs: np.ndarray) -> pa.Array:
    fields = [pa.array(np.ascontiguousarray(c)) for c in runs.T]
    struct = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), struct)


def _find(batches):
    names = ["doc_id", "n_words", "runs", "collapsed"]
    for batch in batches:
        raw, at = batches_of(batch)
        ids = batch.column(0)
        for i, j in blocks(at):
            words = Words(raw, at[i:j + 1], BLANK_WORDS, lower=False)
            text = _text_of(words)
            runs = runs_of(words.hashes(), text) if len(text) else np.zeros((0, 3), np.int64)
            data, limits = collapsed(words, runs)
            of_run = np.searchsorted(runs[:, 0], words.of_text)
            own = runs.copy()
            own[:, 0] -= words.of_text[:-1][text[runs[:, 0]]] if len(runs) else 0
            left = pa.Array.from_buffers(
                pa.large_string(), j - i,
                [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(data)],
            )
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(np.diff(words.of_text).astype(np.int64)),
                 _list_of(of_run, own), left.cast(pa.string())],
                names=names,
            )


def periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, runs, collapsed.

    A run is a stretch of consecutive words with smallest period q, at least ``LEAST_WORDS``
    and ``LEAST_EXPONENT * q`` long, that no neighbouring word extends; ``runs`` lists start
    (word number), length and period, by start and period. ``collapsed`` has the words that no
    run holds after its first q words, joined by one space.

    Words end at ASCII white space and are told apart by 64-bit hashes. A null or empty text
    has no words and no runs. Repeated rows are worked on each by itself; doc_id may be null.
    Other columns are not read. An empty table gives none.

    A block of texts, or one longer text, is held at once, with one class number for each word
    and doubling of the longest repeat: about 8 * log2(words) bytes a word for a text that
    repeats throughout, and next to nothing for one that does not.
    """
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType
    return documents.select("doc_id", "text").mapInArrow(
        _find,
        f"doc_id {kind.simpleString()}, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )
