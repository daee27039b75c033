"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics are worked out where the texts are read. The trees are grown on a bounded sample of
labelled rows, flattened into node arrays, and score all documents in whole arrays.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parecer.llm.storage import small_batches, written
from parecer.llm.words import BLANK_WORDS, Words, batches_of, blocks, sequence_hashes

REPEAT_WORDS = 8
FEWEST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Labelled rows that the trees are grown on, drawn by the hash of their id.
SAMPLE_ROWS = 20_000
#: Documents scored below this are rejected: only what is clearly bad goes.
LEAST_SCORE = 0.35

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_distinct", "n_upper", "n_digits", "n_bytes"]
#: What the trees see, each a ratio of counts, and how the quality may depend on it:
#: -1 never better with more, +1 never worse, 0 free.
FEATURES = {
    "words": ("n_words", None, 0),
    "symbol_share": ("n_symbols", "word_chars", -1),
    "dup_line_share": ("n_dup_lines", "n_lines", -1),
    "repeat_share": ("n_repeat_words", "n_words", -1),
    "distinct_share": ("n_distinct", "n_words", 1),
    "word_length": ("word_chars", "n_words", 0),
    "line_length": ("n_words", "n_lines", 0),
    "upper_share": ("n_upper", "n_words", 0),
    "digit_share": ("n_digits", "word_chars", 0),
}

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def repeated_words(hashes: np.ndarray, size: int) -> int:
    """Words in ``size``-word windows that occur twice or more."""
    windows = sequence_hashes(hashes, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(hashes) + 1, dtype=np.int32)
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``COUNTS`` for each text."""
    words = Words(raw, at, BLANK_WORDS, lower=False)
    hashes = words.hashes()
    data, limits = words.data, words.of_text
    n = len(at) - 1

    def total(flags):
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[words.at[1:]] - sums[words.at[:-1]]

    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    out[:, 0] = np.diff(limits)
    out[:, 1] = total(BLANK_WORDS[data] & ((data & 0xC0) != 0x80))
    out[:, 2] = total(_SYMBOLS[data])
    out[:, 7] = total(_UPPER[data])
    out[:, 8] = total(_DIGIT[data])
    out[:, 9] = np.diff(words.at)
    for t in range(n):
        own = hashes[limits[t]:limits[t + 1]]
        lines = [x for x in data[words.at[t]:words.at[t + 1]].tobytes().split(b"\n") if x.strip()]
        out[t, 3] = len(lines) - len(set(lines))
        out[t, 4] = repeated_words(own, REPEAT_WORDS)
        out[t, 5] = len(lines)
        out[t, 6] = len(np.unique(own))
    return out


def _measure(batches):
    for batch in batches:
        raw, at = batches_of(batch)
        found = [text_statistics(raw, at[i:j + 1]) for i, j in blocks(at)]
        found = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in np.ascontiguousarray(found.T))],
            names=["doc_id", *COUNTS],
        )


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every row; a null text counts as empty."""
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    columns = []
    for over, under, _ in FEATURES.values():
        x = counts[over].astype(np.float64)
        columns.append(x if under is None else x / np.maximum(counts[under], 1))
    return np.stack(columns, axis=1)


class Trees:
    """Boosted trees as flat node arrays. A node without feature (-1) holds a value; in any
    other, rows up to the threshold go to the node ``left``, the others to the one after it."""

    def __init__(self, base: float):
        self.base = base
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.value: list[float] = []
        self.depth = 0

    def node(self) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.value.append(0.0)
        return len(self.feature) - 1

    def flat(self) -> Trees:
        for name in ("feature", "threshold", "left", "value"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all rows of a level at a time."""
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                feature = self.feature[at]
                inner = feature >= 0
                right = rows[each, np.maximum(feature, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(
    rows: np.ndarray, labels: np.ndarray, signs: list[int],
    n_trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, fewest: int = 20,
    ridge: float = 1.0,
) -> Trees:
    """Newton boosting of the logistic loss on binned features. A split on a constrained
    feature must order its children's values by the sign, and bounds passed down the tree
    keep later splits from undoing the order. Without rows, or with one label, every score is
    near that label's share."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    trees = Trees(float(np.log(share / (1 - share))))
    trees.depth = depth
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0)
             for c in rows.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, rows.T)], axis=1)
    margin = np.full(len(labels), trees.base)

    def value(g, h, low, high):
        return min(max(-g / (h + ridge), low), high)

    def best_split(index, g, h, low, high):
        found = None
        for f, sign in enumerate(signs):
            n = len(edges[f]) + 1
            gs = np.cumsum(np.bincount(binned[index, f], g[index], n))[:-1]
            hs = np.cumsum(np.bincount(binned[index, f], h[index], n))[:-1]
            ns = np.cumsum(np.bincount(binned[index, f], minlength=n))[:-1]
            if not len(gs):
                continue
            gr, hr = g[index].sum() - gs, h[index].sum() - hs
            wl = np.clip(-gs / (hs + ridge), low, high)
            wr = np.clip(-gr / (hr + ridge), low, high)
            gain = -(gs * wl + (hs + ridge) * wl**2 / 2 + gr * wr + (hr + ridge) * wr**2 / 2)
            gain[(ns < fewest) | (len(index) - ns < fewest) | (sign * (wr - wl) < 0)] = -np.inf
            k = int(gain.argmax())
            if gain[k] > -np.inf and (found is None or gain[k] > found[0]):
                found = (gain[k], f, k, wl[k], wr[k])
        return found

    def build(node, index, g, h, level, low, high):
        own = value(g[index].sum(), h[index].sum(), low, high)
        split = best_split(index, g, h, low, high) if level < depth else None
        before = -(g[index].sum() * own + (h[index].sum() + ridge) * own**2 / 2)
        if split is None or split[0] <= before + 1e-6:
            trees.value[node] = rate * own
            margin[index] += rate * own
            return
        _, f, k, wl, wr = split
        trees.feature[node], trees.threshold[node] = f, float(edges[f][k])
        trees.left[node] = left = trees.node()
        right = trees.node()
        middle = (wl + wr) / 2
        bounds = {0: (low, high, low, high), 1: (low, middle, middle, high),
                  -1: (middle, high, low, middle)}[signs[f]]
        goes_left = binned[index, f] <= k
        build(left, index[goes_left], g, h, level + 1, *bounds[:2])
        build(right, index[~goes_left], g, h, level + 1, *bounds[2:])

    for _ in range(n_trees if len(labels) else 0):
        p = 1 / (1 + np.exp(-margin))
        root = trees.node()
        trees.roots.append(root)
        build(root, np.arange(len(labels)), p - labels, p * (1 - p), 0, -np.inf, np.inf)
    return trees.flat()


def labelled_sample(measured: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS):
    """Features and labels of at most ``most`` labelled rows, drawn by hash."""
    wanted = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # At most ``most`` pairs of numbers.
    found = measured.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(
        *[F.min(c).alias(c) for c in (*COUNTS, "quality")]
    ).toPandas().sort_values("doc_id")
    counts = {c: found[c].to_numpy(np.int64) for c in COUNTS}
    return features(counts), found["quality"].to_numpy(np.float64)


def _score(batches, trees: Trees):
    for batch in batches:
        counts = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COUNTS}
        scores = trees.scores(features(counts))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"]
        )


def judged(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
    least_score: float = LEAST_SCORE,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, ``COUNTS``, score, base_failed, kept.

    Too few words or too many repeated ones fail a document outright; the trees judge the
    rest. Null and empty texts have zero counts and so fail. Labels of unknown documents,
    null labels and null ids are not learnt from; a document labelled twice takes the higher
    label. Without labels every score is one half and the trees keep all. Repeated rows give
    repeated results; other columns are not read. An empty table gives none.
    """
    measured = written(statistics(documents), "statistics")
    rows, quality = labelled_sample(measured, labels, sample_rows)
    trees = grow(rows, quality, [sign for *_, sign in FEATURES.values()])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema)
    scored = measured.mapInArrow(partial(_score, trees=trees), schema + ", score double")
    failed = (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("score") >= least_score)
    )
