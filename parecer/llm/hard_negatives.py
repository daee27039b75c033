"""Hard negatives of anchors, searched exactly through an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted on a bounded sample; a row's cell
is its nearest codeword in either half. The index is a table of shards, each holding its rows
ordered by cell and, for each codeword, the radius of its rows' halves. An anchor visits the
cells of a shard by a multi-sequence heap: by decreasing sum of the two halves' bounds, each
the product with the codeword and the radius times the anchor's length. It stops when what it
has found is above every bound left, so the result is that of scoring all rows.

Anchors go out in passes of at most ``PASS_BYTES``, whatever their number; a pass first finds
the positives of its anchors and then the negatives in the windows that those give.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parecer.llm.storage import small_batches, written
from parecer.session import scratch_path

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's score lies.
LOWEST, HIGHEST = 30, 90
SCALE = 256
#: Larger components count as this, so that a product of 8,192 of them is a 64-bit integer.
MOST = 1 << 25
#: Rows that the codebooks are fitted on, those with the smallest hash of vec_id.
SAMPLE_ROWS = 4096
CODEWORDS, ROUNDS = 16, 8
SHARD_BYTES = 1 << 22
PASS_BYTES = 1 << 23
#: Rows scored before the first test whether to stop; twice as many before the next.
FIRST_ROWS = 128
#: Stands for a missing vec_id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row``, ``vec_id``, ``label`` and whole-number components ``v`` of the rows that take
    part: those with a label and a vector of finite components."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(
        x,
        lambda c: F.greatest(
            F.least(F.floor(c.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)
        ).cast("int"),
    )
    return vectors.where(F.col("label").isNotNull() & x.isNotNull() & ~odd).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"),
        F.col("label").cast("long"), whole.alias("v"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.arange(dim) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _ids(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


def codebook(points: np.ndarray, size: int = CODEWORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the points by Lloyd's rounds from the first distinct ones."""
    points = points.astype(np.float64)
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:size]]
    for _ in range(rounds):
        near = nearest(points, centres)
        for k in range(len(centres)):
            own = points[near == k]
            if len(own):
                centres[k] = own.mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (centres**2).sum(axis=1) - 2 * points.astype(np.float64) @ centres.T
    return far.argmin(axis=1)


class Shard:
    """Rows in the order of their cells."""

    def __init__(self, ids, labels, rows, matrix, codebooks):
        half = codebooks[0].shape[1]
        halves = (matrix[:, :half], matrix[:, half:])
        near = [nearest(x, c) for x, c in zip(halves, codebooks)]
        cell = near[0] * len(codebooks[1]) + near[1]
        order = np.argsort(cell, kind="stable")
        cells = len(codebooks[0]) * len(codebooks[1])
        self.limits = np.searchsorted(cell[order], np.arange(cells + 1)).astype(np.int64)
        self.radii = []
        for x, c, own in zip(halves, codebooks, near):
            far = np.sqrt(((x - c[own]) ** 2).sum(axis=1))
            radius = np.full(len(c), -1.0)  # no rows
            np.maximum.at(radius, own, far)
            self.radii.append(radius)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.matrix = matrix[order]

    FIELDS = {"ids": np.int64, "labels": np.int64, "rows": np.int64, "limits": np.int64,
              "first_radii": np.float64, "second_radii": np.float64, "matrix": np.int32}

    def packed(self) -> list[bytes]:
        parts = [self.ids, self.labels, self.rows, self.limits, *self.radii, self.matrix]
        return [
            np.ascontiguousarray(x, dtype=t).tobytes() for x, t in zip(parts, self.FIELDS.values())
        ]

    @classmethod
    def unpacked(cls, batch: pa.RecordBatch, i: int) -> Shard:
        self = cls.__new__(cls)
        parts = [
            np.frombuffer(batch.column(k)[i].as_py(), dtype=t)
            for k, t in enumerate(cls.FIELDS.values())
        ]
        self.ids, self.labels, self.rows, self.limits, *self.radii, matrix = parts
        self.matrix = matrix.reshape(len(self.ids), -1).astype(np.int64)
        return self

    def bounds(self, anchors: np.ndarray, codebooks) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half what the products with a codeword's rows are at least and at most."""
        half = codebooks[0].shape[1]
        out = []
        for x, c, radius in zip((anchors[:, :half], anchors[:, half:]), codebooks, self.radii):
            x = x.astype(np.float64)
            middle = x @ c.T
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            reach = length * np.maximum(radius, 0)
            # What rounding of the sums may add.
            reach += 1 + 1e-9 * length * (np.sqrt((c**2).sum(axis=1)) + np.maximum(radius, 0))
            middle[:, radius < 0] = -np.inf
            out.append((middle - reach, middle + reach))
        return out

    def exact(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and anchors as doubles where those hold every score."""
        if len(self.matrix) and len(anchors):
            most = float(np.abs(self.matrix).max()) * float(np.abs(anchors).max())
            if most * self.matrix.shape[1] < 2**53:
                return self.matrix.astype(np.float64), anchors.astype(np.float64)
        return self.matrix, anchors


def by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
    """(bound, cell) by decreasing sum of the halves' bounds; codewords without rows never."""
    a = np.argsort(-first, kind="stable")[:int((first > -np.inf).sum())]
    b = np.argsort(-second, kind="stable")[:int((second > -np.inf).sum())]
    if not len(a) or not len(b):
        return
    x, y = first[a].tolist(), second[b].tolist()
    a, b, width = a.tolist(), b.tolist(), len(second)
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i] * width + b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k places by falling score, then rising id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Search:
    """What one anchor has found: the first ``k`` in each window of scores (low, high)."""

    def __init__(self, label: int, row: int, same: bool, windows: list[tuple[int, int]], k: int):
        self.label, self.row, self.same, self.windows, self.k = label, row, same, windows, k
        self.low = min(low for low, _ in windows)
        self.high = max(high for _, high in windows)
        self.scores = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)
        self.scored = 0

    def in_window(self, low: int, high: int) -> np.ndarray:
        return np.flatnonzero((self.scores >= low) & (self.scores <= high))

    def keep_best(self) -> None:
        kept = [
            at[best(self.scores[at], self.ids[at], self.k)]
            for at in (self.in_window(*w) for w in self.windows)
        ]
        kept = np.unique(np.concatenate(kept))
        self.scores, self.ids = self.scores[kept], self.ids[kept]

    def certain(self, bound: float) -> bool:
        """Whether no score up to the bound changes any window."""
        for low, high in self.windows:
            if bound < low:
                continue
            at = self.in_window(low, high)
            if len(at) < self.k:
                return False
            if np.partition(self.scores[at], len(at) - self.k)[len(at) - self.k] <= bound:
                return False
        return True

    def add(self, shard: Shard, cells: list[tuple[int, int]], matrix, anchor) -> None:
        at = np.concatenate([np.arange(i, j) for i, j in cells])
        scores = np.concatenate([matrix[i:j] @ anchor for i, j in cells]).astype(np.int64)
        self.scored += len(at)
        fits = (scores >= self.low) & (scores <= self.high)
        at, scores = at[fits], scores[fits]
        labels = shard.labels[at]
        fits = (labels == self.label) & (shard.rows[at] != self.row) if self.same else (
            labels != self.label
        )
        self.scores = np.concatenate((self.scores, scores[fits]))
        self.ids = np.concatenate((self.ids, shard.ids[at[fits]]))

    def visit(self, shard: Shard, matrix, anchor, bounds) -> None:
        (low1, high1), (low2, high2) = bounds
        width, limits = len(high2), shard.limits
        cells, n, enough = [], 0, FIRST_ROWS
        for bound, cell in by_bound(high1, high2):
            if n >= enough or bound < self.low:
                if cells:
                    self.add(shard, cells, matrix, anchor)
                    cells, n, enough = [], 0, 2 * enough
                if self.certain(bound):
                    break
            i, j = int(limits[cell]), int(limits[cell + 1])
            if i < j and low1[cell // width] + low2[cell % width] <= self.high:
                cells.append((i, j))
                n += j - i
        if cells:
            self.add(shard, cells, matrix, anchor)
        self.keep_best()


def _build(batches, codebooks, dim: int, shard_rows: int):
    held: list[tuple] = []
    n = 0

    def shard():
        made = Shard(*(np.concatenate(x) for x in zip(*held)), codebooks)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in made.packed()], names=list(Shard.FIELDS)
        )

    for batch in batches:
        for i in range(0, batch.num_rows, shard_rows):
            part = batch.slice(i, shard_rows)
            held.append((_ids(part["vec_id"]), part["label"].to_numpy(), part["row"].to_numpy(),
                         _matrix(part["v"], dim)))
            n += part.num_rows
            if n >= shard_rows:
                yield shard()
                held, n = [], 0
    if held:
        yield shard()


#: Every score.
ANY = (-(2**62), 2**62)


def _searches(batches, sent, codebooks, same: bool, k: int) -> list[Search]:
    """The anchors of a pass after all shards of a task."""
    ids, labels, rows, matrix, windows = sent.value
    found = [
        Search(label, row, same, windows[i], k) if windows[i] else None
        for i, (label, row) in enumerate(zip(labels.tolist(), rows.tolist()))
    ]
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard.unpacked(batch, i)
            x, anchors = shard.exact(matrix)
            (low1, high1), (low2, high2) = shard.bounds(matrix, codebooks)
            for a, search in enumerate(found):
                if search:
                    bounds = ((low1[a], high1[a]), (low2[a], high2[a]))
                    search.visit(shard, x, anchors[a], bounds)
    return found


def _find(batches, sent, codebooks, same: bool, k: int):
    """(anchor, window, score, id) of the first k in each window, of the rows of one task."""
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    for a, search in enumerate(_searches(batches, sent, codebooks, same, k)):
        if search is None:
            continue
        for w, (low, high) in enumerate(search.windows):
            at = search.in_window(low, high)
            at = at[best(search.scores[at], search.ids[at], k)]
            for column, x in zip(
                out, (np.full(len(at), a), np.full(len(at), w), search.scores[at], search.ids[at])
            ):
                column.append(x)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x).astype(np.int64)) for x in out],
        names=["anchor", "window", "score", "id"],
    )


def _first(index: DataFrame, sent, codebooks, same: bool, k: int) -> DataFrame:
    """The first k of every anchor and window over all tasks, as ``rank`` from 1, ``score``
    and ``id``. A task sends k rows at most for each."""
    found = index.mapInArrow(
        partial(_find, sent=sent, codebooks=codebooks, same=same, k=k),
        "anchor long, window long, score long, id long",
    )
    order = F.struct((-F.col("score")).alias("minus"), "id")
    return (
        found.groupBy("anchor", "window")
        .agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
        .select("anchor", "window", F.posexplode("best").alias("place", "x"))
        .select("anchor", "window", (F.col("place") + 1).alias("rank"),
                (-F.col("x.minus")).alias("score"), F.col("x.id").alias("id"))
    )


def _windows(positives: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    return [(-(-low * score // 100), high * score // 100) for score, _ in positives]


def _pass(
    spark: SparkSession, index: DataFrame, anchors: pa.Table, codebooks, dim: int,
    positives: int, negatives: int, low: int, high: int, path: str,
) -> None:
    ids = _ids(anchors["vec_id"].combine_chunks())
    fields = [ids, anchors["label"].to_numpy(), anchors["row"].to_numpy(),
              _matrix(anchors["v"], dim)]
    sent = spark.sparkContext.broadcast((*fields, [[ANY]] * len(ids)))
    found: list[list[tuple[int, int]]] = [[] for _ in ids]
    # At most ``positives`` numbers for each anchor of the pass.
    for r in _first(index, sent, codebooks, True, positives).orderBy("anchor", "rank").collect():
        found[r["anchor"]].append((r["score"], r["id"]))
    sent.unpersist()
    sent = spark.sparkContext.broadcast((*fields, [_windows(x, low, high) for x in found]))
    pairs = [
        (a, w, int(ids[a]), None if i == NO_ID else i, score)
        for a, own in enumerate(found) for w, (score, i) in enumerate(own)
    ]
    told = spark.createDataFrame(
        pairs, "anchor long, window long, anchor_id long, positive_id long, positive_score long"
    )
    _first(index, sent, codebooks, False, negatives).join(told, ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank",
        F.when(F.col("id") != int(NO_ID), F.col("id")).alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    ).write.mode("append").parquet(path)
    sent.unpersist()


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOWEST, high: int = HIGHEST, scale: int = SCALE,
    pass_bytes: int = PASS_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` is over vec_id, and rows without
    vec_id are never anchors. Components become ``floor(scale * x)``, and a score is the
    integer product of two rows. An anchor's positives are the first ``positives`` other rows
    of its label; for each the first ``negatives`` rows of other labels are returned whose
    score is ``low`` to ``high`` percent of the positive's, by falling score and then rising
    vec_id, rows without vec_id last. Where a score is negative there are none.

    Rows with a null label or vector, or with a null or non-finite component, take no part. A
    shorter vector counts as filled up with zeros, and components beyond ``MOST`` as that.
    Repeated rows count each: one may be the other's positive. Ties between rows of one vec_id
    give the same output whichever is first. Other columns are not read. An empty table, or one
    without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(usable(vectors, scale), "vectors")
    chosen = rows.where(F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull())
    dim = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 2)
    n_passes = -(-chosen.count() // max(pass_bytes // (8 * dim), 1))
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    if n_passes:
        sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
        points = _matrix(sample.toArrow()["v"], dim)
        codebooks = [codebook(x) for x in (points[:, :dim // 2], points[:, dim // 2:])]
        build = partial(
            _build, codebooks=codebooks, dim=dim, shard_rows=max(shard_bytes // (4 * dim), 1)
        )
        fields = ", ".join(f"{f} binary" for f in Shard.FIELDS)
        index = written(rows.mapInArrow(build, fields), "index")
        number = F.pmod(F.xxhash64("row"), F.lit(n_passes))
        for k in range(n_passes):
            anchors = chosen.where(number == k).toArrow()
            if anchors.num_rows:
                _pass(spark, index, anchors, codebooks, dim, positives, negatives, low, high, path)
    return spark.read.schema(RESULT).parquet(path)
