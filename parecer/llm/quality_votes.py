"""Quality by nearest neighbours: labelled documents vote in a latent semantic space.

Terms are hashed words and binned text statistics. The space is fitted on a bounded sample of
labelled documents; their vectors go to every task, where each document is compared with all
of them, a block of documents at a time, by exact cosine products.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parecer.llm.quality_rules import COUNTS, text_statistics
from parecer.llm.storage import small_batches
from parecer.llm.words import BLANK_WORDS, U, Words, batches_of, blocks

#: Labelled rows the space is fitted on and that vote, drawn by the hash of their id.
SAMPLE_ROWS = 3000
WORD_TERMS = 2048
#: Statistics as terms: how many bins each has, and the share of a vector's length they make.
BINS = 12
STATISTICS = 5
STATISTIC_WEIGHT = 0.6
TERMS = WORD_TERMS + BINS * STATISTICS
DIMENSIONS = 48
NEIGHBOURS = 25
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 4
ACCEPTED = 0.7


def term_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of term weights for each text: 1 + log of a word's count, and the bins its
    statistics fall in. A text without words is in the bins of an empty text."""
    words = Words(raw, at, BLANK_WORDS, lower=True)
    terms = (words.hashes() >> U(20)) % U(WORD_TERMS)
    limits = words.of_text
    n = len(at) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    owner = np.repeat(np.arange(n), np.diff(limits)) * WORD_TERMS + terms.astype(np.int64)
    counts = np.bincount(owner, minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
    out[:, :WORD_TERMS] = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)
    stats = dict(zip(COUNTS, text_statistics(raw, at).T))
    share = lambda a, b: stats[a] / np.maximum(stats[b], 1)
    measured = [
        np.log2(stats["n_words"] + 1) / 16,
        1 - share("n_distinct", "n_words") ** 2,
        np.sqrt(share("n_symbols", "word_chars")) * 2,
        np.sqrt(share("n_repeat_words", "n_words")),
        np.sqrt(share("n_upper", "word_chars")),
    ]
    for k, x in enumerate(measured):
        place = np.minimum((np.clip(x, 0, 1) * BINS).astype(int), BINS - 1)
        out[np.arange(n), WORD_TERMS + k * BINS + place] = 1
    return out


def weighted(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of length one: rare words weigh more, and statistics have a fixed share."""
    out = rows * rarity
    for part, size in ((slice(0, WORD_TERMS), 1 - STATISTIC_WEIGHT),
                       (slice(WORD_TERMS, TERMS), STATISTIC_WEIGHT)):
        norm = np.sqrt((out[:, part] ** 2).sum(axis=1, keepdims=True))
        out[:, part] *= np.sqrt(size) / np.maximum(norm, 1e-9)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-9)


class Voters:
    """The labelled vectors in the latent space, and the way into it."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        n = len(rows)
        self.prior = float((labels.sum() + 1) / (n + 2))
        self.labels = labels.astype(np.float32)
        seen = (rows[:, :WORD_TERMS] > 0).sum(axis=0)
        self.rarity = np.ones(TERMS, dtype=np.float32)
        self.rarity[:WORD_TERMS] = np.log((n + 1) / (seen + 1)) + 0.1
        x = weighted(rows, self.rarity).astype(np.float32)
        # Truncated singular vectors by subspace iteration from a fixed start.
        size = min(dimensions, n, TERMS)
        basis = np.random.default_rng(5).standard_normal((TERMS, size + 8 if n > size + 8 else size))
        for _ in range(4 if n else 0):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        if n:
            small = np.linalg.svd(x @ basis, full_matrices=False)[2]
            basis = basis @ small.T[:, :size]
        self.basis = basis.astype(np.float32)
        self.vectors = unit(x @ self.basis).astype(np.float32)

    def scores(self, rows: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        """The share of label 1 among the nearest voters, by similarity; the labels' overall
        share counts as one more vote of little weight, and alone if nothing is similar."""
        if not len(self.vectors):
            return np.full(len(rows), self.prior)
        own = unit(weighted(rows, self.rarity) @ self.basis)
        near = own @ self.vectors.T
        k = min(neighbours, near.shape[1])
        # Ties at the edge go to the voters that come first.
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, best, axis=1), 0, 1) ** sharpness
        votes = (weight * self.labels[best]).sum(axis=1)
        return np.clip((votes + 0.05 * self.prior) / (weight.sum(axis=1) + 0.05), 0, 1)


def _terms(batches):
    for batch in batches:
        raw, at = batches_of(batch)
        found = [term_counts(raw, at[i:j + 1]) for i, j in blocks(at)]
        packed = [row.tobytes() for part in found for row in part]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(packed, pa.binary())],
            names=["doc_id", "quality", "terms"],
        )


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; those without id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
    dimensions: int = DIMENSIONS,
) -> Voters:
    """Voters from at most ``sample_rows`` labelled documents that are not held out."""
    small_batches(documents.sparkSession)
    wanted = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # At most ``sample_rows`` pairs of numbers, and as many rows of terms.
    chosen = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(wanted), "doc_id")
        .select("doc_id", "quality", "text")
    )
    found = (
        chosen.mapInArrow(_terms, "doc_id long, quality double, terms binary")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("terms").alias("terms"))
        .toPandas().sort_values("doc_id")
    )
    rows = np.frombuffer(b"".join(map(bytes, found["terms"])), dtype=np.float32)
    return Voters(rows.reshape(-1, TERMS), found["quality"].to_numpy(np.float64), dimensions)


def _vote(batches, voters: Voters, neighbours: int, sharpness: float):
    for batch in batches:
        raw, at = batches_of(batch)
        found = [
            voters.scores(term_counts(raw, at[i:j + 1]), neighbours, sharpness)
            for i, j in blocks(at)
        ]
        scores = np.concatenate(found) if found else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"]
        )


def scored(
    documents: DataFrame, labels: DataFrame, row: Column, sample_rows: int = SAMPLE_ROWS,
    neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS,
) -> DataFrame:
    """``row`` and ``score`` of every row of ``documents``.

    Only the text makes a score. A null text is an empty one, and an empty text is voted on
    by its statistics alone. Labels of unknown documents, null labels and null ids are not
    learnt from; a document labelled twice takes the higher label. Without labels every score
    is one half. Repeated rows get equal scores. An empty table gives none.
    """
    voters = fit(documents, labels, sample_rows)
    texts = documents.select(row.alias("row"), "text")
    schema = StructType([texts.schema["row"], StructField("score", DoubleType())])
    vote = partial(_vote, voters=voters, neighbours=neighbours, sharpness=sharpness)
    return texts.mapInArrow(vote, schema)


def accepted(documents: DataFrame, labels: DataFrame, least: float = ACCEPTED, **settings):
    """The rows of ``documents`` whose score is high enough, all columns as they are."""
    columns = documents.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return (
        scored(documents, labels, row, **settings).where(F.col("score") >= least).select("row.*")
    )
