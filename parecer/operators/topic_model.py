"""Online variational LDA over documents that are dealt once into stored mini-batches.

A stored row is a shard of documents, with one packed column for each mini-batch. In the first
pass every update reads its column of all shards, and nothing else, and the shards' sums make
one new matrix. By then all shards agree on what each topic is about; in a later pass each
shard makes the updates of all its mini-batches by itself, and the matrices they end with are
averaged by their documents. So a fit reads the corpus once per pass, and needs a job per
mini-batch and then one per pass, whatever the size of the corpus.

Tasks work on whole mini-batches in numpy and send one row per word, which Spark sums. On the
driver are the word list and the topic matrix, at most words × topics numbers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parecer.session import scratch_path

# Functions sent to executors carry their code along, so executors need no copy of this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of a mini-batch in a shard that is full.
BATCH_DOCS = 512
#: Steps of a document's variational update, and the mean change below which a block is done.
STEPS, TOLERANCE = 100, 1e-3
#: Steps when documents are assigned to topics of a given matrix; always as many.
FOLD_IN_STEPS = 20
#: The digamma function's series is used from here on.
DIGAMMA_SHIFT = 6


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function for x > 0, by its series far from 0."""
    y = x + DIGAMMA_SHIFT
    out = np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    for i in range(DIGAMMA_SHIFT):
        out = out - 1 / (x + i)
    return out


def word_weights(matrix: np.ndarray) -> np.ndarray:
    """exp of the expected logarithm of each topic's word probabilities (topics × words)."""
    return np.exp(digamma(matrix) - digamma(matrix.sum(axis=1, keepdims=True)))


def encode(terms: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words per document, their numbers and counts, of a column of term lists;
    terms outside the word list are left out, a null list is empty."""
    n = len(terms)
    of_doc = pc.list_parent_indices(terms).to_numpy()
    ids = pc.index_in(pc.list_flatten(terms), value_set=words)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    pair = of_doc[known].astype(np.int64) * len(words) + ids.drop_null().to_numpy()
    pair, counts = np.unique(pair, return_counts=True)
    sizes = np.bincount(pair // len(words), minlength=n)
    return sizes.astype(np.int32), (pair % len(words)).astype(np.int32), counts.astype(np.int32)


class Block:
    """Documents as arrays: words per document, word numbers, counts."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts.astype(np.float64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.some = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.some]
        self.n = len(sizes)

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        x = np.frombuffer(data, dtype=np.int32)
        sizes = x[1:1 + x[0]]
        return cls(sizes, *np.split(x[1 + x[0]:], 2))

    def per_doc(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, rows.shape[1]))
        if len(self.some):
            out[self.some] = np.add.reduceat(rows, self.starts, axis=0)
        return out

    def infer(
        self, weights: np.ndarray, prior: float, steps: int, tolerance: float = 0.0
    ) -> tuple[np.ndarray, np.ndarray]:
        """Each document's topic parameters after so many steps from an even start, and the
        words' counts over their normalizers at the last step."""
        own = weights.T[self.ids]
        even = self.per_doc(self.counts[:, None]) / weights.shape[0]
        topics = np.full((self.n, weights.shape[0]), prior) + even
        while True:
            mood = np.exp(digamma(topics))
            share = self.counts / np.maximum((mood[self.doc] * own).sum(axis=1), 1e-300)
            if steps == 0:
                return topics, mood[self.doc] * share[:, None]
            before, steps = topics, steps - 1
            topics = prior + mood * self.per_doc(share[:, None] * own)
            if tolerance and np.abs(topics - before).mean(axis=1).max(initial=0) < tolerance:
                steps = 0


def _shards(batches: Iterator[pa.RecordBatch], words: list[str], parts: int, batch_docs: int):
    """Documents dealt in turn to the mini-batches of a shard, by where they stand in their
    task."""
    vocabulary = pa.array(words, pa.string())
    held: list[list[tuple]] = [[] for _ in range(parts)]
    n = np.zeros(parts, dtype=np.int64)

    def row() -> pa.RecordBatch:
        packed = []
        for k, own in enumerate(held):
            arrays = [np.concatenate(x) for x in zip(*own)] if own else []
            packed.append(np.concatenate([[n[k]], *arrays]).astype(np.int32).tobytes())
            own.clear()
        names = [f"n{k}" for k in range(parts)] + [f"b{k}" for k in range(parts)]
        arrays = [pa.array([int(x)], pa.int64()) for x in n]
        arrays += [pa.array([x], pa.binary()) for x in packed]
        n[:] = 0
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        sizes, ids, counts = encode(batch.column(0), vocabulary)
        own = (int(n.sum()) + np.arange(len(sizes))) % parts
        of_word = np.repeat(own, sizes)
        for k in range(parts):
            mine = own == k
            held[k].append((sizes[mine], ids[of_word == k], counts[of_word == k]))
            n[k] += int(mine.sum())
        if n.sum() >= parts * batch_docs:
            yield row()
    if n.any():
        yield row()


def stored_shards(
    docs: DataFrame, words: Sequence[str], parts: int, batch_docs: int = BATCH_DOCS
) -> DataFrame:
    """The documents' ``terms`` as a table of shards: the number of documents and the packed
    documents of each of ``parts`` mini-batches (``n0``, ..., ``b0``, ...).

    Documents are brought together by size and dealt in turn, so neither equal documents nor
    small input files make a mini-batch larger or smaller than the others.
    """
    schema = [f"n{k} long" for k in range(parts)] + [f"b{k} binary" for k in range(parts)]
    deal = partial(_shards, words=list(words), parts=parts, batch_docs=batch_docs)
    path = scratch_path(docs.sparkSession, "shards")
    docs.select("terms").hint("rebalance").mapInArrow(deal, ", ".join(schema)).write.parquet(path)
    return docs.sparkSession.read.schema(", ".join(schema)).parquet(path)


def _rows(total: np.ndarray) -> pa.RecordBatch:
    """A row per word that has anything (topics × words)."""
    some = np.flatnonzero(total.any(axis=0))
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int64()), *(pa.array(t[some]) for t in total)],
        names=["word", *(f"t{t}" for t in range(len(total)))],
    )


def _counted(block: Block, weights: np.ndarray, prior: float) -> np.ndarray:
    """Expected counts of words by topic over a block's documents (topics × words)."""
    _, share = block.infer(weights, prior, STEPS, TOLERANCE)
    n_words = weights.shape[1]
    return weights * np.stack(
        [np.bincount(block.ids, x, minlength=n_words) for x in share.T]
    )


def _one_batch(batches: Iterator[pa.RecordBatch], weights: np.ndarray, prior: float):
    total = np.zeros(weights.shape)
    for batch in batches:
        for data in batch.column(0):
            total += _counted(Block.unpacked(data.as_py()), weights, prior)
    yield _rows(total)


def moved(matrix: np.ndarray, found: np.ndarray, share: float, rate: float) -> np.ndarray:
    """The matrix after one update: toward what its mini-batch, ``share`` of all documents,
    would give if all were like it."""
    return (1 - rate) * matrix + rate * (1 / len(matrix) + found / share)


def _own_pass(
    batches: Iterator[pa.RecordBatch], matrix: np.ndarray, rates: list[float], n_docs: int
):
    """The matrices of a task's shards after a pass over their own mini-batches, times their
    documents."""
    total = np.zeros(matrix.shape)
    for batch in batches:
        for i in range(batch.num_rows):
            now, n_shard = matrix, 0
            for k, rate in enumerate(rates):
                block = Block.unpacked(batch.column(k)[i].as_py())
                if block.n:
                    found = _counted(block, word_weights(now), 1 / len(now))
                    now, n_shard = moved(now, found, block.n / n_docs, rate), n_shard + block.n
            total += n_shard * now
    yield _rows(total)


def _summed(table: DataFrame, work, k: int, n_words: int) -> np.ndarray:
    """What the tasks give for each word, summed by Spark: a row per word comes back."""
    names = [f"t{t}" for t in range(k)]
    found = (
        table.mapInArrow(work, "word long, " + ", ".join(f"{c} double" for c in names))
        .groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
        .toArrow()
    )
    out = np.zeros((k, n_words))
    out[:, found["word"].to_numpy()] = np.stack([found[c].to_numpy() for c in names])
    return out


def learn(
    shards: DataFrame, parts: int, n_words: int, k: int, passes: int, seed: int,
    offset: float, decay: float,
) -> np.ndarray:
    """The topic matrix (topics × words) after ``passes`` over the mini-batches in turn;
    update u moves it by the rate ``(offset + u) ** -decay``."""
    matrix = np.random.default_rng(seed).gamma(100.0, 0.01, (k, n_words))
    rates = [(offset + u) ** -decay for u in range(1, passes * parts + 1)]
    sizes = shards.agg(*[F.sum(f"n{b}") for b in range(parts)]).first()
    n_docs = sum(sizes)
    for b in range(parts if passes else 0):
        if sizes[b]:
            work = partial(_one_batch, weights=word_weights(matrix), prior=1 / k)
            found = _summed(shards.select(f"b{b}"), work, k, n_words)
            matrix = moved(matrix, found, sizes[b] / n_docs, rates[b])
    columns = shards.select(*[f"b{b}" for b in range(parts)])
    for done in range(1, passes):
        own = rates[done * parts:(done + 1) * parts]
        work = partial(_own_pass, matrix=matrix, rates=own, n_docs=n_docs)
        matrix = _summed(columns, work, k, n_words) / n_docs
    return matrix


def _assign(batches: Iterator[pa.RecordBatch], words: list[str], weights, prior, steps):
    vocabulary = pa.array(words, pa.string())
    for batch in batches:
        terms = batch.column(batch.schema.get_field_index("terms"))
        topics, _ = Block(*encode(terms, vocabulary)).infer(weights, prior, steps)
        # The first topic that is not below another but for rounding.
        best = (topics >= topics.max(axis=1, initial=0, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(best + 1, pa.int32())], names=[*batch.schema.names, "topic"]
        )


def fold_in(
    docs: DataFrame, words: Sequence[str], matrix: np.ndarray, steps: int = FOLD_IN_STEPS
) -> DataFrame:
    """Adds ``topic``, the heaviest topic of each document's ``terms`` under a given matrix,
    after a fixed number of steps from an even start; the first one on ties, and for a
    document without any of the words. Documents stay where they are."""
    if "topic" in docs.columns:
        raise ValueError("the documents have a column named topic")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    assign = partial(
        _assign, words=list(words), weights=word_weights(matrix), prior=1.0 / len(matrix),
        steps=steps,
    )
    return docs.mapInArrow(assign, f"{columns}, topic int")


def matrix_rows(
    spark: SparkSession, words: Sequence[str], matrix: np.ndarray, n_words: int
) -> DataFrame:
    """The heaviest words of each topic: topic, rank, word, weight, prob."""
    rows = []
    for topic, weights in enumerate(matrix):
        best = sorted(range(len(words)), key=lambda i: (-weights[i], words[i]))[:n_words]
        rows += [
            (topic + 1, rank + 1, words[i], float(weights[i]), float(weights[i] / weights.sum()))
            for rank, i in enumerate(best)
        ]
    return spark.createDataFrame(
        rows, "topic int, rank int, word string, weight double, prob double"
    )
