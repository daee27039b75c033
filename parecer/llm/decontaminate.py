"""Benchmark passages in documents: an FM-index per shard, searched for every test phrase.

A task turns its documents into shards of word numbers and indexes each: suffix array,
Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. All phrases are
searched backward at once, occurrences are located by walking to the next sampled position,
and the words they cover are merged into spans. Word numbers are those of the benchmark's
vocabulary; a run of such words shorter than the shortest phrase can hold none and is left
out of the index. Documents are never shuffled.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parecer.llm.storage import small_batches, written
from parecer.llm.words import PLAIN_WORDS, U, Words, batches_of, blocks, text_bytes

WINDOW = 10
#: Words of one index.
SHARD_WORDS = 1 << 18
#: Every so many positions of the text one suffix position is kept.
SAMPLE = 16
#: Bytes of benchmark texts searched for in one pass; a larger benchmark takes more passes.
PASS_BYTES = 1 << 25


class Phrases:
    """The distinct windows of benchmark items as rows of word numbers, padded on the left.

    Words are numbered from 2; 1 separates runs and 0 ends an index.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        raw, at = text_bytes(pa.array([text for _, text in items], pa.string()))
        words = Words(raw, at, PLAIN_WORDS, lower=True)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes) + 2
        found: dict[tuple, set[str]] = {}
        for (item, _), a, b in zip(items, words.of_text[:-1], words.of_text[1:]):
            for i in range(a, max(b - window, a if b > a else a - 1) + 1):
                found.setdefault(tuple(numbers[i:min(i + window, b)].tolist()), set()).add(item)
        self.items = list(found.values())
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.rows = np.zeros((len(found), window), dtype=np.int64)
        for k, phrase in enumerate(found):
            self.rows[k, window - len(phrase):] = phrase
        self.shortest = int(self.lengths.min()) if len(found) else 0
        # A quick test on 20 bits of a hash spares most words the search.
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.vocabulary >> U(44)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, 0 for words of no item."""
        out = np.zeros(len(hashes), dtype=np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> U(44)).astype(np.int64)])
        if len(some):
            at = np.searchsorted(self.vocabulary, hashes[some])
            at[at == len(self.vocabulary)] = 0
            out[some] = np.where(self.vocabulary[at] == hashes[some], at + 2, 0)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text that ends in its only 0, by prefix doubling."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        keys = rank * np.int64(n + 1)
        keys[:-step] += rank[step:] + 1
        order = np.argsort(keys, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        rank[order] = np.cumsum(new)
        if step >= n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class Index:
    """An FM-index of a text of word numbers that ends in its only 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        self.last = text[order - 1]
        n_symbols = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.levels = []
        now = self.last
        for bit in reversed(range(n_symbols.bit_length())):
            ones = (now >> bit) & 1
            rank = np.concatenate(([0], np.cumsum(ones)))
            self.levels.append((bit, rank, len(now) - rank[-1]))
            now = np.concatenate((now[ones == 0], now[ones == 1]))
        self.place = np.where(order % sample == 0, order, -1)

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before a row."""
        a, b = np.zeros_like(upto), upto
        for bit, rank, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            a = np.where(one, zeros + rank[a], a - rank[a])
            b = np.where(one, zeros + rank[b], b - rank[b])
        return b - a

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each phrase, as half-open ranges."""
        low = np.zeros(len(phrases.rows), dtype=np.int64)
        high = np.full(len(phrases.rows), len(self.last), dtype=np.int64)
        live = np.arange(len(low))
        for k in reversed(range(phrases.rows.shape[1])):
            live = live[(high[live] > low[live])]
            symbols = phrases.rows[live, k]
            inside = (symbols > 0) & (symbols < len(self.before) - 1)
            gone = live[(symbols > 0) & ~inside]
            high[gone] = low[gone]
            on, symbols = live[inside], symbols[inside]
            low[on] = self.before[symbols] + self.rank(symbols, low[on])
            high[on] = self.before[symbols] + self.rank(symbols, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of some rows begin."""
        out, steps, open_ones = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_ones):
            known = self.place[rows]
            done = known >= 0
            out[open_ones[done]] = known[done] + steps
            open_ones, rows = open_ones[~done], rows[~done]
            symbols = self.last[rows]
            rows = self.before[symbols] + self.rank(symbols, rows)
            steps += 1
        return out


def _runs(numbers: np.ndarray, limits: np.ndarray, shortest: int):
    """Runs of known words, within one text and long enough: starts and ends."""
    known = np.concatenate(([False], numbers > 0, [False]))
    starts = known[1:-1] & ~known[:-2]
    ends = known[1:-1] & ~known[2:]
    edges = limits[1:-1]
    edges = edges[(edges > 0) & (edges < len(numbers))]
    starts[edges] = known[1:-1][edges]
    ends[edges - 1] = known[1:-1][edges - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    keep = b - a >= shortest
    return a[keep], b[keep]


class Shard:
    """Documents of a task until their index is built and searched."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.runs, self.size = phrases, [], [], 0

    def add(self, words: Words, carried: list[tuple]) -> None:
        numbers = self.phrases.number(words.hashes())
        base = len(self.docs)
        limits = words.of_text
        self.docs += [(*row, int(n)) for row, n in zip(carried, np.diff(limits))]
        if not self.phrases.shortest:
            return
        for a, b in zip(*_runs(numbers, limits, self.phrases.shortest)):
            doc = int(np.searchsorted(limits, a, side="right")) - 1
            first = int(limits[doc])
            self.runs.append((base + doc, a - first, numbers[a:b],
                              words.starts[a:b] - words.at[doc], words.ends[a:b] - words.at[doc]))
            self.size += b - a + 1

    def results(self):
        """Each document with its word count, merged spans and items."""
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if self.runs:
            gap = np.ones(1, dtype=np.int64)
            text = np.concatenate([x for run in self.runs for x in (run[2], gap)] + [gap * 0])
            starts = np.cumsum([0] + [len(run[2]) + 1 for run in self.runs])
            index = Index(text)
            low, high = index.search(self.phrases)
            count = high - low
            hit = np.flatnonzero(count > 0)
            which = np.repeat(hit, count[hit])
            within = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            at = index.locate(low[which] + within)
            runs = np.searchsorted(starts, at, side="right") - 1
            for p, run, i in zip(which.tolist(), runs.tolist(), (at - starts[runs]).tolist()):
                doc = self.runs[run][0]
                spans.setdefault(doc, []).append((run, i, i + int(self.phrases.lengths[p])))
                items.setdefault(doc, set()).update(self.phrases.items[p])
        for doc, row in enumerate(self.docs):
            yield (*row, self.merged(spans.get(doc, [])), sorted(items.get(doc, ())))

    def merged(self, found: list[tuple]) -> list[dict]:
        out: list[list[int]] = []
        for run, a, b in sorted(found):
            if out and out[-1][0] == run and a <= out[-1][2]:
                out[-1][2] = max(b, out[-1][2])
            else:
                out.append([run, a, b])
        return [
            {"word": int(self.runs[r][1] + a), "words": b - a,
             "byte": int(self.runs[r][3][a]), "bytes": int(self.runs[r][4][b - 1] - self.runs[r][3][a])}
            for r, a, b in out
        ]


_FOUND = (
    "n_words long, spans array<struct<word:long,words:long,byte:long,bytes:long>>, "
    "items array<string>"
)


def _search(batches, phrases: Phrases, kind: pa.DataType, shard_words: int):
    spans = pa.list_(pa.struct([(k, pa.int64()) for k in ("word", "words", "byte", "bytes")]))

    def send(shard):
        rows, n, found, items = zip(*shard.results())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, kind), pa.array(n, pa.int64()), pa.array(found, spans),
             pa.array(items, pa.list_(pa.string()))],
            names=["doc_id", "n_words", "spans", "items"],
        )

    shard = Shard(phrases)
    for batch in batches:
        raw, at = batches_of(batch)
        ids = batch.column(0).to_pylist()
        for i, j in blocks(at):
            shard.add(Words(raw, at[i:j + 1], PLAIN_WORDS, lower=True), [(x,) for x in ids[i:j]])
            if shard.size >= shard_words or len(shard.docs) >= 50_000:
                yield send(shard)
                shard = Shard(phrases)
    if shard.docs:
        yield send(shard)


def _passes(benchmark: DataFrame, pass_bytes: int) -> list[DataFrame]:
    """The benchmark's items in tables of about ``pass_bytes``, none of them collected yet; an
    id's texts are dealt out too. Items without id are no items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(
        "item is not null and text is not null"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // pass_bytes
    return [
        items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).distinct()
        for part in range(parts)
    ]


def _collected(items: DataFrame) -> list[tuple]:
    return [tuple(r) for r in items.collect()]


def contamination(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW,
    pass_bytes: int = PASS_BYTES, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per row of ``documents``: key, n_words, spans, items.

    ``spans`` are merged runs of words hit, by word and byte; ``items`` the ids, sorted as
    strings, of benchmark items of which a window of ``window`` words (a shorter item: all its
    words) occurs. Texts without words, null ones included, hit nothing, and such items have
    no window. Repeated rows, on either side, are judged alike; rows without key keep null.
    Other columns are not read. Empty tables give no rows, or rows without hits. A benchmark
    beyond ``pass_bytes`` is searched in several passes, whose spans are joined by row.
    """
    small_batches(documents.sparkSession)
    passes = _passes(benchmark, pass_bytes)
    search = partial(_searched, window=window, shard_words=shard_words)
    if len(passes) == 1:
        return search(documents.select(key, "text"), key, _collected(passes[0]))
    rows = documents.select(key, F.xxhash64(F.col(key), F.col("text")).alias("row_key"), "text")
    # Each pass is written before the next is collected; rows without hits come from the first.
    parts = [
        written(
            search(rows.select("row_key", "text"), "row_key", _collected(items)).where(
                F.lit(k == 0) | (F.size("items") > 0)
            ),
            "benchmark-hits",
        )
        for k, items in enumerate(passes)
    ]
    joined = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("row_key", "n_words")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    return rows.select(key, "row_key").join(joined, "row_key").drop("row_key")


def _searched(
    texts: DataFrame, key: str, items: list[tuple], window: int, shard_words: int
) -> DataFrame:
    kind = texts.schema[key].dataType
    search = partial(
        _search, phrases=Phrases(items, window), kind=to_arrow_type(kind), shard_words=shard_words
    )
    return texts.mapInArrow(search, f"doc_id {kind.simpleString()}, {_FOUND}").withColumnRenamed(
        "doc_id", key
    )


def hit_words():
    """Words in a row's ``spans``, each counted once."""
    ordered = "array_sort(transform(spans, s -> struct(s.word as a, s.word + s.words as b)))"
    return F.expr(
        f"aggregate({ordered}, struct(0L as n, 0L as upto), (x, s) -> struct("
        "x.n + greatest(0L, s.b - greatest(s.a, x.upto)) as n, greatest(x.upto, s.b) as upto)).n"
    )


def _without(data: bytes, spans: list[dict]) -> str:
    """A text without its spans; those that overlap or meet, of other passes, are cut as one."""
    ends: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["word"]):
        words, end = s["word"] + s["words"], s["byte"] + s["bytes"]
        if ends and s["word"] <= ends[-1][0]:
            ends[-1][0], ends[-1][2] = max(words, ends[-1][0]), max(end, ends[-1][2])
        else:
            ends.append([words, s["byte"], end])
    out, last = [], 0
    for _, start, end in ends:
        out.append(data[last:start])
        last = end
    return b"".join([*out, data[last:]]).decode()


def _strip(batches, phrases: Phrases):
    """Whole rows again, with the spans cut from the texts."""
    for batch in batches:
        raw, at = batches_of(batch, "text")
        place = batch.schema.get_field_index("text")
        old = batch.column(place)
        texts = old.to_pylist()
        for i, j in blocks(at):
            shard = Shard(phrases)
            shard.add(Words(raw, at[i:j + 1], PLAIN_WORDS, lower=True), [(t,) for t in range(i, j)])
            for t, _, spans, _ in shard.results() if shard.runs else ():
                if spans:
                    texts[t] = _without(raw[at[t]:at[t + 1]].tobytes(), spans)
        columns = list(batch.columns)
        columns[place] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _cut(batches):
    """Whole rows without their last column, the spans, which are cut from the texts."""
    for batch in batches:
        raw, at = batches_of(batch, "text")
        place = batch.schema.get_field_index("text")
        columns = list(batch.columns)
        texts = columns[place].to_pylist()
        for t, spans in enumerate(columns.pop().to_pylist()):
            if spans:
                texts[t] = _without(raw[at[t]:at[t + 1]].tobytes(), spans)
        columns[place] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``documents`` with every occurrence of a benchmark window cut from ``text``; all rows
    and all other columns stay, and so does a null text. Every pass of a benchmark beyond
    ``pass_bytes`` searches the texts as given; its spans are written, and what all passes
    found in a text is cut at once."""
    small_batches(documents.sparkSession)
    names = [f"c{i}" for i in range(len(documents.columns))]
    names[documents.columns.index("text")] = "text"
    now = documents.toDF(*names)
    passes = _passes(benchmark, pass_bytes)
    if len(passes) == 1:
        strip = partial(_strip, phrases=Phrases(_collected(passes[0]), window))
        return now.mapInArrow(strip, now.schema).toDF(*documents.columns)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    texts = now.where("text is not null").select(digest, "text")
    parts = [
        written(
            _searched(texts, "digest", _collected(items), window, shard_words)
            .where("size(spans) > 0")
            .select("digest", "spans"),
            "benchmark-spans",
        )
        for items in passes
    ]
    found = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("digest")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )
    marked = now.select("*", digest).join(found, "digest", "left").select(*names, "spans")
    return marked.mapInArrow(_cut, now.schema).toDF(*documents.columns)
