"""Repeated passages by suffix sorting: bucket-pointer refinement over shared regions.

Every ``length``-byte string is assigned to the one of its q-grams with the smallest hash, its
anchor; equal strings have equal anchors at the same offset. Consecutive strings with one
anchor form a region, about ``length`` / 2 of them in random text. Only regions whose anchor
occurs twice can hold a repeated string, so the texts of those alone are sorted, anchor by
anchor, and no string is lost.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parecer.llm.storage import identity, small_batches, written
from parecer.llm.words import _VALUES, U, batches_of, blocks, mix, powers

LENGTH = 400
GRAM = 32
#: Different regions of one anchor that one task sorts; anchors with more are split.
MOST_REGIONS = 2000
#: Strings of a long text whose anchors are worked out at once.
TEXT_BYTES = 1 << 20
#: Bytes sorted at once.
SORT_BYTES = 1 << 20
#: Offsets in a part of a split anchor.
PART = 20

_REGION = ["fp", "print", "windows", "lead"]
_ANCHORS = "id_key long, text_key long, fp long, print long, windows int, lead int, start int"


def _smallest_of(hashes: np.ndarray, width: int, n: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive hashes."""
    size, now = 1, hashes
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    return np.minimum(now[:n], now[width - size:width - size + n])


def text_regions(data: np.ndarray, length: int, gram: int):
    """Rows of (anchor hash, region hash, strings, anchor's place in the region, start)."""
    n = len(data) - length + 1
    if n <= 0:
        return
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    grams = len(data) - gram + 1
    hashes = mix((sums[gram:] - sums[:grams]) * down[:grams])
    width = length - gram + 1
    least = _smallest_of(hashes, width, n)
    edges = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), n]
    raw = memoryview(np.ascontiguousarray(data))
    for a, b in zip(edges[:-1], edges[1:]):
        value = int(least[a])
        while a < b:  # an anchor that leaves before the run ends gives way to its next equal
            at = a + int(hashes[a:a + width].argmin())
            end = min(b, at + 1)
            yield value, xxhash.xxh3_64_intdigest(raw[a:end + length - 1]), end - a, at - a, a
            a = end


def _all_regions(data: np.ndarray, length: int, gram: int):
    """The regions of a text, worked out over ``TEXT_BYTES`` strings at a time. A region that
    is cut there is two, with one anchor; its strings are found all the same."""
    for base in range(0, len(data), TEXT_BYTES):
        for *row, start in text_regions(data[base:base + TEXT_BYTES + length - 1], length, gram):
            yield *row, base + start


def _anchors(batches, length: int, gram: int):
    signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
    for batch in batches:
        raw, at = batches_of(batch)
        ids, texts = batch.column(0), batch.column(1)
        for i, j in blocks(at, 1 << 22):
            owners, rows = [], []
            for t in range(i, j):
                before = len(rows)
                rows += _all_regions(raw[at[t]:at[t + 1]], length, gram)
                owners += [t] * (len(rows) - before)
            if rows:
                fp, prints, windows, lead, start = zip(*rows)
                owners = pa.array(owners, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(owners), texts.take(owners), pa.array(signed(fp)),
                     pa.array(signed(prints)),
                     *(pa.array(x, pa.int32()) for x in (windows, lead, start))],
                    names=["id_key", "text_key", *_REGION, "start"],
                )


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of smaller ones, and whether another key equals it."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys) + 1, dtype=bool)
    new[1:-1] = keys[order[1:]] != keys[order[:-1]]
    heads = np.flatnonzero(new[:-1])
    sizes = np.diff(np.append(heads, len(keys)))
    rank, shared = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=bool)
    rank[order] = np.repeat(heads, sizes)
    shared[order] = np.repeat(sizes > 1, sizes)
    return rank, shared


def repeated_starts(data: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """The bucket of every start of a ``length``-byte string after bucket-pointer refinement.

    ``room`` has the bytes from each position to the end of its region. Positions start in
    the bucket of their first 8 bytes. A bucket pointer is the rank at which the bucket
    begins; a bucket is refined by sorting its members on their own pointer and the pointer
    ``depth`` bytes further on, whose refinements so far are thereby reused, which doubles
    the depth. Buckets of one position are done and not sorted again. Starts whose string
    occurs once, or without room for one, get -1; other equal strings share a bucket.
    """
    n, depth = len(data), min(8, length)
    padded = np.append(data, np.zeros(depth, dtype=np.uint8)).astype(np.uint64)
    first = np.zeros(n, dtype=np.uint64)
    for k in range(depth):
        first = (first << U(8)) | padded[k:k + n]
    pointer = np.full(n, -1, dtype=np.int64)
    live = np.flatnonzero(room >= depth)
    if not len(live):
        return pointer
    rank, shared = _ranked(first[live])
    pointer[live] = rank
    live = live[shared]
    while depth < length and len(live):
        step = min(depth, length - depth)
        # A position without room for the greater depth begins no wanted string.
        live = live[room[live] >= depth + step]
        keys = pointer[live] * np.int64(n + 1) + pointer[live + step] + 1
        rank, shared = _ranked(keys)
        # Ranks within a bucket keep its members between its old ends.
        old = pointer[live]
        order = np.argsort(old, kind="stable")
        begins = np.empty(len(live), dtype=np.int64)
        groups = np.flatnonzero(np.append(True, old[order[1:]] != old[order[:-1]]))
        begins[order] = np.repeat(groups, np.diff(np.append(groups, len(live))))
        pointer[live] = old + rank - begins
        live = live[shared]
        depth += step
    found = np.full(n, -1, dtype=np.int64)
    found[live] = pointer[live]
    return found


def _ranges(flags: np.ndarray):
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())


def _sorted_group(rows: list[tuple], length: int) -> list[tuple]:
    """Ranges of strings, per region, that occur elsewhere in the rows or in a copy of it."""
    sizes = np.array([len(r[-1]) for r in rows])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(r[-1] for r in rows), dtype=np.uint8)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    twice = repeated_starts(data, room, length) >= 0
    out = []
    for row, end, size in zip(rows, ends.tolist(), sizes.tolist()):
        flags = twice[end - size:end - length + 1]
        flags = np.ones_like(flags) if row[4] > 1 else flags
        out += [(*row[:4], a, b) for a, b in _ranges(flags)]
    return out


def _sort_regions(batches, length: int):
    """Batches come ordered by anchor; whole anchors are sorted together, some at a time."""
    def send(rows):
        columns = list(zip(*_sorted_group(rows, length))) or [()] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=[*_REGION, "first", "last"]
        )

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= SORT_BYTES and row[0] != held[-1][0]:
                yield send(held)
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
    if held:
        yield send(held)


def _two_hashes(first: str, second: str, *columns):
    return (
        F.xxhash64(*columns).alias(first), F.xxhash64(*reversed(columns)).alias(second)
    )


def _part_rows(regions: DataFrame, length: int, part: int) -> DataFrame:
    """One row per region and part: its first and last string, ``t1`` and ``t2``, and hashes of
    its content (``g1``, ``g2``) and of its middle (``h1``, ``h2``)."""
    first = F.floor(-F.col("lead") / part)
    last = F.floor((F.col("windows") - 1 - F.col("lead")) / part)
    begin = F.col("lead") + F.col("p") * part
    return (
        regions.select("*", F.explode(F.sequence(first, last)).alias("p"))
        .select("*", F.greatest(F.lit(0), begin).cast("int").alias("t1"),
                F.least(F.col("windows") - 1, begin + part - 1).cast("int").alias("t2"),
                (begin + part - 1).cast("int").alias("middle"))
        .select(
            *_REGION, "n", "t1", "t2",
            *_two_hashes("g1", "g2", "fp", F.col("t1") - F.col("lead"),
                         F.col("t2") - F.col("lead"),
                         F.expr(f"substring(bytes, t1 + 1, t2 - t1 + {length})")),
            *_two_hashes("h1", "h2", "fp", "p",
                         F.expr(f"substring(bytes, middle + 1, {length - part + 1})")),
        )
    )


def split_anchor_ranges(regions: DataFrame, length: int, part: int = PART) -> DataFrame:
    """Ranges of repeated strings for anchors with more regions than one task sorts.

    Strings are told apart by their place relative to the anchor and go by parts of ``part``
    consecutive places. Equal parts are one kind with a count; a kind that occurs again is
    repeated as a whole. All strings of a part share the bytes in its middle, so of the other
    kinds those whose middle occurs once are done. The strings of what remains, the edges of
    passages, are compared one by one, those of a repeated kind once for all its regions. Every
    row is keyed by content, so nothing of an anchor has to meet in one task.
    """
    parts = written(_part_rows(regions, length, part), "parts")
    kinds = written(
        parts.groupBy("g1", "g2").agg(
            F.sum("n").alias("total"), F.min(F.struct(*_REGION, "t1", "t2")).alias("at"),
            F.min("h1").alias("h1"), F.min("h2").alias("h2"),
        ),
        "part-kinds",
    )
    again = kinds.where("total > 1").select("g1", "g2")
    whole = parts.join(again, ["g1", "g2"], "left_semi").select(
        *_REGION, F.col("t1").alias("first"), F.col("t2").alias("last")
    )
    # Where a middle has repeated kinds alone there is nothing left to find.
    middles = (
        kinds.groupBy("h1", "h2")
        .agg(F.sum("total").alias("all"), F.min("total").alias("least"))
        .where("all > 1 AND least = 1")
    )
    open_kinds = kinds.join(middles.select("h1", "h2"), ["h1", "h2"], "left_semi").select(
        "total", "at.*"
    )
    strings = written(
        open_kinds.join(regions.select(*_REGION, "bytes"), _REGION)
        .select(*_REGION, "total", "bytes", F.explode(F.sequence("t1", "t2")).alias("t"))
        .select(*_REGION, "total", "t",
                *_two_hashes("s1", "s2", "fp", F.expr(f"substring(bytes, t + 1, {length})"))),
        "strings",
    )
    same = strings.groupBy("s1", "s2").agg(F.sum("total").alias("all")).where("all > 1")
    found = strings.where("total = 1").join(same.select("s1", "s2"), ["s1", "s2"], "left_semi")
    place = F.row_number().over(Window.partitionBy(*_REGION).orderBy("t"))
    edges = (
        found.select(*_REGION, "t", (F.col("t") - place).alias("run"))
        .groupBy(*_REGION, "run")
        .agg(F.min("t").alias("first"), F.max("t").alias("last"))
        .drop("run")
    )
    return whole.unionByName(edges)


def repeated_spans(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, most_regions: int = MOST_REGIONS
) -> DataFrame:
    """``id_key``, ``text_key``, ``spans``: byte ranges, not yet merged, of each text covered
    by a ``length``-byte string that also starts elsewhere, the same text included."""
    small_batches(documents.sparkSession)
    texts = documents.select(*identity(), "text")
    anchors = written(
        texts.mapInArrow(partial(_anchors, length=length, gram=gram), _ANCHORS), "anchors"
    )
    # Written, as are the kinds below, so that the join shuffles plain rows on both sides and
    # an anchor with many of them can be split.
    often = written(
        anchors.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"),
        "frequent-anchors",
    )
    places = written(anchors.join(often, "fp", "left_semi"), "shared-anchors")
    regions = places.groupBy(*_REGION).agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.min(F.struct("id_key", "text_key", "start")).alias("at"),
    )
    regions = written(regions, "regions")
    kinds = written(regions.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    told = regions.join(kinds, "fp")
    whole = told.where("kinds = 1").select(
        *_REGION, F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")
    )
    asked = (
        told.where("kinds > 1")
        .select("at.id_key", "at.text_key",
                F.struct(*_REGION, "n", "kinds", "at.start").alias("region"))
        .groupBy("id_key", "text_key")
        .agg(F.collect_list("region").alias("regions"))
    )
    cut = f"substring(bytes, r.start + 1, r.windows + {length - 1})"
    copy = F.row_number().over(Window.partitionBy("id_key", "text_key").orderBy("id_key"))
    with_bytes = written(
        texts.join(asked, ["id_key", "text_key"])
        .withColumn("copy", copy)
        .where("copy = 1")
        .withColumn("bytes", F.col("text").cast("binary"))
        .select(F.expr(
            "inline(transform(regions, r -> named_struct('fp', r.fp, 'print', r.print, 'windows', "
            f"r.windows, 'lead', r.lead, 'n', r.n, 'kinds', r.kinds, 'bytes', {cut})))"
        )),
        "region-texts",
    )
    sorted_ones = (
        with_bytes.where(F.col("kinds") <= most_regions)
        .select(*_REGION, "n", "bytes")
        .repartition("fp")
        .sortWithinPartitions("fp")
        .mapInArrow(
            partial(_sort_regions, length=length),
            "fp long, print long, windows int, lead int, first int, last int",
        )
    )
    split = split_anchor_ranges(with_bytes.where(F.col("kinds") > most_regions), length)
    ranges = written(whole.unionByName(sorted_ones).unionByName(split), "ranges")
    return (
        places.join(ranges, _REGION)
        .select("id_key", "text_key",
                F.struct((F.col("start") + F.col("first")).alias("a"),
                         (F.col("start") + F.col("last") + length).alias("b")).alias("span"))
        .groupBy("id_key", "text_key")
        .agg(F.collect_set("span").alias("spans"))
    )


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(data: bytes, spans) -> bytes:
    ends = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))


def _whole_characters(data: bytes, spans):
    """Spans grown to whole characters: half a character cannot stay in a text."""
    middle = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    for a, b in spans:
        while middle(a):
            a -= 1
        while middle(b):
            b += 1
        yield {"a": a, "b": b}


def _cut(batches, as_text: bool):
    for batch in batches:
        raw, at = batches_of(batch)
        names = batch.schema.names
        spans = [merged(s) for s in batch.column(names.index("spans")).to_pylist()]
        kept = []
        for t, cuts in enumerate(spans):
            data = raw[at[t]:at[t + 1]].tobytes()
            cuts = merged(_whole_characters(data, cuts)) if as_text and cuts else cuts
            kept.append(_without(data, cuts) if cuts else data)
        if as_text:
            column = pa.array([k.decode() if k is not None else k for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["row", "kept"])
        else:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)),
                 pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def without_repeats(documents: DataFrame, **settings) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    Each byte covered by a ``length``-byte string that also starts elsewhere is removed, at
    all its places. A null text is empty; texts shorter than ``length`` keep everything. Rows
    that repeat, doc_id and all, are places of their own. Rows without doc_id are treated as
    any other. Columns other than doc_id and text are not read. An empty table gives none.
    """
    spans = repeated_spans(documents, **settings)
    texts = documents.select("doc_id", *identity(), F.coalesce("text", F.lit("")).alias("text"))
    return (
        texts.join(spans, ["id_key", "text_key"], "left")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
        .mapInArrow(partial(_cut, as_text=False),
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def documents_without_repeats(documents: DataFrame, **settings) -> DataFrame:
    """``documents`` with the repeated passages cut from ``text``, whole characters at a time;
    a null text stays null and every other column stays as it is."""
    spans = repeated_spans(documents, **settings)
    columns = documents.columns
    others = [c for c in columns if c != "text"]
    id_key, text_key = identity()
    joined = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), id_key, text_key, "text"
    ).join(spans, ["id_key", "text_key"], "left")
    marked = joined.select(
        F.struct("row", F.col("text").isNull().alias("none")).alias("row"), "text", "spans"
    )
    schema = StructType([marked.schema["row"], StructField("kept", StringType())])
    cut = marked.mapInArrow(partial(_cut, as_text=True), schema)
    text = F.when(~F.col("row.none"), F.col("kept")).alias("text")
    return cut.select(
        *[text if c == "text" else F.col(f"row.row.`{c}`").alias(c) for c in columns]
    )
