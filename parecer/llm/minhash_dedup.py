"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets.

Two small collections of band values, ``groups`` each, are made per document from
``2 * groups * rows`` minhashes. A table key is one value of the first collection with one of
the second, so there are ``groups ** 2`` tables for the cost of ``2 * groups`` bands: at
similarity 0.75 with 20 groups of 3, two documents miss each other in all 400 tables with a
probability under 4 in 100,000.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parecer.llm.components import connected_components
from parecer.llm.storage import NO_ID, discarded, identity, small_batches, written
from parecer.llm.words import BLANK_WORDS, U, Words, batches_of, blocks, mix, sequence_hashes

SHINGLE = 5
PERCENT = 75
GROUPS = 20
ROWS = 3
#: Rounds in which a class is compared with a few members drawn from its band values, and how
#: many in each, before all that remain.
TRIES = (1, 4, 4)
#: Classes with one value of the first collection from which on they are compared by that value,
#: with the tables as a test of the pair, instead of one row for each of their tables.
MANY = 100

_SETS = "id_key long, text_key long, n_shingles long, set_a long, set_b long"
_SIGNED = _SETS + ", bits_a long, bits_b long, marks array<long>, bands array<long>"
#: Longs of the bitmap in which each shingle of a set marks one bit.
MARKS = 8


def shingle_sets(raw, at, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words than
    ``size`` has its whole word sequence as one shingle, one without words has none."""
    words = Words(raw, at, BLANK_WORDS, lower=True)
    hashes = words.hashes()
    long_ones = sequence_hashes(hashes, size)
    out = []
    for a, b in zip(words.of_text[:-1].tolist(), words.of_text[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(long_ones[a:b - size + 1]))
        elif b > a:
            out.append(sequence_hashes(hashes[a:b], b - a) ^ U(b - a))
        else:
            out.append(long_ones[:0])
    return out


def _families(groups: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(11)
    n = 2 * groups * rows
    return (
        random.integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1),
        random.integers(1, 1 << 63, n, dtype=np.uint64),
    )


def _sign(batches, size: int, groups: int, rows: int):
    """A fingerprint of each text's set, its band values and one bit of each minhash."""
    times, plus = _families(groups, rows)
    n_bits = min(128, len(times))
    places = U(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        raw, at = batches_of(batch)
        parts = {k: [] for k in ("n", "a", "b", "x", "y", "marks", "bands")}
        for i, j in blocks(at):
            sets = shingle_sets(raw, at[i:j + 1], size)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            filled = np.flatnonzero(sizes)
            every = np.concatenate(sets)
            starts = np.concatenate(([0], np.cumsum(sizes[filled])[:-1])).astype(np.int64)
            least = np.zeros((len(sizes), len(times)), dtype=np.uint64)
            prints = np.zeros((2, len(sizes)), dtype=np.uint64)
            if len(filled):
                for f in range(len(times)):
                    least[filled, f] = np.minimum.reduceat((every ^ plus[f]) * times[f], starts)
                prints[0, filled] = np.add.reduceat(mix(every), starts)
                prints[1, filled] = np.add.reduceat(mix(every ^ U(0x5851F42D4C957F2D)), starts)
            marks = np.zeros((len(sizes), 64 * MARKS), dtype=np.uint8)
            marks[np.repeat(np.arange(len(sizes)), sizes), (every % U(64 * MARKS)).astype(int)] = 1
            marks = np.packbits(marks, axis=1).view(np.uint64)
            spread = mix(least)
            bands = spread.reshape(len(sizes), 2 * groups, rows)
            value = np.full(bands.shape[:2], 0, dtype=np.uint64)
            for r in range(rows):
                value = mix(value * U(3) + bands[:, :, r])
            value = mix(value + np.arange(2 * groups, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
            bit = np.zeros((len(sizes), 128), dtype=np.uint64)
            bit[:, :n_bits] = spread[:, :n_bits] & U(1)
            for key, made in (
                ("n", sizes), ("a", prints[0]), ("b", prints[1]),
                ("x", (bit[:, :64] * places).sum(axis=1, dtype=np.uint64)),
                ("y", (bit[:, 64:] * places).sum(axis=1, dtype=np.uint64)),
                ("marks", marks.reshape(-1)),
                ("bands", value.reshape(-1)),
            ):
                parts[key].append(made.view(np.int64))
        n = batch.num_rows
        joined = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}
        lists = lambda k, size: pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(joined[k])
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1),
                *(pa.array(joined[k]) for k in ("n", "a", "b", "x", "y")),
                lists("marks", MARKS), lists("bands", 2 * groups),
            ],
            names=["id_key", "text_key", "n_shingles", "set_a", "set_b", "bits_a", "bits_b",
                   "marks", "bands"],
        )


def _full_sets(batches, size: int):
    for batch in batches:
        raw, at = batches_of(batch)
        for i, j in blocks(at):
            sets = shingle_sets(raw, at[i:j + 1], size)
            limits = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.ListArray.from_arrays(
                        pa.array(limits), pa.array(np.concatenate(sets).view(np.int64))
                    ),
                ],
                names=["id", "shingles"],
            )


def _shared_values(reps: DataFrame) -> DataFrame:
    """``id``, ``place``, ``value`` of the band values that several classes have, and the
    ``weight`` of the class: how many rows all its values have."""
    values = reps.select(
        "id", F.posexplode("bands").alias("place", "value")
    ).select("id", F.col("place").cast("byte").alias("place"), "value")
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    weighed = values.join(shared, "value").groupBy("id").agg(
        F.sum("n").alias("weight"), F.collect_list(F.struct("place", "value")).alias("values")
    )
    return written(weighed.select("id", "weight", F.inline("values")), "band-values")


def _mixed(values: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """The rows of the band values that more than one component has, each with its component,
    one of the value's members and how many there are. Other values lead to no link between
    components.

    While nothing is linked the member is the heaviest: copies of one original have more
    values in common with it than with each other. Later it is drawn by the hash of the id, so
    that values with common members have few different ones.
    """
    drawn = F.xxhash64("id", F.lit(seed))
    if labels:
        placed = values.join(labels, "id", "left").withColumn(
            "comp", F.coalesce("component", "id")
        ).drop("component")
        order = drawn
    else:
        placed = values.withColumn("comp", F.col("id"))
        order = F.struct("weight", drawn)
    open_values = (
        placed.groupBy("value")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
             F.max_by(F.struct("id", "comp"), order).alias("one"),
             F.count(F.lit(1)).alias("members"))
        .where("low < high")
        .select("value", F.col("one.id").alias("hub"), F.col("one.comp").alias("hub_comp"),
                "members")
    )
    return written(
        placed.select("id", "place", "value", "comp").join(open_values, "value"), "open-values"
    )


def _drawn(mixed: DataFrame, reps: DataFrame, tries: int, percent: int, n_bits: int) -> DataFrame:
    """Pairs of a class and a member of another component that it meets most often, up to
    ``tries`` for each class, if they may be similar."""
    often = Window.partitionBy("id").orderBy(F.desc("n"), "hub")
    return (
        mixed.where("comp != hub_comp")
        .groupBy("id", "hub")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("place", F.row_number().over(often))
        .where(F.col("place") <= tries)
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        .distinct()
        .join(_side(reps, "a"), "a")
        .join(_side(reps, "b"), "b")
        .where(_may_be_similar(percent, n_bits))
        .select("a", "b")
    )


def tensor_keys(values: DataFrame, groups: int) -> DataFrame:
    """``id``, ``comp``, ``i``, ``j``, ``key``: every pair of a first-collection and a
    second-collection band value of a class, by their places.

    ``values`` are those that several components have. No pair of two components is lost: it
    meets in a table only if it shares both values of the key, and then both are among them.
    """
    one = F.struct("place", "value")
    kept = values.groupBy("id", "comp").agg(
        F.collect_list(F.when(F.col("place") < groups, one)).alias("first"),
        F.collect_list(F.when(F.col("place") >= groups, one)).alias("second"),
    )
    pairs = kept.select("id", "comp", "second", F.explode("first").alias("x")).select(
        "id", "comp", "x", F.explode("second").alias("y")
    )
    return pairs.select(
        "id", "comp", F.col("x.place").alias("i"), F.col("y.place").alias("j"),
        F.xxhash64("x.value", "y.value").alias("key"),
    )


def _tables(keys: DataFrame) -> DataFrame:
    """The rows of the tables that hold more than one component. Of tables with the same
    members the first is kept: it is also the first in which any two of them meet."""
    by_key = keys.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        F.min(F.struct("i", "j")).alias("place"),
    )
    first = (
        by_key.where("low < high").groupBy("n", "x", "y")
        .agg(F.min_by("key", F.struct("place", "key")).alias("key")).select("key")
    )
    return written(keys.join(first, "key"), "tables")


def verified(
    pairs: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, percent: int = PERCENT
) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough. Sets are made for the classes
    in the pairs alone, one for each, however many rows repeat its first row."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = reps.select(
        "id", F.col("rep").alias("id_key"), F.col("rep_text").alias("text_key")
    ).join(ids, "id", "left_semi")
    sets = written(
        texts.join(wanted, ["id_key", "text_key"])
        .select("id", "text")
        .mapInArrow(partial(_full_sets, size=shingle), "id long, shingles array<long>")
        .dropDuplicates(["id"]),
        "shingle-sets",
    )
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_of_a"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_of_b"))
    both = F.size(F.array_intersect("set_of_a", "set_of_b"))
    found = written(
        pairs.join(first, "a")
        .join(second, "b")
        .select("a", "b", both.alias("n"),
                (F.size("set_of_a") + F.size("set_of_b")).alias("sizes"))
        .where(100 * F.col("n") >= percent * (F.col("sizes") - F.col("n")))
        .select("a", "b"),
        "links",
    )
    discarded(sets)
    discarded(pairs)
    return found


def _may_be_similar(percent: int, n_bits: int):
    """Of a pair of sides a and b. Three things rule it out: sizes that differ too much; too
    few common marks, as two sets share no more shingles than marks and those that fall on a
    mark already made; and, but for one in a thousand million, minhash bits that differ six
    standard deviations beyond what the least similarity gives."""
    chance = (1 - percent / 100) / 2
    most = n_bits * chance + 6 * (n_bits * chance * (1 - chance)) ** 0.5
    differing = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) + F.bit_count(
        F.col("ya").bitwiseXOR(F.col("yb"))
    )
    common = sum(
        F.bit_count(F.col("marks_a")[i].bitwiseAND(F.col("marks_b")[i])) for i in range(MARKS)
    ) + F.least("extra_a", "extra_b")
    return (
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (differing <= most)
        & ((100 + percent) * common >= percent * (F.col("na") + F.col("nb")))
    )


def _side(reps: DataFrame, name: str, *more: str) -> DataFrame:
    """A representative's size, bits and marks as one side of a pair."""
    made = sum(F.bit_count(F.col("marks")[i]) for i in range(MARKS))
    return reps.select(
        F.col("id").alias(name), F.col("n_shingles").alias(f"n{name}"),
        F.col("bits_a").alias(f"x{name}"), F.col("bits_b").alias(f"y{name}"),
        F.col("marks").alias(f"marks_{name}"), (F.col("n_shingles") - made).alias(f"extra_{name}"),
        *[F.col(c).alias(f"{c}_{name}") for c in more],
    )


def _shared_from(start, n):
    """Whether sides a and b have one of ``n`` band values from ``start`` on in common."""
    return F.arrays_overlap(
        F.slice("bands_a", start, n.cast("int")), F.slice("bands_b", start, n.cast("int"))
    )


def _across(open_buckets: DataFrame, reps: DataFrame, percent: int, groups: int, n_bits: int):
    """Every pair of two components that meet in a bucket and may be similar, once.

    The tests stand inside the join, so a bucket's other pairs are not emitted, and a pair of
    several buckets is emitted in the first of them only.
    """
    placed = open_buckets.join(
        reps.select("id", "n_shingles", "bits_a", "bits_b", "marks", "bands"), "id"
    )
    one, two = _side(placed, "a", "key", "comp", "bands", "i", "j"), _side(
        placed, "b", "key", "comp", "bands"
    )

    met = one.join(
        two,
        (F.col("key_a") == F.col("key_b"))
        & (F.col("comp_a") < F.col("comp_b"))
        & _may_be_similar(percent, n_bits)
        & ~_shared_from(1, F.col("i_a"))
        & ~_shared_from(groups + 1, F.col("j_a") - groups),
    )
    return met.select("a", "b")


def _across_many(values: DataFrame, reps: DataFrame, percent: int, groups: int, n_bits: int):
    """What ``_across`` gives of the tables of ``values``, first-collection values that many
    classes have, without a row for each table.

    Two classes with such a value meet in one of its tables if they also share a value of the
    second collection. A value's classes outside the component of its drawn member are compared
    with all of it, so a component, however large, is not compared with itself. A pair of
    several values is emitted in the first of them only.
    """
    placed = values.select(
        "id", "comp", "place", F.col("value").alias("first_value"),
        (F.col("comp") != F.col("hub_comp")).alias("outside"),
    ).join(reps.select("id", "n_shingles", "bits_a", "bits_b", "marks", "bands"), "id")
    one = _side(placed.where("outside"), "a", "first_value", "comp", "bands", "place")
    two = _side(placed, "b", "first_value", "comp", "bands", "outside")
    met = one.join(
        two,
        (F.col("first_value_a") == F.col("first_value_b"))
        & (F.col("comp_a") != F.col("comp_b"))
        & (~F.col("outside_b") | (F.col("a") < F.col("b")))
        & _may_be_similar(percent, n_bits)
        & _shared_from(groups + 1, F.lit(groups))
        & ~_shared_from(1, F.col("place_a")),
    )
    return met.select("a", "b")


#: What equal sets of shingles share: a class.
_ONE_SET = ["n_shingles", "set_a", "set_b"]


def _placed(
    documents: DataFrame, shingle: int, percent: int, groups: int, rows: int
) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and each class with its first row (``rep``, ``rep_text``; rows without
    doc_id come last) and the component it belongs to.

    In each of the rounds of ``TRIES`` a class is compared with the members of other
    components, one drawn from each of its band values, that it meets most often. Values that
    a single component has are left out then, which takes a group of copies, however large,
    out of the search once it is linked. The last round makes the tables of the values that
    remain and compares every pair of two components that meet in one, whatever was tried
    before; pairs within a component would change nothing. Values that ``MANY`` classes have
    are joined as such, and their tables are a test of the pair.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(*identity(), "text")
    signed = written(
        texts.mapInArrow(partial(_sign, size=shingle, groups=groups, rows=rows), _SIGNED),
        "signatures",
    )
    reps = written(
        signed.where("n_shingles > 0")
        .groupBy(*_ONE_SET)
        .agg(
            F.min(
                F.struct((F.col("id_key") == NO_ID).alias("nameless"), "id_key", "text_key",
                         "bits_a", "bits_b", "marks", "bands")
            ).alias("r")
        )
        .select(*_ONE_SET, F.col("r.id_key").alias("rep"), F.col("r.text_key").alias("rep_text"),
                F.xxhash64(*_ONE_SET).alias("id"), "r.bits_a", "r.bits_b", "r.marks", "r.bands"),
        "classes",
    )
    n_bits = min(128, 2 * groups * rows)
    values, links, labels = _shared_values(reps), None, None
    for turn, tries in enumerate(TRIES):
        mixed = _mixed(values, labels, turn)
        discarded(values)
        found = verified(_drawn(mixed, reps, tries, percent, n_bits), texts, reps, shingle, percent)
        links = found if links is None else links.union(found)
        labels = connected_components(links)
        values = mixed.select("id", "place", "value")
    mixed = _mixed(values, labels, len(TRIES))
    discarded(values)
    many = (F.col("place") < groups) & (F.col("members") >= MANY)
    tables = _tables(tensor_keys(mixed.where(~many), groups))
    pairs = _across(tables, reps, percent, groups, n_bits).union(
        _across_many(mixed.where(many), reps, percent, groups, n_bits)
    )
    rest = verified(pairs, texts, reps, shingle, percent)
    if not rest.isEmpty():
        labels = connected_components(links.union(rest))
    return signed, reps.select("id", "rep", "rep_text", *_ONE_SET).join(
        labels, "id", "left"
    ).withColumn("component", F.coalesce("component", "id"))


def near_duplicates(
    documents: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    groups: int = GROUPS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked if their sets of ``shingle``-word shingles have a Jaccard similarity
    of at least ``percent`` in a hundred; a component's id is its smallest doc_id. A text
    without words, empty or null, has no shingles and is linked with nothing. Rows with equal
    sets are one class before any search, so exact copies never make pairs. A repeated row is
    in its twin's component and both rows are returned; a row without doc_id takes its class's
    component. Other columns, whatever their names, are not read. An empty table gives none.
    """
    signed, placed = _placed(documents, shingle, percent, groups, rows)
    # Components are named by their smallest doc_id; classes of rows without one come last.
    named = placed.groupBy("component").agg(
        F.min(F.when(F.col("rep") > NO_ID, F.col("rep"))).alias("component_id")
    )
    classes = placed.join(named, "component").select(*_ONE_SET, "component_id")
    missing = F.col("id_key") == NO_ID
    doc_id = F.when(~missing, F.col("id_key"))
    found = signed.select("id_key", "text_key", *_ONE_SET).join(classes, _ONE_SET, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(doc_id)
    return found.select(
        doc_id.alias("doc_id"), "text_key", "n_shingles", component.alias("component_id"),
        doc_id.eqNullSafe(component).alias("kept"),
    )


def one_of_each_group(
    documents: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    groups: int = GROUPS,
    rows: int = ROWS,
) -> DataFrame:
    """The rows of ``documents`` that stay: one of every component of near-duplicates.

    It is the row with the smallest doc_id, also where ids are missing or shared: rows without
    doc_id come last, and among equal ids the smaller text_key decides. Texts without words
    are in no component and stay; of equal ones with the same doc_id, or none, one stays.
    """
    signed, placed = _placed(documents, shingle, percent, groups, rows)
    first = placed.groupBy("component").agg(
        F.min(F.struct((F.col("rep") == NO_ID).alias("nameless"), "rep", "rep_text")).alias("r")
    )
    wordless = signed.where("n_shingles = 0").select("id_key", "text_key").distinct()
    kept = first.select(
        F.col("r.rep").alias("id_key"), F.col("r.rep_text").alias("text_key")
    ).union(wordless)
    id_key, text_key = identity()
    columns = documents.columns
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                             id_key, text_key)
    return (
        keyed.join(kept, ["id_key", "text_key"], "left_semi")
        .dropDuplicates(["id_key", "text_key"])
        .select("row.*")
    )
