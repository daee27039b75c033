"""Mixing sources to target weights: whole copies first, then a Pareto sample of documents.

A source's target in words says how often each of its documents is taken: whole copies of all
are certain, and what is then due is drawn. A document's inclusion probability is its share of
the words due, so longer documents are likelier; documents are ranked by their random odds
divided by their inclusion odds, and the sample ends with the document that brings its words
nearest to those due. The rank is never sorted as a whole: the place of the cut is refined by
sums over ranges of the rank, until few documents share its range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parecer.llm.storage import NO_ID, written

#: The sources' weights in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, against all words.
GROWTH = 1.5
#: Times that a document is taken at most, and a source with it.
MOST_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the rank (the logarithm of a ratio of odds): so many to each unit, and so many
#: again within the one that the cut is in.
RANGES, FINER = 64, 4096
#: Parts in which a source meets its row of a small table, so that a large one is split.
SALTS = 64
#: Equal rows that one row stands for where rows are listed one by one.
LISTED = 10_000


def _of_salts(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _in_order(sources: DataFrame) -> DataFrame:
    """``number`` from 0 in the order of names, null last, counted by ranges of names."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("named").desc(), F.col("source").asc()]
    split = written(
        sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    # At most ``parts`` rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("part").orderBy(*order)
    return split.join(offsets, "part").select(
        *sources.columns, (F.col("before") + F.row_number().over(inside) - 1).alias("number")
    )


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, growth: float = GROWTH,
    most: int = MOST_COPIES,
) -> DataFrame:
    """Adds ``number`` and ``target`` to rows of ``named``, ``source`` and ``source_size``.

    ``growth`` times all words are shared by weight. A source whose share is above ``most``
    times its size keeps that, and the rest is shared again by the others, until none is
    above; every round sums one row per source. An empty table gives none.
    """
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), F.col("number").cast("int") % len(weights) + 1
    )
    rows = written(
        _in_order(sources).withColumn("weight", weight).withColumn(
            "most", F.col("source_size") * most
        ),
        "weights",
    )
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("open")).first()
    shared, kept, open_weight, n_kept = (whole["words"] or 0) * growth, 0, whole["open"], -1
    while True:
        target = F.lit(shared - kept) * F.col("weight") / F.lit(open_weight or 1)
        above = target > F.col("most")
        told = rows.agg(
            F.sum(F.when(above, F.col("most"))).alias("kept"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(above).alias("n"),
        ).first()
        if told["n"] <= max(n_kept, 0):
            # Those above a share stay above the next one, which is no smaller.
            return rows.withColumn("target", F.least(target, F.col("most").cast("double")))
        kept, open_weight, n_kept = told["kept"], told["open"], told["n"]


def _cut_in(words: DataFrame, place: str) -> DataFrame:
    """For each source the range in which the running words pass those ``due``, and the words
    before it. ``words`` has a row per source and range."""
    upto = Window.partitionBy("number").orderBy(place)
    before = F.coalesce(
        F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    due = F.col("due") - F.col("before")
    return (
        words.withColumn("inside", before)
        .where((F.col("inside") <= due) & (F.col("inside") + F.col("words") > due))
        .select("number", "due", place, (F.col("before") + F.col("inside")).alias("before"))
    )


def _cuts(drawn: DataFrame) -> DataFrame:
    """One row per source: the group of equal rows at which its sample ends and how many of
    its rows are in (``odds``, ``id_key``, ``size``, ``last``)."""
    words = F.sum(F.col("size") * F.col("copies")).alias("words")
    none = F.lit(0).cast("long").alias("before")
    coarse = _cut_in(
        drawn.groupBy("number", "due", "range").agg(words).withColumn("before", none), "range"
    )
    at_coarse = drawn.join(coarse.select("number", "range", "before"), ["number", "range"])
    fine = _cut_in(at_coarse.groupBy("number", "due", "before", "finer").agg(words), "finer")
    at_fine = at_coarse.drop("before").join(
        fine.select("number", "finer", "before"), ["number", "finer"]
    )
    # What is left of a source here is about one in RANGES * FINER / 4 of its documents.
    order = Window.partitionBy("number").orderBy("odds", "id_key", "size")
    upto = F.sum(F.col("size") * F.col("copies")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    left = F.col("due") - F.col("upto") + F.col("size") * F.col("copies")
    return (
        at_fine.withColumn("upto", F.col("before") + upto)
        .where((F.col("upto") > F.col("due")) & (left >= 0))
        .select(
            "number", F.col("odds").alias("last_odds"), F.col("id_key").alias("last_id"),
            F.col("size").alias("last_size"), _nearest(left).alias("last"),
        )
    )


def _nearest(left: Column) -> Column:
    """Copies of a group whose words are nearest to those left."""
    n = F.floor(left / F.col("size") + 0.5)
    return F.least(F.col("copies"), F.greatest(n, F.lit(0))).cast("long")


def _spread(groups: DataFrame) -> DataFrame:
    """Groups of ``n`` rows in parts of at most ``LISTED``, dealt out over the tasks."""
    parts = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {LISTED}"))
    return (
        groups.withColumn("part", F.explode(parts))
        .withColumn("n", F.least(F.lit(LISTED), F.col("n") - F.col("part") * LISTED))
        .repartition("id_key", "size", "part").drop("part")
    )


def mixed(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, growth: float = GROWTH,
    most: int = MOST_COPIES, seed: int = 11,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, size, source_size, target, taken.

    ``size`` is the number of words of the text, 0 for null. ``target`` is that of the row's
    source as ``targets`` gives it, null being a source of its own. ``taken`` is the words of
    the row in the mix: as many whole copies as all rows of its source get, and one more if it
    is drawn, hence at most ``most`` times its size. What a source takes is off its target by
    half a document at most. Documents that are due a copy by themselves (their share of the
    words due is not below their size) are always drawn.

    The draw depends on ``seed``, doc_id and size alone, so reruns agree however the table is
    split. Rows equal in source, doc_id and size have one rank; if the cut falls among them,
    as many are taken as fit. Rows without doc_id are drawn by size. Texts without words take
    none. Other columns are not read. An empty table gives none.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    groups = written(
        documents.select(
            F.col("source").isNotNull().alias("named"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.col("doc_id").isNotNull().alias("known"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_key"),
            size.alias("size"),
        ).groupBy("named", "source", "known", "id_key", "size")
        .agg(F.count(F.lit(1)).alias("copies")),
        "sizes",
    )
    square = (F.col("size").cast("decimal(19,0)") * F.col("size")).cast("decimal(38,0)")
    sources = groups.groupBy("named", "source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"),
        F.sum((square * F.col("copies")).cast("decimal(38,0)")).cast("double").alias("squares"),
    )
    aimed = targets(sources, weights, growth, most)
    whole = F.least(F.lit(most), F.floor(F.try_divide("target", F.col("source_size"))))
    aimed = aimed.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "due", F.col("target") - F.col("whole") * F.col("source_size")
    )
    share = F.when(F.col("due") > 0, F.col("due") * F.col("size") / F.col("squares"))
    name = F.concat(
        F.lit(f"{seed}:"), F.when(F.col("known"), F.col("id_key").cast("string")).otherwise(""),
        F.lit(":"), F.col("size").cast("string"),
    )
    chance = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") + 0.5) / (1 << 48)
    odds = F.ln(F.col("chance") / (1 - F.col("chance"))) - F.ln(
        F.col("share") / (1 - F.col("share"))
    )
    by_range = F.col("odds") * RANGES
    placed = written(
        groups.withColumn("salt", _salt("id_key", "size"))
        .join(_of_salts(written(aimed, "targets")), ["named", "source", "salt"])
        .withColumn("share", F.when((F.col("size") > 0), share))
        .withColumn("chance", chance)
        .withColumn("certain", F.coalesce(F.col("share") >= 1, F.lit(False)))
        # Certain documents come before all ranges.
        .withColumn("odds", F.when(F.col("certain"), F.lit(-1e9)).otherwise(odds))
        .withColumn("range", F.floor(by_range))
        .withColumn("finer", F.floor((by_range - F.col("range")) * FINER))
        .select("number", "known", "id_key", "size", "copies", "source_size", "target", "whole",
                "due", "certain", "odds", "range", "finer"),
        "placed",
    )
    cuts = _of_salts(written(_cuts(placed.where(F.col("odds").isNotNull())), "cuts"))
    here, last = ("odds", "id_key", "size"), ("last_odds", "last_id", "last_size")
    same = reduce(lambda a, b: a & b, (F.col(x) == F.col(y) for x, y in zip(here, last)))
    sooner = F.struct(*here) < F.struct(*(F.col(x).alias(y) for x, y in zip(last, here)))
    drawn = F.when(F.col("certain") | sooner, F.col("copies")).when(same, F.col("last"))
    drawn = F.coalesce(drawn, F.lit(0))
    times = [
        F.struct(F.col("whole").alias("times"), (F.col("copies") - F.col("drawn")).alias("n")),
        F.struct((F.col("whole") + 1).alias("times"), F.col("drawn").alias("n")),
    ]

    def counted(groups: DataFrame) -> DataFrame:
        return (
            groups.withColumn("salt", _salt("id_key", "size"))
            .join(cuts, ["number", "salt"], "left")
            .withColumn("drawn", drawn)
            .withColumn("part", F.explode(F.filter(F.array(*times), lambda x: x["n"] > 0)))
            .select("known", "id_key", "size", "source_size", "target", "part.times", "part.n")
        )

    few = counted(placed.where(F.col("copies") <= LISTED))
    many = _spread(counted(placed.where(F.col("copies") > LISTED)))
    listed = few.unionByName(many).withColumn(
        "one", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))
    )
    return listed.select(
        F.when(F.col("known"), F.col("id_key")).alias("doc_id"), "size", "source_size", "target",
        (F.col("times") * F.col("size")).alias("taken"),
    )
