"""Edges written out by hand, independent of the tables of fixed values."""

import pytest
from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions.ladders import cut

DAYS = {
    -11: (0, 0, 0), -10: (0, 0, 0), -9: (1, 1, 1), -4: (1, 1, 1), -3: (2, 1, 1), -2: (2, 2, 2),
    -1: (2, 2, 2), 0: (3, 2, 2), 1: (4, 3, 3), 3: (4, 3, 3), 4: (5, 4, 4), 10: (5, 4, 4),
    11: (6, 5, 5),
}


@pytest.mark.parametrize("day, places", DAYS.items())
def test_delay_edges(spark, day, places):
    x = F.lit(day)
    groups = cut(x, fv.DELAY_CUT_EDGES, fv.DELAY_CUT_LABELS)
    got = spark.range(1).select(
        fv.DELAY_LADDER.rank(x), groups, fv.DOSE_LADDER.rank(x)
    ).first()
    assert (got[0], fv.DELAY_CUT_LABELS.index(got[1]), got[2]) == places


@pytest.mark.parametrize(
    "ladder, places",
    [
        (fv.FREIGHT_LADDER, {0: 0, 1: 1, 5: 1, 6: 2, 10: 2, 11: 3, 20: 3, 21: 4, 30: 4, 31: 5}),
        (fv.INSTALLMENT_LADDER, {1: 0, 2: 1, 3: 1, 4: 2, 6: 2, 7: 3, 10: 3, 11: 4}),
    ],
)
def test_ladder_edges(spark, ladder, places):
    got = spark.range(1).select(*[ladder.rank(F.lit(x)) for x in places]).first()
    assert list(got) == list(places.values())
