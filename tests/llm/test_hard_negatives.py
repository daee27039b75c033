import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parecer.llm import hard_negatives as m

SCHEMA = "vec_id long, embedding array<float>, label int, score double, id long, `a b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, n, 1.0, 2, 3) for i, v, n in rows], SCHEMA)


def brute(rows, positives=5, negatives=10):
    use = []
    for i, v, n in rows:
        if v is not None and n is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(256 * float(np.float32(x))) for x in v], n))
    first = lambda x: sorted(x, key=lambda y: (-y[0], y[1] is None, y[1] or 0))
    out = []
    for k, (a, v, n) in enumerate(use):
        if a is None or a % 10:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, label)
                  for j, (i, w, label) in enumerate(use) if j != k]
        for ps, p, _ in first(x for x in scored if x[2] == n)[:positives]:
            fit = [x for x in scored if x[2] != n and 30 * ps <= 100 * x[0] <= 90 * ps]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i, _) in enumerate(first(fit)[:negatives])]
    return sorted(map(str, out))


def mined(spark, rows, parts=3, **options):
    vectors = table(spark, rows).repartition(parts)
    got = m.hard_negatives(vectors, F.col("vec_id") % 10 == 0, **options).collect()
    return sorted(str(tuple(r)) for r in got)


def cloud(seed, n, dim=8):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    return [
        (i, [x + draw.gauss(0, 0.1) for x in middle[i % 6]], draw.randrange(4)) for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_as_scoring_all_rows(spark, seed):
    rows = cloud(seed, 400, dim=7 + seed)
    assert mined(spark, rows) == brute(rows)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    v = [0.5, 0.25, 0.0, 0.0]
    rows = [(i, v, i % 3) for i in range(60)] + [(10, v, 1)] * 2 + [(None, v, 2)] * 4
    rows += [(70, None, 1), (80, v, None), (90, [0.1, None, 0.2, 0.0], 1), (100, [], 2),
             (110, [math.nan] * 4, 0), (120, [math.inf, 0.0, 0.0, 0.0], 0), (130, [0.5], 1),
             (140, [-x for x in v], 1), (150, [0.0] * 4, 1), (61, [0.4, 0.1, 0.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_passes_and_shards_change_nothing(spark):
    rows = cloud(9, 300)
    assert mined(spark, rows, pass_bytes=8 * 8 * 7, shard_bytes=4 * 8 * 11) == brute(rows)


def test_large_components_stay_whole_numbers(spark):
    rows = [(i, [1000.0 * (i % 7), 99999.0 - i, 3.0], i % 2) for i in range(40)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [7e4], 0)]) == [
        str((0, 1, 1, 2, m.MOST**2, m.MOST * 70000 * 256))
    ]


def test_a_search_leaves_cells_out(spark):
    """Far cells are not scored once the windows are certain."""
    draw = np.random.default_rng(1)
    middle = draw.normal(0, 300, (16, 8))
    near = draw.integers(0, 16, 4000)
    points = (middle[near] + draw.normal(0, 4, (4000, 8))).round().astype(np.int64)
    books = [m.codebook(points[:, :4]), m.codebook(points[:, 4:])]
    number = np.arange(4000)
    shard = m.Shard(number, number % 3, number, points, books)
    anchor = points[:1]
    bounds = [tuple(x[0] for x in half) for half in shard.bounds(anchor, books)]
    search = m.Search(0, 0, True, [m.ANY], 5)
    matrix, anchors = shard.exact(anchor)
    search.visit(shard, matrix, anchors[0], bounds)
    scores = points @ anchor[0]
    same = [i for i in number if i % 3 == 0 and i]
    want = sorted(same, key=lambda i: (-scores[i], i))[:5]
    assert set(search.ids.tolist()) == set(want) and search.scored < 1500
    bound, cells = math.inf, []
    for b, cell in m.by_bound(bounds[0][1], bounds[1][1]):
        i, j = shard.limits[cell], shard.limits[cell + 1]
        own = shard.matrix[i:j] @ anchor[0]
        assert b <= bound and (own <= b).all()
        bound = b
        cells += range(i, j)
    assert sorted(cells) == number.tolist()


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(10, None, None)], [(10, [1.0], 1)]])
def test_nothing_to_mine(spark, rows):
    assert mined(spark, rows, parts=1) == []
