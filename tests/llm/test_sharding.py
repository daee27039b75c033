import random
import zlib
from collections import defaultdict

import pytest
from tests.llm.common import ODD, documents, prose

from parecer.llm import sharding as m


def smallest_capacity(sizes, shards):
    def needed(capacity):
        n, fill = 1, 0
        for size in sizes:
            if fill + size > capacity:
                n, fill = n + 1, 0
            fill += size
        return n

    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)


@pytest.mark.parametrize("seed", range(3))
def test_capacity_is_the_smallest_that_fits(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.randint(1, 9) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(sizes)), "unit int, size long")
    found = m.cut_points(table, 7).first()
    assert found["heavy"] == [] and found["capacity"] == smallest_capacity(sizes, 7)
    assert len(found["cuts"]) <= 6 and found["cuts"] == sorted(found["cuts"])


def test_a_group_above_the_fair_share_has_its_own_shard(spark):
    sizes = [5] * 30 + [100] + [5] * 30 + [40]
    table = spark.createDataFrame(list(enumerate(sizes)), "unit int, size long")
    found = m.cut_points(table, 6).first()
    assert found["heavy"] == [30]
    assert found["capacity"] == smallest_capacity(sizes[:30] + sizes[31:], 5)


def test_rows_and_slots(spark):
    rows = ODD + [(i, prose(i % 90, 5 + i % 50)) for i in range(100, 700)] + [(800, "same")] * 5
    got = m.sharded(documents(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    slots, by_text, bytes_of = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        bytes_of[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
                  for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())


def test_empty_table(spark):
    assert m.sharded(documents(spark, [])).collect() == []
