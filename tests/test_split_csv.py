"""Reading CSV with line breaks inside quotes by splits, against Spark's reader."""

import random

import pytest
from pyspark.sql import functions as F

from parecer.sources import tables as io
from tests.conftest import rows

HEADER = "review_id,order_id,review_score,review_comment_title,review_comment_message"


def field(draw):
    kind = draw.random()
    if kind < 0.2:
        return ""
    text = "".join(draw.choice('ab ,"\né1') for _ in range(draw.randint(1, 40)))
    if kind < 0.3:
        text = "\n".join(["long"] * draw.randint(20, 60))
    if kind < 0.35:
        return '""'
    if set(text) & set(',"\n') or draw.random() < 0.2:
        return '"' + text.replace('"', '""') + '"'
    return text.strip() or "x"


def review_file(path, seed, n, end="\n", mark=""):
    draw = random.Random(seed)
    lines = [f"r{seed}_{i},o{i},{draw.randint(1, 5)},{field(draw)},{field(draw)}" for i in range(n)]
    text = mark + end.join([HEADER, *lines]) + (end if draw.random() < 0.5 else "")
    path.write_text(text, encoding="utf-8", newline="")
    return n


@pytest.fixture(params=[64, 300, 5000])
def small_splits(spark, request):
    """Splits far smaller than records, about as large, and larger."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_as_the_reader_of_whole_files(small_splits, tmp_path):
    folder = tmp_path / "reviews.csv"
    folder.mkdir()
    n = review_file(folder / "a.csv", 1, 120)
    n += review_file(folder / "b.csv", 2, 90, mark="﻿")
    n += review_file(folder / "c.csv", 3, 3)
    split = io.read_csv(small_splits, str(folder), "reviews")
    whole = io.read_csv(small_splits, str(folder), "reviews", split=False)
    assert split.schema == whole.schema
    assert sorted(map(str, rows(split))) == sorted(map(str, rows(whole)))
    assert split.count() == n


def test_a_file_is_read_by_many_tasks(small_splits, tmp_path):
    path = tmp_path / "reviews.csv"
    review_file(path, 5, 400)
    split = io.read_csv(small_splits, str(path), "reviews")
    tasks = split.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4
    assert io.read_csv(small_splits, str(path), "reviews", split=False).rdd.getNumPartitions() == 1


def test_carriage_returns_and_empty_lines(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        f'{HEADER}\r\nr1,a,1,"x\r\ny",\r\n\r\nr2,b,2,,"z"\r\n', encoding="utf-8", newline=""
    )
    got = rows(io.read_csv(spark, str(path), "reviews", split=True).orderBy("review_id"))
    assert [r[0:5] for r in got] == [("r1", "a", 1, "x\ny", None), ("r2", "b", 2, None, "z")]


def test_a_quote_inside_an_unquoted_field_stops_the_job(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(f'{HEADER}\nr1,a,1,5" screen,ok\nr2,b,2,6" tv,ok\n', encoding="utf-8")
    with pytest.raises(Exception, match="unsplit"):
        io.read_csv(spark, str(path), "reviews", split=True).collect()
    assert io.read_csv(spark, str(path), "reviews", split=False).count() == 2


def test_another_header_stops_the_job(spark, tmp_path):
    folder = tmp_path / "reviews.csv"
    folder.mkdir()
    review_file(folder / "a.csv", 1, 5)
    (folder / "b.csv").write_text("order_id,review_id,review_score,t,m\no,r,1,,\n")
    with pytest.raises(Exception, match="another header"):
        io.read_csv(spark, str(folder), "reviews", split=True).count()


def test_splits_that_changed_stop_the_job(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    review_file(path, 7, 200)
    table = io.read_csv(spark, str(path), "reviews", split=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        with pytest.raises(Exception, match="changed"):
            table.select("review_id", F.lit(1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_a_header(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(HEADER)
    assert rows(io.read_csv(spark, str(path), "reviews", split=True)) == []
    plan = io.read_csv(spark, str(path), "reviews")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # one split, one task
