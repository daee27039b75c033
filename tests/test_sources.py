import os
import os
import subprocess
import sys
import time
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from parecer.plans import steps
from parecer.session import scratch_path, settings_for, shared_dir
from parecer.sources import tables as io
from parecer.sources.schemas import ROLLUPS
from parecer.sources.star_schema import star_schema_tables
from tests.conftest import rows

CSV = {
    "orders": (
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "a,c1,delivered,2018-01-01 10:00:00,,,2018-01-05 09:30:00,2018-01-10 00:00:00\n"
        "b,c2,shipped,2018-02-01 10:00:00,,,,2018-02-10 00:00:00\n"
    ),
    "reviews": (
        "review_id,order_id,review_score,review_comment_title,review_comment_message\n"
        'r1,a,1,,"duas linhas,\ne ""aspas"""\n'
        "r2,b,5,ok,\n"
    ),
    # Columns in another order than listed in the schemas.
    "order_items": "price,freight_value,order_id,product_id,seller_id\n10.50,1.25,a,p1,s1\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_csv_is_typed_by_header_name(spark, folder):
    t = io.read_tables(spark, folder)
    items = t["order_items"].first()
    assert (float(items["price"]), items["order_id"]) == (10.5, "a")
    first = t["orders"].orderBy("order_id").first()
    assert first["order_delivered_customer_date"] == datetime(2018, 1, 5, 9, 30)
    assert first["order_approved_at"] is None


def test_line_breaks_and_quotes_inside_comments(spark, folder):
    reviews = io.read_tables(spark, folder)["text_reviews"].orderBy("review_id").collect()
    assert len(reviews) == 2
    assert reviews[0]["review_comment_message"] == 'duas linhas,\ne "aspas"'
    assert reviews[1]["review_comment_message"] is None


def test_own_file_names(spark, folder):
    os.rename(f"{folder}/orders.csv", f"{folder}/o_2018.csv")
    t = io.read_tables(spark, folder, {"orders": "o_2018.csv"})
    assert t["orders"].count() == 2


def test_bad_time_stops_or_becomes_null(spark):
    df = spark.createDataFrame([("2018-01-01 00:00:00",), ("soon",)], "x string")
    got = rows(io.parse_timestamps(df, ["x"], bad_as_null=True))
    assert got == [(datetime(2018, 1, 1),), (None,)]
    with pytest.raises(Exception, match="soon"):
        io.parse_timestamps(df, ["x"]).collect()


def test_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.range(5), path)
    io.write_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_comments_survive_a_round_trip(spark, tmp_path):
    source = star_schema_tables(spark, "/root/testdata/sf0.001")["text_reviews"]
    path = str(tmp_path / "reviews.csv")
    io.write_table(source, path, "csv", header=True, escape='"')
    back = io.read_csv(spark, path, "reviews")
    message = "review_comment_message"
    digest = [F.sum(F.crc32(message)), F.count(message), F.sum(F.length(message))]
    assert source.agg(*digest).first() == back.agg(*digest).first()


def test_rollup_files_may_start_with_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "dose.csv"
    path.write_text("﻿delay_bucket,ords,bads,brate\non_time,10,1,10.0\n", encoding="utf-8")
    assert rows(io.read_rollup(spark, str(path), "delay_dose")) == [("on_time", 10, 1, 10.0)]
    assert set(ROLLUPS) == {
        "kpi_summary", "monthly_trend", "delay_dose", "group_compare", "category_risk", "payment",
    }


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder and shared_dir(spark) == folder
    assert scratch_path(spark, "x").startswith(folder)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert spark.sparkContext.getCheckpointDir().startswith(f"file:{folder}")


def test_a_cluster_without_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_shuffle_partitions_follow_the_input_size():
    large = settings_for(100 * 2**40, 4000)
    assert large["spark.sql.shuffle.partitions"] == "40000"
    assert 128 * 2**20 <= int(large["spark.sql.files.maxPartitionBytes"]) <= 512 * 2**20
    assert settings_for(2**40, 400)["spark.sql.shuffle.partitions"] == "512"
    assert settings_for(0, 8)["spark.sql.shuffle.partitions"] == "8"


def test_intermediate_tables_go_when_the_application_ends(tmp_path):
    code = (
        "from parecer.session import *\n"
        f"s = local_session(1, 'x', '1g', {{'spark.checkpoint.dir': {str(tmp_path)!r}}})\n"
        "materialize(s.range(3))\n"
        "s.range(3).write.parquet(scratch_path(s, 'x'))\n"
        f"import os; assert len(os.listdir({str(tmp_path)!r})) == 2\n"
        "s.stop()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
    for _ in range(50):
        if not os.listdir(tmp_path):
            break
        time.sleep(0.2)
    assert os.listdir(tmp_path) == []


def test_a_second_file_with_other_columns_stops_the_job(spark, tmp_path):
    folder = tmp_path / "products.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("product_id,product_category_name\np1,toys\n")
    (folder / "b.csv").write_text("product_category_name,product_id\ntoys,p2\n")
    with pytest.raises(Exception):
        io.read_csv(spark, str(folder), "products").collect()


def test_a_byte_order_mark_is_no_part_of_a_name(spark, tmp_path):
    path = tmp_path / "dose.csv"
    path.write_bytes(b"\xef\xbb\xbfbads,delay_bucket,brate,ords\n1,on_time,10.0,7\n")
    assert rows(io.read_rollup(spark, str(path), "delay_dose")) == [("on_time", 7, 1, 10.0)]


def test_all_steps_write_their_results(spark, tmp_path):
    t = star_schema_tables(spark, "/root/testdata/sf0.01")
    io.write_tables({**t, "reviews": t["reviews"]}, str(tmp_path / "tables"))
    stored = dict(io.read_parquet_tables(spark, str(tmp_path / "tables")))
    stored["text_reviews"] = t["text_reviews"]
    written = steps.run_steps(stored, str(tmp_path / "out"))
    assert {name.split("/")[0] for name in written} == set(steps.STEPS)
    for path in written.values():
        assert spark.read.parquet(path).columns
    q1 = spark.read.parquet(written["ask/q1_delay"])
    assert rows(q1) == rows(steps.ask(t)["q1_delay"])
