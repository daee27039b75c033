"""Every query against its SQL counterpart in DuckDB, and the driver's entry points."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from parecer.plans import catalog  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
ORACLES = entry.oracle_sql()
ROWS_ONLY = {"l1_lda_topics", "l2_topic_share", "l3_topic_by_delay"}
# The corpus operators have tests of their own.
NAMES = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, _, n = compare(spark, con, FOLDER, name, entry.queries()[name], ORACLES.get(name))
    assert verdict == ("rows only" if name in ROWS_ONLY else "ok")
    assert n > 0


def test_every_query_but_the_models_has_sql():
    assert set(NAMES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["delay_bucket", "order_cnt", "avg_review_score", "bad_rate_pct"]
    assert df.count() > 0
