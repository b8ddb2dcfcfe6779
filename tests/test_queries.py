import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["s2_csv_sink", "p11_unpack_key", "j3_natural_full", "a14_composition_percent", "w7_deltas", "w8b_widening_fill",
          "w14_event_durations", "b2_hill_numbers", "b8_response_ratio", "m16_welch_vs_baseline", "m20_rank_sum", "l3_bootstrap_weights"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    status, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert status.startswith("ok"), status


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"(op|[a-z])\d+[a-z]?_[a-z0-9_]+|pipeline", n) for n in entry.queries())
