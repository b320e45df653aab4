"""Every registered query against its SQL on the smallest tables; the text operators have their own tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DONE_IN_LLM = {"pipeline"} | {n for n in entry.queries() if n.startswith("op")}
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return compare.connect(FOLDER)


def test_every_query_has_sql_of_the_same_name():
    assert set(entry.oracle_sql()) - DONE_IN_LLM == set(entry.queries()) - DONE_IN_LLM


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - DONE_IN_LLM))
def test_query_equals_sql(spark, database, name):
    assert compare.compare(spark, database, name, FOLDER).startswith("ok")


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["invoice_month", "customer_segment"] and df.count() > 0
