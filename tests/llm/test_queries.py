"""The registered text queries against their SQL on the smallest tables, whole."""

from __future__ import annotations

from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

from ledgergrain.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(names, cursor.fetchall())


def test_every_operator_has_one_query():
    numbers = [int(n.split("_")[0][2:]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
