"""The registry is consistent, and a few cheap queries equal their DuckDB twins."""

import os

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["b6_rank_stations", "p4_common_values", "x3_grouped_holdout", "j11_asof_link", "v3_softmax", "q9_language_gate", "r8_group_effect", "s8_registry_upsert"])
def test_query_equals_its_twin(spark, name):
    df = entry.queries()[name](spark, SF)
    cur = duck(SF).execute(entry.oracle_sql()[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall()) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_every_stored_inspection_is_read_back(spark):
    name = "s5_scan_all_inspections"
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF).execute(entry.oracle_sql()[name])
    assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None
    assert len(rows) == duck(SF).execute("SELECT count(*) FROM embeddings").fetchone()[0] > 100
