"""The registered queries against their SQL, on the smallest given tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# Quick ones; `python check.py` runs all of them.
NAMES = [
    "content_hash", "table_documents", "detect_format", "contract_bytes", "headings", "sections", "chunks", "detect_changes", "next_versions", "resumable_versions",
    "numbered_lines", "embed_texts", "postings", "semantic_topk", "lexical_search", "boolean_matches", "route_sources", "rrf_fuse", "context_neighbours"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables are absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
