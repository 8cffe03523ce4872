"""A sample of registered queries against their SQL in DuckDB; tools/compare.py runs all of them."""

import duckdb
import pytest

from sourcegrain.plans.registry import all_queries
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["scan_corpus_files", "admission_skip_reasons", "rule_scan_documents", "line_window_passages", "verify_citations", "finding_lifecycle", "identical_files",
          "js_symbols", "python_symbols", "import_edges", "bm25_candidates", "task_topics", "parse_test_logs", "gate_verdicts", "latest_runs", "patch_targets"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    q = all_queries()[name]
    df = q.run(spark, SF)
    cur = duck.execute(q.sql)
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_a_name_and_items():
    assert len(all_queries()) > 150
    assert all(q.items for q in all_queries().values())
