"""Driver contract: entry runs, every query has a name-matched oracle, a sample agrees with DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"
SAMPLE = ["node_metrics", "run_report", "fold_state", "eval_cases", "merge_barrier", "redact",
          "validate_schema", "answer_asof", "find_cycles"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "status" in df.columns and df.count() > 0


def test_every_query_registered_with_oracle_or_listed():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100 and set(q) - set(o) <= {k for k in q if k.startswith('op') or k == 'pipeline'}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    from runlens.sources.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
