import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(show(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=str)
    have = sorted((tuple(show(r[c]) for c in sorted(names)) for r in got.collect()), key=str)
    assert have == want


def against_sql(spark, folder, name):
    """The rows of a query and of its SQL over the events of a folder, as sorted texts of column values."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    got = catalog.QUERIES[name](spark, str(folder))
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda each: sorted((tuple(show(r[i]) for i in each[0]) for r in each[1]), key=str)
    return rows((names, got.collect())), rows((range(len(names)), found.fetchall()))


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """The smallest events with the value 0 for every fortieth of them, as the larger tables have some."""
    folder = tmp_path_factory.mktemp("zeros")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 40 = 7 THEN 0 ELSE value END AS value) FROM '{SMALL}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["command_backtest", "command_signals", "tool_backtest", "tool_months", "tool_signals", "command_baseline", "processed_bars", "tool_candles", "tool_process", "tool_walk", "command_process", "research_regimes", "tool_compare", "tool_search", "written_metrics", "broken_bars"])
def test_values_of_zero(spark, zeros, name):
    have, want = against_sql(spark, zeros, name)
    assert have == want and have
