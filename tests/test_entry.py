import json
import os

import duckdb
import pytest

import __spark_entry__ as entry
import bench
from lodestone import catalog


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def values(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got, sorted(want.columns)) == values(want, sorted(want.columns))


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_prunes_and_aggregates_without_python(spark, sf):
    plan = catalog.QUERIES["gaf_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "props" not in plan


def test_bench_times_all_queries(spark, sf, monkeypatch, capsys):
    names = [*entry.queries()]
    monkeypatch.setattr(entry, "queries", lambda: {n: lambda s, _: s.range(1) for n in names})
    monkeypatch.setenv("BENCH_SF_DIR", sf)
    monkeypatch.setenv("BENCH_CPUS", "4")
    monkeypatch.delenv("BENCH_QUERIES", raising=False)
    bench.main()
    assert [*json.loads(capsys.readouterr().out.splitlines()[-1])["queries"]] == names
