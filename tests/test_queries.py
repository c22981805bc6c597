"""Every query against the DuckDB SQL of the same rows, at the smallest size."""

import duckdb
import pytest

from codonloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def values(frame):
    cols = sorted(frame.columns)
    rows = frame[cols].astype(object).where(frame[cols].notna(), None).to_numpy().tolist()
    return cols, sorted(tuple(x if x is None or isinstance(x, (str, bool)) else float(x) for x in r) for r in rows) if rows and not any(x is None for r in rows for x in r) else sorted(map(repr, (tuple(None if x is None else x if isinstance(x, (str, bool)) else float(x) for x in r) for r in rows)))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    assert values(registry.queries()[name](spark, sf).toPandas()) == values(con.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_random_query_repeats(spark, sf, name):
    first = registry.queries()[name](spark, sf).toPandas()
    assert len(first)
    again = registry.queries()[name](spark, sf).toPandas()
    cols = list(first.columns)
    assert first.sort_values(cols, ignore_index=True).equals(again.sort_values(cols, ignore_index=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_live_trace(spark, tmp_path):
    from codonloom.streaming import live_trace

    rows = [(i, c, "K", float(i)) for i in range(10) for c in (0, 1)]
    spark.createDataFrame(rows, live_trace.SCHEMA).write.parquet(str(tmp_path / "t"))
    live_trace.watch(spark, str(tmp_path / "t"), "live", str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(99, 0, "K", 1.0)], live_trace.SCHEMA).write.mode("append").parquet(str(tmp_path / "t"))
    assert {(r.chain, r.n, r.mean) for r in spark.table("live").collect()} == {(0, 10, 4.5), (1, 10, 4.5)}
