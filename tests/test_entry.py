"""Driver contract: entry(), queries(), oracle_sql()."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "median" in df.columns


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 30


def test_oracle_spot_check(spark):
    import duckdb
    from tests.conftest import SF
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("stratified_split", "roc_auc"):
        want = sorted(con.execute(E.oracle_sql()[name]).fetchall())
        got = sorted(tuple(r) for r in E.queries()[name](spark, SF).collect())
        assert len(want) == len(got)
        for a, b in zip(want, got):
            assert [round(x, 6) if isinstance(x, float) else x for x in a] == \
                   [round(x, 6) if isinstance(x, float) else x for x in b]
