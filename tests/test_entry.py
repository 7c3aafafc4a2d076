import duckdb

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "labels", "conversations"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "avg_sentiment" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_some_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name in ["daily_sentiment", "dedup_stats", "negative_users", "trend_summary", "word_frequencies"]:
        df = E.queries()[name](spark, SMOKE)
        got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
        cur = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        want = sorted(tuple(str(r[i]) for i in order) for r in cur.fetchall())
        assert len(got) == len(want), name
        assert got == want, name
