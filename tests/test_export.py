import datetime as dt
import json
import tempfile
from pathlib import Path

import pytest
from posts import post
from pyspark.sql import functions as F

from chorus.operators import filters as FL
from chorus.operators import network as G
from chorus.operators import series as S
from chorus.operators.project import posts_flat
from chorus.plans import export as E
from chorus.plans.analyze import analyze_posts
from chorus.schema import POST_SCHEMA
from chorus.sources import ingest as I


def test_export_posts_missing_sentiment(make_posts):
    p = make_posts([post(1, "  " + "x" * 600 + "  ", label=None, engagement={})])
    r = E.export_posts(p).first()
    assert (r["sentiment"], r["sentiment_score"], r["sentiment_method"]) == ("", 0.0, "")
    assert len(r["content"]) == 500 and r["content"].endswith("...") and r["likes"] == 0.0
    assert len(E.export_posts(p).columns) == 22


def test_csv_skips_empty_and_json_sorted(make_posts):
    base = tempfile.mkdtemp(prefix="chorus-out-")
    f = posts_flat(make_posts([post(1, "a"), post(2, "b")]))
    written = E.write_csv({"daily": S.daily_sentiment(f), "empty": f.limit(0)}, f"{base}/report")
    assert written == [f"{base}/report_daily"]
    header = next(Path(written[0]).glob("part-*.csv")).read_text().splitlines()[0]
    assert header.startswith("date,positive")
    E.write_json(S.daily_sentiment(f), f"{base}/daily.json")
    line = next(Path(f"{base}/daily.json").glob("part-*.json")).read_text().splitlines()[0]
    assert list(json.loads(line)) == sorted(json.loads(line))


def test_node_link_round_trip(make_posts, spark):
    rows = [post(i, f"t{i}", author="alice", mentions=["bob"]) for i in range(3)]
    g = G.mention_graph(G.mention_edges(make_posts(rows)))
    nodes = g.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    base = tempfile.mkdtemp(prefix="chorus-graph-")
    E.write_node_link(nodes, g, base)
    n, e = I.read_graph(spark, base)
    assert n.count() == 2 and e.select("src", "dst", "weight").first() == ("alice", "bob", 3)


def test_read_analysis_posts(spark, make_posts):
    base = Path(tempfile.mkdtemp(prefix="chorus-doc-"))
    doc = {"metadata": {"version": "1.0.0"},
           "posts": [{"seq": 1, "id": "1", "platform": "twitter", "author": "a", "content": "hi",
                      "timestamp": "2024-01-01T00:00:00", "engagement": {"likes": 1.0}, "query": "q"}]}
    (base / "doc.json").write_text(json.dumps(doc))
    got = I.read_analysis_posts(spark, str(base / "doc.json"), POST_SCHEMA)
    assert got.count() == 1 and got.first()["author"] == "a"
    assert I.read_analysis_posts(spark, str(base / "missing.json"), POST_SCHEMA).count() == 0


def test_lookback_and_dashboard_day(make_posts):
    now = dt.datetime(2024, 1, 10)
    assert FL.lookback_range(3, now) == (dt.datetime(2024, 1, 7), now)
    with pytest.raises(ValueError):
        FL.lookback_range(0, now)
    p = make_posts([post(1, "a", ts=dt.datetime(2024, 1, 5, 12)), post(2, "b", ts=dt.datetime(2024, 1, 4, 12))])
    assert FL.dashboard_filter(p, "2024-01-04", "2024-01-05").count() == 1          # end-day posts lost
    assert FL.dashboard_filter(p, "2024-01-04", "2024-01-05", end_inclusive_day=True).count() == 2


def test_series_by_key(make_posts):
    rows = [post(i, f"t{i}", platform="twitter" if i % 2 else "reddit", ts=dt.datetime(2024, 1, 1 + i % 3, 9))
            for i in range(12)]
    d = S.daily_sentiment(posts_flat(make_posts(rows)), by=["platform"])
    assert {r["platform"] for r in d.collect()} == {"twitter", "reddit"}
    t = S.trend_summary(posts_flat(make_posts(rows)), by=["platform"])
    assert t.count() == 2


def test_analyze_posts_runs(make_posts):
    rows = [post(i, f"text {i % 5}", ts=dt.datetime(2024, 1, 1 + i % 4, i % 24)) for i in range(30)]
    res = analyze_posts(make_posts(rows))
    assert res["deduplication"].first()["unique_posts"] == 5
    assert res["ts_daily_sentiment"].count() == 4
    assert {"engagement", "negative_users", "viral_posts", "ts_trend_summary"} <= set(res)


def test_write_analysis_round_trip(make_posts, spark):
    from chorus.sources import ingest as I2
    rows = [post(i, f"text {i}") for i in range(5)]
    p = make_posts(rows)
    res = {"by_platform": posts_flat(p).groupBy("platform").count()}
    base = tempfile.mkdtemp(prefix="chorus-analysis-")
    E.write_analysis(res, p, base)
    back = spark.read.schema(POST_SCHEMA).json(f"{base}/posts")
    assert back.count() == 5 and spark.read.json(f"{base}/by_platform").first()["count"] == 5
    assert I2.read_analysis_posts(spark, f"{base}/missing.json", POST_SCHEMA).count() == 0
