import datetime as dt

import pytest

from posts import post

from chorus.operators import aggregate as A
from chorus.operators.project import posts_flat


def flat(make_posts, rows):
    return posts_flat(make_posts(rows))


def test_distribution(make_posts):
    f = flat(make_posts, [post(i, f"t{i}", label=l) for i, l in enumerate(["POSITIVE", "NEGATIVE", "NEUTRAL", "POSITIVE"], 1)])
    counts = {r["sentiment"]: r["count"] for r in A.sentiment_distribution(f).collect()}
    assert counts == {"POSITIVE": 2, "NEGATIVE": 1, "NEUTRAL": 1}
    s = A.sentiment_summary(f).first()
    assert s["sentiment_ratio"] == 0.25 and s["dominant_sentiment"] == "POSITIVE"


def test_platform(make_posts):
    f = flat(make_posts, [post(1, "a"), post(2, "b"), post(3, "c", platform="reddit")])
    assert {r["platform"]: r["count"] for r in A.by_platform(f).collect()} == {"twitter": 2, "reddit": 1}


def test_engagement(make_posts):
    f = flat(make_posts, [post(1, "a", likes=100, retweets=50), post(2, "b", likes=200, retweets=100),
                          post(3, "c", likes=0, retweets=0)])
    e = A.engagement_stats(f).first()
    assert (e["total_likes"], e["total_shares"], e["avg_likes"], e["max_likes"], e["zero_engagement_posts"]) == \
        (300, 150, 100.0, 200, 1)


def test_authors(make_posts):
    f = flat(make_posts, [post(1, "a", author="user1"), post(2, "b", author="user1"), post(3, "c", author="user1"),
                          post(4, "d", author="user2")])
    a = A.author_stats(f).first()
    assert (a["unique_authors"], a["single_post_authors"], a["max_posts"]) == (2, 1, 3)
    assert A.most_active_authors(f).first()["author"] == "user1"


def test_temporal(make_posts):
    day = dt.datetime(2024, 1, 10)
    rows = [post(i, f"t{i}", ts=day.replace(hour=9, minute=i)) for i in range(3)] + \
           [post(10 + i, f"u{i}", ts=day.replace(hour=20, minute=i)) for i in range(2)]
    f = flat(make_posts, rows)
    assert {r["hour"]: r["count"] for r in A.posts_by_hour(f).collect()} == {9: 3, 20: 2}
    t = A.temporal_summary(f).first()
    assert t["peak_hour"] == 9 and t["evening_posts"] == 2
    dow = {r["day_of_week"]: r["count"] for r in A.posts_by_day_of_week(f).collect()}
    assert dow["Wednesday"] == 5 and dow["Monday"] == 0 and len(dow) == 7


def test_negative_users(make_posts):
    rows = [post(i, f"n{i}", author="negative_user", label="NEGATIVE") for i in range(4)] + \
           [post(10, "p", author="negative_user", label="POSITIVE")] + \
           [post(20 + i, f"p{i}", author="positive_user", label="POSITIVE") for i in range(3)] + \
           [post(30, "n", author="positive_user", label="NEGATIVE")]
    top = A.negative_users(flat(make_posts, rows)).first()
    assert top["author"] == "negative_user" and top["negative_ratio"] == 0.8


def test_hashtags(make_posts):
    rows = [post(i, f"t{i}", hashtags=["python"]) for i in range(5)] + \
           [post(10 + i, f"u{i}", hashtags=["Data"]) for i in range(3)]
    p = make_posts(rows)
    top = {r["term"]: r["count"] for r in A.top_terms(p, "hashtags").collect()}
    assert top == {"python": 5, "data": 3}
    assert A.term_summary(p, "hashtags").first()["unique_terms"] == 2


def test_viral(make_posts):
    rows = [post(1, "a", likes=10, retweets=5), post(2, "b", likes=20, retweets=10),
            post(3, "c", likes=15, retweets=8), post(4, "viral", likes=1000, retweets=500)]
    f = posts_flat(make_posts(rows), keep=["content", "url"])
    v = A.viral_posts(f).collect()
    assert len(v) == 1 and v[0]["engagement"] == 1500
    assert A.viral_threshold(f).first()["threshold"] == pytest.approx(1059.0)


def test_leaders(make_posts):
    rows = [post(i, f"p{i}", author="positive_leader", likes=1000, retweets=500) for i in range(3)] + \
           [post(10, "q", author="neutral_user", label="NEUTRAL", likes=10, retweets=5),
            post(11, "r", author="neutral_user", label="NEUTRAL", likes=10, retweets=5)]
    leaders = A.sentiment_leaders(flat(make_posts, rows)).filter("sentiment = 'positive'").collect()
    assert leaders[0]["author"] == "positive_leader"


def test_empty_input(make_posts):
    f = flat(make_posts, [])
    assert A.by_platform(f).count() == 0
    assert A.negative_users(f).count() == 0
    assert A.date_range(f).first()["total_posts"] == 0


def test_heatmap_wide(make_posts):
    rows = [post(1, "a", likes=10, retweets=5, ts=dt.datetime(2024, 1, 10, 9)),
            post(2, "b", likes=20, retweets=5, ts=dt.datetime(2024, 1, 10, 9))]
    w = A.engagement_heatmap(make_posts(rows), wide=True).first()
    assert w["day"] == "Wednesday" and w["9"] == 20.0 and w["10"] is None and len(w) == 25


def test_statistics_from_value_cells_equal_pandas(make_posts):
    import numpy as np
    rng = np.random.default_rng(3)
    likes = rng.integers(0, 60, 300)
    authors = [None if a == 0 else f"u{a}" for a in rng.zipf(1.6, 300) % 40]
    rows = [post(i, "x" * (i % 17), author=authors[i], likes=int(likes[i]), retweets=int(likes[i]) // 3) for i in range(300)]
    f = flat(make_posts, rows).persist()
    e = np.array([r["engagement_total"] for r in f.select("engagement_total").collect()], float)
    got = A.engagement_stats(f).first()
    assert (got["median_engagement"], got["engagement_std"]) == (pytest.approx(np.median(e)), pytest.approx(e.std(ddof=1)))
    assert got["high_engagement_posts"] == (e > e.mean() + e.std(ddof=1)).sum() and got["total_engagement"] == e.sum()
    counts = np.sort(np.unique([a for a in authors if a], return_counts=True)[1])
    a = A.author_stats(f).first()
    assert (a["unique_authors"], a["median_posts"], a["single_post_authors"]) == (len(counts), np.median(counts), (counts == 1).sum())
    assert a["author_concentration"] == pytest.approx(counts[-10:].sum() / 300)
    c = A.content_stats(f).first()
    lengths = np.array([i % 17 for i in range(300)])
    assert (c["avg_length"], c["median_length"], c["max_length"]) == (pytest.approx(lengths.mean()), np.median(lengths), 16)


def test_statistics_of_no_posts_and_of_one(make_posts):
    none = flat(make_posts, [post(1, "a")]).limit(0)
    e, a, c = (f(none).first() for f in (A.engagement_stats, A.author_stats, A.content_stats))
    assert e["total_engagement"] is None and e["zero_engagement_posts"] == 0 and e["median_engagement"] is None
    assert (a["unique_authors"], a["single_post_authors"], a["max_posts"]) == (0, 0, None)
    assert c["with_title"] == 0 and c["median_length"] is None and A.viral_threshold(none).first()["threshold"] is None
    one = A.engagement_stats(flat(make_posts, [post(1, "a", likes=5, retweets=0)])).first()
    assert one["engagement_std"] is None and one["high_engagement_posts"] == 0
    nobody = A.author_stats(flat(make_posts, [post(1, "a", author=None)])).first()
    assert nobody["unique_authors"] == 0 and nobody["median_posts"] is None


def test_summary_reads_the_posts_once(make_posts, tmp_path, spark):
    from chorus.plans import export as E
    flat(make_posts, [post(i, f"t{i}", author=f"u{i % 3}") for i in range(30)]).write.parquet(str(tmp_path / "flat"))
    f = spark.read.parquet(str(tmp_path / "flat"))
    for out in (E.summary_document(f), E.export_summary_statistics(f)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan and out.count() > 0  # parts read the written narrow table
