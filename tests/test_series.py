import datetime as dt

import pytest
from posts import post

from chorus.operators import series as S
from chorus.operators.project import posts_flat


def day(d, h=12, m=0):
    return dt.datetime(2024, 1, d, h, m)


def test_daily_counts(make_posts):
    rows = [post(1, "a", ts=day(1)), post(2, "b", ts=day(1, 13)), post(3, "c", label="NEGATIVE", ts=day(1, 14)),
            post(4, "d", ts=day(2)), post(5, "e", label="NEGATIVE", ts=day(2, 13)),
            post(6, "f", label="NEGATIVE", ts=day(2, 14))]
    d = {r["date"]: (r["positive"], r["negative"], r["total"]) for r in S.daily_sentiment(posts_flat(make_posts(rows))).collect()}
    assert d == {"2024-01-01": (2, 1, 3), "2024-01-02": (1, 2, 3)}


@pytest.fixture
def gap_flat(make_posts):
    # daily means 1.0, (gap), 0.0, -1.0 with 7 posts
    rows = [post(1, "a", ts=day(1)), post(2, "b", ts=day(1, 13)), post(3, "c", ts=day(1, 14)),
            post(4, "d", label="NEUTRAL", ts=day(3)), post(5, "e", label="NEUTRAL", ts=day(3, 13)),
            post(6, "f", label="NEGATIVE", ts=day(4)), post(7, "g", label="NEGATIVE", ts=day(4, 13))]
    return posts_flat(make_posts(rows))


def test_gap_moving_averages(gap_flat):
    t = {r["date"]: (r["ma_3"], r["ma_7"]) for r in S.daily_trend(gap_flat).collect()}
    assert [t[f"2024-01-0{d}"] for d in (1, 2, 3, 4)] == [(1.0, 1.0), (1.0, 1.0), (0.5, 0.5), (-0.5, 0.0)]


def test_gap_trend_summary(gap_flat):
    s = S.trend_summary(gap_flat).first()
    assert s["slope"] == pytest.approx(-9 / 14)
    assert s["overall_trend"] == "worsening"
    assert s["trend_strength"] == 2.0
    assert (s["momentum_1_day"], s["momentum_3_day"], s["momentum_7_day"]) == (-1.0, -2.0, None)
    assert s["acceleration"] is None and s["momentum_direction"] == "negative"
    assert s["trend_consistency"] == 0.0
    assert S.turning_points(gap_flat).count() == 0
    assert S.volatility(gap_flat).first()["daily"] is None


def test_anomaly(make_posts):
    rows = []
    for d in range(1, 10):
        rows += [post(d * 10, "p", ts=day(d)), post(d * 10 + 1, "n", label="NEGATIVE", ts=day(d, 13))]
    rows += [post(200, "x", label="NEGATIVE", ts=day(10)), post(201, "y", label="NEGATIVE", ts=day(10, 13))]
    a = S.anomalies(posts_flat(make_posts(rows))).collect()
    assert a[0]["type"] == "negative_spike" and a[0]["date"] == "2024-01-10"


def test_peak_hour(make_posts):
    rows = [post(d * 100 + i, "p", ts=day(d, 15, i)) for d in (1, 2, 3) for i in range(10)]
    rows += [post(900 + d, "q", ts=day(d, 9)) for d in (1, 2, 3)]
    p = S.peak_hours(posts_flat(make_posts(rows))).first()
    assert p["hour_of_day"] == 15 and p["post_count"] == 10


def test_periodicity(make_posts):
    rows = [post(d * 100 + h, "m", ts=day(d, h)) for d in range(1, 6) for h in (6, 8, 10)]
    rows += [post(d * 100 + h, "e", label="NEGATIVE", ts=day(d, h)) for d in range(1, 6) for h in (18, 20)]
    s = {r["kind"]: r for r in S.periodicity_summary(posts_flat(make_posts(rows))).collect()}
    assert 6 <= s["hour"]["most_positive"] <= 11 and 18 <= s["hour"]["most_negative"] <= 21


def test_forecast_half_split(make_posts):
    rows = [post(i, f"t{i}", label="POSITIVE" if i < 8 else ("NEGATIVE" if i % 2 else "POSITIVE"),
                 ts=day(1 + i // 5, 10, i)) for i in range(16)]
    f = S.forecast_indicators(posts_flat(make_posts(rows))).first()
    assert f["volatility_trend"] == "increasing"


def test_time_rank_exact_with_hot_timestamp(spark, make_posts):
    import random
    rnd = random.Random(5)
    hot = day(2, 12)
    rows = [post(s, "t", ts=hot if rnd.random() < 0.4 else day(1 + rnd.randrange(5), rnd.randrange(24)), seq=s)
            for s in rnd.sample(range(10_000), 300)]
    f = posts_flat(make_posts(rows).repartition(7))
    got = {r["seq"]: r["rank"] for r in S.time_rank(f).collect()}
    want = {seq: i for i, (_, seq) in enumerate(sorted((r[7], r[0]) for r in rows))}
    assert got == want
