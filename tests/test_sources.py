import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from chorus.sources import ingest as I


def _write(lines):
    d = Path(tempfile.mkdtemp(prefix="chorus-src-"))
    p = d / "in.json"
    p.write_text("\n".join(json.dumps(x) for x in lines))
    return str(p)


def test_tweets(spark):
    raw = [{"id": str(i), "date": "2024-01-0%dT10:00:00" % (i + 1), "user": {"username": "u%d" % i, "id": "9"},
            "rawContent": "Test tweet %d #test @mention" % i, "likeCount": 10 * i, "retweetCount": 5 * i,
            "replyCount": 2 * i, "quoteCount": i, "url": None, "lang": "en"} for i in range(3)]
    raw[1]["inReplyToTweetId"] = "77"
    posts = {r["id"]: r for r in I.read_tweets(spark, _write(raw), "test").collect()}
    p = posts["2"]
    assert p["engagement"] == {"likes": 20.0, "retweets": 10.0, "replies": 4.0, "quotes": 2.0}
    assert p["metadata"]["hashtags"] == ["test"] and p["metadata"]["mentions"] == ["mention"]
    assert p["url"] == "https://twitter.com/i/status/2"
    assert posts["1"]["metadata"]["is_reply"] is True and posts["0"]["metadata"]["is_reply"] is False


def test_submissions(spark):
    raw = [{"id": "a", "title": "T", "selftext": None, "author": None, "created_utc": 1704067200.0, "score": 100,
            "num_comments": 3, "upvote_ratio": 0.0, "permalink": "/r/x/a"},
           {"id": "b", "title": "U", "selftext": "body", "author": "bob", "created_utc": 1704067200.0, "score": 101,
            "num_comments": 1, "upvote_ratio": 0.9, "permalink": "/r/x/b", "all_awardings": [{"id": "g"}]}]
    got = {r["id"]: r for r in I.read_submissions(spark, _write(raw), "q").collect()}
    assert got["a"]["author"] == "[deleted]" and got["a"]["content"] == ""
    assert got["a"]["engagement"]["upvotes"] == 100.0 and got["a"]["engagement"]["downvotes"] == 0.0
    assert got["b"]["engagement"]["upvotes"] == 90.0 and got["b"]["engagement"]["downvotes"] == 10.0
    assert got["b"]["metadata"]["awards"] == 1


def test_listing_defaults(spark):
    listing = {"data": {"children": [{"data": {"id": "x", "title": "t", "created_utc": 0.0}}, {"data": {}}]}}
    got = I.read_listings(spark, _write([listing]), "q").collect()
    assert len(got) == 1 and got[0]["engagement"]["upvote_ratio"] == 0.5 and got[0]["engagement"]["upvotes"] == 0.0


def test_comments_limit(spark):
    raw = [{"id": str(i), "author": None if i == 0 else "a", "body": "b", "score": i, "created_utc": 0.0,
            "is_submitter": False, "parent_id": "t3_s", "permalink": "/c", "submission_id": "s", "position": i}
           for i in range(5)]
    got = I.read_comments(spark, _write(raw), limit=3).collect()
    assert len(got) == 3 and {r["author"] for r in got} == {"[deleted]", "a"}


def test_tweet_media_coordinates_and_fallbacks(spark):
    raw = [{"id": "7", "date": "2024-01-01T00:00:00", "user": None, "rawContent": "see http://a.b/c #x",
            "media": [{"type": "photo"}, {"type": "video"}], "coordinates": {"latitude": 1.5, "longitude": -2.0},
            "retweetedTweet": {"id": "1"}, "outlinks": []}]
    p = I.read_tweets(spark, _write(raw), "q").first()
    md = p["metadata"]
    assert md["media_types"] == ["photo", "video"] and (md["coordinates"]["lat"], md["coordinates"]["lon"]) == (1.5, -2.0)
    assert md["is_retweet"] is True and md["urls"] == ["http://a.b/c"] and md["hashtags"] == ["x"]
    assert p["author"] == "unknown"


def test_listing_corrupt_lines_kept_aside(spark):
    d = Path(tempfile.mkdtemp(prefix="chorus-src-"))
    good = {"data": {"children": [{"data": {"id": "x", "title": "t", "created_utc": 0.0}}]}}
    (d / "l.json").write_text(json.dumps(good) + "\n{not json\n")
    bad = []
    posts = I.read_listings(spark, str(d / "l.json"), "q", bad_records=bad)
    assert posts.count() == 1 and bad[0].count() == 1


def test_comments_without_a_submission_are_told_apart(spark):
    rows = [("a", "t3_s1", "/r/x/comments/s1/t/a"), ("b", None, None), ("c", "t3_s2", None), ("d", "t1_a", "")]
    raw = spark.createDataFrame(rows, "id string, parent_id string, permalink string")
    for name, kind in (("author", "string"), ("body", "string"), ("score", "long"), ("created_utc", "double"), ("is_submitter", "boolean")):
        raw = raw.withColumn(name, F.lit(None).cast(kind))
    bad = []
    got = I.comments_to_rows(raw, bad_records=bad).collect()
    assert sorted((r["id"], r["submission_id"]) for r in got) == [("a", "s1"), ("c", "s2")]
    assert sorted(r["id"] for r in bad[0].collect()) == ["b", "d"]
