"""From landed files to every result: order numbers, united sources, empty inputs, long chains."""

import json

import pytest
from posts import post
from pyspark.sql import functions as F

from chorus.operators import dedup as D
from chorus.operators import filters as FL
from chorus.plans.analyze import analyze_posts
from chorus.plans.export import report_cuts, write_analysis
from chorus.schema import POST_SCHEMA, coerce_posts
from chorus.sources import ingest as I


def tweet(i, text):
    return {"id": str(i), "date": f"2024-01-{i % 9 + 1:02d}T10:00:00", "user": {"username": f"u{i % 3}", "id": str(i % 3)},
            "rawContent": text, "likeCount": i, "retweetCount": 1, "replyCount": 0}


def submission(i, text):
    return {"id": f"s{i}", "title": "t", "selftext": text, "author": "a", "created_utc": 1704100000.0 + i, "score": i,
            "num_comments": 1, "upvote_ratio": 0.5, "subreddit": f"r{i % 2}", "permalink": f"/r/r/comments/s{i}"}


@pytest.fixture
def landing(tmp_path):
    for name, rows in (("tweets", [tweet(i, f"text {i}") for i in range(4)]), ("reddit", [submission(i, f"text {i + 3}") for i in range(4)])):
        folder = tmp_path / name
        folder.mkdir()
        for k in range(2):
            (folder / f"part-{k}.json").write_text("\n".join(json.dumps(r) for r in rows[2 * k:2 * k + 2]))
    return tmp_path


def united(spark, landing):
    return I.union_sources(I.read_tweets(spark, f"{landing}/tweets", "q"), I.read_submissions(spark, f"{landing}/reddit", "q"))


def test_two_sources_keep_their_order_and_dedup_once(spark, landing):
    posts = united(spark, landing)
    assert [r["id"] for r in posts.orderBy("seq").collect()] == ["0", "1", "2", "3", "s0", "s1", "s2", "s3"]
    flags = {r["id_key"]: r["dup_type"] for r in D.dedup_flags(posts).collect()}
    assert len(flags) == 8 and [k for k, v in flags.items() if v] == ["reddit:s0"]  # repeats tweet 3
    assert D.unique_posts(posts).count() == 7


def test_every_result_of_the_analysis_from_files(spark, landing):
    results = analyze_posts(united(spark, landing))
    assert results["deduplication"].first()["unique_posts"] == 7
    for name, df in results.items():
        df.collect(), name
    assert set(report_cuts(results)) >= {"negative_users", "viral_posts", "ts_anomalies"}


def test_analysis_of_no_posts(spark):
    for name, df in analyze_posts(spark.createDataFrame([], POST_SCHEMA)).items():
        assert df.count() <= 7, name  # zero-filled weekdays at most


def test_repeated_seq_is_an_error(spark, make_posts):
    with pytest.raises(ValueError, match="not unique"):
        D.dedup_flags(make_posts([post(1, seq=5), post(2, seq=5)]))


def test_incremental_with_nothing_new(spark, make_posts):
    batch = make_posts([post(i, content=f"c{i}") for i in range(4)])
    _, seen = D.dedup_incremental(batch, spark.createDataFrame([], "id_key string, hash_key string"))
    again, _ = D.dedup_incremental(batch, seen)
    assert [r["kept"] for r in again.collect()] == [False] * 4
    empty, _ = D.dedup_incremental(make_posts([]), seen)
    assert empty.count() == 0


def test_chain_of_a_thousand_rows(spark):
    # rows (i, i) and (i, i + 1): each shares a key with the next; greedily every second row stays
    rows = [(s, f"i{(s + 1) // 2}", f"h{s // 2}") for s in range(1000)]
    kept, ids, hashes = [], set(), set()
    for s, i, h in rows:
        if i not in ids and h not in hashes:
            kept.append(s)
            ids.add(i)
            hashes.add(h)
    got = D.greedy_keep(spark.createDataFrame(rows, "seq long, id_key string, hash_key string"))
    assert sorted(r["seq"] for r in got.collect()) == kept


def test_zoned_stamps_are_utc(spark):
    df = spark.createDataFrame([("1", "2024-01-02T03:04:05Z"), ("2", "2024-01-02T03:04:05.250+02:00"), ("3", "x"), ("4", "2024-01-02")],
                               "id string, timestamp string")
    got = {r["id"]: str(r["timestamp"]) for r in coerce_posts(df, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {"1": "2024-01-02 03:04:05", "2": "2024-01-02 01:04:05.250000", "3": "1999-01-01 00:00:00", "4": "2024-01-02 00:00:00"}


def test_comments_find_their_submission(spark, tmp_path):
    rows = [{"id": f"c{s}_{i}", "author": "a", "body": "b", "score": i, "created_utc": 1.0 * i, "permalink": f"/r/x/comments/s{s}/t/c{i}/"}
            for s in range(50) for i in range(10)]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    got = I.read_comments(spark, str(tmp_path / "c.json"), limit=4)
    assert got.count() == 200 and got.select("submission_id").distinct().count() == 50
    (tmp_path / "bad.json").write_text(json.dumps({"id": "x", "body": "b"}))
    with pytest.raises(Exception, match="without a submission"):
        I.read_comments(spark, str(tmp_path / "bad.json")).collect()


def test_analysis_document_shapes(spark, tmp_path, make_posts):
    posts = make_posts([post(i) for i in range(3)])
    write_analysis({"by": posts.groupBy("platform").count()}, posts, str(tmp_path / "doc"))
    for path in (str(tmp_path / "doc"), f"file://{tmp_path}/doc"):
        assert I.read_analysis_posts(spark, path, POST_SCHEMA).count() == 3
    bare = [{"id": "1", "platform": "twitter", "content": "x"}, {"id": "2", "platform": "reddit"}]
    (tmp_path / "bare.json").write_text(json.dumps(bare))
    (tmp_path / "doc.json").write_text(json.dumps({"metadata": {}, "posts": bare}))
    for name in ("bare.json", "doc.json"):
        back = I.read_analysis_posts(spark, f"file://{tmp_path}/{name}", POST_SCHEMA)
        assert [r["id"] for r in back.orderBy("seq").collect()] == ["1", "2"], name
    assert I.read_analysis_posts(spark, str(tmp_path / "none.json"), POST_SCHEMA).count() == 0


def test_read_texts_are_numbered_without_a_shuffle_or_a_plain_copy(spark, landing):
    tweets = I.read_tweets(spark, f"{landing}/tweets", "q")
    plan = tweets.select("seq", "content")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "FileScan parquet" in plan and "Scan ExistingRDD" not in plan
    assert [r["id"] for r in tweets.orderBy("seq").collect()] == ["0", "1", "2", "3"]


def test_percentiles_equal_the_built_in(spark):
    from chorus.operators.aggregate import percentiles
    df = spark.range(1000).select((F.col("id") * F.col("id") % 97).cast("double").alias("x"))
    ps = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    want = df.agg(*[F.percentile("x", p).alias(f"p{i}") for i, p in enumerate(ps)]).first()
    assert percentiles(df, "x", ps).first().asDict() == pytest.approx(want.asDict())
    assert percentiles(df.limit(0), "x", [0.5]).first()["p0"] is None


def test_limit_per_subreddit(make_posts):
    posts = make_posts([post(i, platform="reddit", subreddit=f"s{i % 3}") for i in range(30)])
    assert FL.limit_per_subreddit(posts, 4).count() == 12
    assert FL.limit_per_subreddit(posts, 4, total=5).count() == 8


def test_unions_of_unions_keep_order_and_never_share_numbers(spark, landing):
    tweets, reddit = I.read_tweets(spark, f"{landing}/tweets", "q"), I.read_submissions(spark, f"{landing}/reddit", "q")
    nested = I.union_sources(I.union_sources(tweets, spark.createDataFrame([], POST_SCHEMA)), I.union_sources(reddit, tweets))
    flat = I.union_sources(tweets, reddit, tweets)
    for posts in (nested, flat):
        rows = posts.orderBy("seq").collect()
        assert [r["id"] for r in rows] == ["0", "1", "2", "3", "s0", "s1", "s2", "s3", "0", "1", "2", "3"]
        assert len({r["seq"] for r in rows}) == 12
        flags = D.dedup_flags(posts).orderBy("seq").collect()
        assert [r["dup_type"] for r in flags] == [None] * 4 + ["content"] + [None] * 3 + ["exact_id"] * 4
    many = I.union_sources(*[tweets] * 12)
    assert many.count() == many.select("seq").distinct().count() == 48
