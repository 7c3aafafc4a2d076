from posts import post

from chorus.functions import columns as C
from chorus.functions import text as X
from chorus.operators import sentiment as N
from chorus.operators import keywords as W
from pyspark.sql import functions as F


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_cleaner(spark):
    assert one(spark, X.clean_text, "Check https://example.com now") == "Check now"
    assert one(spark, X.clean_text, "hi @user1 there") == "hi user1 there"
    assert one(spark, X.clean_text, "#Python #Programming") == "Python Programming"


def test_normalize_unicode_words(spark):
    assert one(spark, X.normalize_content, "Héllo, Wörld!  #Tag @bob https://x.y/z") == "héllo wörld tag"
    assert one(spark, X.normalize_content, None) == ""


def test_labels(spark):
    for raw, want in [("POS", "POSITIVE"), (" neg ", "NEGATIVE"), ("NE", "NEUTRAL"), ("other", "OTHER")]:
        assert one(spark, C.canonical_label, raw) == want


def test_truncate(spark):
    s = one(spark, lambda c: C.truncate_suffix(c, 100), "a" * 200)
    assert len(s) == 100 and s.endswith("...")
    assert one(spark, lambda c: C.truncate_suffix(c, 100), None) == ""


def test_engagement_score(make_posts):
    from chorus.operators.project import posts_flat
    f = posts_flat(make_posts([post(1, "x", engagement={"likes": 10.0, "retweets": 5.0})]))
    assert f.first()["engagement_total"] == 15.0


def test_sentiment_components(make_posts):
    p = make_posts([post(1, "This is great and I love it!", title=None),
                    post(2, "terrible awful bad??"), post(3, "plain words here")])
    got = {r["seq"]: r["sentiment"] for r in N.score_posts(p).collect()}
    assert got[1]["label"] == "POSITIVE" and got[2]["label"] == "NEGATIVE" and got[3]["label"] == "NEUTRAL"
    assert got[1]["details"]["emphasis"] == 1.0 and got[2]["details"]["emphasis"] == -2.0
    assert got[1]["method"] == "comprehensive" and got[1]["score"] == abs(got[1]["compound"])


def test_keywords(make_posts):
    p = make_posts([post(1, "Spark engines process 2024 datasets quickly", title="Fast spark"),
                    post(2, "the and but spark")])
    words = {r["word"]: r["count"] for r in W.word_frequencies(p).collect()}
    assert words["spark"] == 3 and "the" not in words and "2024" not in words


def test_emoji_and_demojize(spark):
    df = spark.createDataFrame([("love it \U0001F604\U0001F604",), ("\U0001F604 \U0001F620",), ("no emoji!?",)], "t string")
    got = [r[0] for r in df.select(N.emoji_score(F.col("t"))).collect()]
    assert got == [1.0, 0.0, 0.0]
    assert one(spark, X.clean_text, "hi\U0001F44Dthere") == "hi thumbs_up there"
    assert one(spark, lambda c: X.char_count(c, "!"), "a!b!!") == 3


def test_every_name_of_an_emoji_table(spark):
    names = X.emoji_names()
    assert len(names) > 1000 and names["\U0001F604"] == "smile" and all(n.strip() and " " not in n for n in names.values())
    df = spark.createDataFrame([(f"a{e}b{e}", n) for e, n in names.items()], "t string, n string")
    got = df.select(X.demojize(F.col("t")).alias("t"), "n").collect()
    assert [r["t"] for r in got] == [f"a {r['n']} b {r['n']} " for r in got]


def test_emoji_sequences_longest_first_with_joiners_and_tones(spark):
    man, laptop, zwj, tone, vs = "\U0001F468", "\U0001F4BB", "‍", "\U0001F3FD", "️"
    names = {man: "man", laptop: "laptop", man + zwj + laptop: "man_technologist", man + tone + zwj + laptop: "dark_technologist", "❤": "red_heart",
             "\U0001F1E9\U0001F1EA": "germany"}
    texts = {f"x{man}{zwj}{laptop}y": "x man_technologist y", f"{man}{tone}{zwj}{laptop}": " dark_technologist ", f"{man}{tone}!": " man_medium_skin_tone !",
             f"{man}{laptop}{man}": " man  laptop  man ", f"❤{vs}❤": " red_heart  red_heart ", "\U0001F1E9\U0001F1EA": " germany ",
             "plain": "plain", "": "", "\U0001F600": "\U0001F600"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", X.demojize(F.col("t"), names).alias("d")).collect()} == texts
    assert df.select(X.demojize(F.col("t"), {}).alias("d")).first()["d"] is not None


def test_word_classes_by_table_ending_and_default(spark):
    tags = spark.createDataFrame([("running", "V"), ("singing", "V"), ("evening", "N"), ("quick", "A"), ("quick", "R"), ("slowly", "R"), (None, "V"), ("x", None)],
                                 "word string, tag string")
    words = spark.createDataFrame([(w,) for w in ("evening", "ringing", "quick", "badly", "zzz", "x")], "word string")
    got = {r["word"]: r["tag"] for r in W.word_tags(words, tags).collect()}
    assert got == {"evening": "N", "ringing": "V", "quick": "A", "badly": "R", "zzz": "N", "x": "N"}
    none = W.word_tags(words, tags.limit(0)).collect()
    assert {r["tag"] for r in none} == {"N"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_handed_over_once_for_all_passes(make_posts):
    posts = make_posts([post(1, "Good, good #day @bob https://x.y!"), post(2, None), post(3, "Été  © bad")])
    c = X.clean_text(F.col("content"))
    for df in (posts.select(c, F.length(c)), posts.select(*X.text_feature_columns(F.col("content"))), N.vader_only(posts), N.score_posts(posts)):
        assert "ArrowEvalPython" in plan(df) and "regexp_replace" not in plan(df)
    assert [r[0] for r in posts.select(c).collect()] == ["Good, good day bob", "", "Été copyright_sign bad"]
    assert posts.select(*X.text_feature_columns(F.col("content"))).collect()[1]["num_words"] is None


def test_words_are_counted_before_they_move(make_posts):
    posts = make_posts([post(i, "Data, d4ta data spät SPÄT https://a.b www.data", title=None) for i in range(30)])
    counts = W.word_frequencies(posts)
    assert "MapInArrow" in plan(counts) and "Generate" not in plan(counts)
    assert {r["word"]: r["count"] for r in counts.collect()} == {"data": 90, "dta": 30, "spät": 60}


def test_lexicon_table_reads_texts_once(make_posts):
    posts = make_posts([post(1, "good good bad", seq=1), post(2, "good", seq=1), post(3, "", seq=3), post(4, "zzz", seq=4)])
    lexicon = posts.sparkSession.createDataFrame([("good", 1, 2.0), ("bad", -1, None)], "word string, polarity int, valence double")
    scores = N.lexicon_table_scores(posts, lexicon)
    assert plan(scores).count("MapInArrow") == 1
    got = sorted((r["seq"], round(r["lexicon"], 6), round(r["textblob"], 6)) for r in scores.collect())
    assert got == [(1, round(2 / 3, 6), 0.5), (1, 2.0, 0.5), (3, 0.0, 0.0), (4, 0.0, 0.0)]


def test_scatter_sample_hands_on_no_whole_text(make_posts):
    from chorus.operators import filters as FL
    posts = make_posts([post(i, "x" * 300, label=None if i == 2 else "POSITIVE") for i in range(12)])
    sample = FL.scatter_sample(posts)
    assert " content#" not in plan(sample).split("Project")[0] and len(sample.collect()) == 11
    limit = [line for line in plan(sample).splitlines() if "Limit" in line or "Sort [" in line]
    assert limit and "substring" in plan(sample)[plan(sample).index("Sort ["):]
