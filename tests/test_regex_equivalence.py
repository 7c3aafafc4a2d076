"""The fused regex passes equal the reference's step-by-step chains."""
import random

from pyspark.sql import functions as F

from chorus.functions import text as X
from chorus.operators import keywords as W


def sequential_normalize(c):
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, X.URL, "")
    t = F.regexp_replace(t, X.MENTION, "")
    t = F.regexp_replace(t, X.HASHTAG, "$1")
    t = F.regexp_replace(t, X.NOT_WORD_OR_SPACE, " ")
    return X.collapse_space(t)


def sequential_clean(c):
    t = X.demojize(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, X.URL, "")
    t = F.regexp_replace(t, rf"@({X.WORD}+)", "$1")
    t = F.regexp_replace(t, X.HASHTAG, "$1")
    return X.collapse_space(t)


def sequential_keyword_tokens(c):
    t = F.regexp_replace(c, X.HTTP_URL, "")
    t = F.regexp_replace(t, X.MENTION, "")
    t = F.regexp_replace(t, X.HASHTAG, "$1")
    t = F.regexp_replace(t, X.NOT_WORD_OR_SPACE, " ")
    t = F.regexp_replace(t, X.DIGITS, "")
    words = F.split(F.lower(t), f"{X.SPACE}+")
    return F.filter(words, lambda w: F.char_length(w) >= 3)


def test_fused_equals_sequential(spark):
    tricky = ["#@abc", "@#abc", "##@abc", "@@abc", "a#@b", "@bobhttps://x y", "#ab@cd", "a@b#c", "#", "@",
              "x #@ y", "Hi, @Bob! #Tag2 http://a.b/c?d=1 www.z.org ok", " #é@é x", "##", "@@", "#@",
              "a1b 2 c3d", "ends with #", "tab\there\nnew"]
    rnd = random.Random(3)
    alphabet = list("#@htp:/.1 aéZ_") + [" ", "\t"]
    tricky += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "i int, t string")
    c = F.col("t")
    kw_text = F.concat(F.lit(" "), c)
    fused_tokens = F.filter(F.split(W.keyword_text("_title", "t"), " "), lambda w: F.char_length(w) >= 3)
    out = df.withColumn("_title", F.lit("")).select(
        "t",
        (X.normalize_content(c) == sequential_normalize(c)).alias("norm"),
        (X.clean_text(c) == sequential_clean(c)).alias("clean"),
        (fused_tokens == sequential_keyword_tokens(kw_text)).alias("kw"))
    bad = out.filter(~(F.col("norm") & F.col("clean") & F.col("kw"))).collect()
    assert bad == []
