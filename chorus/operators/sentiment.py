"""Lexicon sentiment scoring.

The reference combines three per-row NLP libraries with a word lexicon, an
emoji score and punctuation emphasis.  Here every component is a column of the
text: one Arrow function cleans it, cuts it into tokens and gives the few that
a lexicon knows, from which native expressions make the scores, so scoring is a
narrow (shuffle-free) projection that runs wherever the posts are.  The library rule engines are re-aimed as
a valence lexicon (N6) with the usual ``s / sqrt(s² + 15)`` normalisation;
their negation and booster rules are not reproduced, so labels will differ
from the reference's on real text — every downstream operator reads only the
resulting ``sentiment`` column.

Lexicons are parameters: small ``{word: polarity}`` / ``{word: valence}``
dicts go along with the function (the built-in ones below are seeds), and a lexicon
of any size is a table (``word, polarity, valence``) joined to the tokens:
:func:`lexicon_table_scores`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions import columns as C
from chorus.functions import text as X
from chorus.schema import sentiment_struct

# Seed opinion lexicon (+1 positive, -1 negative).
OPINION_WORDS = {
    **{w: 1 for w in ["good", "great", "excellent", "amazing", "love", "loved", "happy", "nice", "best",
                      "wonderful", "awesome", "fantastic", "like", "enjoy", "enjoyed", "perfect", "brilliant",
                      "glad", "pleased", "beautiful", "success", "win", "fun", "helpful", "thanks", "recommend",
                      "impressive", "positive", "superb", "delightful"]},
    **{w: -1 for w in ["bad", "terrible", "awful", "hate", "hated", "sad", "angry", "worst", "poor", "horrible",
                       "broken", "fail", "failed", "failure", "error", "problem", "wrong", "annoying", "disappointed",
                       "disappointing", "ugly", "slow", "bug", "crash", "useless", "negative", "boring", "waste",
                       "scam", "sucks"]},
}
# Seed valence lexicon (word → valence in [-4, 4]).
VALENCE_WORDS = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "amazing": 2.8, "love": 3.2, "happy": 2.7, "nice": 1.8,
    "best": 3.2, "wonderful": 2.7, "awesome": 3.1, "fantastic": 2.6, "like": 1.5, "enjoy": 2.2, "perfect": 2.7,
    "glad": 2.0, "fun": 2.3, "thanks": 1.9, "win": 2.8, "success": 2.7, "helpful": 1.8,
    "bad": -2.5, "terrible": -2.1, "awful": -2.0, "hate": -2.7, "sad": -2.1, "angry": -2.3, "worst": -3.1,
    "poor": -2.1, "horrible": -2.5, "fail": -2.5, "failed": -2.3, "error": -1.7, "problem": -1.7, "wrong": -2.1,
    "annoying": -1.7, "disappointed": -1.9, "ugly": -2.3, "useless": -1.8, "boring": -1.3, "scam": -2.6,
}
VALENCE_ALPHA = 15.0  # normalisation constant of the compound score
THRESHOLD = 0.05      # |compound| below this is NEUTRAL


def _token_hits(lexicon: dict, valence: dict):
    tokens = X.tokenizer()

    def hits(t: str) -> dict:
        found, toks = {}, tokens(t)
        for w in toks:
            if w in lexicon or w in valence:
                found[w] = found.get(w, 0) + 1
        return {"n": len(toks), "hits": [{"c": c, "p": lexicon.get(w), "v": valence.get(w)} for w, c in found.items()]}
    return hits


def token_hits(text, lexicon: dict | None = None, valence: dict | None = None) -> Column:
    """``n`` tokens of a cleaned text, and ``hits``: its different words that a lexicon knows, in order of first place,
    with occurrence count ``c``, polarity ``p`` and valence ``v`` (null: not in that lexicon)."""
    opinion, val = ({k: float(v) for k, v in d.items()} for d in (lexicon or OPINION_WORDS, valence or VALENCE_WORDS))
    return X.text_function(text, lambda: _token_hits(opinion, val), "struct<n:int,hits:array<struct<c:int,p:double,v:double>>>")


def _emoji_scorer():
    positive, negative = list(X.POSITIVE_EMOJI.values()), list(X.NEGATIVE_EMOJI.values())

    def score(t: str) -> float:
        if t.isascii():
            return 0.0
        p, n = sum(e in t for e in positive), sum(e in t for e in negative)
        return (p - n) / (p + n) if p + n else 0.0
    return score


def _emphasis():
    def marks(t: str) -> float:
        return float(t.count("!") - t.count("?"))
    return marks


def emoji_score(raw_text) -> Column:
    """Listed emoji present (distinct, not occurrences): ``(p − n) / (p + n)``, else 0."""
    return X.text_function(raw_text, _emoji_scorer, "double")


def emphasis(raw_text) -> Column:
    """``!`` count minus ``?`` count on the raw text."""
    return X.text_function(raw_text, _emphasis, "double")


_CHUNK = 500_000  # rows of words that a task hands on at once


def _word_rows(rows: int):
    tokens = X.tokenizer()

    def run(batches):
        for batch in batches:
            at, lengths, sizes, words, counts = 0, [], [], [], []

            def emit(end):
                each = pa.array(np.repeat(np.arange(at, end), sizes))
                return pa.RecordBatch.from_arrays(
                    [batch.column("seq").take(each), batch.column("row").take(each), pa.array(np.repeat(lengths, sizes), pa.int32()),
                     pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["seq", "row", "n", "word", "c"])
            texts = batch.column("t").to_pylist()
            for i, t in enumerate(texts):
                toks, found = tokens(t), {}
                for w in toks:
                    found[w] = found.get(w, 0) + 1
                lengths.append(len(toks))
                sizes.append(max(len(found), 1))
                words += found or [None]
                counts += found.values() or [0]
                if len(words) >= rows:
                    yield emit(i + 1)
                    at, lengths, sizes, words, counts = i + 1, [], [], [], []
            if words:
                yield emit(len(texts))
    return run


#: A lexicon of up to so many words is sent to every task; a larger one meets the words by a shuffle.
_SMALL = 200_000


def lexicon_table_scores(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """N1 and N6 with a lexicon table: ``seq, lexicon, vader, textblob``.

    ``lexicon`` has ``word`` (distinct), ``polarity`` and ``valence`` (either may be null).  Tokens are
    counted per post before they meet the table, so a word that fills a third of a text moves once.  Each text is
    read once: its words carry its length, meet the table where they are (a lexicon of ``_SMALL`` words and more: by
    a shuffle) and are summed per post before anything else moves.  Posts without a match score 0.
    """
    words = posts.select("seq", F.monotonically_increasing_id().alias("row"), F.make_valid_utf8(C.scoring_text()).alias("t")).mapInArrow(
        _word_rows(_CHUNK), f"seq {posts.schema['seq'].dataType.simpleString()}, row long, n int, word string, c long")
    table = lexicon.select("word", "polarity", "valence")
    if table.limit(_SMALL + 1).count() <= _SMALL:
        table = F.broadcast(table)
    per_post = words.join(table, "word", "left").groupBy("seq", "row", "n").agg(
        F.sum(F.when(F.col("polarity") > 0, F.col("c")).when(F.col("polarity") < 0, -F.col("c")).otherwise(0)).alias("net"),
        F.sum(F.coalesce(F.col("valence") * F.col("c"), F.lit(0.0))).alias("s"),
        F.sum(F.when(F.col("valence").isNotNull(), F.col("c")).otherwise(0)).alias("m"))
    # posts of one number share their hits; a post without a number has none
    same = Window.partitionBy("seq")
    of = lambda c: F.when(F.col("seq").isNotNull(), F.sum(c).over(same)).otherwise(F.lit(0))
    j = per_post.select("seq", "n", *[of(c).alias(c) for c in ("net", "s", "m")])
    s = F.col("s")
    return j.select("seq", F.when(F.col("n") > 0, F.col("net") / F.col("n")).otherwise(F.lit(0.0)).alias("lexicon"),
                    (s / F.sqrt(s * s + F.lit(VALENCE_ALPHA))).alias("vader"),
                    F.when(F.col("m") > 0, s / F.col("m") / 4.0).otherwise(F.lit(0.0)).alias("textblob"))


def threshold_label(compound) -> Column:
    """≥ 0.05 POSITIVE, ≤ −0.05 NEGATIVE, else NEUTRAL."""
    c = compound if isinstance(compound, Column) else F.col(compound)
    return (F.when(c >= THRESHOLD, F.lit("POSITIVE"))
             .when(c <= -THRESHOLD, F.lit("NEGATIVE"))
             .otherwise(F.lit("NEUTRAL")))


def hit_scores(found: Column):
    """(vader, textblob, lexicon) from :func:`token_hits`.

    N6: compound = s / sqrt(s² + α) of the summed valence; polarity = mean valence / 4 over matched tokens (0 when
    none match).  N1: positive minus negative tokens over all tokens.
    """
    hits, n_tokens = found["hits"], found["n"]
    agg = lambda f, zero: F.aggregate(hits, zero, f)
    pos = agg(lambda a, h: a + F.when(h["p"] > 0, h["c"]).otherwise(0), F.lit(0))
    neg = agg(lambda a, h: a + F.when(h["p"] < 0, h["c"]).otherwise(0), F.lit(0))
    s = agg(lambda a, h: a + F.coalesce(h["v"], F.lit(0.0)) * h["c"], F.lit(0.0))
    m = agg(lambda a, h: a + F.when(h["v"].isNotNull(), h["c"]).otherwise(0), F.lit(0))
    vader = s / F.sqrt(s * s + F.lit(VALENCE_ALPHA))
    blob = F.when(m > 0, s / m / 4.0).otherwise(F.lit(0.0))
    lex = F.when(n_tokens > 0, (pos - neg) / n_tokens).otherwise(F.lit(0.0))
    return vader, blob, lex


def score_posts(posts: DataFrame, lexicon: dict | None = None, valence: dict | None = None) -> DataFrame:
    """Attach the combined sentiment to every post (scoring text P11).

    ``sentiment`` = {label, score = |combined|, method 'comprehensive',
    compound, original_text = first 200 chars, details}.
    """
    text = F.col("_text")
    found = posts.withColumn("_text", C.scoring_text()).select(
        "*", token_hits(text, lexicon, valence).alias("_found"), emoji_score(text).alias("_emoji"), emphasis(text).alias("_emphasis"))
    vader, blob, lex = hit_scores(F.col("_found"))
    parts = found.withColumns({"_vader": vader, "_textblob": blob, "_lexicon": lex})
    combined = (F.col("_vader") + F.col("_textblob") + F.col("_lexicon")) / 3 + 0.1 * F.col("_emoji") + 0.02 * F.col("_emphasis")
    with_parts = parts.withColumn("_combined", combined)
    combined = F.col("_combined")
    details = F.create_map(*[x for k in ("vader", "textblob", "lexicon", "emoji", "emphasis")
                             for x in (F.lit(k), F.col(f"_{k}"))])
    sent = sentiment_struct(threshold_label(combined), F.abs(combined), F.lit("comprehensive"),
                            compound=combined, original_text=F.substring("_text", 1, 200), details=details)
    return with_parts.withColumn("sentiment", sent).drop(
        "_text", "_found", *[f"_{k}" for k in ("vader", "textblob", "lexicon", "emoji", "emphasis", "combined")])


def vader_only(posts: DataFrame, valence: dict | None = None) -> DataFrame:
    """N5 over the valence compound: label, |compound|, method 'vader'."""
    staged = posts.withColumn("_text", C.scoring_text())
    compound, _, _ = hit_scores(token_hits(F.col("_text"), None, valence))
    return staged.withColumn("_c", compound).withColumn(
        "sentiment", sentiment_struct(threshold_label(F.col("_c")), F.abs("_c"), F.lit("vader"),
                                      compound=F.col("_c"), original_text=F.substring("_text", 1, 200))
    ).drop("_c", "_text")


def label_counts(flat: DataFrame) -> DataFrame:
    """POSITIVE / NEGATIVE / NEUTRAL counts (other labels ignored)."""
    lab = F.col("sentiment")
    return flat.agg(F.count_if(lab == "POSITIVE").alias("positive"),
                    F.count_if(lab == "NEGATIVE").alias("negative"),
                    F.count_if(lab == "NEUTRAL").alias("neutral"))

