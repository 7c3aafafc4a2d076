"""Keyword frequencies.

Tokens come from regular-expression cleaning of ``title + ' ' + content``;
each task counts the words of its texts before they move, so very frequent
words cost one partial row per task; stop words are removed from the counts
with a broadcast anti-join against a fixed-size table.  The reference additionally
keeps only some word classes (nouns, adjectives, adverbs); its tagger is replaced
by a ``word → tag`` table with suffix back-off (``word_tags``), off by default, that
is joined to the counted words, so a frequent word is tagged once.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions import text as X
from chorus.session import ensure_checkpoint_dir

# The standard English stop-word list (NLTK corpus, in its order).
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him "
    "his himself she she's her hers herself it it's its itself they them their theirs themselves what which who "
    "whom this that that'll these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't "
    "doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't "
    "shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# Extra words the analysis treats as stop words.
EXTRA_STOPWORDS = (
    "the a an and or but in on at to for of with by from up about into through during before after above below "
    "between under is are was were be been being have has had do does did will would could should can may might "
    "must shall ought make made making get got getting go going went come came coming take took taking see saw "
    "seeing know knew knowing think thought thinking say said saying tell told telling give gave giving find found "
    "finding look looked looking use used using work worked working try tried trying seem seemed seeming become "
    "became becoming want wanted wanting need needed needing i you he she it we they me him her us them my your his "
    "its our their mine yours hers ours theirs this that these those some any all each every no none both either "
    "neither much many more most few little really very so too quite rather pretty just only even also still yet "
    "already always never sometimes often usually maybe perhaps probably definitely certainly surely clearly "
    "obviously actually basically generally specifically now then today yesterday tomorrow here there where when "
    "how why what which who again back away around down over off out through against across along rt via amp "
    "https http www com org net like share comment post thread reddit twitter facebook instagram youtube tiktok "
    "link url edit delete update subreddit upvote downvote karma mod moderator op original poster submission lol "
    "lmao haha yeah yes ok okay thanks thank please sorry wow omg tbh imo imho fwiw btw afaik tldr tl dr etc ie eg "
    "0 1 2 3 4 5 6 7 8 9 10 20 30 am pm re vs id tv pc ai"
).split()
MIN_WORD_LENGTH = 3
PLACEHOLDER = "no_meaningful_content"


def stopword_table(spark, extra=()) -> DataFrame:
    """Stop words that can matter (length ≥ 3) as a one-column table."""
    words = sorted({w for w in (*ENGLISH_STOPWORDS, *EXTRA_STOPWORDS, *extra) if len(w) >= MIN_WORD_LENGTH})
    return spark.createDataFrame([(w,) for w in words], "word string")


def _joined(title="title", content="content"):
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(content), F.lit("")))


def _keyword_text():
    words = X.word_splitter(www=False, digits=False)

    def clean(t: str) -> str:
        return " ".join(words(t).lower().split())
    return clean


def keyword_text(title="title", content="content"):
    """W1 cleaning: drop http(s) URLs and mentions, unhash, punctuation → space, delete digits, lower."""
    return X.text_function(_joined(title, content), _keyword_text, "string")


def keyword_tokens(posts: DataFrame, allowed_words: DataFrame | None = None) -> DataFrame:
    """One row per meaningful token occurrence (``seq``, ``word``); ``keyword_counts`` counts them without these rows."""
    # whitespace runs are single spaces here; empty pieces fail the length filter
    words = posts.select("seq", F.explode(F.split(keyword_text(), " ")).alias("word"))
    words = words.filter(F.char_length("word") >= MIN_WORD_LENGTH)
    words = words.join(stopword_table(posts.sparkSession), "word", "left_anti")
    if allowed_words is not None:
        words = words.join(allowed_words.select("word").distinct(), "word", "left_semi")
    return words


_HELD = 4_000_000  # characters of text whose words a task counts at once


def _counted(words, least: int, held: int):
    def counted(texts):
        found = pc.value_counts(pc.split_pattern(pa.array(texts, pa.large_string()), " ").flatten())
        lower = [w.lower() for w in found.field("values").to_numpy(zero_copy_only=False)]
        out = pa.RecordBatch.from_arrays([pa.array(lower, pa.string()), found.field("counts")], names=["word", "n"])
        return out.filter(pc.greater_equal(pc.utf8_length(out.column("word")), least))

    def run(batches):
        for batch in batches:
            texts, size = [], 0
            for t in batch.column("t").to_pylist():
                texts.append(words(t))
                size += len(t)
                if size >= held:
                    yield counted(texts)
                    texts, size = [], 0
            yield counted(texts)
    return run


def keyword_counts(posts: DataFrame, allowed_words: DataFrame | None = None) -> DataFrame:
    """``word, count`` of the meaningful tokens.  Each task counts the words of its texts, so a word moves
    once a task, however often it stands there."""
    texts = posts.select(F.make_valid_utf8(_joined()).alias("t"))
    parts = texts.mapInArrow(_counted(X.word_splitter(www=False, digits=False), MIN_WORD_LENGTH, _HELD), "word string, n long")
    counts = parts.groupBy("word").agg(F.sum("n").alias("count")).join(stopword_table(posts.sparkSession), "word", "left_anti")
    if allowed_words is not None:
        counts = counts.join(allowed_words.select("word").distinct(), "word", "left_semi")
    return counts


def suffix_tags(tags: DataFrame, longest: int = 4) -> DataFrame:
    """suffix, tag: for every ending of up to ``longest`` letters of the tagged words (shorter than the word) the
    tag most of them have (ties: the first in order)."""
    ends = tags.where("word is not null and tag is not null").select("word", "tag").distinct().select(
        "tag", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(F.char_length("word") > k, F.right("word", k)))).alias("suffix"))
    counts = ends.where("suffix is not null").groupBy("suffix", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("suffix").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))


def word_tags(words: DataFrame, tags: DataFrame, longest: int = 4, default: str = "N") -> DataFrame:
    """word, tag of different ``words``: the table's tag (several: the first in order), else that of the word's longest
    ending known to the table, else ``default`` (a noun, as taggers guess)."""
    own = tags.where("tag is not null").groupBy("word").agg(F.min("tag").alias("own"))
    found = words.select("word").join(own, "word", "left")
    ends = found.where("own is null").select("word", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(k.alias("k"), F.when(F.char_length("word") > k, F.right("word", k)).alias("suffix")))).alias("e"))
    guess = (ends.select("word", "e.k", "e.suffix").join(suffix_tags(tags, longest), "suffix")
             .groupBy("word").agg(F.max_by("tag", "k").alias("guess")))
    return found.join(guess, "word", "left").select("word", F.coalesce("own", "guess", F.lit(default)).alias("tag"))


def word_frequencies(posts: DataFrame, sentiment_filter: str | None = None,
                     allowed_words: DataFrame | None = None, min_count: int = 2, switch_at: int = 20,
                     tags: DataFrame | None = None, keep_tags: tuple[str, ...] = ("N", "A", "R")) -> DataFrame:
    """Word counts.  The reference's word cloud drops words seen less than ``min_count`` times when
    more than ``switch_at`` posts take part; ``min_count=1`` counts every word.  With a ``tags`` table (word, tag)
    only words of the classes ``keep_tags`` stay."""
    if sentiment_filter:
        posts = posts.filter(F.col("sentiment.label") == sentiment_filter)
    counts = keyword_counts(posts, allowed_words)
    if tags is not None:
        ensure_checkpoint_dir(posts.sparkSession)
        counts = counts.checkpoint(eager=True)  # the texts are counted once; the words meet their tags in two places
        classes = word_tags(counts, tags).where(F.col("tag").isin(*keep_tags))
        counts = counts.join(classes.select("word"), "word", "left_semi")
    if min_count <= 1:
        return counts
    many = posts.select("seq").limit(switch_at + 1).agg(F.count(F.lit(1)) > switch_at).scalar()
    return counts.filter(~many | (F.col("count") >= min_count))


def top_words(posts: DataFrame, sentiment_filter: str | None = None, top: int = 100) -> DataFrame:
    """The ``top`` most frequent words (ties alphabetical); a placeholder row when none."""
    freq = word_frequencies(posts, sentiment_filter)
    best = freq.orderBy(F.col("count").desc(), F.col("word")).limit(top)
    spark = posts.sparkSession
    placeholder = spark.range(1).select(F.lit(PLACEHOLDER).alias("word"), F.lit(1).cast("bigint").alias("count"))
    has_any = best.select(F.count(F.lit(1))).scalar()
    return best.unionByName(placeholder.filter(has_any == 0))
