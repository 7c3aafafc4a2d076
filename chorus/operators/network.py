"""Graphs as edge and node DataFrames.

Undirected edges are stored once with ``src <= dst`` (``least``/``greatest``
of the two ends), so every graph statistic is a group-by over edges.  Nodes
of different kinds (user, subreddit, topic) are keyed by (type, id).

Re-aimed: the reference's user-similarity graph (G7) joins *every* pair of
active users sharing a topic or subreddit; with a handful of topics that is
quadratic in users (all pairs within a topic group).  Here the exact inputs
of that graph are linear-size tables — :func:`user_profiles` (per active user:
topic set, subreddit set, sentiment score) — and :func:`pair_similarity`
scores the pairs a caller supplies (e.g. mention-graph edges) with the same
weight formula, without enumerating pairs.  See README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.operators import aggregate as A


def mention_edges(posts: DataFrame) -> DataFrame:
    """G1: directed (author, mention) counts and the subreddits (reddit only) they occur in."""
    e = posts.select("seq", "author", "platform", F.col("metadata.subreddit").alias("subreddit"),
                     F.explode("metadata.mentions").alias("mention"))
    sub = F.when((F.col("platform") == "reddit") & (F.length("subreddit") > 0), F.col("subreddit"))
    return e.groupBy("author", "mention").agg(
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_set(sub)).alias("subreddits"),
        F.min("seq").alias("first_seq"))


def mention_graph(edges: DataFrame, min_connections: int = 2, merge: str = "last") -> DataFrame:
    """Undirected edges with ``count >= min_connections``.

    When both directions qualify, ``merge='last'`` keeps the direction first
    seen later (the reference overwrites the edge), ``'sum'`` adds them.
    """
    q = edges.filter(F.col("count") >= min_connections)
    u, v = F.least("author", "mention"), F.greatest("author", "mention")
    q = q.select(u.alias("src"), v.alias("dst"), "count", "subreddits", "first_seq")
    if merge == "sum":
        return q.groupBy("src", "dst").agg(
            F.sum("count").alias("weight"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("subreddits")))).alias("subreddits"))
    last = q.groupBy("src", "dst").agg(F.max_by(F.struct("count", "subreddits"), "first_seq").alias("e"))
    return last.select("src", "dst", F.col("e.count").alias("weight"), F.col("e.subreddits").alias("subreddits"))


def degree_centrality(graph: DataFrame) -> DataFrame:
    """Degree / (n − 1) per node (a self-loop adds 2); a single node has 1."""
    ends = graph.select(F.explode(F.array("src", "dst")).alias("node"))
    deg = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    n = deg.select(F.count(F.lit(1))).scalar()
    return deg.select("node", "degree",
                      F.when(n <= 1, F.lit(1.0)).otherwise(F.col("degree") / (n - 1)).alias("centrality"))


def node_tone(nodes: DataFrame, flat: DataFrame, node_col: str = "node") -> DataFrame:
    """Colour of each node from its author's scored posts.

    gray without scored posts; red if the negative share > 0.6; green if the
    positive share > 0.6; else yellow.
    """
    lab = F.col("sentiment")
    counts = (flat.filter("has_sentiment").groupBy(F.col("author").alias(node_col))
              .agg(F.count_if(lab == "POSITIVE").alias("positive"), F.count_if(lab == "NEGATIVE").alias("negative"),
                   F.count_if(lab == "NEUTRAL").alias("neutral"), F.count(F.lit(1)).alias("total")))
    j = nodes.join(counts, node_col, "left")
    total = F.coalesce("total", F.lit(0))
    tone = (F.when(total == 0, F.lit("gray"))
             .when(F.col("negative") / total > 0.6, F.lit("red"))
             .when(F.col("positive") / total > 0.6, F.lit("green"))
             .otherwise(F.lit("yellow")))
    return j.select(node_col, total.alias("scored_posts"), tone.alias("tone"))


def subreddit_topic_edges(posts: DataFrame) -> DataFrame:
    """(subreddit, topic) co-occurrence counts; a missing subreddit is ``unknown``."""
    return posts.groupBy(F.coalesce(F.col("metadata.subreddit"), F.lit("unknown")).alias("subreddit"),
                         F.col("query").alias("topic")).agg(F.count(F.lit(1)).alias("weight"))


def triangular_network(rows: DataFrame) -> DataFrame:
    """user–subreddit, user–topic and subreddit–topic edges with counts.

    ``rows`` has ``author``, ``subreddit`` or ``metadata.subreddit``, and ``query`` or ``topic``; row by
    row the first non-empty one counts, empty ends are skipped.  Output: ``src_type, src, dst_type, dst,
    weight``.
    """
    full = lambda c: F.nullif(c, F.lit(""))
    subs = [full(F.col("subreddit"))] if "subreddit" in rows.columns else []
    if "metadata" in rows.columns:
        subs.append(full(F.col("metadata.subreddit")))
    topics = [full(F.col(c)) for c in ("query", "topic") if c in rows.columns]
    r = rows.select(F.col("author").alias("user"), F.coalesce(*subs).alias("subreddit"), F.coalesce(*topics).alias("topic"))
    ok = lambda c: F.col(c).isNotNull() & (F.length(c) > 0)
    pairs = F.array(
        F.when(ok("user") & ok("subreddit"), F.struct(F.lit("user").alias("st"), F.col("user").alias("s"),
                                                       F.lit("subreddit").alias("dt"), F.col("subreddit").alias("d"))),
        F.when(ok("user") & ok("topic"), F.struct(F.lit("user").alias("st"), F.col("user").alias("s"),
                                                   F.lit("topic").alias("dt"), F.col("topic").alias("d"))),
        F.when(ok("subreddit") & ok("topic"), F.struct(F.lit("subreddit").alias("st"), F.col("subreddit").alias("s"),
                                                        F.lit("topic").alias("dt"), F.col("topic").alias("d"))))
    e = r.select(F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("e")).select("e.*")
    return e.groupBy(F.col("st").alias("src_type"), F.col("s").alias("src"),
                     F.col("dt").alias("dst_type"), F.col("d").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def network_nodes(edges: DataFrame) -> DataFrame:
    """Typed node list of a G6 edge table."""
    a = edges.select(F.col("src_type").alias("type"), F.col("src").alias("id"))
    b = edges.select(F.col("dst_type").alias("type"), F.col("dst").alias("id"))
    return a.unionByName(b).distinct()


def user_top_terms(flat: DataFrame, min_posts: int = 3, top: int = 3) -> DataFrame:
    """For users with ≥ ``min_posts`` scored posts, their top topics and subreddits.

    Ties follow first use (smallest ``seq``), as a counter's insertion order.
    """
    active = A.user_patterns(flat).filter(F.col("post_count") >= min_posts).select("author")
    scored = flat.filter("has_sentiment")
    terms = scored.select("author", "seq", F.inline(F.array(
        F.struct(F.lit("topic").alias("kind"), F.col("query").alias("term")),
        F.struct(F.lit("subreddit").alias("kind"), F.col("subreddit").alias("term")))))
    terms = terms.filter(F.col("term").isNotNull() & (F.length("term") > 0))
    counts = terms.groupBy("author", "kind", "term").agg(F.count(F.lit(1)).alias("count"),
                                                        F.min("seq").alias("first_seq"))
    rk = F.row_number().over(Window.partitionBy("author", "kind").orderBy(F.col("count").desc(), "first_seq"))
    ranked = counts.select("*", rk.cast("bigint").alias("rank")).filter(F.col("rank") <= top)
    return ranked.join(active, "author", "left_semi").select("author", "kind", "rank", "term", "count")


def user_nodes(flat: DataFrame, min_posts: int = 3, top: int = 3) -> DataFrame:
    """The node of every user with ≥ ``min_posts`` scored posts: the A22 attributes and the ``top``
    topics and subreddits, joined by ``|``."""
    best = user_top_terms(flat, min_posts, top)
    names = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("kind") == kind, F.struct("rank", "term")))), lambda t: t["term"]), "|")
    terms = best.groupBy("author").agg(names("topic").alias("top_topics"), names("subreddit").alias("top_subreddits"))
    users = A.user_patterns(flat).filter(F.col("post_count") >= min_posts).drop("first_seq")
    return users.join(terms, "author", "left").withColumn("top_topics", F.coalesce("top_topics", F.lit(""))).withColumn(
        "top_subreddits", F.coalesce("top_subreddits", F.lit("")))


def user_profiles(flat: DataFrame, min_posts: int = 3) -> DataFrame:
    """G7 inputs: active users (≥ ``min_posts`` scored posts) with their topic
    set, subreddit set and ``(positive − negative) / posts`` score."""
    u = A.user_patterns(flat).filter(F.col("post_count") >= min_posts).select("author", "sentiment_score")
    scored = flat.filter("has_sentiment")
    terms = scored.groupBy("author").agg(
        F.array_sort(F.collect_set(F.when(F.length("query") > 0, F.col("query")))).alias("topics"),
        F.array_sort(F.collect_set(F.when(F.length("subreddit") > 0, F.col("subreddit")))).alias("subreddits"))
    return u.join(terms, "author")


def pair_similarity(profiles: DataFrame, pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """G7 weight for given user pairs (``src``, ``dst``), both active.

    weight = (Jaccard(topics) + Jaccard(subreddits) + 1 − |Δscore|) / 3; a pair
    is an edge when it shares a topic or subreddit and weight > ``threshold``.
    Both look-ups are equi-joins on the user name (one profile row per user).
    """
    a = profiles.select(F.col("author").alias("src"), F.col("topics").alias("t1"),
                        F.col("subreddits").alias("s1"), F.col("sentiment_score").alias("x1"))
    b = profiles.select(F.col("author").alias("dst"), F.col("topics").alias("t2"),
                        F.col("subreddits").alias("s2"), F.col("sentiment_score").alias("x2"))
    j = pairs.select("src", "dst").join(a, "src").join(b, "dst")
    jac = lambda x, y: F.when(F.size(F.array_union(x, y)) > 0,
                              F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))
    shared_t, shared_s = F.array_intersect("t1", "t2"), F.array_intersect("s1", "s2")
    sim = 1 - F.abs(F.col("x1") - F.col("x2"))
    w = (jac(F.col("t1"), F.col("t2")) + jac(F.col("s1"), F.col("s2")) + sim) / 3
    out = j.select("src", "dst", w.alias("weight"), jac(F.col("t1"), F.col("t2")).alias("topic_overlap"),
                   jac(F.col("s1"), F.col("s2")).alias("subreddit_overlap"), sim.alias("sentiment_similarity"),
                   F.size(shared_t).alias("shared_topics"), F.size(shared_s).alias("shared_subreddits"))
    return out.filter(((F.col("shared_topics") > 0) | (F.col("shared_subreddits") > 0)) & (F.col("weight") > threshold))
