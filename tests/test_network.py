from posts import post

from chorus.operators import network as G
from chorus.operators.project import posts_flat


def test_mention_graph_last_direction_wins(make_posts):
    rows = [post(1, "a", author="alice", mentions=["bob"]), post(2, "b", author="alice", mentions=["bob"]),
            post(3, "c", author="bob", mentions=["alice"]), post(4, "d", author="bob", mentions=["alice"]),
            post(5, "e", author="bob", mentions=["alice"]), post(6, "f", author="carol", mentions=["alice"])]
    p = make_posts(rows)
    g = G.mention_graph(G.mention_edges(p)).collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in g] == [("alice", "bob", 3)]
    cent = {r["node"]: r["centrality"] for r in G.degree_centrality(G.mention_graph(G.mention_edges(p))).collect()}
    assert cent == {"alice": 1.0, "bob": 1.0}


def test_tone(make_posts, spark):
    rows = [post(i, f"n{i}", author="grumpy", label="NEGATIVE") for i in range(4)] + [post(9, "p", author="grumpy")]
    nodes = spark.createDataFrame([("grumpy",), ("ghost",)], "node string")
    tone = {r["node"]: r["tone"] for r in G.node_tone(nodes, posts_flat(make_posts(rows))).collect()}
    assert tone == {"grumpy": "red", "ghost": "gray"}


def test_triangular(make_posts):
    rows = [post(1, "a", author="u1", platform="reddit", subreddit="python", query="spark"),
            post(2, "b", author="u1", platform="reddit", subreddit="python", query="spark")]
    e = {(r["src_type"], r["dst_type"]): r["weight"] for r in G.triangular_network(posts_flat(make_posts(rows))).collect()}
    assert e == {("user", "subreddit"): 2, ("user", "topic"): 2, ("subreddit", "topic"): 2}


def test_pair_similarity_hand_computed(make_posts, spark):
    # u1: topics {a, b}, subreddit {r}, 3 POSITIVE → score 1.0
    # u2: topics {b}, subreddit {r, s}, 2 POSITIVE + 1 NEGATIVE → score 1/3
    rows = [post(1, "x", author="u1", query="a", platform="reddit", subreddit="r"),
            post(2, "x", author="u1", query="b", platform="reddit", subreddit="r"),
            post(3, "x", author="u1", query="b"),
            post(4, "x", author="u2", query="b", platform="reddit", subreddit="r"),
            post(5, "x", author="u2", query="b", platform="reddit", subreddit="s"),
            post(6, "x", author="u2", query="b", label="NEGATIVE")]
    prof = G.user_profiles(posts_flat(make_posts(rows)))
    pairs = spark.createDataFrame([("u1", "u2")], "src string, dst string")
    r = G.pair_similarity(prof, pairs).first()
    assert r["topic_overlap"] == 0.5 and r["subreddit_overlap"] == 0.5
    assert abs(r["sentiment_similarity"] - (1 - 2 / 3)) < 1e-12
    assert abs(r["weight"] - (0.5 + 0.5 + 1 / 3) / 3) < 1e-12
