"""Contract queries of the operators: thin wrappers that pick the contract's columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm import (centroids, jaccard, language, licenses, mixing, neighbours, order, packing, sharding, suffix, topk, toxicity,
                        trie)
from chorus.llm.common import stage, table


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, score_col="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.jump_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = neighbours.near_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "n_links", "component_id", "kept")


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_tput_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(topk.quantised(table(spark, sf_dir, "embeddings")), "topk")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix.drop_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard.jaccard_classes(table(spark, sf_dir, "documents"), k=4, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, written = order.materialise(table(spark, sf_dir, "documents"))
    return order.index_of(written).select("slot", "shard", "record", "byte_offset", "number", "n_ids", "first_doc",
                                          "first_start", "last_doc", "ids_crc32")


def op11_lookup_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, final = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    return rows.withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests
                           else F.lit("")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = trie.prefix_trie(table(spark, sf_dir, "conversations"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(trie.ends_hash(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return language.predict(docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text"), model)


QUERIES = {f.__name__: f for f in [op1_harmonic_packing, op2_sainte_lague_mix, op3_weak_toxicity, op4_jump_shards, op5_nn_descent, op6_license_rules,
                                   op7_tput_top_k, op8_suffix_dedup,
                                   op9_jaccard_join, op10_training_order, op11_lookup_centroids, op12_prefix_trie,
                                   op13_naive_bayes_language]}
def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds of op 11 written out: a<i> assigns, c<i> holds the centroids of round i."""
    steps = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v AS c FROM v ORDER BY j LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, unnest(list_min(list_transform(cs, lambda c: {{
            'd': CAST(list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'j': c.j}})))
       FROM v, (SELECT list({{'j': j, 'c': c}}) AS cs FROM c{i}))""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(range(64)) AS i, unnest(v) AS x FROM a{i}) GROUP BY j, i),
m{i} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)"""


ORACLES: dict[str, str] = {
    "op11_lookup_centroids": _centroid_sql(),
    # crc32 bit by bit over the digits; nodes are told apart by the whole list of their turns
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                  {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                 lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 6 AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(own.turns[:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN own ON own.conv_id = h.base),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
n AS (SELECT turns[:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(turns)), '')) AS ends_sha256
      FROM p GROUP BY ALL),
k AS (SELECT node[:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node),
u AS (SELECT node[:d] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
             sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node[depth].text) END) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u ON m.node = u.node LEFT JOIN m AS p ON m.depth > 0 AND p.node = m.node[:m.depth - 1]""",
    "op7_tput_top_k": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
