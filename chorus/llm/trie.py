"""Prefix trie of conversations by whole-sequence collapse.

1. *Turns.*  A turn (role, text) becomes a SHA-256 digest and a count of code points; texts are read once and
   move no further.  Turns are numbered through range partitions over (conversation, turn) with carried counts,
   so one conversation may fill many tasks.
2. *Prefix keys.*  Position and digest of every turn are hashed to four 32-bit words; the running sums of those
   words (exact longs) identify a prefix.  Sums carry over partition borders as counts do, so no task walks a
   whole conversation.
3. *Collapse.*  Conversations with equal last keys are one weighted sequence, held by its smallest member;
   its members' list is kept in sorted chunks.
4. *Leaves.*  Sequences whose key is a proper prefix of another sequence go by an anti-join; the rest are leaves.
5. *Weighted prefixes.*  The prefixes of the sequences' holders are aggregated by key with the weights.

Sums over a subtree need no pair of node and ancestor: with w a sequence's weight, T its code points and
``before(x)`` the code points above node x,

    sum over members of the turns from x on  =  sum w T  -  n_convs * before(x),

and every node belongs to the holder equal to its smallest member, which owns one run of nodes at the end of
its path, so the nodes' own sizes add up to  sum(T - Q)  -  (before(x) - Q_owner),  Q being the code points
above the first node that a holder owns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import ready, stage

_WORDS = ("k1", "k2", "k3", "k4")
_SUMS = (*_WORDS, "cp")
_CHUNK = 16_384  # members in one row of an end list


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _digest(role: str, text: str) -> Column:
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)


def _key(depth: Column, words: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[w.cast("string") for w in words]))


def _before(df: DataFrame, columns, key: str = "conv_id", order: str = "part") -> DataFrame:
    """Sums of ``columns`` over the earlier parts of the same conversation (one row a part: few)."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(key, order, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(f"{c}_0") for c in columns])


def _numbered(conversations: DataFrame, id_col, turn_col, role_col, text_col) -> DataFrame:
    """conv_id, part, turn, digest, row, cp, local: turns in range partitions, numbered inside each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    turns = stage(conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), _digest(role_col, text_col).alias("digest"),
        F.length(text).cast("long").alias("cp"), F.monotonically_increasing_id().alias("row")), "trie-turns")
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    ranged = turns.repartitionByRange(_partitions(turns), F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "trie-ranges")
    return ranged.withColumn("local", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)).cast("long"))


def rebuilt_turns(conversations: DataFrame, heads: int = 6, group: int = 100, id_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): turns (conv_id, part, depth, digest, cp) of every rebuilt conversation, depth from 1,
    and all conversation ids (conv_id).

    Conversation c starts with the first h turns of conversation ``c - c % group`` (all if it has fewer, none if it
    does not exist), h = crc32(decimal c) % heads, and goes on with its own turns after its first h.  ``heads=1``
    leaves conversations as they are.  Turns come by ``turn``, null first; turns with the same number come in the
    order of their digests, so equal rows are interchangeable.  Rows without an id belong to no conversation.
    ``c % group`` has the sign of c.  Other columns are ignored.
    """
    rows = _numbered(conversations, id_col, turn_col, role_col, text_col)
    spans = stage(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "trie-spans")
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("total")).withColumn("base", F.expr(f"conv_id - conv_id % {int(group)}"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(int(heads)))
    bases = convs.where("conv_id = base").select("base", F.col("total").alias("base_total"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_total", F.lit(0))))
    convs = stage(convs.select("conv_id", "base", "h", "taken"), "trie-convs")
    start = _before(spans, ["n"]).join(convs, "conv_id")
    rows = rows.join(start, ["conv_id", "part"]).select("conv_id", "part", "digest", "cp", "h", "taken", "base",
                                                        (F.col("n_0") + F.col("local")).alias("pos"))
    rows = stage(rows, "trie-positions")
    own = rows.where("pos > h").select("conv_id", "part", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "cp")
    first = rows.where(f"conv_id = base and pos < {int(heads)}").select("base", F.col("pos").alias("depth"), "digest", "cp")
    head = convs.where("taken > 0").join(first, "base").where("depth <= taken").select(
        "conv_id", F.lit(-1).alias("part"), "depth", "digest", "cp")
    return own.unionByName(head), convs.select("conv_id")


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes: conv_id, depth, key, parent_key, digest, cp, upto; ends: conv_id, len, key, total) of turns."""
    h = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    turns = turns.withColumn("h", h).select("conv_id", "part", "depth", "digest", "cp", *[
        F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(_WORDS)])
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = stage(turns.select("*", *[F.sum(c).over(upto).alias(f"{c}_l") for c in _SUMS]), "trie-sums")
    spans = stage(local.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in _SUMS], F.count("*").alias("n")), "trie-span-sums")
    sums = local.join(_before(spans, _SUMS), ["conv_id", "part"])
    words = [F.col(f"{w}_0") + F.col(f"{w}_l") for w in _WORDS]
    prefixes = sums.select(
        "conv_id", "depth", _key(F.col("depth"), words).alias("key"),
        _key(F.col("depth") - 1, [w - F.col(c) for w, c in zip(words, _WORDS)]).alias("parent_key"),
        "digest", "cp", (F.col("cp_0") + F.col("cp_l")).alias("upto"))
    ends = spans.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _SUMS], F.sum("n").alias("len"))
    return prefixes, ends.select("conv_id", "len", _key(F.col("len"), [F.col(w) for w in _WORDS]).alias("key"), F.col("cp").alias("total"))


def _lists(batches):
    """Sorted rows (key, conv_id) -> rows (key, first, ids): at most _CHUNK ids a row."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        out, a = [], 0
        for b in range(1, len(keys) + 1):
            if b == len(keys) or keys[b] != keys[a] or b - a == _CHUNK:
                out.append((keys[a], ids[a], ",".join(map(str, ids[a:b]))))
                a = b
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                                         names=["key", "first", "ids"])


def _list_hashes(batches):
    """Chunks in order -> one SHA-256 a key; only its running state is held."""
    key, state = None, None

    def row(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["key", "ends_sha256"])

    for batch in batches:
        done = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield row(done)
    if state is not None:
        yield row([(key, state.hexdigest())])


def ends_hash(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of each list's decimal ids, comma-joined, from its chunks.  A hash is one chain, so a
    list streams through one task, which holds one chunk and the hash's state."""
    ready(ends)
    return ends.repartition(_partitions(ends), "key").sortWithinPartitions("key", "first").mapInArrow(
        _list_hashes, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, heads: int = 6, group: int = 100, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of rebuilt conversations (see ``rebuilt_turns``).

    nodes: key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, digest
    (of the last turn; null at the root).  saved_tokens sums, over the node's subtree, (n_convs - 1) times the
    code points of each node's last text.  ends: key, first, ids, the members that end at a node, ascending, in
    chunks of bounded length.  Null roles and texts are empty; repeated rows are turns of their own; equal
    conversations are members of the same nodes; a conversation left without turns is a member of the root
    only.  An empty table has no conversations, so no nodes.
    """
    ready(conversations)
    turns, convs = rebuilt_turns(conversations, heads, group, id_col, turn_col, role_col, text_col)
    prefixes, ends = _prefixes(turns)
    prefixes = stage(prefixes, "trie-prefixes")
    root = _key(F.lit(0), [F.lit(0)] * 4)
    ends = stage(convs.join(ends, "conv_id", "left").select(
        "conv_id", F.coalesce("len", F.lit(0)).cast("long").alias("len"), F.coalesce("key", root).alias("key"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total")), "trie-ends")
    lists = stage(ends.repartitionByRange(_partitions(ends), "key", "conv_id").sortWithinPartitions("key", "conv_id")
                  .mapInArrow(_lists, "key string, first long, ids string"), "trie-lists")
    # whole sequences, held by their smallest members
    whole = stage(ends.groupBy("key").agg(F.min("conv_id").alias("holder"), F.count("*").alias("w"), F.min("len").alias("len"),
                                          F.min("total").alias("total")), "trie-whole")
    held = prefixes.withColumnRenamed("conv_id", "holder").join(whole.select("holder", "w", "len", "total"), "holder")
    top = whole.select("holder", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("string").alias("parent_key"),
                       F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("cp"), F.lit(0).cast("long").alias("upto"),
                       "w", "len", "total")
    held = stage(held.unionByName(top), "trie-held")
    leaves = whole.join(held.where("depth < len").select("key").distinct(), "key", "left_anti").select("holder", F.lit(1).alias("leaf"))
    nodes = stage(held.groupBy("key").agg(
        F.min("holder").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("digest").alias("digest"),
        F.min("cp").alias("cp"), F.min("upto").alias("upto"), F.sum("w").alias("n_convs"), F.sum(F.col("w") * F.col("total")).alias("wt")),
        "trie-nodes").withColumn("before", F.col("upto") - F.col("cp"))
    owned = nodes.groupBy(F.col("conv_id").alias("holder")).agg(F.min("before").alias("q"))
    share = whole.join(owned, "holder", "left").join(leaves, "holder", "left").select(
        "holder", F.coalesce(F.col("total") - F.col("q"), F.lit(0)).alias("u"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    below = held.select("holder", "key").join(share, "holder").groupBy("key").agg(F.sum("u").alias("u"), F.sum("leaf").alias("n_leaves"))
    kids = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = (nodes.join(parents, "parent_key", "left").join(owned.withColumnRenamed("holder", "conv_id"), "conv_id")
           .join(below, "key").join(kids, "key", "left"))
    saved = (F.col("wt") - F.col("n_convs") * F.col("before")) - (F.col("u") - (F.col("before") - F.col("q")))
    return out.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                      F.col("n_leaves").cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), "digest"), lists


def with_turns(nodes: DataFrame, conversations: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with ``last_role`` and ``last_text``, the turn that each ends with (null at the root)."""
    r, t = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(_digest(role_col, text_col).alias("digest"), r.alias("last_role"), t.alias("last_text"))
    return nodes.join(turns.dropDuplicates(["digest"]), "digest", "left")
