"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. Targets: sources share ``share`` of all words by weight; a target stops at ``cap`` times its source's
   words and the excess is reshared by weight until no target is above (water filling, in closed form).
2. Each source is cut into shards of about ``shard_words`` words (by a hash of its rows, so a source with
   a third of all rows has a third of all shards), each shard's seeded row order into equal blocks of
   about ``block_words`` words.  Blocks go to sources by highest quotients ``target / (2 s - 1)``, then
   each source's blocks to its shards the same way: integer quotas, reruns agree.
3. Within a shard the quota takes whole passes over all blocks first, then blocks picked by a seeded
   permutation of the block numbers; a row gives the words it has in picked blocks.

Only narrow rows (id, source, size) are shuffled; equal ones are counted before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import stage

#: A word of the size contract, and the weights dealt to the sources in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
_PRIME = 1_000_003  # larger than any shard's number of blocks, so it has no factor in common with it


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash60(*cols, at: int = 1):
    """A number below 2**60 from an md5, the same in every SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """source, source_size -> adds weight and target.  One row per source."""
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                  ((rn - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("goal", F.sum("source_size").over(every) * share)
    level = (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    first = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                     F.when(F.col("level") <= F.col("ratio"), F.col("nth"))).over(every)
    # when every source is at its limit (share >= cap) no level exists and the limits are the targets
    return s.withColumn("target", F.least("most", F.coalesce(first * F.col("weight"), F.col("most")))).select(
        "source", "source_size", "weight", "target")


def sainte_lague(rows: DataFrame, group: str, key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats each row gets of its group's ``seats`` (highest quotients, ties to smaller key).

    A divisor that surely gives no seat too many settles all but about one seat per row; only the next
    few quotients of each row are ranked, so the work does not grow with the number of seats.
    """
    g = Window.partitionBy(group)
    w = F.col(weight).cast("double")
    r = (rows.withColumn("_w", F.sum(w).over(g)).withColumn("_k", F.count_if(w > 0).over(g))
         .withColumn("_n", F.col(seats).cast("double")))
    low = F.when((F.col("_n") > F.col("_k") / 2) & (w > 0),
                 F.floor(w * (F.col("_n") - F.col("_k") / 2) / (F.col("_w") * (1 + 1e-9)) + 0.5)).otherwise(0)
    r = r.withColumn("_low", low.cast("long"))
    r = r.withColumn("_rest", F.col(seats) - F.sum("_low").over(g))
    more = F.when(w > 0, F.ceil(w / F.col("_w") * (F.col("_k") + F.col("_n") * 2e-9)) + 2).otherwise(0).cast("int")
    nxt = (r.where(w > 0).select(group, key, "_rest", "_low", w.alias("_wt"), F.explode(F.sequence(F.lit(1), more)).alias("_i"))
           .withColumn("_q", F.col("_wt") / (2 * (F.col("_low") + F.col("_i")) - 1)))
    nxt = nxt.withColumn("_rk", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_q"), key, "_i")))
    won = (nxt.where(F.col("_rk") <= F.col("_rest")).groupBy(F.col(group).alias("_g"), F.col(key).alias("_key"))
           .agg(F.count(F.lit(1)).alias("_won")))
    return (r.join(won, r[group].eqNullSafe(F.col("_g")) & r[key].eqNullSafe(F.col("_key")), "left")
            .withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0)))
            .drop("_w", "_k", "_n", "_low", "_rest", "_g", "_key", "_won"))


def plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, block_words: int = 64,
         shard_words: int = 1 << 20, seed: int = 17, by_text: bool = False, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """doc_id, source, (th,) size, source_size, target, passes, ranges, taken: what the mix takes of each row,
    ``passes`` times the whole row and once the words [start, stop) of each range.

    Null and empty texts have size 0 and give nothing; the null source is a source of its own, last in
    order; rows that repeat id, source and size (and, ``by_text``, the text) are separate rows of the
    stream; no rows give no rows.  ``cap`` must be 1 or more.
    """
    keys = ["doc_id", "source", *(["th"] if by_text else []), "size"]
    text = F.col(text_col).cast("string")
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size")]
    sized = stage(docs.select(*cols, *([F.xxhash64(text).alias("th")] if by_text else []))
                  .groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), "mix")
    sources = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")),
                      share, cap, weights)
    sources = sources.withColumn("sid", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    sources = stage(sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")), "mix")
    rows = sized.join(sources.select(F.col("source").alias("_s"), "sid", "shards"),
                      F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("shard", _hash60(F.lit(seed), F.col("doc_id"), F.col("size")) % F.col("shards")).drop("shards")
    # quotas: blocks of each shard, seats of each source, seats of each shard
    cells = (rows.groupBy("sid", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).where("words > 0")
             .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long")))
    cells = stage(cells, "mix")
    per = cells.groupBy("sid").agg(F.sum("blocks").alias("all_blocks"))
    seats = sources.join(per, "sid").withColumn("wish", F.col("target") * F.col("all_blocks") / F.col("source_size"))
    seats = seats.withColumn("every", F.lit(0)).withColumn("total", F.round(F.sum("wish").over(Window.partitionBy("every"))).cast("long"))
    seats = sainte_lague(seats, "every", "sid", "wish", "total", "quota")
    most = F.floor(F.col("all_blocks") * cap).cast("long")
    quotas = seats.select("sid", F.least("quota", most).alias("quota"))
    cells = sainte_lague(cells.join(quotas, "sid"), "sid", "shard", "blocks", "quota", "cell_quota")
    cells = stage(cells.select("sid", "shard", "words", "blocks", "cell_quota",
                               (_hash60(F.lit(seed), F.col("sid"), F.col("shard")) % F.col("blocks")).alias("shift")), "mix")
    # the seeded stream of each shard, and what lies in picked blocks
    end = F.sum(F.col("size") * F.col("copies")).over(
        Window.partitionBy("sid", "shard").orderBy(_hash60(F.lit(seed), F.col("doc_id"), F.col("size"), at=16), *keys)
        .rowsBetween(Window.unboundedPreceding, 0))
    stream = (rows.where("size > 0").withColumn("end", end)
              .withColumn("a", F.explode(F.expr("sequence(end - copies * size, end - size, size)"))).drop("end"))
    stream = stream.join(cells, ["sid", "shard"]).withColumn("e", F.col("a") + F.col("size"))
    stream = (stream.withColumn("passes", F.expr("cell_quota div blocks")).withColumn("part", F.expr("cell_quota % blocks"))
              .withColumn("b0", F.expr("((a + 1) * blocks - 1) div words")).withColumn("b1", F.expr("(e * blocks - 1) div words")))
    ranges = F.expr(f"""transform(filter(sequence(b0, b1), b -> (b * {_PRIME}L + shift) % blocks < part), b -> named_struct(
        'start', greatest(a, (b * words) div blocks) - a, 'stop', least(e, ((b + 1) * words) div blocks) - a))""")
    stream = stream.withColumn("ranges", F.when(F.col("part") > 0, ranges).otherwise(F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")))
    stream = stream.withColumn("taken", F.expr("passes * size + aggregate(ranges, 0L, (t, r) -> t + r.stop - r.start)"))
    out = [*keys, "passes", "ranges", "taken"]
    empty = sized.where("size = 0").withColumn("taken", F.explode(F.expr("array_repeat(0L, int(copies))"))).withColumn(
        "passes", F.lit(0).cast("long")).withColumn("ranges", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"))
    return (stream.select(*out).unionByName(empty.select(*out))
            .join(sources.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mixed rows: the columns of ``docs``, a row for every whole pass over it and one for the words in
    picked blocks (null and empty texts and rows the mix leaves out are not in it).  An ``n_chars`` column
    follows the text."""
    taken = plan(docs, by_text=True, id_col=id_col, text_col=text_col, source_col=source_col, **params)
    taken = taken.where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("th").alias("_plan_th"),
                                            "passes", "ranges")
    one = docs.withColumn("_th", F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, source_col, "_th"])
    rows = one.join(taken, F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("_source"))
                    & F.col("_th").eqNullSafe(F.col("_plan_th")))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.when(F.size("ranges") > 0, F.rtrim(F.array_join(F.flatten(F.transform(
        "ranges", lambda r: F.slice(F.col("_words"), (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int")))), "")))
    rows = rows.withColumn("_words", F.when(F.size("ranges") > 0, words)).withColumn("_part", part)
    whole = F.expr("array_repeat(_whole, int(passes))")
    rows = rows.withColumn("_whole", F.col(text_col).cast("string")).withColumn(
        "_text", F.explode(F.filter(F.concat(whole, F.array("_part")), lambda t: t.isNotNull())))
    out = {text_col: F.col("_text"), **({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
