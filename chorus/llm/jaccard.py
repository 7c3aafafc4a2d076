"""Exact word n-gram Jaccard join in the Jaccard metric space: which documents link, and their components.

``1 - Jaccard`` is a metric.  A region of documents is joined by pivots: every document's distance to the
region's pivots is computed, documents within the threshold of a pivot are linked to it without being
compared with each other, every document falls into the Voronoi region of its nearest pivot, and one that is
no more than twice the threshold farther from another pivot (the triangle inequality's window) is copied
into that region too.  Regions are joined recursively and exactly; a region whose documents are already one
component needs no more work, so thousands of near copies cost one comparison each, not one per pair.

Unrelated documents all lie at distance 1 from every pivot, so no pivot can part them.  The outermost
regions therefore come from an exact partition: sets of up to ``u`` elements that reach the threshold differ
in at most ``d`` elements, so of ``d`` + 1 parts of the hashed element space one holds the same elements in
both; documents that agree on a part belong to one family.  Sizes are split into octaves, with a bridge
between neighbours.  More parts than needed let a document keep back its smallest ones, on which unrelated
documents agree by chance, without losing a link (see ``signatures``).  A family too large for a task is cut into chunks by set size,
and chunks are joined two by two where the size window (the empty set as pivot of the difference metric)
allows a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import chunks, components, ready, stage, union_all, unstage

_C = np.uint64(0x9E3779B97F4A7C15)
_SEEN = 1_000_000
_SLICES = 4  # signatures are a few hundred a document: a slice of them is shuffled at a time


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word k-grams of every text (fewer words: the whole sequence)."""
    import xxhash
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    full = np.fromiter((w != "" for w in words), bool, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy()
    keep = full[codes] if len(words) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    h = hashed[codes[keep]] if len(words) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            grams = grams * _C + h[i:len(h) - k + 1 + i] if len(grams) else grams
        grams = _mix(grams)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= k:
                out.append(np.unique(grams[a:b - k + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for w in h[a:b]:
                    x = x * _C + w
                out.append(_mix(np.array([x + np.uint64(1)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _limit(total: int, percent: int) -> int:
    """Most elements in which two sets with ``total`` elements together may differ at the threshold."""
    return (100 - percent) * total // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Part signatures of a set: two sets that reach the threshold have one in common.

    A set and any partner agree on at least ``m - own`` of the ``m`` parts.  The set may therefore keep
    back all parts with fewer than ``c`` elements as long as those are fewer than ``m - own``: an agreeing
    part with ``c`` elements or more is left.  The partner's ``c`` may differ; the argument holds for the
    larger one, and a part agreed on has one size.  So small parts, on which unrelated documents agree by
    chance, are hardly ever sent, and about ``own`` signatures are.
    """
    n = len(s)
    top = 1 << n.bit_length()  # the octave is [top / 2, top)
    schemes = [(2 * n.bit_length(), 2 * (top - 1))]
    if 100 * n >= percent * top:  # may link into the next octave
        schemes.append((2 * n.bit_length() + 1, (top - 1) + 100 * (top - 1) // percent))
    low = top // 2 - 1
    if low and percent * n <= 100 * low:  # may link into the octave below
        schemes.append((2 * (n.bit_length() - 1) + 1, low + 100 * low // percent))
    own = _limit(n + 100 * n // percent, percent)
    out = []
    for tag, total in schemes:
        m = _limit(total, percent) * 13 // 10 + 1
        seed = _mix(np.array([tag * 1_000_003 + m], np.uint64))[0]
        x = _mix(s ^ seed)
        part = (x % np.uint64(m)).astype(np.int64)
        size = np.bincount(part, minlength=m)
        c = int(np.partition(size, max(0, m - own - 1))[max(0, m - own - 1)])
        with np.errstate(over="ignore"):
            o = np.argsort(part, kind="stable")
            sums = np.zeros(m, np.uint64)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            full = np.nonzero(size)[0]
            sums[full] = np.add.reduceat(_mix(x[o]), first[full])
            sent = np.nonzero(size >= c)[0]
            out.append(_mix(sums[sent] ^ _mix(sent.astype(np.uint64) * _C + seed) ^ size[sent].astype(np.uint64)))
    return np.concatenate(out)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _class_key(s: np.ndarray) -> int:
    import xxhash
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


_SIGS = [f"sigs{i}" for i in range(_SLICES)]


def _base(k, percent):
    def run(batches):
        seen: set[int] = set()  # copies met in one task send their signatures once
        for whole in batches:
            for b in chunks(whole, "text", 8 << 20):
                sets = shingle_sets(b.column("text"), k)
                keys = [_class_key(s) if len(s) else None for s in sets]
                sigs = []
                for s, c in zip(sets, keys):
                    sigs.append(signatures(s, percent) if c is not None and c not in seen else np.zeros(0, np.uint64))
                    if len(seen) < _SEEN:
                        seen.add(c)
                owner = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
                flat = np.concatenate([*sigs, np.zeros(0, np.uint64)])
                mine = (flat % np.uint64(_SLICES)).astype(np.int64)
                lists = []
                for i in range(_SLICES):
                    at = np.concatenate([[0], np.cumsum(np.bincount(owner[mine == i], minlength=len(sigs)))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(at), _as_long(flat[mine == i])))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.int64()), *lists],
                    names=["doc_id", "th", "n", "cid", *_SIGS])
    return run


class _Region:
    """Documents of one family block: exact intersections by an inverted index, links by pivots."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(x) for x in sets], np.int64)
        self.percent, self.tau = percent, 1 - percent / 100
        flat = np.concatenate(sets)
        _, code = np.unique(flat, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.code = code
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, others):
        for y in others:
            a, b = self.find(x), self.find(int(y))
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((x, int(y)))

    def index(self, rows: np.ndarray):
        """Postings of the rows: (place of each code's list, rows by code)."""
        use = np.concatenate([np.arange(self.at[r], self.at[r + 1]) for r in rows])
        codes, own = self.code[use], np.repeat(np.arange(len(rows)), self.size[rows])
        o = np.argsort(codes, kind="stable")
        return codes[o], own[o]

    def shared(self, x: int, codes, own, n: int) -> np.ndarray:
        """Intersection sizes of document x with the indexed rows."""
        mine = self.code[self.at[x]:self.at[x + 1]]
        a, b = np.searchsorted(codes, mine, "left"), np.searchsorted(codes, mine, "right")
        k = b - a
        at = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return np.bincount(own[at], minlength=n)

    def join(self, rows: np.ndarray, pivots: int = 8, small: int = 48):
        if len({self.find(int(r)) for r in rows}) < 2:
            return
        codes, own = self.index(rows)
        if len(rows) <= small:
            return self.all_pairs(rows, codes, own)
        dist = np.empty((pivots, len(rows)))
        chosen = rows[np.linspace(0, len(rows) - 1, pivots).astype(int)]
        for i, p in enumerate(chosen):
            both = self.shared(int(p), codes, own, len(rows))
            union = self.size[p] + self.size[rows] - both
            dist[i] = 1 - both / union
            self.link(int(p), rows[100 * both >= self.percent * union])
        near = dist.min(0)
        cells = [rows[(dist[i] <= near + 2 * self.tau + 1e-9) & (rows != p)] for i, p in enumerate(chosen)]
        if max(map(len, cells)) > 0.6 * len(rows):  # too close together (or too far apart) for the windows to part them
            return self.all_pairs(rows, codes, own)
        for cell in cells:
            if len(cell) > 1:
                self.join(cell, pivots, small)

    def all_pairs(self, rows, codes, own):
        """Every document against all others of the region that are not in its component yet."""
        root = np.array([self.find(int(r)) for r in rows])
        for root_of, n in sorted(zip(*np.unique(root, return_counts=True)), key=lambda x: x[1])[:-1]:
            for x in rows[root == root_of]:  # the largest component is met from the other side
                both = self.shared(int(x), codes, own, len(rows))
                union = self.size[x] + self.size[rows] - both
                self.link(int(x), rows[100 * both >= self.percent * union])


def _join_blocks(k, percent):
    """Rows sorted by (family, block): join each block; links that connect its documents."""
    def flush(cids, texts):
        sets = shingle_sets(pa.array(texts, pa.string()), k)
        keep = {}
        for c, x in zip(cids, sets):
            if len(x):
                keep.setdefault(c, x)
        if len(keep) < 2:
            return []
        names = list(keep)
        region = _Region([keep[c] for c in names], percent)
        region.join(np.arange(len(names)))
        return [(names[a], names[b]) for a, b in region.links]

    def run(batches):
        key, cids, texts = None, [], []
        for b in batches:
            out = []
            for f, x, y, c, t in zip(*(b.column(n).to_pylist() for n in ("family", "x", "y", "cid", "text"))):
                if (f, x, y) != key:
                    out += flush(cids, texts) if len(cids) > 1 else []
                    key, cids, texts = (f, x, y), [], []
                elif c == cids[-1]:
                    continue
                cids.append(c)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = flush(cids, texts) if len(cids) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def _region_edges(wide: DataFrame, sigs: str, parts: int) -> DataFrame:
    """pivot, cid: the lowest class of each region with the region's other classes; one exchange serves both sides."""
    sig = wide.select("cid", F.explode(sigs).alias("region")).repartition(parts, "region")
    low = sig.groupBy("region").agg(F.min("cid").alias("pivot"), F.max("cid").alias("most")).where("pivot < most")
    return sig.join(low, "region").where("cid <> pivot").select("pivot", "cid").distinct()


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, chunk: int = 400_000, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows are doc_id, th (hash of the text), n_shingles, class_id (equal sets), component_id;
    links are class pairs (a, b) at or above ``percent``, enough to connect every component.

    Two documents link when 100 * intersection >= percent * union of their sets of lower-cased word
    k-grams.  ``component_id`` is the smallest doc_id reachable by links.  Null and empty texts have no
    shingles and link with nothing (own doc_id); null doc_ids link by their text but name no component;
    repeated rows get a row each; no rows give no rows.  ``chunk`` bounds the shingles of a block's side.
    """
    spark = ready(docs)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    wide = stage(src.mapInArrow(_base(k, percent), "doc_id long, th long, n long, cid long, " + ", ".join(f"{c} array<long>" for c in _SIGS)), "jaccard")
    base = stage(wide.select("doc_id", "th", "n", "cid"), "jaccard")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = union_all([stage(_region_edges(wide, c, parts), "jaccard") for c in _SIGS])
    unstage(wide)  # the signatures are most of what is staged, and edges are all that is asked of them
    family = components(edges, "pivot", "cid").select(F.col("node").alias("cid"), F.col("component").alias("family"))
    reps = base.where("n > 0").groupBy("cid").agg(F.min(F.struct("th", "doc_id")).alias("one"), F.max("n").alias("n")).join(family, "cid")
    reps = reps.select("cid", "family", "n", "one.th", F.col("one.doc_id").alias("rep"))
    reps = stage(reps.withColumn("x", F.expr(f"coalesce(sum(n) over (partition by family order by n, cid rows between unbounded preceding "
                                             f"and 1 preceding), 0L) div {chunk}L")), "jaccard")
    sides = reps.groupBy("family", "x").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("size"))
    other = sides.select("family", F.col("x").alias("y"), F.col("lo").alias("lo2"))
    blocks = sides.join(other, "family").where(f"x <= y and lo2 * {percent} <= hi * 100").select("family", "x", "y")
    ends = blocks.select("family", "x", "y", F.col("x").alias("side")).unionByName(
        blocks.where("x < y").select("family", "x", "y", F.col("y").alias("side")))
    spread = reps.select("family", F.col("x").alias("side"), "cid").join(ends, ["family", "side"]).select("cid", "family", "x", "y")
    # a chunk's texts go to each of its blocks: about as many texts as there are classes are on disk at a time
    own = sides.agg(F.sum("size")).scalar()
    sent = ends.join(sides.select("family", F.col("x").alias("side"), "size"), ["family", "side"])
    many = sent.agg(F.coalesce(F.ceil(F.sum("size") / own), F.lit(1))).first()[0]
    one = reps.select(F.col("th").alias("rep_th"), "rep", "cid")
    texts = stage(src.join(one, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "text"), "jaccard")
    links = []
    for i in range(many):
        mine = spread.where(F.pmod(F.xxhash64("family", "x", "y"), F.lit(many)) == i).join(texts, "cid")
        rows = mine.select("family", "x", "y", "cid", "text").repartition(parts, "family", "x", "y").sortWithinPartitions("family", "x", "y", "cid")
        links.append(stage(rows.mapInArrow(_join_blocks(k, percent), "a long, b long"), "jaccard"))
    unstage(texts)
    links = union_all(links)
    comp = components(links)
    best = base.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"))
    named = best.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    names = named.join(low, "component").select(F.col("cid").alias("class_id"), "component_id")
    rows = (base.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"))
            .join(names, "class_id", "left")
            .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))))
    return rows, links


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                     **params) -> DataFrame:
    """The rows of ``docs`` with one document of each component left (the smallest doc_id), columns unchanged.
    Rows without an id or without words stay; of rows that repeat id and text one stays."""
    rows, _ = jaccard_classes(docs, k, percent, id_col=id_col, text_col=text_col, **params)
    gone = rows.where("doc_id <> component_id").select("doc_id", "th").distinct()
    th = "_text_hash"
    marked = docs.withColumn(th, F.xxhash64(F.col(text_col).cast("string")))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th"))
    left = marked.join(gone, (F.col(th) == F.col("_gone_th")) & (F.col(id_col) == F.col("_gone_id")), "left_anti")
    return left.dropDuplicates([id_col, th]).select(*docs.columns)
