"""Near-duplicate vectors by NN-descent: links at cosine >= ``threshold`` and their components.

1. Equal vectors are one node with a weight.  Random hyperplane codes sort the nodes several times over;
   blocks of consecutive rows (bounded whatever the data) give every node its first neighbour list.
2. NN-descent: at every node, its neighbours and those that name it are compared with each other, and each
   keeps its best ``k``; rounds go on until few lists change.
3. A list is saturated when its last entry still reaches the threshold.  The lists of a component with
   saturated nodes are enlarged to the whole component: its members are compared exactly, in bounded
   blocks.  In a component too large for that, members within half the threshold's angle of the
   component's mean all link with each other (the triangle inequality on angles), which counts their
   links without comparing them; only the others are compared with all.  Full lists name no farther
   partners, so components with saturated nodes also search outwards before that: pieces that a block
   shows to be connected are joined, then the means and radii of these components say which of them can
   still reach each other, and those are compared exactly and joined when they link.
4. Recall is audited against brute force, row by row, for a sample of all rows and one of the rows outside
   saturated components; while either mean is below the target, more code orders and rounds are added, and
   a target that is never reached is an error.

Pairs kept are checked in double precision, so no link lies below the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import components, ready, stage, union_all

_NODE = "rid long, low long, weight long, x binary"
#: In place of a cosine: the two nodes are in one component, without being a listed link.
_JOIN = 2.0
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cos", pa.float64())])


def _rows(col: pa.Array) -> np.ndarray:
    """A column of equally long float64 blobs as a matrix."""
    n = len(col)
    if not n:
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(n, -1)


def _edges(u, v, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(c, pa.float64())], schema=_EDGE)


def _units(dim):
    """Unit vectors (double) of the lists; shorter ones end in zeros."""
    def run(batches):
        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                x = np.zeros(dim)
                x[:len(v)] = v
                x /= np.abs(x).max()
                out.append((x / math.sqrt(float(x @ x))).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "low", "weight")), pa.array(out, pa.binary())],
                                             names=["rid", "low", "weight", "x"])
    return run


def _codes(dim, bits, trees, seed):
    def run(batches):
        planes = [np.random.default_rng([seed, t]).standard_normal((bits + 1, dim)) for t in trees]
        for b in batches:
            x = _rows(b.column("x"))
            for t, p in zip(trees, planes):
                y = x @ p.T if len(x) else np.zeros((0, bits + 1))
                code = ((y[:, :bits] > 0) @ (1 << np.arange(bits)[::-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(code), pa.array(y[:, bits]),
                                                  b.column("rid"), b.column("x")], names=["tree", "code", "fine", "rid", "x"])
    return run


def _labels(hit):
    """Smallest place that every row of a symmetric matrix of links reaches."""
    label = np.arange(len(hit))
    near = hit | np.eye(len(hit), dtype=bool)
    while True:
        low = np.where(near, label[None, :], len(hit)).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _best(ids, x, k, threshold):
    """The k best others of every row of a block, and joins (cos = _JOIN) of what links beyond them."""
    u, v, c, s, top = _top(ids, x, k)
    if top is None or k >= len(ids) - 1:
        return u, v, c
    hit = s >= threshold
    listed = np.zeros_like(hit)
    np.put_along_axis(listed, top, True, 1)
    listed &= hit
    one, all_ = _labels(listed | listed.T), _labels(hit)
    roots = np.nonzero((one == np.arange(len(ids))) & (all_ != one))[0]
    return (np.concatenate([u, ids[roots]]), np.concatenate([v, ids[all_[roots]]]),
            np.concatenate([c, np.full(len(roots), _JOIN)]))


def _top(ids, x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), s, None
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel(), s, top


def _blocks(k, size, threshold):
    """Consecutive rows of one order, ``size`` at a time."""
    def run(batches):
        ids, xs, tree = np.zeros(0, np.int64), None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column("tree").to_numpy()
            x, r = _rows(b.column("x")), b.column("rid").to_numpy()
            for piece in np.split(np.arange(len(t)), np.nonzero(np.diff(t))[0] + 1):
                if xs is not None and t[piece[0]] != tree:
                    yield _edges(*_best(ids, xs, k, threshold))
                    ids, xs = np.zeros(0, np.int64), None
                tree = t[piece[0]]
                ids = np.concatenate([ids, r[piece]])
                xs = x[piece] if xs is None else np.concatenate([xs, x[piece]])
                while len(ids) >= 2 * size:
                    yield _edges(*_best(ids[:size], xs[:size], k, threshold))
                    ids, xs = ids[size:], xs[size:]
        if xs is not None:
            yield _edges(*_best(ids, xs, k, threshold))
    return run


def _at_node():
    """Neighbours of one node compared with each other: pairs better than the worst entry of either list."""
    def flush(ids, low, x):
        s = x @ x.T
        np.fill_diagonal(s, -2)
        a, c = np.nonzero(s > low[:, None])
        return ids[a], ids[c], s[a, c]

    def run(batches):
        key, hold = None, []
        for b in batches:
            w, m, low, x = b.column("w").to_numpy(), b.column("m").to_numpy(), b.column("kth").to_numpy(), _rows(b.column("x"))
            out = []
            for piece in np.split(np.arange(len(w)), np.nonzero(np.diff(w))[0] + 1) if len(w) else []:
                if w[piece[0]] != key:
                    if hold:
                        out.append(flush(*(np.concatenate(c) for c in zip(*hold))))
                    key, hold = w[piece[0]], []
                hold.append((m[piece], low[piece], x[piece]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))
        if hold:
            yield _edges(*flush(*(np.concatenate(c) for c in zip(*hold))))
    return run


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k best distinct neighbours."""
    best = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    return best.withColumn("n", rank).where(f"n <= {k}").drop("n")


def _count_links(threshold):
    """(rid, links) parts of one block of compared nodes against one block of members."""
    def run(batches):
        for b in batches:
            out_id, out_n = [], []
            for ra, wa, xa, rb, wb, ball, xb in zip(*(b.column(c) for c in ("ra", "wa", "xa", "rb", "wb", "ball", "xb"))):
                ra, wa, rb, wb = (np.array(c.as_py(), np.int64) for c in (ra, wa, rb, wb))
                inside = np.array(ball.as_py(), bool)
                a = np.frombuffer(b"".join(xa.as_py()), np.float64).reshape(len(ra), -1)
                c = np.frombuffer(b"".join(xb.as_py()), np.float64).reshape(len(rb), -1)
                hit = (a @ c.T >= threshold) & (ra[:, None] != rb[None, :])
                out_id += [ra, rb[inside]]
                out_n += [hit @ wb, wa @ hit[:, inside]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out_id, np.zeros(0, np.int64)])),
                                              pa.array(np.concatenate([*out_n, np.zeros(0, np.int64)]).astype(np.int64))], names=["rid", "links"])
    return run


def _audit(sent, threshold):
    def run(batches):
        ids, q = sent.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                hit = (q @ _rows(b.column("x")).T >= threshold) & (ids[:, None] != b.column("rid").to_numpy()[None, :])
                total += hit @ b.column("weight").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["rid", "links"])
    return run


def _radii(batches):
    """Largest angle to its component's mean in every batch; no mean, no bound."""
    for b in batches:
        x, c = _rows(b.column("x")), b.column("component").to_numpy()
        m = np.array(b.column("mean").to_pylist(), float).reshape(len(x), -1)
        size = np.sqrt((m * m).sum(1))
        cos = np.where(size > 1e-9, (x * m).sum(1) / np.where(size > 1e-9, size, 1), -1.0) if len(x) else np.zeros(0)
        names, at = np.unique(c, return_inverse=True)
        low = np.full(len(names), 1.0)
        np.minimum.at(low, at, cos)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.arccos(np.clip(low, -1, 1)))], names=["component", "radius"])


def _reach(angle):
    """Pairs of components, of two blocks, that are near enough for a link."""
    def run(batches):
        for b in batches:
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for ca, ra, ma, cb, rb, mb in zip(*(b.column(n).to_pylist() for n in ("ca", "ra", "ma", "cb", "rb", "mb"))):
                ca, cb, ma, mb = np.array(ca, np.int64), np.array(cb, np.int64), np.array(ma, float), np.array(mb, float)
                ma, mb = (m / np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None] for m in (ma, mb))
                apart = np.arccos(np.clip(ma @ mb.T, -1, 1))
                i, j = np.nonzero((apart <= np.array(ra)[:, None] + np.array(rb)[None, :] + angle + 1e-6) & (ca[:, None] < cb[None, :]))
                out[0].append(ca[i])
                out[1].append(cb[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names=["a", "b"])
    return run


def _meets(threshold):
    """Component pairs of which two blocks of members hold a link."""
    def run(batches):
        for b in batches:
            out = []
            for ca, cb, xa, xb in zip(*(b.column(n) for n in ("a", "b", "xa", "xb"))):
                x, y = (np.frombuffer(b"".join(v.as_py()), np.float64).reshape(len(v), -1) for v in (xa, xb))
                if (x @ y.T >= threshold).any():
                    out.append((ca.as_py(), cb.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def _outward(nodes: DataFrame, comp: DataFrame, full: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): components with saturated lists that link with each other, by exact comparison of all
    pairs that the triangle inequality on their means and radii does not rule out."""
    members = stage(nodes.join(comp.withColumnRenamed("node", "rid"), "rid").join(full, "component").select("component", "rid", "weight", "x"), "nnd")
    mean = stage(_means(members), "nnd")
    radius = (members.join(mean, "component").select("component", "x", "mean").mapInArrow(_radii, "component long, radius double")
              .groupBy("component").agg(F.max("radius").alias("radius")))
    balls = mean.join(radius, "component")
    groups = max(1, math.ceil(mean.count() / block))
    balls = balls.withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups)))

    def pack(s):
        return balls.groupBy(F.col("g").alias("g" + s)).agg(F.collect_list(F.struct("component", "radius", "mean")).alias("m")).select(
            "g" + s, F.col("m.component").alias("c" + s), F.col("m.radius").alias("r" + s), F.col("m.mean").alias("m" + s))
    both = stage(pack("a").crossJoin(pack("b")).repartition(groups * groups if groups < 32 else 1024, "ga", "gb")
                 .mapInArrow(_reach(math.acos(min(1.0, threshold))), "a long, b long"), "nnd")
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    near = both.select(F.col("a").alias("component")).unionByName(both.select(F.col("b").alias("component"))).distinct()
    cut = members.join(near, "component").join(size, "component").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / block)))
    cut = stage(cut.groupBy("component", "chunk").agg(F.collect_list("x").alias("x")), "nnd")
    sides = [cut.select(F.col("component").alias(s), F.col("x").alias("x" + s)) for s in ("a", "b")]
    return both.join(sides[0], "a").join(sides[1], "b").select("a", "b", "xa", "xb").mapInArrow(_meets(threshold), "a long, b long").distinct()


def _whole_components(nodes: DataFrame, comp: DataFrame, full: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rid, links): exact weights of links within the components that have saturated lists."""
    members = stage(nodes.join(comp.withColumnRenamed("node", "rid"), "rid").join(full, "component"), "nnd")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(sizes, "component")
    mean = _means(members.where(F.col("size") > block))
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    large = members.where(F.col("size") > block).join(mean, "component").mapInArrow(
        _in_ball(half), "component long, rid long, weight long, x binary, size long, ball boolean")
    all_ = members.where(F.col("size") <= block).select("component", "rid", "weight", "x", "size", F.lit(False).alias("ball")).unionByName(large)
    all_ = stage(all_.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / block))), "nnd")

    def pack(df, s):
        return df.groupBy("component", "chunk").agg(F.collect_list(F.struct("rid", "weight", "ball", "x")).alias("m")).select(
            "component", F.col("m.rid").alias("r" + s), F.col("m.weight").alias("w" + s), F.col("m.x").alias("x" + s),
            *([F.col("m.ball").alias("ball")] if s == "b" else []))
    outer = pack(all_.where("not ball"), "a")
    inner = pack(all_, "b")
    counted = outer.join(inner, "component").mapInArrow(_count_links(threshold), "rid long, links long")
    ball = all_.where("ball").groupBy("component").agg(F.sum("weight").alias("inside"))
    mutual = all_.where("ball").join(ball, "component").select("rid", (F.col("inside") - F.col("weight")).alias("links"))
    return counted.unionByName(mutual).groupBy("rid").agg(F.sum("links").alias("links"))


def _sum_rows(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        x = _rows(b.column("x"))
        c, w = b.column("component").to_numpy(), b.column("weight").to_numpy()
        for k in np.unique(c):
            total[k] = total.get(k, 0) + (x[c == k] * w[c == k, None]).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                     names=["component", "part"])


def _means(members: DataFrame) -> DataFrame:
    """Weighted sums of the members of every component, added up task by task."""
    parts = members.select("component", "weight", "x").mapInArrow(_sum_rows, "component long, part array<double>")
    added = parts.select("component", F.posexplode("part").alias("i", "v")).groupBy("component", "i").agg(F.sum("v").alias("v"))
    return added.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("mean"))


def _in_ball(half):
    def run(batches):
        for b in batches:
            x = _rows(b.column("x"))
            m = np.array(b.column("mean").to_pylist(), float).reshape(len(x), -1)
            size = np.sqrt((m * m).sum(1))
            inside = (x * m).sum(1) >= half * np.where(size > 0, size, np.inf) if len(x) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "rid", "weight", "x", "size")), pa.array(inside)],
                                             names=["component", "rid", "weight", "x", "size", "ball"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, k: int = 8, trees: int = 3, rounds: int = 2, block: int = 256,
                 whole: int = 1024, audit_rows: int = 512, recall: float = 0.95, attempts: int = 8, seed: int = 5,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, dict]:
    """(rows, audit): vec_id, n_links, component_id, kept for every row; audit has the measured recall, the
    mean over sampled rows with links (the smaller of all rows and those outside saturated components).
    Raises RuntimeError when it stays below ``recall`` after ``attempts`` sets of orders.

    ``n_links`` counts the other rows at cosine >= ``threshold``, equal vectors included.  Vectors that are
    null, zero or hold null or non-finite components link with nothing.  Null ids link, but name no component
    and are not kept; repeated rows count as rows; shorter vectors end in zeros; no rows give no rows.
    """
    spark = ready(vectors)
    x = F.col(vec_col)
    good = (x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
            & F.exists(x, lambda c: c != 0))
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, x).alias("v"))
    dim = src.agg(F.max(F.size("v"))).first()[0] or 0
    empty = src.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                          F.col("vec_id").isNotNull().alias("kept"))
    if dim < 1:
        return empty, {"recall": 1.0, "sample_links": 0}
    grouped = stage(src.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
                    .withColumn("rid", F.monotonically_increasing_id()), "nnd")
    nodes = stage(grouped.mapInArrow(_units(dim), _NODE), "nnd")
    n = nodes.count()
    bits = max(1, math.ceil(math.log2(max(2, n / block))))
    parts = max(1, n * trees // (block * 16))
    edges, joins, first = None, None, 0
    for _ in range(attempts):
        order = nodes.select("rid", "x").mapInArrow(_codes(dim, bits, list(range(first, first + trees)), seed),
                                                    "tree int, code long, fine double, rid long, x binary")
        order = order.repartitionByRange(parts, "tree", "code", "fine", "rid").sortWithinPartitions("tree", "code", "fine", "rid")
        new = stage(order.mapInArrow(_blocks(k, block, threshold), "u long, v long, cos double"), "nnd")
        more = new.where(F.col("cos") == _JOIN).select("u", "v")
        joins = more if joins is None else joins.unionByName(more)
        new = new.where(F.col("cos") < _JOIN)
        edges = stage(_lists(new if edges is None else new.unionByName(edges), k), "nnd")
        first += trees
        for _ in range(rounds):
            both = edges.select(F.col("u").alias("w"), F.col("v").alias("m")).unionByName(
                edges.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cos"), "u"))).where(f"n <= {k}")
                .select(F.col("v").alias("w"), F.col("u").alias("m"))).distinct()
            worst = edges.groupBy("u").agg(F.min("cos").alias("kth"))
            rows = both.join(nodes.select(F.col("rid").alias("m"), "x"), "m").join(worst.withColumnRenamed("u", "m"), "m")
            rows = rows.select("w", "m", "kth", "x").repartition("w").sortWithinPartitions("w", "m")
            found = rows.mapInArrow(_at_node(), "u long, v long, cos double")
            nxt = stage(_lists(edges.unionByName(found), k), "nnd")
            changed = nxt.join(edges, ["u", "v"], "left_anti").count()
            edges = nxt
            if changed <= 0.002 * n * k:
                break
        linked = edges.where(F.col("cos") >= threshold)
        tied = linked.select("u", "v").unionByName(joins)
        comp = components(tied, "u", "v")
        saturated = stage(edges.groupBy("u").agg(F.min("cos").alias("kth"), F.count(F.lit(1)).alias("n"))
                          .where((F.col("kth") >= threshold) & (F.col("n") >= k)).select(F.col("u").alias("node")), "nnd")
        full = stage(saturated.join(comp, "node").select("component").distinct(), "nnd")
        meets = stage(_outward(nodes, comp, full, threshold, whole), "nnd")  # a component's name is one of its nodes
        if not meets.isEmpty():
            comp = components(tied.unionByName(meets.select(F.col("a").alias("u"), F.col("b").alias("v"))), "u", "v")
            full = stage(saturated.join(comp, "node").select("component").distinct(), "nnd")
        exact = _whole_components(nodes, comp, full, threshold, whole)
        pairs = linked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        listed = (pairs.join(nodes.select(F.col("rid").alias("v"), "weight"), "v").groupBy(F.col("u").alias("rid")).agg(F.sum("weight").alias("links")))
        listed = listed.join(comp.withColumnRenamed("node", "rid"), "rid").join(full, "component", "left_anti").select("rid", "links")
        links = stage(listed.unionByName(exact), "nnd")
        inside = comp.join(full, "component").select(F.col("node").alias("rid"))
        rank = [F.xxhash64("rid"), "rid"]
        sample = {r["rid"]: r["x"] for part in (nodes, nodes.join(inside, "rid", "left_anti"))
                  for r in part.select("rid", "x").orderBy(*rank).limit(audit_rows).collect()}  # 2 * audit_rows vectors at most
        sent = spark.sparkContext.broadcast((np.array(list(sample), np.int64), np.array([np.frombuffer(x, np.float64) for x in sample.values()])))
        true = nodes.mapInArrow(_audit(sent, threshold), "rid long, links long").groupBy("rid").agg(F.sum("links").alias("truth"))
        share = F.least("truth", F.coalesce("links", F.lit(0))) / F.col("truth")
        got = (true.where("truth > 0").join(links, "rid", "left").join(inside.withColumn("inside", F.lit(True)), "rid", "left")
               .agg(F.sum("truth"), F.avg(share), F.avg(F.when(F.col("inside").isNull(), share))).first())
        measured = min(1.0 if g is None else g for g in got[1:])
        if measured >= recall:
            break
    else:
        raise RuntimeError(f"recall {measured:.4f} after {first} code orders, the target is {recall}")
    named = nodes.select("rid", "low", "weight").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn(
        "component", F.coalesce("component", "rid"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = (named.join(low, "component").join(links, "rid", "left")
             .select("rid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    rows = (src.where("v is not null").join(grouped.select("v", "rid"), "v").join(named, "rid")
            .select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")))
    return union_all([rows, empty]), {"recall": measured, "sample_links": got[0] or 0, "orders": first}

