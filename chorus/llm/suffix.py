"""Repeated passages by suffix sorting: every byte covered by a ``length``-byte string that also starts
anywhere else in the corpus is removed.

1. Candidates.  Every ``length``-byte window has an anchor, the smallest hash among its ``gram``-byte
   substrings, so equal windows have equal anchors at the same place.  Windows in a row with one anchor
   form a segment (some 150 window starts).  Anchors that occur once in the corpus end here; the only
   rows shuffled so far are hashes and places.
2. Equal segments are counted by a 128-bit digest before anything else moves: a segment that occurs twice
   is repeated whole, and a passage in a third of all documents is one row per task.
3. The different segments of one anchor are compared by suffix sorting, many anchors to a task.  Equal
   windows hold their anchor at the same place, so only the suffixes that start at anchors are sorted
   directly; those that start before are induced from them, one byte to the left a round, and neighbours
   that share ``length`` bytes mark each other's starts.  Anchors with more than ``max_group`` different
   segments would make a task too large; their windows are counted by digest instead, one row a window,
   spread over all tasks.
4. Marked starts go back to the documents by text hash; overlapping runs merge.

Texts move twice: to cut the segments of step 3, and for the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.common import SPACE_BYTES, chunks, ready, stage, text_bytes

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_SLICE = 1 << 20
_POS = np.uint64((1 << 21) - 1)
_BUFFER = 2 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _B, np.uint64), np.full(n, _B_INV, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _grams(raw: np.ndarray, g: int) -> np.ndarray:
    """A 64-bit hash of the g bytes from every place."""
    global _UP, _DOWN
    n = len(raw)
    if len(_UP) < n:
        _UP, _DOWN = _powers(max(n, 1 << 16))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[:n], dtype=np.uint64)])
        x = (total[g:] - total[:-g]) * _DOWN[:n - g + 1]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (w - size)], v[w - size:]) if w > size else v


def segments(raw: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(anchor hash, first window start, number of starts, anchor place) of all segments; ``ends`` is the end
    of the document each byte belongs to."""
    n = len(raw)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    h = _grams(raw, gram)
    places = np.arange(len(h), dtype=np.uint64)
    v = _window_min((h & ~_POS) | places, length - gram + 1)
    at = (v & _POS).astype(np.int64)
    starts = np.arange(len(at))
    ok = starts + length <= ends[:len(at)]
    starts, at = starts[ok], at[ok]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)])
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(starts)))
    return h[at[first]], starts[first], count, at[first]


def _slices(raw: np.ndarray, offsets: np.ndarray, length: int):
    """(bytes, document end of each byte, row of each document, its start) in slices of about a megabyte.
    Documents longer than a slice are cut with ``length - 1`` bytes of overlap, so every window is in one."""
    row, n = 0, len(offsets) - 1
    while row < n:
        a = int(offsets[row])
        if offsets[row + 1] - a > _SLICE:
            end = int(offsets[row + 1])
            while True:
                stop = min(end, a + _SLICE)
                yield raw[a:stop], np.array([0, stop - a]), np.array([row]), np.array([a - int(offsets[row])])
                if stop == end:
                    break
                a = stop - length + 1
            row += 1
        else:
            last = max(row + 1, int(np.searchsorted(offsets, a + _SLICE, "right")) - 1)
            yield raw[a:offsets[last]], offsets[row:last + 1] - a, np.arange(row, last), np.zeros(last - row, np.int64)
            row = last


def _scan(length, gram, hashes_only=False):
    """Rows (h, th, p, n, rel, dig) of all segments, or their anchor hashes alone."""
    def run(batches):
        import xxhash
        for whole in batches:
            for b in chunks(whole, "text", 4 << 20):
                raw, offsets = text_bytes(b.column("text"))
                th = [] if hashes_only else b.column("th").to_pylist()
                for part, cuts, rows, base in _slices(raw, offsets, length):
                    which = np.repeat(np.arange(len(rows)), np.diff(cuts))
                    h, start, count, at = segments(part, cuts[1:][which], length, gram)
                    if not len(h):
                        continue
                    if hashes_only:
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
                        continue
                    data = part.tobytes()
                    doc = which[start]
                    stops = start + count - 1 + length
                    dig = [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(start.tolist(), stops.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array([th[rows[d]] for d in doc], pa.binary()),
                         pa.array(start - cuts[doc] + base[doc], pa.int64()), pa.array(count, pa.int32()),
                         pa.array(at - start, pa.int32()), pa.array(dig, pa.binary())],
                        names=["h", "th", "p", "n", "rel", "dig"])
    return run


def _cut(length):
    """Bytes of the wanted segments of every text."""
    def run(batches):
        for b in batches:
            out = []
            for text, want in zip(b.column("text"), b.column("want")):
                data = text.as_py().encode() if text.is_valid else b""
                for x in want.as_py():
                    out.append((x["h"], x["dig"], x["c"], x["rel"], data[x["p"]:x["p"] + x["n"] - 1 + length]))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())],
                                             names=["h", "dig", "c", "rel", "bytes"])
    return run


def _packed(t: np.ndarray) -> np.ndarray:
    """Seven 9-bit symbols from every place in one number (zeros after the end)."""
    t = np.concatenate([t.astype(np.int64), np.zeros(6, np.int64)])
    n = len(t) - 6
    k = np.zeros(n, np.int64)
    for j in range(7):
        k = (k << 9) | t[j:j + n]
    return k


def _sort_places(keys, s: np.ndarray, depth: int) -> np.ndarray:
    """Places ``s`` in the order of their suffixes; ``keys`` gives the seven packed symbols from any places.
    Seven symbols a round, only ties going on; ties of ``depth`` symbols stay together in any order."""
    k = keys(s)
    o = np.argsort(k, kind="stable")
    s, k = s[o], k[o]
    tie = np.concatenate([[False], k[1:] == k[:-1]]) if len(s) else np.zeros(0, bool)
    done = 7
    todo = np.nonzero(tie | np.append(tie[1:], False))[0] if len(s) else np.zeros(0, np.int64)
    group = np.cumsum(~tie)[todo] if len(todo) else todo
    while done < depth and len(todo):
        k = keys(s[todo] + done)
        done += 7
        peer = group[1:] == group[:-1]
        differ = peer & (k[1:] != k[:-1])
        if not differ.any():
            continue
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][differ]] = True
        part = np.nonzero(mixed[group])[0]  # only groups that this round parts are sorted
        o = part[np.lexsort((k[part], group[part]))]
        s[todo[part]] = s[todo[o]]
        k[part] = k[o]
        same = np.concatenate([[False], peer & (k[1:] == k[:-1])])
        keep = same | np.append(same[1:], False)
        group = np.cumsum(~same)[keep]
        todo = todo[keep]
    return s


def suffix_array(t: np.ndarray, depth: int, places: np.ndarray | None = None) -> np.ndarray:
    """Places of ``t`` (symbols 0 to 256) in the order of their suffixes; only ``places``, if given.

    Suffixes smaller than their successor are sorted directly, ties of ``depth`` symbols stay together in any
    order.  The others are induced, bucket by bucket (two-stage sorting).  Given places are all sorted directly.
    """
    n = len(t)
    if places is not None:
        ended = np.concatenate([t, np.zeros(depth + 14, t.dtype)])

        def keys(p):
            k = np.zeros(len(p), np.int64)
            for j in range(7):
                k = (k << 9) | ended[p + j]
            return k
        return _sort_places(keys, np.asarray(places, np.int64), depth)
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.nonzero(np.diff(t.astype(np.int32)))[0]
    nxt = np.append(t[change + 1].astype(np.int32), -1)  # symbol after the run, none at the end
    run = np.repeat(np.arange(len(change) + 1), np.diff(np.concatenate([[0], change + 1, [n]])))
    small = nxt[run] > t
    padded = np.concatenate([_packed(t), np.zeros(depth + 8, np.int64)])
    s = _sort_places(lambda p: padded[p], np.nonzero(small)[0], depth)
    bounds = np.searchsorted(t[s], np.arange(258)) if len(s) else np.zeros(258, np.int64)
    larger: list[list[np.ndarray]] = [[] for _ in range(257)]
    larger[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in np.unique(t):
        c = int(c)
        front = np.concatenate([*larger[c], np.zeros(0, np.int64)]).astype(np.int64)
        parts = [front]
        while len(front):  # runs of one symbol: each induces the one before it
            before = front[front > 0] - 1
            front = before[(t[before] == c) & ~small[before]]
            parts.append(front)
        bucket = np.concatenate([*parts, s[bounds[c]:bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            sym = t[before]
            o = np.argsort(sym, kind="stable")
            before, sym = before[o], sym[o]
            cut = np.nonzero(np.diff(sym))[0] + 1
            for piece in np.split(before, cut):
                larger[int(t[piece[0]])].append(piece)
    return np.concatenate(out)


def common_at_least(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of places share ``length`` bytes (the common prefix, eight bytes a round)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(raw) + 1,), strides=(1,))
    alive = np.arange(len(a))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _range_min(v: np.ndarray):
    """A function of (i, j), i < j: the smallest of v[i + 1], ..., v[j]."""
    rows = [v]
    while 1 << len(rows) <= len(v):
        half = 1 << (len(rows) - 1)
        rows.append(np.append(np.minimum(rows[-1][:-half], rows[-1][half:]), rows[-1][-half:]))
    table = np.array(rows)
    level = np.zeros(len(v) + 1, np.int64)
    for x in range(1, len(rows)):
        level[1 << x:] = x

    def smallest(i, j):
        x = level[j - i]
        return np.minimum(table[x, i + 1], table[x, j + 1 - (1 << x)])
    return smallest


def _aligned_hits(raw: np.ndarray, t: np.ndarray, begin: np.ndarray, sizes: np.ndarray, length: int, at: np.ndarray,
                  group: np.ndarray) -> np.ndarray:
    """Which places of ``raw`` start a window that another string of its group holds as far from its anchor.

    The suffixes at the anchors are sorted.  A class holds the strings of a group that agree on the d bytes
    before the anchor, in that order; each round adds a byte to the left, which parts classes and keeps the
    order in them.  Two neighbours of a class share the windows d bytes before their anchors if d and the
    common prefix of their anchors' suffixes make ``length``.  Strings alone in their class, or whose anchor's
    suffix shares too little for their largest d, are through.
    """
    hit = np.zeros(len(raw), bool)
    if not len(sizes):
        return hit
    anchor = begin + at
    order = np.searchsorted(anchor, suffix_array(t, length, anchor))
    order = order[np.argsort(group[order], kind="stable")]
    right = np.minimum(sizes - at, length)
    sight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(length, np.uint8)]), length)[anchor[order]]
    differ = sight[1:] != sight[:-1]
    common = np.where(differ.any(1), differ.argmax(1), length)
    del sight, differ
    common = np.minimum(common, np.minimum(right[order[1:]], right[order[:-1]]))
    smallest = _range_min(np.concatenate([[0], common]))
    place = np.arange(len(order))  # in the order at the anchors
    cls = group[order]
    d = 0
    while True:
        pair = np.nonzero(cls[1:] == cls[:-1])[0]
        shared = smallest(place[pair], place[pair + 1])
        found = pair[shared + d >= length]
        first = anchor[order] - d
        hit[first[found]] = True
        hit[first[found + 1]] = True
        best = np.zeros(len(order), np.int64)  # longest common prefix with a neighbour of the class
        best[pair] = shared
        best[pair + 1] = np.maximum(best[pair + 1], shared)
        reach = at[order]
        go = (reach > d) & (best + reach >= length) & (best > 0)
        order, place, cls = order[go], place[go], cls[go]
        if len(order) < 2:
            return hit
        d += 1
        byte = raw[anchor[order] - d]
        key = cls * 256 + byte
        if ((cls[1:] == cls[:-1]) & (byte[1:] != byte[:-1])).any():
            o = np.argsort(key, kind="stable")
            order, place, key = order[o], place[o], key[o]
        cls = np.cumsum(np.append(False, key[1:] != key[:-1]))


def repeated_starts(parts: list[bytes], length: int, at: np.ndarray | None = None, group: np.ndarray | None = None) -> list[np.ndarray]:
    """For each byte string, which of its ``length``-byte windows occur elsewhere in the list (or in itself).

    ``at`` and ``group`` say that windows can only be equal in different strings of one group (a number from 0)
    and as far from the place ``at`` in them, which all windows hold; then only the suffixes at these places
    are sorted, and the others induced from them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    t = raw.astype(np.uint16) + 1
    t[begin + sizes] = 0  # separators: no byte equals them
    if at is not None:
        hit = _aligned_hits(raw, t, begin, sizes, length, at, group)
        return [hit[b:b + max(0, s - length + 1)] for b, s in zip(begin, sizes)]
    sa = suffix_array(t, length)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    valid = sa + length <= (begin + sizes)[owner[sa]]
    sa = sa[valid]
    hit = np.zeros(len(raw), bool)
    if len(sa) > 1:
        same = common_at_least(raw, sa[:-1], sa[1:], length)
        hit[sa[:-1][same]] = True
        hit[sa[1:][same]] = True
    return [hit[b:b + max(0, s - length + 1)] for b, s in zip(begin, sizes)]


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])]


_RUNS = "array<struct<a:int,b:int>>"
_RUNS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_groups(length):
    """Rows sorted by (h, dig): suffix-sort whole groups, some megabytes at a time."""
    def flush(rows):
        at = np.array([r[3] for r in rows], np.int64)
        group = np.cumsum([0] + [a[0] != b[0] for a, b in zip(rows, rows[1:])])
        hits = repeated_starts([r[2] for r in rows], length, at, group)
        out = [(r[0], r[1], _runs(m)) for r, m in zip(rows, hits) if m.any()]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], _RUNS_ARROW)],
                                          names=["h", "dig", "runs"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for h, d, x, rel in zip(*(b.column(c).to_pylist() for c in ("h", "dig", "bytes", "rel"))):
                if (h, d) == last:
                    continue
                if size > _BUFFER and h != last[0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append((h, d, x, rel))
                size += len(x)
                last = (h, d)
        if rows:
            yield flush(rows)
    return run


def _windows(length):
    """One row a window: its place before the anchor and a digest of its bytes."""
    def run(batches):
        import xxhash
        for b in batches:
            for h, d, rel, x in zip(*(b.column(c).to_pylist() for c in ("h", "dig", "rel", "bytes"))):
                n = len(x) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * n, pa.int64()), pa.array([d] * n, pa.binary()), pa.array(np.arange(n), pa.int32()),
                     pa.array([xxhash.xxh3_128_digest(x[i:i + length]) for i in range(n)], pa.binary())],
                    names=["h", "dig", "i", "w"])
    return run


def _words_inside(data: bytes, s: int, e: int) -> int:
    """Words of ``data[s:e]`` that the edges do not cut; cutting off punctuation alone cuts no word."""
    inner = lambda c: c >= 128 or chr(c).isalnum()
    words = data[s:e].split()
    n = len(words)
    for at, end in ((s, 0), (e, -1)):
        if words and 0 < at < len(data) and data[at - 1] not in SPACE_BYTES and data[at] not in SPACE_BYTES:
            n -= (inner(data[at - 1]) and inner(data[at])) or not any(map(inner, words[end]))
    return n


def _long_runs(data: bytes, starts: list, length: int, over_words: int, whole: int) -> list:
    """Runs of starts, joined where one goes on in the next, of more than ``over_words`` words or at least ``whole`` bytes."""
    joined: list[dict] = []
    for s in sorted(starts, key=lambda s: (s["a"], s["b"])):
        if joined and s["a"] <= joined[-1]["b"]:
            joined[-1]["b"] = max(joined[-1]["b"], s["b"])
        else:
            joined.append({"a": s["a"], "b": s["b"]})
    return [s for s in joined if s["b"] - 1 + length - s["a"] >= whole or _words_inside(data, s["a"], s["b"] - 1 + length) > over_words]


def _apply(length, names, as_text, over_words=None, whole=None):
    def run(batches):
        for b in batches:
            spans, kept, sizes = [], [], []
            for text, starts in zip(b.column("_text").to_pylist(), b.column("_starts").to_pylist()):
                data = (text or "").encode()
                sizes.append(len(data))
                merged: list[list[int]] = []
                if over_words is not None and starts:
                    starts = _long_runs(data, starts, length, over_words, whole)
                for x in sorted((s["a"], s["b"] - 1 + length) for s in starts or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                spans.append([{"start": a, "end": e} for a, e in merged])
                at, rest = 0, []
                for a, e in merged:
                    rest.append(data[at:a])
                    at = e
                rest = b"".join([*rest, data[at:]])
                kept.append((rest.decode(errors="ignore") if merged else text) if as_text else rest)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string() if as_text else pa.binary())],
                names=[*names, "_bytes", "_spans", "_kept"])
    return run


def repeated_places(docs: DataFrame, length: int = 400, gram: int | None = None, max_group: int = 4096,
                    text_col: str = "text") -> DataFrame:
    """th (md5 of the text), starts: the runs [a, b) of byte places where a ``length``-byte string starts that
    also starts elsewhere.  Rows only for texts that have some.  ``length`` is 8 or more; anchors are hashes
    of ``gram`` bytes (a quarter of ``length`` by default)."""
    if length < 8:
        raise ValueError("length must be 8 or more")
    gram = gram or max(4, length // 4)
    spark = ready(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.unhex(F.md5(text)).alias("th"), text.alias("text")).where(F.octet_length("text") >= length)
    # two scans, so that the segments of anchors that occur once are never written
    hashes = src.select("text").mapInArrow(_scan(length, gram, hashes_only=True), "h long")
    twice = stage(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("h"), "suffix")
    # a plain table on either side: Spark can split the rows of a hot anchor
    occ = stage(src.mapInArrow(_scan(length, gram), "h long, th binary, p long, n int, rel int, dig binary").join(twice, "h"), "suffix")
    kinds = stage(occ.groupBy("h", "dig").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("th", "p", "n", "rel")).alias("at")), "suffix")
    groups = stage(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1"),
                   "suffix")
    need = kinds.join(groups.select("h", "kinds"), "h")
    want = need.groupBy("at.th").agg(F.collect_list(F.struct("h", "dig", "c", F.col("at.p").alias("p"), F.col("at.n").alias("n"),
                                                            F.col("at.rel").alias("rel"))).alias("want"))
    parts = src.join(want, "th").select("text", "want").mapInArrow(_cut(length), "h long, dig binary, c long, rel int, bytes binary")
    parts = stage(parts.join(groups.select("h", "kinds"), "h"), "suffix")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # sorting is slow for its bytes: no coalescing
    normal = (parts.where(F.col("kinds") <= max_group).select("h", "dig", "rel", "bytes")
              .repartition(width, "h").sortWithinPartitions("h", "dig"))
    marks = normal.mapInArrow(_sorted_groups(length), f"h long, dig binary, runs {_RUNS}")
    large = parts.where(F.col("kinds") > max_group).dropDuplicates(["h", "dig"])
    wins = large.mapInArrow(_windows(length), "h long, dig binary, i int, w binary")
    wins = wins.join(wins.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w"), ["h", "w"])
    marks = marks.unionByName(wins.groupBy("h", "dig").agg(F.array_agg(
        F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b"))).alias("runs")).select("h", "dig", F.col("runs").cast(_RUNS)))
    whole = kinds.where("c > 1").select("h", "dig", F.lit(True).alias("whole"))
    marks = stage(kinds.select("h", "dig").join(whole, ["h", "dig"], "left").join(marks, ["h", "dig"], "left")
                  .where("whole or runs is not null"), "suffix")
    runs = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))).otherwise(F.col("runs"))
    found = occ.join(marks, ["h", "dig"]).select("th", "p", F.explode(runs).alias("r"))
    found = found.select("th", (F.col("p") + F.col("r.a")).alias("a"), (F.col("p") + F.col("r.b")).alias("b")).distinct()
    return stage(found.groupBy("th").agg(F.collect_list(F.struct("a", "b")).alias("starts")), "suffix")


def drop_repeats(docs: DataFrame, length: int = 400, as_text: bool = False, text_col: str = "text", over_words: int | None = None,
                 whole: int = 1 << 30, **params) -> DataFrame:
    """All columns of ``docs`` with n_bytes, spans (removed byte runs) and kept (the other bytes, or as_text).

    Null and empty texts and those shorter than ``length`` keep all; null texts are empty bytes (null as
    text); equal rows remove each other whole; no rows give no rows.  With ``as_text`` a character cut by
    a run's edge goes too.  Columns of ``docs`` called n_bytes, spans or kept are replaced.
    With ``over_words``, of the places where ``length``-byte strings that also start elsewhere follow each other
    without a gap only those stay in the result that hold more whole words, or ``whole`` bytes.
    """
    found = repeated_places(docs, length=length, text_col=text_col, **params)
    docs = docs.drop("n_bytes", "spans", "kept")
    names = docs.columns
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn("_text", text).withColumn("_th", F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    joined = keyed.join(found.select(F.col("th").alias("_found"), F.col("starts").alias("_starts")),
                        F.col("_th") == F.col("_found"), "left").select(*names, "_text", "_starts")
    schema = T.StructType([*docs.schema.fields, T.StructField("_bytes", T.LongType()),
                           T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           T.StructField("_kept", T.StringType() if as_text else T.BinaryType())])
    return joined.mapInArrow(_apply(length, names, as_text, over_words, whole), schema).select(
        *names, F.col("_bytes").alias("n_bytes"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))


def cut_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` with their repeated passages gone, columns unchanged; ``n_chars`` follows the text."""
    got = drop_repeats(docs, length, as_text=True, text_col=text_col, **params)
    out = {text_col: F.col("kept"), **({"n_chars": F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(
        F.length("kept")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return got.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
