"""Plain single-process versions of operators, for comparison."""

import hashlib
import math
import zlib
from collections import defaultdict


def rebuilt(rows, heads=6, group=100):
    """rows (conv_id, turn, role, text) -> conv_id: [(role, text)]"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest(), r, t))
    plain = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = plain.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:]
    return out


def trie(rows, heads=6, group=100):
    """{(conv_id, depth): (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}"""
    convs = rebuilt(rows, heads, group)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, m in members.items():
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    out = {}
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(node)))
        out[(min(m), len(node))] = (min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node],
                                    hashlib.sha256(ends.encode()).hexdigest())
    return out


def centroids(rows, k=8, rounds=10, dim=64, scale=1024, seed=3):
    """rows (vec_id, vector) -> ([(vec_id, cluster, distance)] sorted, centroids)"""
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        got = defaultdict(list)
        for _, v in kept:
            got[near(v)[1]].append(v)
        for j, vs in got.items():
            cents[j] = [sum(col) // len(vs) for col in zip(*vs)]
    return sorted([(i, near(v)[1], near(v)[0]) for i, v in kept], key=lambda r: (r[0] is not None, r)), cents


def _hash(gram, bits):
    m = 0xFFFFFFFF
    one = []
    for ch in gram:
        c = ord(ch) if ch != " " else 0
        x = (c * 0x9E3779B1 + 0x7F4A7C15) & m
        one.append(x ^ (x >> 15))
    if len(one) == 1:
        return ((one[0] * 0x27D4EB2F) & m) >> (32 - bits)
    two = (one[0] * 0x85EBCA77 + one[1]) & m
    two ^= two >> 13
    if len(one) == 2:
        return ((two * 0x165667B1) & m) >> (32 - bits)
    three = (two * 0xC2B2AE3D + one[2]) & m
    three ^= three >> 16
    return ((three * 0xD3A2646D) & m) >> (32 - bits)


def grams(text, bits):
    """Buckets of all 1- to 3-grams inside the words of a text and their two spaces."""
    words = "".join(ch.lower()[0] if ch.isalpha() else " " for ch in text or "").split()
    for w in words:
        p = f" {w} "
        yield from (_hash(c, bits) for c in w)
        yield from (_hash(p[i:i + 2], bits) for i in range(len(p) - 1))
        yield from (_hash(p[i:i + 3], bits) for i in range(len(p) - 2))


def bayes(rows, bits=15, alpha=0.5):
    """rows (doc_id, text, lang) -> {doc_id: (language, posterior)}"""
    docs, counts = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for i, text, lang in rows:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            docs[lang] += 1
            for g in grams(text, bits):
                counts[lang][g] += 1
    total, n = {g: sum(c.values()) for g, c in counts.items()}, sum(docs.values())
    out = {}
    for i, text, _ in rows:
        gs = list(grams(text, bits))
        if not gs or not docs:
            out[i] = ("und", 0.0)
            continue
        post = {g: math.log(docs[g] / n) + sum(math.log((counts[g].get(x, 0) + alpha) / (total.get(g, 0) + alpha * 2 ** bits)) for x in gs)
                for g in sorted(docs)}
        best = max(post, key=post.get)
        out[i] = (best, 1 / sum(math.exp(v - post[best]) for v in post.values()))
    return out
