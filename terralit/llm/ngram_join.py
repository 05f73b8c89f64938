"""N-gram Jaccard self-join of documents, size-aware heavy-light (operator 3)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import MASK48, U64, discard, gram_sets, mix, parts, ready, unused, written
from .components import components

N = 3
THRESHOLD = 0.5
SUBSET = 2
BUCKET_GRAMS = 2_000_000
KEYS = 1 << 20
#: A list that would give more than this many pairs a member becomes a star of edges, whose component is compared as a whole.
CROWD = 16
#: Sets, and bytes of grams, of a block of a component.
BLOCK, BLOCK_BYTES = 2048, 32_000_000
SLOTS = 1024


def least_overlap(size, t: float):
    """How many grams a set of this size must share with any partner at least."""
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


def prefix_len(size, t: float):
    return np.asarray(size) - least_overlap(size, t) + 1


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def _name(g: np.ndarray) -> np.uint64:
    """What identifies a set of grams."""
    return mix(np.bitwise_xor.reduce(mix(g + U64(11)), keepdims=True) + np.add.reduce(mix(g), keepdims=True) * U64(len(g)))[0]


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, k1, k2, fp, size) of each row with a doc_id and a text that has a word.  fp identifies the set, k1
    and k2 the doc_id and text."""
    def of(batches):
        for pdf in batches:
            at, fp, size = [], [], []
            for i, g in gram_sets(pdf["text"].tolist(), n):
                at.append(i), size.append(len(g)), fp.append(_name(g))
            yield pdf[["doc_id", "k1", "k2"]].iloc[at].assign(fp=np.array(fp, np.uint64).view(np.int64), size=np.array(size, np.int32))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key()).filter("doc_id is not null and text is not null")
            .mapInPandas(of, "doc_id long, k1 long, k2 long, fp long, size int"))


def row_key() -> list:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(7)).alias("k2")]


def _grams(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """The grams of each partition's distinct sets by hash bucket: per bucket the sets' fingerprints,
    sizes and gram counts, and 48 bits of each gram; the bucket has the others."""
    def of(batches):
        held, room = [], 0
        seen: set[int] = set()

        def out():
            fps = np.array([f for f, _ in held], np.uint64)
            sizes = np.array([len(g) for _, g in held], np.int64)
            g = np.concatenate([g for _, g in held])
            which = np.repeat(np.arange(len(fps), dtype=np.int32), sizes)
            b = (((g >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            g, which, b = g[order] & MASK48, which[order], b[order]
            cut = np.searchsorted(b, np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                lo, hi = cut[k], cut[k + 1]
                if hi > lo:
                    own, count = np.unique(which[lo:hi], return_counts=True)
                    rows.append((k, fps[own].tobytes(), sizes[own].astype("<u4").tobytes(), count.astype("<u4").tobytes(), _six(g[lo:hi])))
            return pd.DataFrame(rows, columns=["bucket", "fps", "sizes", "counts", "grams"])

        for pdf in batches:
            for _, g in gram_sets(pdf["text"].tolist(), n):
                fp = int(_name(g))
                if fp not in seen:
                    seen.add(fp)
                    held.append((fp, g))
                    room += len(g)
                    if room > BUCKET_GRAMS:
                        yield out()
                        held, room = [], 0
        if held:
            yield out()
    return docs.select("text").filter("doc_id is not null and text is not null").mapInPandas(of, "bucket int, fps binary, sizes binary, counts binary, grams binary")


def _shared(key, pdf: pd.DataFrame, homes: int) -> pd.DataFrame:
    """Of one bucket, the grams that two or more sets have, by home of the set."""
    fps = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["fps"]])
    sizes = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["sizes"]])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]])
    g = np.concatenate([_eight(x) for x in pdf["grams"]])
    uniq, first, back = np.unique(fps, return_index=True, return_inverse=True)
    sizes = sizes[first]
    keep = np.zeros(len(fps), bool)
    keep[first] = True
    stay = np.repeat(keep, counts)
    which = np.repeat(back, counts)[stay].astype(np.int32)
    g = g[stay]
    order = np.argsort(g, kind="stable")
    g, which = g[order], which[order]
    edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    df = np.repeat(np.diff(edge), np.diff(edge))
    m = df > 1
    g, which, df = g[m], which[m], np.minimum(df[m], 65535)
    order = np.argsort(which, kind="stable")
    g, which, df = g[order], which[order], df[order]
    # Every set is reported, also with no shared gram here, only if it has one; sizes go along.
    home = (uniq % U64(homes)).astype(np.int64)
    own, at, count = np.unique(which, return_index=True, return_counts=True)
    rows = []
    by = np.argsort(home[own], kind="stable")
    cut = np.searchsorted(home[own][by], np.arange(homes + 1))
    for h in range(homes):
        sel = by[cut[h]:cut[h + 1]]
        if len(sel):
            take = np.concatenate([np.arange(at[s], at[s] + count[s]) for s in sel])
            rows.append((h, int(key[0]), uniq[own[sel]].tobytes(), sizes[own[sel]].astype("<u4").tobytes(),
                         count[sel].astype("<u4").tobytes(), _six(g[take]), df[take].astype("<u2").tobytes()))
    return pd.DataFrame(rows, columns=["home", "bucket", "fps", "sizes", "counts", "grams", "dfs"])


def _survivors(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """Sets of one home whose prefix, rarest grams first, reaches a shared gram: fp, size, n (shared grams
    in the prefix for one common gram), n2 (for SUBSET common grams), scan (what reading the lists of
    the n costs: a list's pairs a member, or 1 if it is a crowd), grams, and the dfs of the n2."""
    fps = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["fps"]])
    sizes = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["sizes"]]).astype(np.int64)
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
    per_row = [len(x) // 6 for x in pdf["grams"]]
    g = mix(np.concatenate([_eight(x) for x in pdf["grams"]]) + np.repeat(pdf["bucket"].to_numpy().astype(np.uint64), per_row) * U64(0x9E3779B97F4A7C15))
    df = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["dfs"]])
    uniq, first, back = np.unique(fps, return_index=True, return_inverse=True)
    which = np.repeat(back, counts)
    size = sizes[first]
    shared = np.bincount(which, minlength=len(uniq))
    alone = size - shared
    p = prefix_len(size, t) - alone
    p2 = np.where(least_overlap(size, t) >= SUBSET, p + SUBSET - 1, 0)
    order = np.lexsort((g, df, which))
    g, df = g[order], df[order]
    ends = np.concatenate(([0], np.cumsum(shared)))
    cost = np.where(df > 2 * CROWD, 1.0, df / 2)
    rows = []
    for i in np.flatnonzero(p > 0):
        a, b = ends[i], ends[i + 1]
        n, n2 = int(min(p[i], b - a)), int(max(0, min(p2[i], b - a)))
        rows.append((int(uniq[i].view(np.int64)), int(size[i]), n, n2, float(cost[a:a + n].sum()), g[a:b].tobytes(), df[a:a + n2].astype("<u2").tobytes()))
    return pd.DataFrame(rows, columns=["fp", "size", "n", "n2", "scan", "grams", "dfs"])


def size_class(size):
    """Classes of set sizes, two to each doubling; the boundary is the end of one."""
    return np.floor(2 * np.log2(np.maximum(np.asarray(size, float), 1))).astype(np.int64)


def _subsets(g: np.ndarray) -> np.ndarray:
    """The keys of the two-gram subsets of g, in the order of np.triu_indices."""
    a, b = np.triu_indices(len(g), 1)
    low, high = np.minimum(g[a], g[b]), np.maximum(g[a], g[b])
    return mix(mix(low) + high * U64(3) + U64(1)) | U64(1)


def _costs(live: DataFrame, t: float) -> pd.DataFrame:
    """By class of set sizes, least first: what enumerating the subsets of all sets up to that class costs
    (keys made, and pairs in the lists of equal keys), and what scanning costs the sets of the class.

    The pairs are the second moment of how often each subset occurs, over all sets, which sketches of SLOTS signed
    counters, added up over the tasks, tell within a few percent, however many subsets there are.  Subsets
    of frequent grams only become crowds, or are rare, so they cost their key.  Classes whose keys alone
    cost more than scanning everything can't be light, and their subsets aren't enumerated."""
    c = F.floor(2 * F.log2(F.greatest(F.col("size").cast("double"), F.lit(1.0)))).cast("int").alias("c")
    plain = (live.select(c, "scan", F.when(F.ceil(F.col("size") * t - 1e-9) >= SUBSET, F.col("n2") * (F.col("n2") - 1.0) / 2).otherwise(0.0).alias("made"))
             .groupBy("c").agg(F.sum("scan").alias("scan"), F.sum("made").alias("made")).orderBy("c").toPandas())
    if not len(plain):
        return plain.assign(pairs=0.0)
    able = plain["c"][plain["made"].cumsum() <= plain["scan"].sum()]
    most = int(able.max()) if len(able) else -1

    def sketch(batches):
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            for size, n2, raw, dfs in zip(pdf["size"], pdf["n2"], pdf["grams"], pdf["dfs"]):
                if n2 < 2 or least_overlap(size, t) < SUBSET:
                    continue
                row = found.setdefault(int(size_class(size)), np.zeros(SLOTS + 1))
                d = np.frombuffer(dfs, "<u2")
                k = mix(_subsets(np.frombuffer(raw, np.uint64)[:n2]))[d[np.triu_indices(n2, 1)[0]] <= 2 * CROWD]
                row[:SLOTS] += np.bincount((k >> U64(54)).astype(np.int64), np.where(k & U64(1), 1.0, -1.0), SLOTS)
                row[SLOTS] += len(k)
        if found:
            yield pd.DataFrame({"c": list(found), "v": list(found.values())})

    got = live.filter(c <= most).select("size", "n2", "grams", "dfs").mapInPandas(sketch, "c int, v array<double>")
    got = (got.select("c", F.posexplode("v").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).groupBy("c")
           .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")).toPandas())
    upto, pairs = np.zeros(SLOTS + 1), []
    by = {int(k): np.array(v) for k, v in zip(got["c"], got["v"])}
    for k in plain["c"]:
        upto = upto + by.get(int(k), np.zeros(SLOTS + 1))
        pairs.append(max(0.0, float((upto[:SLOTS] ** 2).sum() - upto[SLOTS]) / 2) if k <= most else np.inf)
    return plain.assign(pairs=pairs)


def boundary(costs: pd.DataFrame) -> int:
    """The last class of light sets, -1 if none is: the cut at which enumerating the subsets of the light sets and
    scanning the lists for the heavy ones costs least in all."""
    if not len(costs):
        return -1
    scan, made = costs["scan"].to_numpy(float), costs["made"].to_numpy(float)
    total = np.concatenate(([scan.sum()], np.cumsum(made) + costs["pairs"].to_numpy(float) + scan.sum() - np.cumsum(scan)))
    k = int(np.argmin(total))
    return int(costs["c"].iloc[k - 1]) if k else -1


def _starred(size: np.ndarray, t: float):
    """Of a list's sizes, ascending: (centre, other) of each run of sizes near enough to be paired."""
    cut = np.concatenate(([True], size[:-1] < t * size[1:] - 1e-9))
    centre = np.flatnonzero(cut)[np.cumsum(cut) - 1]
    other = np.flatnonzero(~cut)
    return centre[other], other


def _postings(sets: DataFrame, light_to: int, t: float, buckets: int, crowd: int = CROWD) -> DataFrame:
    """Keys by bucket: the prefix grams of every set, to be scanned by heavy sets, and for light sets
    also the hashes of their prefixes' SUBSET-element subsets.  A key that is a crowd among the sets
    taken at a time is sent on as one posting a run of sizes, marked, with the edges of its star."""
    def of(batches):
        for pdf in batches:
            n2 = pdf["n2"].to_numpy().astype(np.int64)
            size = pdf["size"].to_numpy().astype(np.int64)
            light = (size_class(size) <= light_to) & (least_overlap(size, t) >= SUBSET)
            made = np.cumsum(pdf["n"].to_numpy() + np.where(light, n2 * (n2 - 1) // 2, 0))
            lo = 0
            while lo < len(pdf):  # so many sets at a time that their keys take a bounded room
                hi = max(lo + 1, int(np.searchsorted(made, (made[lo - 1] if lo else 0) + KEYS, side="right")))
                yield block(pdf.iloc[lo:hi], light[lo:hi])
                lo = hi

    def block(pdf, light):
        keys, which = [], []
        size, fp = pdf["size"].to_numpy().astype(np.int64), pdf["fp"].to_numpy().astype(np.int64)
        for i, (n, n2, raw) in enumerate(zip(pdf["n"], pdf["n2"], pdf["grams"])):
            g = np.frombuffer(raw, np.uint64)
            keys.append(mix(g[:n]) & ~U64(1)), which.append(np.full(n, i, np.int32))
            if light[i] and n2 > 1:
                keys.append(_subsets(g[:n2]))
                which.append(np.full(len(keys[-1]), i, np.int32))
        k, w = np.concatenate(keys), np.concatenate(which)
        hot, centre, other = _crowds(k, w, size, light, t, crowd)
        if len(other):
            rest = np.ones(len(k), bool)
            rest[other] = False
            again = np.cumsum(rest) - 1
            edges = np.stack((fp[w[centre]], fp[w[other]], k[centre].view(np.int64)), 1)
            k, w, hot = k[rest], w[rest], again[np.unique(centre)]
        else:
            edges = np.zeros((0, 3), np.int64)
        mark = np.zeros(len(k), bool)
        mark[hot] = True
        b = (((k >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        k, w, b, mark = k[order], w[order], b[order], mark[order]
        cut = np.searchsorted(b, np.arange(buckets + 1))
        home = (((edges[:, 2].view(np.uint64) >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int32)
        rows = []
        for j in range(buckets):
            lo, hi = cut[j], cut[j + 1]
            if hi > lo:
                own, back = np.unique(w[lo:hi], return_inverse=True)
                e = np.unique(edges[home == j, :2], axis=0) if len(edges) else edges[:, :2]
                rows.append((j, fp[own].tobytes(), size[own].astype("<u4").tobytes(), light[own].tobytes(), k[lo:hi].tobytes(), back.astype("<u4").tobytes(), mark[lo:hi].tobytes(), e.tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "fps", "sizes", "light", "keys", "which", "marks", "edges"])
    return sets.select("fp", "size", "n", "n2", "grams").mapInPandas(of, "bucket int, fps binary, sizes binary, light binary, keys binary, which binary, marks binary, edges binary")


def _crowds(key, which, size, light, t, crowd, marks=None):
    """Of postings (key, which): those whose key's list would give more than `crowd` pairs a member, or that are marked, as
    (postings that stand for their list, and centre and other of each edge of the stars)."""
    order = np.lexsort((size[which], key))
    k, w = key[order], which[order]
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True]))) if len(k) else np.zeros(1, np.int64)
    m = np.diff(edge)
    heavy = np.add.reduceat((~light[w]).astype(np.int64), edge[:-1]) if len(m) else m
    sub = (k[edge[:-1]] & U64(1)).astype(bool)
    # Pairs of two light sets come from subsets, so a gram's list gives those with a heavy one.
    pairs = np.where(sub, m * (m - 1) // 2, heavy * (heavy - 1) // 2 + heavy * (m - heavy))
    hot = pairs > crowd * m
    if marks is not None and len(m):
        hot |= np.logical_or.reduceat(marks[order], edge[:-1])
    centres, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for j in np.flatnonzero(hot):
        a, b = _starred(size[w[edge[j]:edge[j + 1]]], t)
        centres.append(order[edge[j] + a]), others.append(order[edge[j] + b])
    hot = order[np.repeat(hot, m)] if len(m) else np.zeros(0, np.int64)
    return hot, np.concatenate(centres), np.concatenate(others)


def _candidates(pdf: pd.DataFrame, t: float, crowd: int = CROWD, most: int = 1 << 19):
    """Pairs that share a key of one bucket and whose sizes allow the threshold, each once with the number
    of prefix grams it shares here (0: found by a subset), and the edges of the stars of crowds (-1)."""
    base = np.cumsum([0] + [len(x) // 8 for x in pdf["fps"]])[:-1]
    fp = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["fps"]])
    size = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["sizes"]]).astype(np.int64)
    light = np.concatenate([np.frombuffer(x, bool) for x in pdf["light"]])
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
    marks = np.concatenate([np.frombuffer(x, bool) for x in pdf["marks"]])
    stars = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["edges"]])
    which = np.concatenate([np.frombuffer(x, "<u4").astype(np.int64) + o for x, o in zip(pdf["which"], base)])
    _, first, back = np.unique(fp, return_index=True, return_inverse=True)
    fp, size, light, which = fp[first], size[first], light[first], back[which]
    hot, centre, other = _crowds(key, which, size, light, t, crowd, marks)
    stars = np.unique(np.concatenate((stars, np.stack((fp[which[centre]], fp[which[other]]), 1))), axis=0)
    rest = np.ones(len(key), bool)
    rest[hot] = False
    key, which = key[rest], which[rest]
    order = np.lexsort((size[which], key))
    key, which = key[order], which[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    end = np.repeat(edge[1:], np.diff(edge)) if len(key) else np.zeros(0, np.int64)
    at = np.arange(len(key))
    sub = (key & U64(1)).astype(bool)
    reach = end - at - 1
    total = np.zeros(0, np.int64)
    counts = np.zeros(0, np.int64)
    upto = np.cumsum(reach)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        r = reach[lo:hi]
        a = np.repeat(at[lo:hi], r)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(r) - r, r)
        x, y, s = which[a], which[b], sub[a]
        ok = (size[x] >= t * size[y] - 1e-9) & (x != y) & (s | ~(light[x] & light[y]))
        x, y, s = x[ok], y[ok], s[ok]
        code = np.minimum(x, y) * len(fp) + np.maximum(x, y)
        code, inv = np.unique(np.concatenate((total, code)), return_inverse=True)
        counts = np.bincount(inv, weights=np.concatenate((counts, np.where(s, 0, 1))), minlength=len(code)).astype(np.int64)
        total = code
        lo = hi
    x, y = total // max(1, len(fp)), total % max(1, len(fp))
    return pd.DataFrame({"a": np.concatenate((fp[x], np.minimum(stars[:, 0], stars[:, 1]))), "b": np.concatenate((fp[y], np.maximum(stars[:, 0], stars[:, 1]))),
                         "found": np.concatenate((counts, np.full(len(stars), -1))).astype(np.int32)})


# --- comparing --------------------------------------------------------------------------

def _counts(left: list[np.ndarray], right: list[np.ndarray], room: int = 1 << 22) -> np.ndarray:
    """How many grams each of `left` has in common with each of `right`.  Frequent grams are counted by matrix
    products, some columns at a time, the others by listing their pairs."""
    n, m = len(left), len(right)
    g = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    _, col = np.unique(g, return_inverse=True)
    a, b = row < n, row >= n
    na, nb = np.bincount(col[a], minlength=col.max(initial=-1) + 1), np.bincount(col[b], minlength=col.max(initial=-1) + 1)
    out = np.zeros(n * m, np.float32)
    both = na * nb
    dense = both > max(64, n * m // 256)
    ra, ca, rb, cb = row[a], col[a], row[b] - n, col[b]
    if dense.any():
        where = np.cumsum(dense) - 1
        step = max(1, room // max(n, m))
        for lo in range(0, int(dense.sum()), step):
            x, y = np.zeros((n, step), np.float32), np.zeros((m, step), np.float32)
            for z, r, c in ((x, ra, ca), (y, rb, cb)):
                own = dense[c] & (where[c] >= lo) & (where[c] < lo + step)
                z[r[own], where[c[own]] - lo] = 1
            out += (x @ y.T).reshape(-1)
    keep = ~dense & (both > 0)
    ra, ca, rb, cb = ra[keep[ca]], ca[keep[ca]], rb[keep[cb]], cb[keep[cb]]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb = ra[oa], ca[oa], rb[ob]
    start, many = np.concatenate(([0], np.cumsum(nb * keep)))[:-1][ca], nb[ca]
    upto, lo = np.cumsum(many), 0
    while lo < len(ra):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + room, side="right")))
        k = many[lo:hi]
        j = np.repeat(start[lo:hi] - np.cumsum(k) + k, k) + np.arange(k.sum())
        code, c = np.unique(np.repeat(ra[lo:hi], k) * m + rb[j], return_counts=True)
        out[code] += c
        lo = hi
    return out.reshape(n, m)


def _compare(left: list, right: list | None, t: float):
    """left and right: (fp, size, grams).  The pairs of both, or of left with itself, of Jaccard t or more, as
    arrays of fps and the Jaccard."""
    other = left if right is None else right
    sx, sy = np.array([s for _, s, _ in left], np.int64), np.array([s for _, s, _ in other], np.int64)
    c = _counts([g for _, _, g in left], [g for _, _, g in other]).astype(np.int64)
    j = c / (sx[:, None] + sy - c)
    ok = j >= t - 1e-12
    if right is None:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    x, y = np.nonzero(ok)
    fx, fy = np.array([f for f, _, _ in left], np.int64), np.array([f for f, _, _ in other], np.int64)
    return fx[x], fy[y], j[x, y]


def _forest(a: np.ndarray, b: np.ndarray):
    """Edges that connect what the edges (a, b) connect, without a cycle."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x
    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _said(found: list, whole: bool) -> pd.DataFrame:
    """Of (a, b, jaccard) arrays: all pairs, or the edges of a forest (links 0) and each set's links."""
    a, b, j = (np.concatenate([f[k] for f in found] + [np.zeros(0, kind)]) for k, kind in ((0, np.int64), (1, np.int64), (2, float)))
    if whole:
        return pd.DataFrame({"a": a, "b": b, "links": np.zeros(len(a), np.int64), "jaccard": j})
    tree = np.array(_forest(a, b), np.int64).reshape(-1, 2)
    node, links = np.unique(np.concatenate((a, b)), return_counts=True)
    return pd.DataFrame({"a": np.concatenate((tree[:, 0], node)), "b": np.concatenate((tree[:, 1], node)),
                         "links": np.concatenate((np.zeros(len(tree), np.int64), links)), "jaccard": 1.0})


def _verify(pairs: pd.DataFrame, sets: pd.DataFrame, t: float):
    """The listed pairs of Jaccard t or more."""
    own = {f: (s, np.sort(np.frombuffer(g, np.uint64))) for f, s, g in zip(sets["fp"], sets["size"], sets["grams"])}
    a, b, jac = [], [], []
    for x, y in zip(pairs["a"], pairs["b"]):
        (sx, gx), (sy, gy) = own[x], own[y]
        if len(gx) > len(gy):
            gx, gy = gy, gx
        at = np.searchsorted(gy, gx)
        at[at == len(gy)] = 0
        common = int(np.count_nonzero(gy[at] == gx))
        j = common / (sx + sy - common)
        if j >= t - 1e-12:
            a.append(x), b.append(y), jac.append(j)
    return np.array(a, np.int64), np.array(b, np.int64), np.array(jac, float)


def _placed(nodes: DataFrame, live: DataFrame, tasks: int, most: int = BLOCK) -> DataFrame:
    """nodes (node, root) -> node, root, blocks, block, task.  A component is cut into blocks of about `most` sets at most
    and BLOCK_BYTES of grams; small ones go to a task together."""
    sized = nodes.join(live.select(F.col("fp").alias("node"), F.length("grams").alias("bytes")), "node")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    return (nodes.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
            .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.col("root"))))


FOUND = "a long, b long, links long, jaccard double"


def similar_sets(docs: DataFrame, n: int = N, t: float = THRESHOLD, whole: bool = False, report: dict | None = None,
                 light_to: int | None = None, crowd: int = CROWD, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, found): members (doc_id, k1, k2, fp) names each row's set; found (a, b, links, jaccard) has,
    with `whole`, all pairs of distinct sets of Jaccard t or more, else edges that connect them (links 0) and for
    each set in a pair a row (a = b) with the number of its pairs.

    1. Grams are hashed in numpy and shuffled by bucket, 6 bytes each; grams of a single set are dropped
       there, since nothing can share them.
    2. The others return to their set.  In the order (document frequency, hash), sets whose prefix has
       only unshared grams leave.
    3. Heavy-light: two light sets are compared if they share a SUBSET-element subset of their prefixes;
       pairs with a heavy set come from scanning the inverted lists of the prefixes.  The boundary is the
       class of sizes at which enumerating, with the counted lists of subsets, costs more than scanning.
    4. A short list gives pairs, at most CROWD a member.  A long one, as groups of near copies have, gives the
       edges of a star, within the task that makes it if it is long there, so what is sent grows with the
       sets, not with their pairs.  The components of the stars are compared as a whole, block by block,
       and the pairs stay in the task that counts them.
    5. Listed pairs are bounded by the shared prefix grams and the rests, tied into components so that
       each set travels to a place once, and intersected exactly.

    There is no cap on lists, candidates or partners.  report, if given, gets the boundary and costs;
    light_to, crowd and most set the boundary's class, CROWD and BLOCK, which change the work and not the result."""
    spark = ready(docs.sparkSession)
    sets = written(_sets(docs, n), "sets")
    sizes = sets.agg(F.sum("size")).first()[0] or 0
    buckets = max(parts(spark) // 2, math.ceil(sizes / BUCKET_GRAMS), 1)
    homes = buckets

    def shared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _shared(key, pdf, homes)

    def survivors(pdf: pd.DataFrame) -> pd.DataFrame:
        return _survivors(pdf, t)

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        return _candidates(pdf, t, crowd)

    def listed(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _said([_verify(pairs, rows, t)], whole)

    def crowds(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("root", sort=False):
            blocks: list[list] = [[], []]
            i, j = int(own["i"].iloc[0]), int(own["j"].iloc[0])
            for f, s, g, b in zip(own["fp"], own["size"], own["grams"], own["block"]):
                blocks[int(b != i)].append((f, s, np.frombuffer(g, np.uint64)))
            out.append(_compare(blocks[0], blocks[1] if i != j else None, t))
        return _said(out, whole)

    live = (_grams(docs, n, buckets).repartitionById(buckets, "bucket").groupBy("bucket")
            .applyInPandas(shared, "home int, bucket int, fps binary, sizes binary, counts binary, grams binary, dfs binary")
            .repartitionById(homes, "home").groupBy("home")
            .applyInPandas(survivors, "fp long, size int, n int, n2 int, scan double, grams binary, dfs binary"))
    live = written(live, "live", "uncompressed")
    costs = _costs(live, t)
    light_to = boundary(costs) if light_to is None else light_to
    if report is not None:
        report |= {"light_to": light_to, "costs": costs}
    total = live.agg(F.sum("n").alias("n"), F.sum(F.length("grams")).alias("bytes")).first()
    keys = float(total["n"] or 0) + float(costs["made"][costs["c"] <= light_to].sum() if len(costs) else 0)
    lists = max(parts(spark) // 2, math.ceil(keys / KEYS), 1)
    tasks = max(parts(spark), math.ceil((total["bytes"] or 0) / BLOCK_BYTES))
    found = written(_postings(live, light_to, t, lists, crowd).repartitionById(lists, "bucket").groupBy("bucket").applyInPandas(candidates, "a long, b long, found int"), "listed")
    stars = components(found.filter("found < 0").select("a", "b"))
    stars = written(_placed(stars, live, tasks, most), "stars")
    rest = live.select("fp", "size", (F.length("grams") / 8 - F.col("n")).cast("int").alias("rest"))
    root = stars.select("node", "root")
    pairs = (found.filter("found >= 0").groupBy("a", "b").agg(F.sum("found").alias("found"), F.min("found").alias("least"))
             .join(rest.toDF("a", "sa", "ra"), "a").join(rest.toDF("b", "sb", "rb"), "b")
             .filter((F.col("least") == 0) | (F.col("found") + F.greatest("ra", "rb") >= F.ceil((F.col("sa") + F.col("sb")) * (t / (1 + t)) - 1e-9)))
             .join(root.toDF("a", "ca"), "a", "left").join(root.toDF("b", "cb"), "b", "left")
             .filter("ca is null or cb is null or ca <> cb").select("a", "b"))
    pairs = written(pairs, "candidates")
    discard(found)
    # Crowds: each set goes to the tiles of its block with all blocks of its component.
    tile = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = stars.select("node", "root", "task", "block", tile).select("node", "root", "task", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiles = tiles.join(live.select(F.col("fp").alias("node"), "size", "grams"), "node").withColumnRenamed("node", "fp")
    crowded = tiles.groupBy("task", "i", "j").applyInPandas(crowds, FOUND)
    # Listed pairs, by component.
    block = written(_placed(components(pairs), live, tasks, most), "blocks").select("node", "task", "block")
    placed = pairs.join(block.toDF("a", "task", "i"), "a").join(block.select("node", "block").toDF("b", "j"), "b")
    place = ["task", "i", "j"]
    here = placed.select(*place, F.col("a").alias("fp")).unionAll(placed.select(*place, F.col("b").alias("fp"))).distinct()
    here = here.join(live.select("fp", "size", "grams"), "fp").selectExpr("task r", "i x", "j y", "fp", "size", "grams")
    alone = placed.groupBy(*place).cogroup(here.groupBy("r", "x", "y")).applyInPandas(listed, FOUND)
    return sets.select("doc_id", "k1", "k2", "fp"), crowded.unionAll(alone)


def classes(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """members as of similar_sets with root, the class of the set, and links."""
    members, found = similar_sets(docs, n, t)
    found = written(found, "found")
    roots = components(found.filter("links = 0").select("a", "b")).withColumnRenamed("node", "fp")
    links = found.filter("links > 0").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    of_set = roots.join(links, "fp")
    members = members.join(of_set, "fp", "left").select("doc_id", "k1", "k2", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    return members, found


def jaccard_join(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, class_id, links, copies), one row for each document.

    A document's set holds its n-grams of words (runs of lower-cased ASCII letters, digits and non-ASCII
    characters); one of fewer than n words has one gram.  Sets of Jaccard t or more are linked, and links is
    how many other sets a document's set is linked with; copies is how many other doc_ids have the same set.
    class_id is the least doc_id of all that links and copies connect.

    Rows with a null doc_id have no row.  Null texts and texts with no word have no set, and a row of their own
    with their doc_id as class_id, no links and no copies.  Very long texts are sets like any other.  Rows
    of the same doc_id and set count once; a doc_id with several sets has a row for each.  Ties need no
    order, since all links count.  Other columns are ignored.  Empty tables give no rows."""
    members, _ = classes(docs, n, t)
    one = members.select("doc_id", "fp", "root", "links").distinct()
    copies = one.groupBy("fp").agg(F.count("*").alias("c"), F.min("doc_id").alias("least"), F.first("root").alias("root"))
    least = copies.groupBy("root").agg(F.min("least").alias("class_id"))
    of_set = copies.join(least, "root").select("fp", "class_id", (F.col("c") - 1).alias("copies"))
    with_set = one.join(of_set, "fp").select("doc_id", "class_id", "links", "copies")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False)))
    none = F.lit(0).cast("long")
    return with_set.unionAll(bare.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("class_id"), none.alias("links"), none.alias("copies")))


def similar_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """Every pair of documents whose sets are equal or linked: (doc_a, doc_b, jaccard), doc_a < doc_b.  These are as many as
    the square of a group of copies; jaccard_join says the same in one row a document.  Of a doc_id with
    several texts the greatest Jaccard counts."""
    members, found = similar_sets(docs, n, t, True)
    m = members.select("fp", "doc_id").distinct()
    pairs = m.toDF("fp", "x").join(m.toDF("fp", "y"), "fp").filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    pairs = pairs.unionAll(found.join(m.toDF("a", "x"), "a").join(m.toDF("b", "y"), "b").filter("x <> y").select("x", "y", "jaccard"))
    return pairs.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def near_dedup(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of jaccard_join: that of the least doc_id and, in it, of the least hash.  Rows
    in no class, null ids, null and wordless texts stay.

    Rows are judged by their texts: of rows that share a doc_id each on its own, and of rows that repeat doc_id
    and text one stays.  All columns are kept, whatever their names; empty tables stay empty."""
    ready(docs.sparkSession)
    members, _ = classes(docs, n, t)
    first = members.groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f"), F.count("*").alias("rows")).filter("rows > 1")
    rows = members.join(first, "root").select("k1", "k2", (F.struct("doc_id", "k1", "k2") == F.col("f")).alias("stays"))
    rows = rows.groupBy("k1", "k2").agg(F.max("stays").alias("stays"))
    x = [unused(docs, c) for c in ("k1", "k2", "stays", "again")]
    names = [F.col(f"`{c}`") for c in docs.columns]
    judged = docs.select(*names, *[k.alias(c) for k, c in zip(row_key(), x)]).join(rows.toDF(*x[:3]), x[:2], "left")
    again = F.row_number().over(W.partitionBy(*x[:2]).orderBy(F.lit(0)))
    judged = judged.filter(f"coalesce({x[2]}, true)").withColumn(x[3], F.when(F.col(x[2]).isNotNull(), again).otherwise(1))
    return judged.filter(f"{x[3]} = 1").select(*names)


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {N} + 2), lambda i: array_to_string(ws[i:i+{N}-1], ' ')) END)) AS gs FROM w WHERE len(ws) > 0),
m AS (SELECT gs, min(doc_id) AS rep, count(DISTINCT doc_id) AS c FROM g GROUP BY gs),
u AS (SELECT rep, len(gs) AS n, unnest(gs) AS x FROM m),
e AS (SELECT rep, n, hash(x) AS x FROM u QUALIFY count(*) OVER (PARTITION BY hash(x)) > 1),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, a.n AS na, b.n AS nb FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep
      GROUP BY a.rep, b.rep, a.n, b.n),
l AS (SELECT a, b FROM p WHERE c / (na + nb - c) >= {THRESHOLD}),
r AS (SELECT rep AS a, rep AS b FROM m UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a),
d AS (SELECT a AS rep, count(*) AS links FROM l GROUP BY a)
SELECT DISTINCT g.doc_id, k.class_id, coalesce(d.links, 0) AS links, m.c - 1 AS copies FROM g JOIN m ON g.gs = m.gs JOIN k ON k.rep = m.rep LEFT JOIN d ON d.rep = m.rep
UNION ALL SELECT DISTINCT doc_id, doc_id, 0, 0 FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM g)
"""
