"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first (operator 6)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import ready, written

K, RECALL, EVERY = 10, 0.95, 50
BRANCH, LEAF, ROUNDS = 8, 128, 6
#: Rows that the top levels are fitted on, at most; rows of a cell that they aim at; rows of a task, at most.
FIT, CELL, TASK_ROWS, CALIBRATION = 32_768, 16_384, 131_072, 200


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a few Lloyd rounds from distinct rows."""
    c = x[r.choice(len(x), k, False)].astype(np.float64)
    for _ in range(rounds):
        own = _sq(x, c).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Tree:
    """Nodes have children, each with a centre, or are leaves: slices of the rows, which are kept in the
    order of their leaves.  Every row is in exactly one leaf."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 5):
        r = np.random.default_rng(seed)
        self.children: list[list[tuple[int, int]]] = []  # of each node: (centre, node)
        self.slices: list[tuple[int, int]] = []
        centres, order = [np.zeros((0, x.shape[1]))], []
        self.leaves = at = made = 0
        todo = [(np.arange(len(x)), None)] if len(x) else []
        while todo:
            rows, above = todo.pop()
            me = len(self.children)
            self.children.append([])
            self.slices.append((0, 0))
            if above is not None:
                self.children[above[0]].append((above[1], me))
            if len(rows) > max(leaf, BRANCH):
                c = kmeans(x[rows], BRANCH, r)
                own = _sq(x[rows], c).argmin(1)
                kinds = np.unique(own)
                if len(kinds) > 1:
                    centres.append(c[kinds])
                    todo += [(rows[own == k], (me, made + j)) for j, k in enumerate(kinds)]
                    made += len(kinds)
                    continue
            self.slices[me] = (at, at + len(rows))  # few rows, or equal ones that no centre parts
            order.append(rows)
            at, self.leaves = at + len(rows), self.leaves + 1
        order = np.concatenate([*order, np.zeros(0, np.int64)])
        self.x, self.ids = x[order], ids[order]
        self.short, self.norm = self.x.astype(np.float32), (self.x * self.x).sum(1).astype(np.float32)
        self.centres = np.concatenate(centres)

    def leaves_of(self, d: list[float]):
        """Leaf nodes in best-bin-first order for a query with distances d to all centres: of the branches
        not yet taken the one whose centre is nearest comes next."""
        heap = [(0.0, 0)] if self.children else []
        while heap:
            i = heapq.heappop(heap)[1]
            while below := self.children[i]:
                best = min(below, key=lambda b: d[b[0]])
                for b in below:
                    if b is not best:
                        heapq.heappush(heap, (d[b[0]], b[1]))
                i = best[1]
            yield i

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of each row, from the root down by the nearest centre."""
        at = np.zeros(len(x), np.int32)
        todo = [0] if self.children else []
        while todo:
            i = todo.pop()
            if below := self.children[i]:
                rows = np.flatnonzero(at == i)
                if len(rows):
                    at[rows] = np.array([n for _, n in below])[_sq(x[rows], self.centres[[c for c, _ in below]]).argmin(1)]
                    todo += [n for _, n in below]
        return at

    def bare(self) -> "Tree":
        """The nodes and centres without rows."""
        self.x = self.ids = self.short = self.norm = None
        return self

    def search(self, q: np.ndarray, k: int, visits: int, own: np.ndarray, block: int = 256):
        """For each query the (ids, squared distances) of its k nearest rows of another id in the first
        `visits` leaves, and in more as long as those hold fewer than k others."""
        for lo in range(0, len(q), block):
            some = q[lo:lo + block]
            far = _sq(some, self.centres)
            for j, v in enumerate(some):
                yield self.nearest(v, self.take(far[j].tolist(), k, visits), k, own[lo + j])

    def take(self, d: list[float], k: int, visits: int) -> list[tuple[int, int]]:
        out, have = [], 0
        for n, i in enumerate(self.leaves_of(d)):
            if n >= visits and have > k:
                break
            s = self.slices[i]
            out.append(s)
            have += s[1] - s[0]
        return out

    def nearest(self, v: np.ndarray, slices: list[tuple[int, int]], k: int, own: int):
        """Exact ranks within the slices: single precision sifts, double precision and ids decide."""
        if not slices:
            return np.zeros(0, np.int64), np.zeros(0)
        w = (-2 * v).astype(np.float32)
        rough = np.concatenate([self.norm[a:b] + self.short[a:b] @ w for a, b in slices])
        at = np.concatenate([np.arange(a, b) for a, b in slices])
        m = self.ids[at] != own
        at, rough = at[m], rough[m]
        if len(at) > k:
            room = 1e-4 * (1 + float(v @ v)) + 1e-5 * float(np.abs(rough).max())
            at = at[rough <= np.partition(rough, k - 1)[k - 1] + room]
        d = ((self.x[at] - v) ** 2).sum(1)
        order = np.lexsort((self.ids[at], d))[:k]
        return self.ids[at[order]], d[order]


def calibrate(tree: Tree, k: int, recall: float, sample: np.ndarray) -> int:
    """The least number of leaf visits, widened step by step, with which the sampled rows find `recall`
    of their exact neighbours in this shard."""
    if tree.leaves <= 1 or not len(sample):
        return 1
    need = []
    far = _sq(tree.x[sample], tree.centres)
    rank = np.zeros(len(tree.x), np.int64)
    place = {i: j for j, i in enumerate(tree.ids)}
    for n, i in enumerate(sample):
        want, _ = tree.nearest(tree.x[i], [(0, len(tree.x))], k, tree.ids[i])
        for m, leaf in enumerate(tree.leaves_of(far[n].tolist())):
            rank[slice(*tree.slices[leaf])] = m
        need += [rank[place[w]] + 1 for w in want]
    need = np.array(need)
    visits = 1
    while len(need) and (need <= visits).mean() < recall and visits < tree.leaves:
        visits += max(1, visits // 8)
    return visits


def _rows(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """One row per id with a whole vector: the least of the vectors that an id has."""
    v = F.transform(F.col(f"`{column}`"), lambda x: x.cast("double"))
    good = vectors.select(F.col(f"`{ident}`").cast("long").alias("id"), v.alias("v")).filter(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))")
    return good.groupBy("id").agg(F.min("v").alias("v"))


def neighbours(vectors: DataFrame, k: int = K, recall: float = RECALL, ident: str = "vec_id", column: str = "embedding",
               every: int = EVERY, fit: int = FIT, cell: int = CELL, task_rows: int = TASK_ROWS) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> (vec_id, neighbor_id, rank, distance): for every row whose id is
    divisible by `every` its k nearest other rows, of all rows, by Euclidean distance, rank from 1.

    The tree's top levels are hierarchical k-means on at most `fit` rows, the first in the order of a hash; every
    row goes down them to its cell, and in a cell a tree is grown down to leaves of LEAF rows.  A cell of
    more than task_rows rows, as of a hot vector, is split by hash among tasks, each with its own tree.
    Queries take the cells best bin first, by a priority queue, so many that the calibration queries, which
    are compared with all rows, find (1 + recall) / 2 of their true neighbours in them; in a cell they visit
    leaves best bin first, so many as the cell's own calibration says.

    Vectors of each length are searched among themselves.  Rows with a null id, a null or empty vector, or
    one with nulls or NaN have no neighbours and aren't any.  An id with several vectors counts once, with the
    least.  Equal distances are ranked by id.  Fewer than k others give fewer rows; an empty table gives
    none.  Other columns are ignored, whatever their names."""
    spark = ready(vectors.sparkSession)
    rows = written(_rows(vectors, ident, column), "vectors")
    out = spark.createDataFrame([], "vec_id long, neighbor_id long, rank int, distance double")
    for dim, total in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        out = out.unionAll(_search(rows.filter(F.size("v") == dim), total, k, recall, every, fit, cell, task_rows))
    return out


def _search(rows: DataFrame, total: int, k: int, recall: float, every: int, fit: int, cell: int, task_rows: int) -> DataFrame:
    spark = rows.sparkSession
    some = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(fit).toPandas()
    x = np.stack(some["v"].to_numpy())
    top = Tree(x, np.arange(len(x)), max(2 * BRANCH, cell * len(x) // total)).bare()
    asked = F.pmod("id", F.lit(every)) == 0
    sample = [(r["id"], np.array(r["v"])) for r in rows.filter(asked).orderBy(F.xxhash64("id", F.lit(9)), "id").limit(CALIBRATION).collect()]
    probes = 1
    if sample and top.leaves > 1:
        qs, qids = np.stack([v for _, v in sample]), [i for i, _ in sample]

        def exact(batches):
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
            for pdf in batches:
                if not len(pdf):
                    continue
                x, ids = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy(np.int64)
                leaf, d = top.home(x), _sq(qs, x)
                for j, i in enumerate(qids):
                    m = np.argpartition(d[j], min(k, len(ids) - 1))[:k + 1]
                    m = m[ids[m] != i]
                    dd, ii, cc = (np.concatenate(z) for z in zip(best[j], (d[j][m], ids[m], leaf[m])))
                    o = np.lexsort((ii, dd))[:k]
                    best[j] = (dd[o], ii[o], cc[o])
            for i, (d, ii, c) in zip(qids, best):
                yield pd.DataFrame({"q": np.full(len(d), i), "d": d, "i": ii, "c": c})

        near = rows.mapInPandas(exact, "q long, d double, i long, c int")
        w = Window.partitionBy("q").orderBy("d", "i")
        true = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "c").toPandas()
        order = {i: {leaf: n for n, leaf in enumerate(top.leaves_of(d.tolist()))} for i, d in zip(qids, _sq(qs, top.centres))}
        depth = np.array([order[q][c] + 1 for q, c in zip(true["q"], true["c"])])
        while len(depth) and (depth <= probes).mean() < (1 + recall) / 2 and probes < top.leaves:
            probes += 1

    def placed(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=top.home(np.stack(pdf["v"].to_numpy())))

    def routed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            far = _sq(np.stack(pdf["v"].to_numpy()), top.centres)
            cells = [[leaf for _, leaf in zip(range(probes), top.leaves_of(d.tolist()))] for d in far]
            yield pdf.assign(cell=cells).explode("cell").astype({"cell": "int32"})

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        q, n, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(own) and len(queries):
            own = own.sort_values("id", kind="stable")
            tree = Tree(np.stack(own["v"].to_numpy()), own["id"].to_numpy(np.int64))
            visits = calibrate(tree, k, recall, np.random.default_rng(3).permutation(len(own))[:CALIBRATION])
            ids = queries["id"].to_numpy(np.int64)
            for i, (there, dist) in zip(ids, tree.search(np.stack(queries["v"].to_numpy()), k, visits, ids)):
                q.append(np.full(len(there), i)), n.append(there), d.append(dist)
        return pd.DataFrame({"id": np.concatenate(q), "n": np.concatenate(n), "d": np.concatenate(d)})

    cells = written(rows.mapInPandas(placed, "id long, v array<double>, cell int"), "cells")
    # A row for each leaf of the top levels, which are fitted on a bounded sample.
    split = cells.groupBy("cell").agg(F.ceil(F.count("*") / task_rows).cast("int").alias("parts"))
    here = cells.join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    there = rows.filter(asked).mapInPandas(routed, "id long, v array<double>, cell int").join(F.broadcast(split), "cell")
    there = there.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = here.groupBy("cell", "part").cogroup(there.groupBy("cell", "part")).applyInPandas(search, "id long, n long, d double")
    w = Window.partitionBy("id").orderBy("d", "n")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("id").alias("vec_id"), F.col("n").alias("neighbor_id"), "rank", F.sqrt("d").alias("distance")))
