"""Quality classifier by non-negative positive-unlabelled learning, in numpy (operator 1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import U64, ready, word_hashes

FIT_POSITIVES, FIT_UNLABELLED = 4000, 8000
BUCKETS, UNITS, STEPS, BATCH, DECAY, SEED = 1 << 14, 24, 500, 512, 1e-3, 11
#: The most of the trusted positives that the cut may lose, and the parts of the cross-fit.
LOST, FOLDS = 0.02, 3

_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 0, 1, 2, 3, 4
_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
for _i, _b in enumerate(_PUNCT):
    _CLASS[_b] = 6 + _i
CLASSES = 6 + len(_PUNCT)
DENSE = CLASSES + 6


def features(texts: list[str], chunk: int = 1 << 21) -> tuple[np.ndarray, list[np.ndarray]]:
    """Dense features (n, DENSE) and the distinct word buckets of each text."""
    dense, words = np.zeros((len(texts), DENSE), np.float32), []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < chunk):
            size += len(texts[to])
            to += 1
        some = texts[at:to]
        raw = [t.encode("utf-8", "replace") for t in some]
        n = np.array([len(r) for r in raw])
        doc = np.repeat(np.arange(len(raw)), n)
        counts = np.bincount(doc * CLASSES + _CLASS[np.frombuffer(b"".join(raw), np.uint8)], minlength=len(raw) * CLASSES)
        d = dense[at:to]
        d[:, :CLASSES] = np.log1p(1000 * counts.reshape(-1, CLASSES) / np.maximum(n, 1)[:, None])
        h, own = word_hashes(some)
        total = np.bincount(own, minlength=len(raw))
        same = (h[1:] == h[:-1]) & (own[1:] == own[:-1]) if len(h) else np.zeros(0, bool)
        order = np.lexsort((h, own))
        hs, os = h[order], own[order]
        first = np.ones(len(hs), bool)
        first[1:] = (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])
        hs, os = hs[first], os[first]
        distinct = np.bincount(os, minlength=len(raw))
        most = np.maximum(total, 1)
        d[:, CLASSES] = np.log1p(total)
        d[:, CLASSES + 1] = distinct / most
        d[:, CLASSES + 2] = np.log1p(total) * distinct / most
        d[:, CLASSES + 3] = np.bincount(own[1:][same], minlength=len(raw)) / most
        d[:, CLASSES + 4] = np.log1p(n / most)
        d[:, CLASSES + 5] = total == 0
        cut = np.searchsorted(os, np.arange(len(raw) + 1))
        b = (hs >> U64(50)).astype(np.int32)
        words += [b[cut[i]:cut[i + 1]] for i in range(len(raw))]
        at = to
    return dense, words


class Words:
    """Rows of word buckets, each row scaled to length 1."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.sizes)))
        self.scale = 1 / np.sqrt(np.maximum(self.sizes, 1))

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[rows]
        at = np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.flat[at], np.repeat(np.arange(len(rows)), n)

    def dot(self, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        flat, own = self.pick(rows)
        return np.bincount(own, w[flat], len(rows)) * self.scale[rows]

    def back(self, d: np.ndarray, rows: np.ndarray) -> np.ndarray:
        flat, own = self.pick(rows)
        return np.bincount(flat, (d * self.scale[rows])[own], BUCKETS)


def _sig(z):
    return 0.5 * (np.tanh(0.5 * z) + 1)


class Net:
    """One hidden layer over the dense features and a linear term over the words."""

    def __init__(self, mean, std, r: np.random.Generator):
        self.mean, self.std = mean, std
        self.p = {"a": r.normal(0, 1 / np.sqrt(DENSE), (DENSE, UNITS)), "b": np.zeros(UNITS),
                  "c": r.normal(0, 0.3, UNITS), "d": np.zeros(1), "w": np.zeros(BUCKETS)}
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.t = 0

    def hidden(self, dense):
        return np.tanh(np.clip((dense - self.mean) / self.std, -6, 6) @ self.p["a"] + self.p["b"])

    def score(self, dense, words: Words, rows=None):
        rows = np.arange(len(dense)) if rows is None else rows
        return self.hidden(dense[rows]) @ self.p["c"] + self.p["d"] + words.dot(self.p["w"], rows)

    def step(self, dense, words: Words, rows, dz, rate: float):
        x = np.clip((dense[rows] - self.mean) / self.std, -6, 6)
        h = np.tanh(x @ self.p["a"] + self.p["b"])
        dh = np.outer(dz, self.p["c"]) * (1 - h * h)
        g = {"a": x.T @ dh + DECAY * self.p["a"], "b": dh.sum(0), "c": h.T @ dz + DECAY * self.p["c"], "d": dz.sum(keepdims=True),
             "w": words.back(dz, rows) + DECAY * self.p["w"]}
        self.t += 1
        for k, v in g.items():
            m, s = self.m[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.p[k] -= rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(s / (1 - 0.99 ** self.t)) + 1e-6)


def _train(dense, words: Words, pos, unl, prior: float | None, seed: int, steps: int) -> Net:
    """With a prior, the non-negative risk with the sigmoid loss: where the estimated negative part goes
    below zero, the step climbs that part instead.  Without one, positive against unlabelled."""
    r = np.random.default_rng(seed)
    both = np.concatenate((pos, unl))
    net = Net(dense[both].mean(0), dense[both].std(0) + 0.05, r)
    for k in range(steps):
        p, u = r.choice(pos, min(BATCH, len(pos)), False), r.choice(unl, min(2 * BATCH, len(unl)), False)
        rows = np.concatenate((p, u))
        z = net.score(dense, words, rows)
        zp, zu = z[:len(p)], z[len(p):]
        if prior is None:
            dz = np.concatenate((-_sig(-zp) / (2 * len(p)), _sig(zu) / (2 * len(u))))
        else:
            sp, su = _sig(zp), _sig(zu)
            negative = su.mean() - prior * sp.mean()
            dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
            dz = np.concatenate((-2 * prior * dp, du)) if negative >= 0 else np.concatenate((prior * dp, -du))
        net.step(dense, words, rows, dz, 0.02 * min(1, (k + 1) / 20) * (1 - k / (steps + 1)))
    return net


def class_prior(pos_scores: np.ndarray, unl_scores: np.ndarray, sure: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among the unlabelled: the least ratio of the shares
    above a cut, with its confidence bound deciding which cut."""
    cuts = np.unique(pos_scores)
    qp = 1 - np.searchsorted(np.sort(pos_scores), cuts) / len(pos_scores)
    qu = 1 - np.searchsorted(np.sort(unl_scores), cuts) / len(unl_scores)
    slack = np.sqrt(np.log(4 / sure) / (2 * len(pos_scores))) + np.sqrt(np.log(4 / sure) / (2 * len(unl_scores)))
    best = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.98))


class Model:
    """A fitted classifier: net, prior and the score from which a document is kept."""

    def __init__(self, net: Net, prior: float, cut: float):
        self.net, self.prior, self.cut = net, prior, cut
        self.net.m = {}


def best_cut(pos: np.ndarray, unl: np.ndarray, prior: float, lost: float = LOST) -> float:
    """The cut of least non-negative risk with the 0-1 loss, of the scores of held-out positives and unlabelled rows: prior *
    P(positive below) + max(0, P(unlabelled from it) - prior * P(positive from it)).  It is at most 0, where
    the surrogate's sign changes, and loses at most `lost` of the positives; of equal risks the lower wins."""
    pos, unl = np.sort(pos), np.sort(unl)
    cuts = np.unique(np.concatenate((pos, unl, [0.0])))
    below = np.searchsorted(pos, cuts) / len(pos)
    risk = prior * below + np.maximum(0, 1 - np.searchsorted(unl, cuts) / len(unl) - prior * (1 - below))
    risk[(cuts > 0) | (below > lost)] = np.inf
    return float(cuts[np.argmin(risk)])


def fit(dense: np.ndarray, rows: list[np.ndarray], positive: np.ndarray, seed: int = SEED, steps: int = STEPS, lost: float = LOST, folds: int = FOLDS) -> Model:
    """A classifier from features and the mask of trusted positives; the other rows are unlabelled.

    Cross-fitted: each of `folds` parts of the rows is scored by nets that were trained on the others, first
    positives against unlabelled, whose scores of all parts give the prior, then by the non-negative
    risk with that prior, whose scores give the cut.  The net itself is trained on all rows."""
    words, r = Words(rows), np.random.default_rng(seed)
    part = np.zeros(len(positive), np.int64)
    for own in (np.flatnonzero(positive), np.flatnonzero(~positive)):
        part[r.permutation(own)] = np.arange(len(own)) % folds
    both = np.flatnonzero(positive), np.flatnonzero(~positive)

    def held(prior: float | None, n: int) -> np.ndarray:
        out = np.zeros(len(positive))
        for k in range(folds):
            p, u = (x[part[x] != k] if (part[x] != k).any() else x for x in both)
            out[part == k] = _train(dense, words, p, u, prior, seed + 2 * k, n).score(dense, words, np.flatnonzero(part == k))
        return out

    first = held(None, steps // 2)
    prior = class_prior(first[positive], first[~positive])
    second = held(prior, steps)
    return Model(_train(dense, words, *both, prior, seed + 1, steps), prior, best_cut(second[positive], second[~positive], prior, lost))


def trained(docs: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED) -> Model | None:
    """Fit on `positives` trusted documents (quality 1, not toxic) and `unlabelled` others, each the first
    in the order of a hash of doc_id; None where either is missing."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    trusted = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
               .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0"))
    ids = [r[0] for r in trusted.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(positives).collect()]
    if not ids:
        return None
    mark = F.xxhash64("doc_id", F.lit(5))
    far = docs.select(mark.alias("h")).orderBy("h").limit(unlabelled).agg(F.max("h")).first()[0]
    if far is None:
        return None

    def read(batches):
        for pdf in batches:
            dense, words = features(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "positive": pdf["positive"], "dense": [x.tobytes() for x in dense], "words": [w.tobytes() for w in words]})

    own = F.col("doc_id").isin(ids)
    chosen = docs.filter(own | (mark <= far)).withColumn("positive", F.coalesce(own, F.lit(False)))
    got = (chosen.mapInPandas(read, "doc_id long, positive boolean, dense binary, words binary")
           .orderBy(~F.col("positive"), mark, "dense").limit(2 * (positives + unlabelled)).toPandas())
    if not got["positive"].any() or got["positive"].all():
        return None
    dense = np.stack([np.frombuffer(x, np.float32) for x in got["dense"]])
    return fit(dense, [np.frombuffer(x, np.int32) for x in got["words"]], got["positive"].to_numpy(bool))


def classify(docs: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, toxic, ...) -> docs' columns, quality_score
    (double) and keep (boolean).

    The fit is on a bounded sample; every row is scored over its whole text, however long, with no shuffle.  A null text
    has a null score and isn't kept.  An empty text is scored like any other (its words and bytes are
    none).  If there is no trusted positive or nothing unlabelled, nothing can be learnt: scores are null
    and every text that isn't null is kept.  Rows are independent, so repeated rows score alike; of a
    doc_id labelled twice the worst label counts.  A score that equals the cut is kept.  An empty table stays
    empty.  Columns quality_score and keep of docs are replaced,
    all others kept."""
    ready(docs.sparkSession)
    model = trained(docs, labels, positives, unlabelled)
    names = [c for c in docs.columns if c not in ("quality_score", "keep")]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("double").alias("quality_score"), F.col("text").isNotNull().alias("keep"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        dense, words = features([t if isinstance(t, str) else "" for t in texts])
        z = model.net.score(dense, Words(words)) if len(texts) else np.zeros(0)
        return pd.Series(np.where(texts.notna(), z, np.nan)).astype("Float64")

    scored = docs.select(*[F.col(f"`{c}`") for c in names], F.nanvl(score("text"), F.lit(None).cast("double")).alias("quality_score"))
    return scored.withColumn("keep", F.coalesce(F.col("quality_score") >= model.cut, F.lit(False)))
