"""Sum-of-squares online packing of documents into training windows (operator 4)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ready, written

WINDOW = 2048
SHARD_TOKENS, SHARD_DOCS = 16_000_000, 1_000_000


class SumOfSquares:
    """One stream of items packed into windows of a fixed capacity.

    ``open[h]`` counts the windows filled to level h (0 < h < capacity).  An item goes to the level for
    which the sum of open[h]**2 after placing it is least; of equal levels the fullest wins, a new
    window counting as level 0.  Of the windows at a level, the one that reached it last is taken."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset in it) for an item of 1 to capacity tokens."""
        c, n = self.capacity, self.open
        if size == c:
            return self.new(), 0
        here = n[1:c - size + 1]
        change = 2 * (n[size + 1:c + 1] - here) + 2
        change[-1] = 1 - 2 * here[-1]
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if change[best] <= 2 * n[size] + 1:
            level = best + 1
            window = self.stacks[level].pop()
            n[level] -= 1
        else:
            level, window = 0, self.new()
        if level + size < c:
            n[level + size] += 1
            self.stacks[level + size].append(window)
        return window, level


OUT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("window", T.LongType()),
                    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                    T.StructField("doc_start", T.LongType()), T.StructField("length", T.IntegerType()),
                    T.StructField("offset", T.IntegerType())])


def pack(docs: DataFrame, capacity: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, length: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece of a document: shard, window, doc_id, piece,
    doc_start (token of the document at which the piece begins), length, offset in the window.

    Tokens are runs of non-space characters, or what the column `length` counts, as the n_tokens of a
    tokenizer.  A document longer than a window is cut into full windows and a rest; nothing is dropped.  The
    number of shards follows the totals, so that each is a stream of about shard_tokens tokens and
    shard_docs documents at most, whatever the size of the corpus; only ids, lengths and hashes are shuffled, and
    texts are read once.  In a shard, documents arrive by (doc_id, text hash), null ids first.

    Null and blank texts have no tokens and give no row.  Repeated rows are packed each.  Null doc_ids
    are packed and stay null.  Of equal levels the fullest wins.  Other columns are ignored, whatever their
    names.  Empty tables give no rows."""
    size = F.regexp_count("text", F.lit(r"\S+")) if length is None else F.col(f"`{length}`")
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("n"), F.xxhash64("text").alias("h")).filter("n > 0")
    ready(docs.sparkSession)
    items = written(items, "items")
    total, many = items.agg(F.sum("n"), F.count("*")).first()
    shards = max(1, math.ceil((total or 0) / shard_tokens), math.ceil(many / shard_docs))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)).cast("int"))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "h"], na_position="first", kind="stable")
        ids, ns = pdf["doc_id"].to_numpy(object), pdf["n"].to_numpy()
        stream = SumOfSquares(capacity)
        window, doc, piece, start, length, offset = [], [], [], [], [], []
        for i, n in zip(ids, ns):
            full, rest = divmod(int(n), capacity)
            for k in range(full + (rest > 0)):
                size = capacity if k < full else rest
                w, at = stream.place(size)
                window.append(w), doc.append(None if i is pd.NA or i != i else int(i)), piece.append(k)
                start.append(k * capacity), length.append(size), offset.append(at)
        out = pd.DataFrame({"shard": np.full(len(window), key[0], np.int32), "window": np.array(window, np.int64)})
        out["doc_id"] = pd.array(doc, dtype="Int64")
        return out.assign(piece=np.array(piece, np.int32), doc_start=np.array(start, np.int64),
                          length=np.array(length, np.int32), offset=np.array(offset, np.int32))

    return items.repartitionById(shards, "shard").groupBy("shard").applyInPandas(one, OUT)
