"""URL filter over a sorted, memory-mapped array of 64-bit digests (operator 2)."""

from __future__ import annotations

import functools
import math
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import local_path, ready, scratch

SHARD_ENTRIES = 4_000_000
#: Hosts, with all that is under them, and one page; a list of production size comes as a table.
BLOCKED = tuple(f"{h}.example.{t}" for h in ("cheap-pills", "spam-farm", "casino-win") for t in ("com", "net", "org")) + ("example.com/blocked/page",)


def _norm(c):
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^[a-z][a-z0-9+.-]*://", ""), "#.*$", "")


def entry_key(c):
    """A list entry as it is stored: no scheme, fragment or trailing slash; the host in lower case."""
    n = F.regexp_replace(_norm(c), "/+$", "")
    host = F.regexp_extract(n, "^[^/?]*", 0)
    return F.concat(F.lower(host), F.substr(n, F.length(host) + 1))


def candidates(c, depth: int = 1 << 20):
    """What a URL can be listed as, in order: its host and parent domains of two labels or more, its host
    with each leading part of the path, and, if it has one, with path and query.  depth is the most path
    parts that any entry has; longer leading parts can't be listed."""
    n = _norm(c)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(n, "^[^/?]*", 0), "^.*@", ""), ":[0-9]*$", ""))
    rest = F.regexp_extract(n, "^[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(rest, r"^[^?]*", 0), F.regexp_extract(rest, r"^[^?]*(\?.*)$", 1)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                     lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    last = lambda p: F.greatest(F.least(F.size(p), F.lit(depth)), F.lit(1))
    down = F.transform(F.array(parts), lambda p: F.transform(F.filter(F.sequence(F.lit(1), last(p)), lambda i: (i <= F.size(p)) & (i <= depth)),
                                                             lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/"))))[0]
    full = F.when(query != "", F.array(F.concat(host, F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(F.lit("")), query)))
    return F.when(c.isNotNull(), F.concat(up, down, F.coalesce(full, F.array().cast("array<string>"))))


@dataclass(frozen=True)
class Index:
    """The shards, in the order of their keys: (path, lowest key, highest key, entries)."""

    shards: tuple[tuple[str, int, int, int], ...]
    mask: int = (1 << 64) - 1
    depth: int = 0


def build(entries: DataFrame, column: str = "entry", shard_entries: int = SHARD_ENTRIES, bits: int = 64) -> Index:
    """Write the index of a list to the shared folder: entries are range partitioned by digest and each
    task writes its own shard of sorted keys, offsets and full strings.  Null and empty entries are left
    out and repeated ones count once.  bits < 64 keeps that many bits of a digest only (for tests)."""
    spark = ready(entries.sparkSession)
    folder, mask = scratch(spark, "urls"), (1 << bits) - 1
    os.makedirs(local_path(folder), exist_ok=True)
    one = entries.select(entry_key(F.col(f"`{column}`").cast("string")).alias("s")).filter("s <> ''").distinct()
    one = one.select("s", F.xxhash64("s").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("k"))
    # Shards are cut by the unsigned order, in which numpy searches.
    one = one.withColumn("o", F.col("k").bitwiseXOR(F.lit(-(1 << 63))))
    n, depth = one.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("s", "/")) - 1), F.lit(0))).first()
    shards = max(1, math.ceil(n / shard_entries))

    def write(batches):
        rows = [pdf for pdf in batches if len(pdf)]
        if not rows:
            return
        pdf = pd.concat(rows)
        keys = pdf["k"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        raw = [pdf["s"].iloc[i].encode() for i in order]
        path = os.path.join(local_path(folder), uuid.uuid4().hex)
        np.save(f"{path}.keys.npy", keys[order])
        np.save(f"{path}.ends.npy", np.cumsum([0] + [len(r) for r in raw]).astype(np.int64))
        with open(f"{path}.text", "wb") as f:
            f.write(b"".join(raw))
        yield pd.DataFrame({"path": [path], "low": [str(keys.min())], "high": [str(keys.max())], "n": [len(keys)]})

    made = one.repartitionByRange(shards, "o").mapInPandas(write, "path string, low string, high string, n long").collect()
    return Index(tuple(sorted(((r["path"], int(r["low"]), int(r["high"]), r["n"]) for r in made), key=lambda s: (s[1], s[0]))), mask, depth)


@functools.lru_cache(maxsize=4096)
def _shard(path: str):
    return np.load(f"{path}.keys.npy", mmap_mode="r"), np.load(f"{path}.ends.npy", mmap_mode="r"), np.memmap(f"{path}.text", np.uint8, "r")


def probe(index: Index, keys: np.ndarray, strings) -> np.ndarray:
    """Whether each string, with its digest among keys, is in the index: a binary search for all keys of
    a shard at once; the entries whose digest is equal are then compared as full strings."""
    keys = keys & np.uint64(index.mask)
    found = np.zeros(len(keys), bool)
    for path, low, high, _ in index.shards:
        own = np.flatnonzero((keys >= np.uint64(low)) & (keys <= np.uint64(high)) & ~found)
        if not len(own):
            continue
        there, ends, text = _shard(path)
        at = np.searchsorted(there, keys[own], side="left")
        hit = np.flatnonzero(there[at] == keys[own])
        for i in hit:
            want, j = strings[own[i]].encode(), at[i]
            while j < len(there) and there[j] == keys[own[i]]:
                if text[ends[j]:ends[j + 1]].tobytes() == want:
                    found[own[i]] = True
                    break
                j += 1
    return found


def url_filter(pages: DataFrame, index: Index, column: str = "url") -> DataFrame:
    """pages (url, ...) -> the same rows and columns, blocked (boolean) and matched (string): the first
    of the URL's candidates that the index has, from its host upwards, then down its path.

    Null URLs have null candidates: blocked is false and matched null, as for empty ones and ones without
    a match.  Repeated rows are each judged.  Columns blocked and matched are replaced.  Nothing is
    shuffled; the index is read by mapping the shared files, so its size isn't bound by a worker's heap."""
    ready(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("blocked", "matched")]

    @F.pandas_udf("string")
    def match(cands: pd.Series, keys: pd.Series) -> pd.Series:
        sizes = [0 if c is None else len(c) for c in cands]
        if not sum(sizes):
            return pd.Series([None] * len(cands), dtype=object)
        flat = np.concatenate([c for c in cands if c is not None])
        k = np.concatenate([np.asarray(x, np.int64) for x in keys if x is not None]).view(np.uint64)
        hits = np.flatnonzero(probe(index, k, flat))
        out = np.full(len(sizes), None, object)
        for h, row in zip(hits[::-1], np.repeat(np.arange(len(sizes)), sizes)[hits[::-1]]):
            out[row] = flat[h]
        return pd.Series(out)

    cands = candidates(F.col(f"`{column}`"), index.depth)
    with_it = pages.select(*[F.col(f"`{c}`") for c in names], cands.alias("__c"))
    with_it = with_it.withColumn("matched", match("__c", F.transform("__c", lambda x: F.xxhash64(x))))
    return with_it.select(*[F.col(f"`{c}`") for c in names], F.col("matched").isNotNull().alias("blocked"), "matched")


def blocklist(spark: SparkSession, entries: tuple[str, ...] = BLOCKED) -> DataFrame:
    return spark.createDataFrame([(e,) for e in entries], "entry string")


_LIST = ", ".join(f"'{e}'" for e in BLOCKED)
SQL = f"""
WITH n AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS n FROM pages),
h AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(n, '^[^/?]*', 0), '^.*@', ''), ':[0-9]*$', '')) AS host,
             regexp_extract(n, '^[^/?]*(.*)$', 1) AS rest FROM n),
p AS (SELECT page_id, url, host, string_split(host, '.') AS ls, list_filter(string_split(regexp_extract(rest, '^[^?]*', 0), '/'), lambda x: x <> '') AS ps,
             regexp_extract(rest, '^[^?]*(\\?.*)$', 1) AS q FROM h),
c AS (SELECT page_id, url, list_concat(list_concat(
        list_transform(range(1, greatest(len(ls), 2)), lambda i: array_to_string(ls[i:], '.')),
        list_transform(range(1, len(ps) + 1), lambda i: host || '/' || array_to_string(ps[1:i], '/'))),
        CASE WHEN q <> '' THEN [host || CASE WHEN len(ps) > 0 THEN '/' || array_to_string(ps, '/') ELSE '' END || q] ELSE [] END) AS cs FROM p),
m AS (SELECT page_id, url, list_filter(cs, lambda x: list_contains([{_LIST}], x)) AS ms FROM c)
SELECT page_id, url, len(ms) > 0 AS blocked, ms[1] AS matched FROM m
"""
