"""Shared plumbing: the shared folder, written tables, word and n-gram hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
MASK48 = U64((1 << 48) - 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, also when the driver runs from another folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local tests a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        sc = spark.sparkContext
        there = sc.getCheckpointDir()
        if there is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            there = "file://" + tempfile.mkdtemp(prefix="terralit-")
            sc.setCheckpointDir(there)
            there = sc.getCheckpointDir()
    return there.rstrip("/")


def local_path(path: str) -> str:
    """The file-system path of a file: address, for files that tasks map into memory."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped files need a mounted shared folder (file:)")
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/terralit/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back.  This cuts the lineage, and what a lost
    executor held is read again from there rather than computed again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    MADE[id(back)] = (path, back)
    return back


#: The tables of written() that are still there, by the identity of the DataFrame.
MADE: dict[int, tuple[str, DataFrame]] = {}


def discard(df: DataFrame) -> None:
    """Delete a table of written() from the shared folder, once all that was made of it is written itself."""
    path, _ = MADE.pop(id(df), (None, None))
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(keep: DataFrame) -> None:
    """Delete all tables of written() but `keep`, which the caller has made of them."""
    for _, df in list(MADE.values()):
        if df is not keep and df.sparkSession is keep.sparkSession:
            discard(df)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name = f"_{name}"
    return f"__{name}"


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashing -----------------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15)
_RINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [U64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                          0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, index of the text) of each word, in order.  A word is a run of lower-cased
    ASCII letters, digits and any non-ASCII characters."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts_of_text = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    is_word = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(buf) + 1
    power = np.full(n, _R)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[buf] * power[:-1])))
    back = np.full(n, _RINV)
    back[0] = 1
    back = np.cumprod(back)
    h = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(starts_of_text, start, side="right") - 1


def gram_sets(texts: list[str], n: int, chunk: int = 1 << 20):
    """Yield (index, sorted array of the distinct n-gram hashes) of each text that has a word.
    A text of fewer than n words has one gram, all its words."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < chunk):
            size += len(texts[to])
            to += 1
        h, doc = word_hashes(texts[at:to])
        if len(h):
            g = np.zeros(max(0, len(h) - n + 1), np.uint64)
            for k in range(n):
                g += h[k:len(h) - n + 1 + k] * _STEP[k]
            g = mix(g)
            first = np.searchsorted(doc, np.arange(to - at + 1))
            for i in range(to - at):
                a, b = first[i], first[i + 1]
                if b - a >= n:
                    yield at + i, np.unique(g[a:b - n + 1])
                elif b > a:
                    s = U64(b - a)
                    for k in range(a, b):
                        s = s * _R + h[k]
                    yield at + i, mix(np.array([s], np.uint64))
        at = to


np.seterr(over="ignore")
