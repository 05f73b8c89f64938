"""Line de-duplication by a suffix array over line ids (operator 9)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import ready, unused, written

MIN_WORDS = 40


def windows(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line, the lengths of the minimal windows that begin there: the shortest run from this
    line with at least `least` words, and the runs that are shortest seen from their last line."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    found: list[set[int]] = [set() for _ in range(n)]
    end = np.searchsorted(total, total[:-1] + least, side="left")
    for i in np.flatnonzero(end <= n):
        found[i].add(int(end[i] - i))
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    for e in np.flatnonzero(start >= 0):
        found[min(start[e], n - 1)].add(int(e + 1 - start[e]))
    return [sorted(s) for s in found]


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of the keys that occur more than once, in the order of the keys: a range partitioned sort of
    the distinct keys.  Counts combine before the shuffle, so a hot line is one row per task."""
    return written(rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1").select(*keys)
                   .repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("named", F.monotonically_increasing_id()), "ranks")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text) -> (k1, k2, ranges): the runs of lines, as [from, to), that copy an earlier run.

    Prefix doubling: r_0 ranks the lines, r_{j+1}(p) ranks the pairs (r_j(p), r_j(p + 2^j)), so equal r_j
    mean 2^j equal lines, and suffixes that became unique leave at once.  A window of L lines with
    2^j <= L < 2^(j+1) belongs to the LCP interval named (L, r_j(p), r_j(p + L - 2^j)).  The first window
    of an interval stays and the others are later copies.  Since every line of a maximal repeated run of
    min_words words lies in one of its forward- or backward-minimal windows, their union is the union of
    the maximal runs; so doubling ends at the longest minimal window, however long the copies are."""
    spark = ready(docs.sparkSession)
    lines = F.split("text", "\n", -1)
    arrays = (docs.filter("text is not null")
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k1"),
                      F.xxhash64("text", "doc_id", F.lit(7)).alias("k2"),
                      F.transform(lines, lambda x: F.xxhash64(x)).alias("a"),
                      F.transform(lines, lambda x: F.xxhash64(x, F.lit(7))).alias("b"),
                      F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("w"))
              .filter(F.aggregate("w", F.lit(0), lambda s, x: s + x) >= min_words)
              .groupBy("k1", "k2").agg(F.first(F.struct("doc_id", "a", "b", "w")).alias("d")).select("k1", "k2", "d.*"))
    keyed = (arrays.repartitionByRange(F.col("doc_id").asc_nulls_last(), "k1", "k2")
             .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "k1", "k2")
             .withColumn("did", F.monotonically_increasing_id()))
    keyed = written(keyed, "lines")

    def explode(batches):
        for pdf in batches:
            rows = [windows(np.asarray(w), min_words) for w in pdf["w"]]
            sizes = [len(r) for r in rows]
            if not sum(sizes):
                continue
            yield pd.DataFrame({"did": np.repeat(pdf["did"].to_numpy(), sizes),
                                "idx": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
                                "a": np.concatenate([np.asarray(x) for x in pdf["a"]]),
                                "b": np.concatenate([np.asarray(x) for x in pdf["b"]]),
                                "lens": [x for r in rows for x in r]})

    rows = keyed.select("did", "a", "b", "w").mapInPandas(explode, "did long, idx int, a long, b long, lens array<int>")
    ranks = written(rows.join(_named(rows, ["a", "b"]), ["a", "b"]).select("did", "idx", F.col("named").alias("r"), "lens"), "suffixes")
    wide = ranks.filter("size(lens) > 0").select("did", "idx", F.explode("lens").alias("len"))
    longest = wide.agg(F.max("len")).first()[0] or 0
    deleted, step = [], 1
    while step <= longest:
        at = ranks.select("did", "idx", "r")
        own = wide.filter((F.col("len") >= step) & (F.col("len") < 2 * step))
        tail = at.select("did", F.col("idx").alias("far"), F.col("r").alias("r2"))
        own = (own.join(at, ["did", "idx"]).withColumn("far", F.col("idx") + F.col("len") - step)
               .join(tail, ["did", "far"]).select("did", "idx", "len", "r", "r2"))
        first = own.groupBy("len", "r", "r2").agg(F.min(F.struct("did", "idx")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        later = own.join(first, ["len", "r", "r2"]).filter(F.struct("did", "idx") > F.col("first"))
        deleted.append(written(later.select("did", "idx", (F.col("idx") + F.col("len")).alias("to")), "runs"))
        if 2 * step > longest:
            break
        pairs = written(at.withColumn("far", F.col("idx") + step).join(tail, ["did", "far"]).select("did", "idx", "r", "r2"), "pairs")
        ranks = written(pairs.join(_named(pairs, ["r", "r2"]), ["r", "r2"])
                        .select("did", "idx", F.col("named").alias("r")), "suffixes")
        if ranks.isEmpty():
            break
        step *= 2
    if not deleted:
        deleted = [spark.createDataFrame([], "did long, idx int, to int")]
    empty = F.expr("cast(array() as array<struct<idx:int,to:int>>)")
    runs = (reduce(DataFrame.unionAll, deleted).groupBy("did").agg(F.sort_array(F.collect_list(F.struct("idx", "to"))).alias("r"))
            .select("did", F.aggregate("r", empty, lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= x["idx"]),
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                    F.element_at(acc, -1)["idx"].alias("idx"), F.greatest(F.element_at(acc, -1)["to"], x["to"]).alias("to"))))
            ).otherwise(F.concat(acc, F.array(x)))).alias("ranges")))
    return keyed.select("k1", "k2", "did").join(runs, "did").select("k1", "k2", "ranges")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows and columns with the later copies of repeated line runs
    deleted from text, and lines_removed (int) added.

    Lines are what '\\n' separates.  A run counts as repeated if the same lines, of min_words words
    (runs of non-space characters) or more in all, occur at an earlier place: in a document of lesser
    (doc_id, hash), null ids last, or further up in the same document.  The first copy stays whole.  Of
    rows with the same doc_id and text, one is kept and each further one is a later copy as a whole if it
    has min_words words.  If all lines go, text is ''.  A null text stays null, with 0 lines removed; an
    empty text stays.  Very long texts are compared whole; an empty table stays empty.  A column lines_removed
    is replaced, all others are kept whatever their names."""
    runs = repeated_runs(docs, min_words)
    names = [c for c in docs.columns if c != "lines_removed"]
    k1, k2, ranges, copy = (unused(docs, c) for c in ("k1", "k2", "ranges", "copy"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("doc_id", "text").alias(k1), F.xxhash64("text", "doc_id", F.lit(7)).alias(k2))
    same = Window.partitionBy(k1, k2).orderBy(F.lit(0))
    joined = keyed.join(runs.toDF(k1, k2, ranges), [k1, k2], "left").withColumn(copy, F.row_number().over(same) > 1)
    lines = F.split("text", "\n", -1)
    whole = F.col(copy) & (F.regexp_count("text", F.lit(r"\S+")) >= min_words)
    kept = F.filter(lines, lambda x, i: ~F.exists(ranges, lambda r: (i >= r["idx"]) & (i < r["to"])))
    text = F.when(whole, F.lit("")).when(F.col(ranges).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    removed = F.when(whole, F.size(lines)).when(
        F.col(ranges).isNotNull(), F.aggregate(ranges, F.lit(0), lambda s, r: s + r["to"] - r["idx"])).otherwise(F.lit(0))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
                         F.coalesce(removed, F.lit(0)).alias("lines_removed"))


SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
c AS (SELECT doc_id, i, sum(len(regexp_extract_all(line, '\\S+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
             len(regexp_extract_all(line, '\\S+')) AS w FROM l),
fw AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
       AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL),
bw AS (SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
       AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.i),
w AS (SELECT * FROM fw UNION SELECT * FROM bw),
t AS (SELECT w.doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS run, e - s AS n FROM w JOIN d USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY run, n ORDER BY doc_id, s) AS k FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE k > 1),
r AS (SELECT l.doc_id, count(gone.i) AS lines_removed,
             coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT o.doc_id, CASE WHEN r.lines_removed > 0 THEN r.text ELSE o.text END AS text,
       CAST(coalesce(r.lines_removed, 0) AS INTEGER) AS lines_removed
FROM documents o LEFT JOIN r ON o.doc_id = r.doc_id
"""
