"""Library operators: search, pages, overlays, statistics, the item-tag graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def visible(items: DataFrame, owner: int, superuser: bool = False) -> DataFrame:
    """Row-level security: superusers see all rows, others their own."""
    return items if superuser else items.filter(F.col("owner_id") == owner)


def search(items: DataFrame, links: DataFrame, tags: DataFrame, title: str | None, tag: str | None) -> DataFrame:
    """Items whose title or one of whose tags contains the words, in any case.  The tag side is a distinct
    set of ids joined as a flag, as a semi-join can't stand inside an OR."""
    cond = F.lit(True) if title is None and tag is None else F.lit(False)
    if title is not None:
        cond = cond | F.col("title").ilike(f"%{title}%")
    if tag is None:
        return items.filter(cond)
    hit = links.join(tags.filter(F.col("name").ilike(f"%{tag}%")), links["tag_id"] == tags["id"], "left_semi").select(F.col("item_id").alias("id")).distinct().withColumn("__h", F.lit(True))
    return items.join(hit, "id", "left").filter(cond | F.col("__h").isNotNull()).drop("__h")


def page(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def overlay(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: values of changes that are set replace those of base."""
    cols = [c for c in changes.columns if c != key]
    ch = changes.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    return base.join(ch, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def without(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti").select(base.columns)


def replace_group(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows of a key take the place of its old ones; keys without new rows keep theirs."""
    return without(base, new, key).unionByName(new)


METHODS = ("regex", "geocoded", "ner", "table_parsing", "manual")


def by_method() -> list[Column]:
    return [F.count_if(F.col("method") == m).alias(f"n_{m}") for m in METHODS]


def site_stats(sites: DataFrame, by: str) -> DataFrame:
    """Totals, manual and automatic counts, mean confidence, and counts by method in one aggregate."""
    return sites.groupBy(by).agg(F.count("*").alias("total"), F.count_if("is_manual").alias("manual"), (F.count("*") - F.count_if("is_manual")).alias("automatic"),
                                 F.coalesce(exact_mean("confidence", 3), F.lit(0.0)).alias("avg_confidence"), *by_method())


def millionths(column: str) -> Column:
    """The sum of a column of at most 6 decimals in whole millionths, in which the order of rows can't tell."""
    return F.sum(F.round(F.col(column) * 1_000_000).cast("bigint"))


def half_up(s: Column, n: Column, digits: int) -> Column:
    """s millionths over n, rounded half up to `digits`; null without rows."""
    unit = 10 ** (6 - digits)
    top, bottom = 2 * s + unit * n, 2 * unit * n
    return F.when(n > 0, ((top - F.pmod(top, bottom)) / bottom).cast("bigint") / 10 ** digits)


def exact_mean(column: str, digits: int) -> Column:
    return half_up(millionths(column), F.count(column), digits)


def user_summary(items: DataFrame, sites: DataFrame) -> DataFrame:
    """Per owner: items, items with sites, sites, coverage, means to 3 digits and counts by method.  Sites are reduced
    to items before the join, so what is shuffled by owner is one row per item."""
    s = sites.groupBy("item_id").agg(F.count("*").alias("n"), millionths("confidence").alias("c"), millionths("validation").alias("v"), *by_method())
    j = items.select("id", "owner_id").join(s, F.col("id") == F.col("item_id"), "left")
    n = F.coalesce(F.sum("n"), F.lit(0))
    mean = lambda x: F.coalesce(half_up(F.sum(x), n, 3), F.lit(0.0))
    return j.groupBy("owner_id").agg(F.count("*").alias("total_items"), F.count("n").alias("items_with_sites"), n.alias("total_sites"), F.round(100.0 * F.count("n").cast("double") / F.count("*"), 1).alias("coverage"),
                                     mean("c").alias("avg_confidence"), mean("v").alias("avg_validation"), *[F.coalesce(F.sum(f"n_{m}"), F.lit(0)).alias(f"n_{m}") for m in METHODS])


def papers(items: DataFrame, creators: DataFrame, search: str | None = None, author: str | None = None, journal: str | None = None) -> DataFrame:
    """Items whose title, abstract or any author has the words of search, of which an author has those of author, and of
    that journal.  Creators are sifted before they are joined."""
    def by(words: str) -> DataFrame:
        return creators.filter(F.lower("last_name").contains(words.lower())).select(F.col("item_id").alias("id")).distinct()

    if search is not None:
        hit = F.lower("title").contains(search.lower()) | F.coalesce(F.lower("abstract_note").contains(search.lower()), F.lit(False))
        items = items.join(by(search).withColumn("__a", F.lit(True)), "id", "left").filter(hit | F.col("__a").isNotNull()).drop("__a")
    if author is not None:
        items = items.join(by(author), "id", "left_semi")
    return items if journal is None else items.filter(F.col("journal") == journal)


def cancelled(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """tasks (task_id, state) with those of ids (task_id) that haven't ended marked REVOKED; ended ones stay."""
    open_ = F.col("state").isin("PENDING", "STARTED", "RETRY", "PROGRESS")
    hit = tasks.join(ids.select("task_id").distinct().withColumn("__c", F.lit(True)), "task_id", "left")
    return hit.withColumn("state", F.when(open_ & F.col("__c").isNotNull(), "REVOKED").otherwise(F.col("state"))).drop("__c")


def batch_status(tasks: DataFrame) -> DataFrame:
    """Counts of a batch's latest states."""
    of = lambda *s: F.count_if(F.col("state").isin(*s))
    return tasks.agg(F.count("*").alias("total"), of("PENDING").alias("pending"), of("STARTED").alias("started"), of("RETRY").alias("retrying"), of("REVOKED").alias("revoked"),
                     of("SUCCESS", "FAILURE", "REVOKED").alias("ready"), of("SUCCESS").alias("successful"), of("FAILURE").alias("failed"))


def manual_sites(new: DataFrame) -> DataFrame:
    """Rows (id, item_id, name, latitude, longitude, ...) as sites made by hand: section other, confidence and validation
    1 where they aren't given."""
    given = lambda c: F.coalesce(F.col(c), F.lit(1.0)) if c in new.columns else F.lit(1.0)
    return new.select("id", "item_id", "name", "latitude", "longitude", given("confidence").alias("confidence"), given("validation").alias("validation"),
                      F.lit("manual").alias("method"), F.lit("manual").alias("source"), F.lit("other").alias("section"), F.lit(True).alias("is_manual"))


def latest(tasks: DataFrame) -> DataFrame:
    """The last state of each task."""
    return tasks.groupBy("task_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))


def shared(spark) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; a temporary one is set only in local runs
    that name none."""
    sc, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terralit-"))


# --- graph -------------------------------------------------------------------------------

def node_label(title: Column, publication: Column, journal: Column) -> Column:
    """Journal, else 20 characters of the publication, else of the title, else '?'; '' counts as missing."""
    return F.coalesce(F.nullif(journal, F.lit("")), F.nullif(F.substring(publication, 1, 20), F.lit("")), F.nullif(F.substring(title, 1, 20), F.lit("")), F.lit("?"))


def nodes(items: DataFrame, tags: DataFrame) -> DataFrame:
    i = items.select(F.concat(F.lit("item_"), F.col("id").cast("string")).alias("node"), F.lit("item").alias("type"), node_label(F.col("title"), F.col("publication_title"), F.col("journal")).alias("label"))
    return i.unionByName(tags.select(F.concat(F.lit("tag_"), F.col("id").cast("string")).alias("node"), F.lit("tag").alias("type"), F.col("name").alias("label")))


def edges(links: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """has-tag edges between items and tags that are both there."""
    k = links.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return k.select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("source"), F.concat(F.lit("tag_"), F.col("tag_id").cast("string")).alias("target"))


def importance(items: DataFrame, tags: DataFrame, links: DataFrame, sites: DataFrame, creators: DataFrame) -> DataFrame:
    """Items by tags, half their sites and 0.3 of their creators, tags by items; each over its kind's most."""
    n = lambda df, c, a: df.groupBy(c).agg(F.count("*").alias(a))
    i = (items.select("id").join(n(links, "item_id", "t").withColumnRenamed("item_id", "id"), "id", "left").join(n(sites, "item_id", "s").withColumnRenamed("item_id", "id"), "id", "left")
         .join(n(creators, "item_id", "c").withColumnRenamed("item_id", "id"), "id", "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    i = i.select(F.concat(F.lit("item_"), F.col("id").cast("string")).alias("node"), (zero("t") + 0.5 * zero("s") + 0.3 * zero("c")).cast("double").alias("raw"))
    t = tags.select("id").join(n(links, "tag_id", "t").withColumnRenamed("tag_id", "id"), "id", "left").select(F.concat(F.lit("tag_"), F.col("id").cast("string")).alias("node"), zero("t").cast("double").alias("raw"))

    def scaled(df: DataFrame) -> DataFrame:
        top = df.agg(F.greatest(F.max("raw"), F.lit(1.0)).alias("top"))  # one row
        return df.crossJoin(F.broadcast(top)).select("node", F.round(F.col("raw") / F.col("top"), 6).alias("importance"))
    return scaled(i).unionByName(scaled(t))


def tag_clusters(links: DataFrame, items: DataFrame) -> DataFrame:
    """Each tag of two items or more is a cluster; items in none are clusters of their own."""
    sized = links.groupBy("tag_id").agg(F.count("*").alias("n")).filter("n >= 2")
    own = links.join(sized, "tag_id").select(F.concat(F.lit("tag_"), F.col("tag_id").cast("string")).alias("cluster"), "item_id")
    alone = items.select(F.col("id").alias("item_id")).join(own.select("item_id").distinct(), "item_id", "left_anti")
    return own.unionByName(alone.select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("cluster"), "item_id"))


def graph_components(node_ids: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): root is the least node of its component.  Links to other nodes than these don't count.

    A source holds its targets together, so each hangs on the least of its targets, and only the targets are joined
    further: of a graph of items and tags that is a graph of tags, however many items there are."""
    shared(node_ids.sparkSession)
    ids = node_ids.select("node")
    targets = links.select(F.col("target").alias("node")).distinct().join(ids, "node", "left_semi").checkpoint()
    known = links.join(targets.select(F.col("node").alias("target")), "target", "left_semi").join(ids.select(F.col("node").alias("source")), "source", "left_semi")
    star = known.groupBy("source").agg(F.min("target").alias("least")).checkpoint()
    among = known.select(F.min("target").over(W.partitionBy("source")).alias("source"), "target").filter("source <> target").distinct()
    also = star.join(targets.select(F.col("node").alias("source")), "source", "left_semi").select("source", F.col("least").alias("target"))
    small = _joined(targets, among.unionByName(also))
    first = star.join(small, star["least"] == small["node"]).groupBy("root").agg(F.min("source").alias("first"))
    roots = small.join(first, "root", "left").select(F.col("node").alias("least"), F.least("root", "first").alias("root"))
    at = ids.join(star, ids["node"] == star["source"], "left").select("node", F.coalesce("least", "node").alias("least"))
    return at.join(roots, "least", "left").select("node", F.coalesce("root", "node").alias("root"))


def _joined(node_ids: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) by least labels and pointer jumping over a graph; labels are written out each round, which
    cuts the lineage, and rounds end when no label changes."""
    both = links.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(links.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct().checkpoint()
    now = node_ids.select("node", F.col("node").alias("root"))
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("r"))
        step = now.join(near, now["node"] == near["a"], "left").select("node", F.least("root", "r").alias("root"), (F.coalesce(F.col("r"), F.col("root")) < F.col("root")).alias("moved"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = step.join(up, "root").select("node", F.least("root", "up").alias("root"), "moved")  # to the root's root: rounds are few on long chains
        step = step.checkpoint()
        now = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return now


def graph_stats(node_ids: DataFrame, links: DataFrame) -> DataFrame:
    n = node_ids.agg(F.count("*").alias("node_count"))
    e = links.agg(F.count("*").alias("edge_count"))
    c = graph_components(node_ids, links).agg(F.count_distinct("root").alias("components"))
    v, m = F.col("node_count").cast("double"), F.col("edge_count").cast("double")
    return n.crossJoin(e).crossJoin(c).select("node_count", "edge_count", F.round(2 * m / v, 1).alias("avg_degree"), F.round(m / (v * (v - 1) / 2), 2).alias("density"), "components")
