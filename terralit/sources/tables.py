"""The domain's tables over the driver's tables, and the readers and writers of other forms."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

HEADINGS = ("Study area", "Field methods and data", "Data collection", "Abstract", "Results", "Discussion", "Conclusion", "Introduction", "References")


class Domain:
    """Lazy DataFrames of the domain; nothing is read until a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def user(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), (F.col("c_custkey") == 0).alias("is_superuser"))

    @cached_property
    def item(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("id"), F.col("o_custkey").alias("owner_id"), F.upper(F.substring(F.md5(k.cast("string")), 1, 8)).alias("key"),
            F.concat_ws(" ", "o_orderpriority", k.cast("string")).alias("title"), F.concat(F.lit("Status "), "o_orderstatus").alias("abstract_note"),
            F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("Journal of Landscape Studies "), (k % 7).cast("string"))).alias("publication_title"),
            F.when(k % 4 == 0, F.concat(F.lit("J. Land. "), (k % 5).cast("string"))).alias("journal"),
            F.col("o_orderpriority").alias("item_type"), F.col("o_orderdate").alias("date_added"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("att"), k.cast("string"))).alias("attachment"))

    @cached_property
    def tag(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def link(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        return (self.raw("lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
                .select(F.col("l_orderkey").alias("item_id"), F.col("s_nationkey").alias("tag_id")).distinct())

    @cached_property
    def creator(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_name")
        return (self.raw("lineitem").select("l_orderkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
                .select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("creator_id"), F.col("s_name").alias("last_name")))

    @cached_property
    def site(self) -> DataFrame:
        n = self.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"))
        hundred = F.round(F.col("l_discount") * 100).cast("int")
        near = lambda a, b: (a + F.col(b) % 200 - 100).cast("double") / 100
        ctx = F.concat(F.when(F.col("l_linenumber") % 4 == 1, "Table 1, Row 2: ").otherwise("Samples were collected at "), F.lit("location site "),
                       F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, " reported by the university").otherwise(" in the study area"))
        return (self.raw("lineitem").join(n, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("id"),
            F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("entity_idx"),
            F.concat(F.lit("Site "), F.col("l_partkey").cast("string")).alias("name"),
            near(100 * ((F.col("nk") * 53) % 161 - 80), "l_partkey").alias("latitude"), near(100 * ((F.col("nk") * 97) % 341 - 170), "l_suppkey").alias("longitude"),
            ((50 + 5 * hundred).cast("double") / 100).alias("confidence"), ((40 + 6 * hundred).cast("double") / 100).alias("validation"),
            F.when(F.col("l_returnflag") == "R", "regex").when(F.col("l_returnflag") == "A", "geocoded").otherwise("ner").alias("method"),
            F.element_at(F.array(*map(F.lit, ("abstract", "methods", "results", "study_area", "other"))), F.col("l_linenumber") % 5 + 1).alias("section"),
            F.element_at(F.array(*map(F.lit, ("COORDINATE", "GPE", "LOC", "STUDY_SITE"))), F.col("l_linenumber") % 4 + 1).alias("entity_type"),
            ctx.alias("context"), (F.col("l_linestatus") == "F").alias("is_manual"), F.col("l_shipdate").alias("created_at")))

    @cached_property
    def section(self) -> DataFrame:
        """One row per line of a document, under the heading that its id gives."""
        heading = F.element_at(F.array(*map(F.lit, HEADINGS)), ((F.col("doc_id") + F.col("pos")) % 9 + 1).cast("int"))
        return (self.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
                .select("doc_id", F.col("pos").alias("span_idx"), heading.alias("heading"), "text"))

    @cached_property
    def gazetteer(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").select(F.col("n_name").alias("name"), ((k * 53) % 161 - 80).cast("double").alias("lat"), ((k * 97) % 341 - 170).cast("double").alias("lon"),
                                         ((k % 5).cast("double") / 10 + 0.5).alias("priority"))

    @cached_property
    def task(self) -> DataFrame:
        state = F.element_at(F.array(*map(F.lit, ("PENDING", "STARTED", "SUCCESS", "FAILURE", "RETRY"))), (F.col("event_id") % 5 + 1).cast("int"))
        return self.raw("events").select(F.col("user_id").alias("task_id"), "ts", "event_id", state.alias("state"))

    @cached_property
    def coordinate_text(self) -> DataFrame:
        """Coordinates written in ten styles; parsing them gives lat and lon again."""
        s = self.raw("lineitem").select(
            F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("entity_idx"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).cast("int").alias("style"),
            ((F.col("l_partkey") * 7919) % 8999).alias("a"), ((F.col("l_suppkey") * 104729) % 17999).alias("b"))
        d = lambda c: F.concat((F.floor(F.col(c) / 100)).cast("string"), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))
        whole = lambda c: F.floor(F.col(c) / 100).cast("string")
        minute = lambda c: (F.col(c) % 60).cast("string")
        j = F.concat
        L = F.lit
        forms = [j(d("a"), L(", -"), d("b")), j(L("Lat: "), d("a"), L(", Lon: -"), d("b")), j(L("Lon: -"), d("b"), L(", Lat: "), d("a")),
                 j(L("("), d("a"), L(", -"), d("b"), L(")")), j(L("["), d("a"), L(", -"), d("b"), L("]")), j(d("a"), L("°N, "), d("b"), L("°W")),
                 j(whole("a"), L("°"), minute("a"), L("'S, "), whole("b"), L("°"), minute("b"), L("'E")),
                 j(whole("a"), L("°"), minute("a"), L("'30\"N, "), whole("b"), L("°"), minute("b"), L("'15\"W")),
                 j(d("a"), L(" N, "), d("b"), L(" W")), j(L("-"), d("a"), L("°, "), d("b"), L("°"))]
        out = forms[-1]
        for i in range(8, -1, -1):
            out = F.when(F.col("style") == i, forms[i]).otherwise(out)
        return s.select("item_id", "entity_idx", "style", "a", "b", out.alias("text"))


#: The same tables for DuckDB; a query names the ones it needs.
PRELUDE = """WITH
usr AS (SELECT c_custkey AS id, c_name AS full_name, c_custkey = 0 AS is_superuser FROM customer),
item AS (SELECT o_orderkey AS id, o_custkey AS owner_id, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS key,
  o_orderpriority || ' ' || o_orderkey AS title, 'Status ' || o_orderstatus AS abstract_note,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'Journal of Landscape Studies ' || (o_orderkey % 7) END AS publication_title,
  CASE WHEN o_orderkey % 4 = 0 THEN 'J. Land. ' || (o_orderkey % 5) END AS journal, o_orderpriority AS item_type, o_orderdate AS date_added,
  CASE WHEN o_orderstatus <> 'P' THEN 'att' || o_orderkey END AS attachment FROM orders),
tag AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
link AS (SELECT DISTINCT l_orderkey AS item_id, s_nationkey AS tag_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
creator AS (SELECT DISTINCT l_orderkey AS item_id, l_suppkey AS creator_id, s_name AS last_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
site AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS id,
  l_orderkey AS item_id, l_linenumber AS entity_idx, 'Site ' || l_partkey AS name,
  CAST(100 * ((s_nationkey * 53) % 161 - 80) + l_partkey % 200 - 100 AS DOUBLE) / 100 AS latitude,
  CAST(100 * ((s_nationkey * 97) % 341 - 170) + l_suppkey % 200 - 100 AS DOUBLE) / 100 AS longitude,
  CAST(50 + 5 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 100 AS confidence, CAST(40 + 6 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 100 AS validation,
  CASE l_returnflag WHEN 'R' THEN 'regex' WHEN 'A' THEN 'geocoded' ELSE 'ner' END AS method,
  ['abstract', 'methods', 'results', 'study_area', 'other'][l_linenumber % 5 + 1] AS section,
  ['COORDINATE', 'GPE', 'LOC', 'STUDY_SITE'][l_linenumber % 4 + 1] AS entity_type,
  CASE WHEN l_linenumber % 4 = 1 THEN 'Table 1, Row 2: ' ELSE 'Samples were collected at ' END || 'location site ' || l_partkey ||
  CASE WHEN l_linenumber % 3 = 0 THEN ' reported by the university' ELSE ' in the study area' END AS context,
  l_linestatus = 'F' AS is_manual, l_shipdate AS created_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
section AS (SELECT doc_id, CAST(pos - 1 AS INT) AS span_idx, ['%s'][(doc_id + pos - 1) %% 9 + 1] AS heading, ls[pos] AS text FROM (
  SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
gazetteer AS (SELECT n_name AS name, CAST((n_nationkey * 53) %% 161 - 80 AS DOUBLE) AS lat, CAST((n_nationkey * 97) %% 341 - 170 AS DOUBLE) AS lon,
  CAST(n_nationkey %% 5 AS DOUBLE) / 10 + 0.5 AS priority FROM nation),
task AS (SELECT user_id AS task_id, ts, event_id, ['PENDING', 'STARTED', 'SUCCESS', 'FAILURE', 'RETRY'][event_id %% 5 + 1] AS state FROM events),
ctext AS (SELECT item_id, entity_idx, style, a, b, CASE style WHEN 0 THEN da || ', -' || db WHEN 1 THEN 'Lat: ' || da || ', Lon: -' || db
  WHEN 2 THEN 'Lon: -' || db || ', Lat: ' || da WHEN 3 THEN '(' || da || ', -' || db || ')' WHEN 4 THEN '[' || da || ', -' || db || ']' WHEN 5 THEN da || '°N, ' || db || '°W'
  WHEN 6 THEN (a // 100) || '°' || (a %% 60) || '''S, ' || (b // 100) || '°' || (b %% 60) || '''E'
  WHEN 7 THEN (a // 100) || '°' || (a %% 60) || '''30"N, ' || (b // 100) || '°' || (b %% 60) || '''15"W' WHEN 8 THEN da || ' N, ' || db || ' W' ELSE '-' || da || '°, ' || db || '°' END AS text FROM (
  SELECT *, (a // 100) || '.' || lpad(CAST(a %% 100 AS VARCHAR), 2, '0') AS da, (b // 100) || '.' || lpad(CAST(b %% 100 AS VARCHAR), 2, '0') AS db FROM (
  SELECT l_orderkey AS item_id, l_linenumber AS entity_idx, CAST((l_orderkey + l_linenumber) %% 10 AS INT) AS style, (l_partkey * 7919) %% 8999 AS a, (l_suppkey * 104729) %% 17999 AS b FROM lineitem)))
"""
_head, _tail = PRELUDE.split("section AS (SELECT doc_id", 1)
PRELUDE = _head + ("section AS (SELECT doc_id" + _tail) % "', '".join(HEADINGS)


# --- other sources and sinks -------------------------------------------------------------

ITEM = ("key string, version int, data struct<key:string,parentItem:string,itemType:string,title:string,abstractNote:string,date:string,DOI:string,"
        "url:string,creators:array<struct<creatorType:string,firstName:string,lastName:string>>>")
COLLECTION = "key string, version int, data struct<key:string,name:string,parentCollection:string>, meta struct<numItems:int>"


def library_json(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Bibliographic JSON, one file a page: one row per top-level item with its creators; children are left out.  limit
    keeps the first of the keys."""
    return first_items(imported_items(spark.read.schema(ITEM).option("multiLine", True).json(path)), limit)


def first_items(items: DataFrame, limit: int | None) -> DataFrame:
    return items if limit is None else items.orderBy("key").limit(limit)


def pages_of_json(pages: DataFrame, column: str, schema: str = ITEM) -> DataFrame:
    """Rows of the records of a column of JSON arrays, as a paged interface gives them."""
    return pages.select(F.explode(F.from_json(F.col(column), f"array<struct<{_fields(schema)}>>")).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    return ",".join(part.replace(" ", ":", 1) for part in schema.split(", "))


def collections(raw: DataFrame) -> DataFrame:
    """Collections: key, name, parent and number of items."""
    return raw.select("key", F.col("data.name").alias("name"), F.col("data.parentCollection").alias("parent"), F.coalesce(F.col("meta.numItems"), F.lit(0)).alias("items"))


def imported_items(raw: DataFrame) -> DataFrame:
    made = F.transform("data.creators", lambda c: F.struct(F.coalesce(c["creatorType"], F.lit("author")).alias("creator_type"),
                                                           F.coalesce(c["firstName"], F.lit("")).alias("first_name"), F.coalesce(c["lastName"], F.lit("")).alias("last_name")))
    return raw.filter("data.parentItem is null").select("key", "version", F.col("data.itemType").alias("item_type"), F.col("data.title").alias("title"), made.alias("creators"))


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """Files with whether their first bytes are those of a PDF; the contents are read for that only."""
    return checked(spark.read.format("binaryFile").load(path)).select("path", "length", "is_pdf")


def checked(files: DataFrame) -> DataFrame:
    return files.withColumn("is_pdf", F.coalesce(F.substring("content", 1, 4) == F.lit(b"%PDF"), F.lit(False)))


PARSED = "span_idx int, heading string, text string, error string"
#: Rows go back to Spark once they have so many characters.
SENT = 1 << 22


def _parse(raw: bytes | None, parsers: list) -> tuple[list[tuple[str, str]], str | None]:
    """The blocks of the first parser whose text is that of a document, else why the last has none."""
    error = "no content" if raw is None else "no parser"
    for parse in parsers if raw is not None else ():
        try:
            blocks = list(parse(raw))
            text = "\n\n".join(t for _, t in blocks)
            if len(text.strip()) >= 10 and len(list(itertools.islice(_WORD.finditer(text), 5))) == 5:
                return blocks, None
            error = "too little text"
        except Exception as e:  # whatever a parser raises, the next has its turn
            error = f"{type(e).__name__}: {e}"
    return [], error


_WORD = re.compile(r"\b[a-zA-Z]{2,}\b")


def parsed(files: DataFrame, parsers: list[Callable[[bytes], list[tuple[str, str]]]]) -> DataFrame:
    """files (path, content) -> (path, span_idx, heading, text, error): the blocks of the first parser that reads a file
    and whose text is that of a document (10 characters and 5 words at least).  A file that none reads has one
    row with the last error.  Parsers are functions of the bytes; OCR fits in as one more.

    Files are read one by one, and their rows are sent on when they have SENT characters, so a worker holds one file's
    blocks and one batch besides what Spark hands it."""
    kind = files.schema["path"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        schema = None
        for batch in batches:
            schema = pa.schema([("path", batch.schema.field(0).type), ("span_idx", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("error", pa.string())])
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                blocks, error = _parse(batch.column(1)[k].as_py(), parsers)
                for i, (heading, text) in enumerate(blocks or [(None, None)]):
                    rows.append((path, i, heading, text, error))
                    held += len(text or "") + 100
                    if held >= SENT:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)
    return files.select("path", "content").mapInArrow(read, f"path {kind}, {PARSED}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def parsed_files(spark: SparkSession, path: str, parsers: list) -> DataFrame:
    """parsed() over the files of a folder."""
    return parsed(spark.read.format("binaryFile").load(path), parsers)


def vocabulary(spark: SparkSession, path: str, fallback: list[tuple[str, str, float]]) -> DataFrame:
    """Phrases (text, category, priority) of a JSON-lines file, or the fallback where it has none."""
    schema = "text string, category string, priority double"
    return or_else(spark.read.schema(schema).json(path).filter("text is not null"), spark.createDataFrame(fallback, schema))


def or_else(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """found, or fallback if it has no row, without a job at definition: one row tells which."""
    some = found.agg((F.count("*") > 0).alias("__some"))
    return found.unionAll(fallback.crossJoin(F.broadcast(some)).filter("not __some").drop("__some"))


def write_sites(sites: DataFrame, path: str) -> None:
    """Result rows by bucket of items; writing a bucket again replaces it and leaves the others, so a repeated task
    changes nothing."""
    sites.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
