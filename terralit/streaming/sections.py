"""Sections as a file stream: each is classified, scored and searched for coordinates as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import coords, text as tx

SCHEMA = "doc_id bigint, span_idx int, heading string, text string"


def section_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def coordinates_of(sections: DataFrame) -> DataFrame:
    """The relevant sections' coordinates; the same for a stream and for a table."""
    s = sections.withColumn("section", tx.section_class(F.col("heading"), F.col("text"))).filter(F.col("section").isin(*tx.RELEVANT))
    found = s.select("doc_id", "span_idx", "section", F.explode(coords.find(F.col("text"))).alias("f")).withColumn("p", coords.parse(F.col("f.text")))
    return found.filter(coords.valid(F.col("p.lat"), F.col("p.lon"))).select("doc_id", "span_idx", "section", F.col("f.text").alias("text"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """All files that are there now, exactly once over restarts."""
    (coordinates_of(section_stream(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
