"""The queries of this package's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, jpeg, licenses, linededup, ngram_join, packing, pieces, pii, quality, urls
from .common import table


def op1_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "quality_score", "keep")


def op2_url_filter(spark, sf_dir):
    index = urls.build(urls.blocklist(spark))
    return urls.url_filter(table(spark, sf_dir, "pages"), index).select("page_id", "url", "blocked", "matched")


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_sum_of_squares_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_progressive_jpeg(spark, sf_dir):
    media = jpeg.pictures(table(spark, sf_dir, "embeddings"))
    return jpeg.decode_media(media).select("vec_id", "width", "height", "rgb", "error")


def op6_nearest_neighbours(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark, sf_dir):
    tokens = pieces.verified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.select("doc_id", "tokens", F.size("tokens").alias("n_tokens"), "round_trip")


def op8_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return linededup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op10_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents")).select("doc_id", "text", "pii_spans")


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_url_filter, op3_ngram_jaccard_join, op4_sum_of_squares_packing, op5_progressive_jpeg,
    op6_nearest_neighbours, op7_sentencepiece, op8_license_scan, op9_line_dedup, op10_personal_data)}
SQL = {"op2_url_filter": urls.SQL, "op3_ngram_jaccard_join": ngram_join.SQL, "op9_line_dedup": linededup.SQL}
