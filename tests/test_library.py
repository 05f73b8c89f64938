import math

import pytest
from pyspark.sql import functions as F

from terralit.functions import coords, text as tx
from terralit.operators import extraction as ex, library as lib
from terralit.streaming import sections as st

CASES = [("45.123, -122.456", 45.123, -122.456), ("45°12'30\"N, 122°30'15\"W", 45.208333, -122.504167), ("45°12'N, 122°30'W", 45.2, -122.5), ("45.123°N, 122.456°W", 45.123, -122.456),
         ("Lat: 45.5, Lon: -122.3", 45.5, -122.3), ("Lon: -122.3, Lat: 45.5", 45.5, -122.3), ("(45.123, -122.456)", 45.123, -122.456), ("[45.123, -122.456]", 45.123, -122.456),
         ("45.5 N, 122.3 W", 45.5, -122.3), ("45 7 12'N, 122 7 30'W", 45.2, -122.5), ("45 7 12 b N, 122 7 30 b W", 45.2, -122.5), ("45o12'N, 122o30'W", 45.2, -122.5),
         ("45°12`N, 122°30`W", 45.2, -122.5), ("00°01'.72N, 77°59'.13E", 0.028667, 77.9855), ("45°12'S, 122°30'E", -45.2, 122.5), ("-45.123, -122.456", -45.123, -122.456),
         ("13 u 13 9 09 S, 74 u 57 9 45 W", -13.219167, -74.9625), ("45.1-45.2°N, 122.3-122.5°W", 45.15, -122.4), ("-45.123°, 122.456°", -45.123, 122.456), ("Coordinates: 45.12, 7.25", 45.12, 7.25),
         ("not a coordinate", None, None), ("45.123", None, None), ("45°N", None, None), (None, None, None)]


def test_coordinates(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string").withColumn("p", coords.parse(F.col("t"))).orderBy("i").collect()
    for r, (t, lat, lon) in zip(rows, CASES):
        if lat is None:
            assert r.p is None, t
        else:
            assert r.p.lat == pytest.approx(lat, abs=1e-5) and r.p.lon == pytest.approx(lon, abs=1e-5), t


def test_find_and_sentences(spark):
    df = spark.createDataFrame([("Sites at 45.123, -122.456 and (46.10, 7.20) as in Fig. 2. Smith et al. The end.",), ("",), (None,)], "t string")
    got = df.select(coords.find("t").alias("f"), tx.sentences("t").alias("s")).collect()
    assert [x.text for x in got[0].f] == ["45.123, -122.456", "(46.10, 7.20)"]
    assert [x.text for x in got[0].s] == ["Sites at 45.123, -122.456 and (46.10, 7.20) as in Fig. 2.", "Smith et al.", "The end."]
    assert got[1].f == [] and got[2].f is None


def test_clusters_keep_the_largest(spark):
    rows = [(1, 0, "COORDINATE", 40.7, -74.0), (1, 1, "GPE", 37.7749, -122.4194), (1, 2, "GPE", 37.8044, -122.2712), (1, 3, "GPE", 37.8715, -122.2730), (1, 4, "GPE", 40.7128, -74.0060),
            (1, 5, "GPE", 40.6782, -73.9442), (1, 6, "LOC", None, None), (2, 0, "GPE", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc int, idx int, entity_type string, lat double, lon double")
    kept = {(r.doc, r.idx) for r in ex.keep_largest(df, "doc", "idx").collect()}
    assert kept == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 6), (2, 0)}
    info = ex.cluster_info(df, "doc", "idx").collect()
    assert [r["info"]["largest_cluster_size"] for r in info] == [3] and info[0]["info"]["coordinates_always_included"] == 1


def test_table_coordinates(spark):
    t = [(1, "Site\tLatitude\tLongitude\nA\t1.5\t2.5\nB\t999\t2\nC\tx\t3\n\nD  -4.25  5"), (2, "Y  X\n1.0  2.0"), (3, "Name  Size\na  1"), (4, "one line"), (5, None)]
    got = ex.table_coordinates(ex.table_rows(spark.createDataFrame(t, "id int, t string"), "t")).orderBy("id", "row_idx").collect()
    assert [(r.id, r.name, r.lat, r.lon) for r in got] == [(1, "A", 1.5, 2.5), (1, "D", -4.25, 5.0), (2, None, 1.0, 2.0)]


def test_quality(spark):
    texts = ["The sampling sites were located in temperate forests\nand the measurements were repeated every summer season.", "", None, "S t u d y   s i t e s   w e r e   l o c a t e d"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.quality(F.col("t")).alias("q")).orderBy("i").collect()
    assert rows[0].q.overall_score > 0.7 and rows[0].q.char_ratio > 0.8 and rows[1].q.overall_score == 0 and rows[2].q.overall_score == 0
    assert rows[3].q.overall_score == pytest.approx(0.625)


def test_cleaning(spark):
    df = spark.createDataFrame([("geograph-\nical  work at 45 &deg; N .Next",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.clean_all(F.col("t"))).collect()]
    assert got == ["geographical work at 45°N. Next", None]


def test_overlay_search_components(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, x double")
    ch = spark.createDataFrame([(2, None, 5.0)], "id int, n string, x double")
    assert sorted(map(tuple, lib.overlay(base, ch, "id").collect())) == [(1, "a", 1.0), (2, "b", 5.0)]
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("e", "f")], "source string, target string")
    roots = {r.node: r.root for r in lib.graph_components(nodes, links).collect()}
    assert roots == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}
    stats = lib.graph_stats(nodes, links).first()
    assert (stats.node_count, stats.edge_count, stats.components) == (6, 4, 3) and math.isclose(stats.avg_degree, 1.3)


def test_stream_is_the_table(spark, tmp_path):
    rows = [(i, 0, "Study area", f"Plot at 45.12, {i}.25 here") for i in range(1, 6)] + [(9, 0, "Results", "at 45.12, 7.25")]
    df = spark.createDataFrame(rows, st.SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    st.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    st.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, st.coordinates_of(df).collect()))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_entry_points():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 120
