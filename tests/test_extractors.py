"""Extractors, sentences, sources and clusters on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralit.functions import coords, text as tx, vocabulary as v
from terralit.operators import extraction as ex, library as lib
from terralit.sources import tables as src


def found(kind, text, names=("Paris", "Rome"), custom=()):
    e = next(x for x in ex.built_in(names, custom) if x.kind == kind)
    return [text[a:b] for a, b in e.spans(text)]


@pytest.mark.parametrize("text, place", [
    ("The study was conducted in California during summer.", "California"), ("Our sites within Sierra Nevada were visited.", "Sierra Nevada"), ("The Amazon basin is wide.", "Amazon"),
    ("Plots were located near Lake Tahoe.", "Lake Tahoe"), ("We used sites that were established along Mekong River.", "Mekong River"), ("This work focuses on Patagonia.", "Patagonia"),
    ("Data were collected at Mauna Loa.", "Mauna Loa"), ("The domain covers Montana.", "Montana")])
def test_study_site_patterns(text, place):
    assert place in found("STUDY_SITE", text)


def test_study_site_needs_a_name():
    assert found("STUDY_SITE", "The study was conducted in summer.") == [] and found("STUDY_SITE", "We walked.") == []


@pytest.mark.parametrize("text, phrase", [
    ("10 km north of Paris", "10 km north of Paris"), ("3.5 miles upstream from Rome", "3.5 miles upstream from Rome"), ("adjacent to the Danube", "adjacent to the Danube"), ("within Serengeti", "within Serengeti"),
    ("east of the Nile", "east of the Nile"), ("situated on Crete", "situated on Crete"), ("the Congo region", "Congo region")])
def test_relations(text, phrase):
    assert phrase in found("SPATIAL_RELATION", "It lies " + text + " , they say")


def test_names_are_whole_words_in_any_case_and_the_longest_wins():
    n = ex.Names(["New York", "York", "St. Louis", "NATION_1"])
    t = "new york and YORK, Yorkshire; St. Louis; NATION_12 NATION_1"
    assert [t[a:b] for a, b in n(t)] == ["new york", "YORK", "St. Louis", "NATION_1"]
    assert ex.Names([])(t) == [] and n("") == [] and n("\u0130 York") == [(2, 6)]


def test_multiword_and_custom_names():
    assert len(v.NAMES) == 78 and found("MULTIWORD_LOCATION", "from northern california to Yosemite National Park") == ["northern california", "Yosemite National Park"]
    assert found("MULTIWORD_LOCATION", "at Black Hut Camp", custom=["Black Hut Camp"]) == ["Black Hut Camp"]


def test_contextual_names():
    assert found("CONTEXTUAL_LOCATION", "The station in Reykjavik works.") == ["Reykjavik"] and found("CONTEXTUAL_LOCATION", "The station. Reykjavik works.") == []


def test_sentences():
    cut = lambda t: [t[a:b].strip() for a, b in tx.split_sentences(t)]
    assert len(v.ABBREVIATIONS) == 63
    assert cut("Plants (e.g. Quercus sp. A) grow approx. 5 km away. See Fig. 1A. Done!") == ["Plants (e.g. Quercus sp. A) grow approx. 5 km away.", "See Fig. 1A.", "Done!"]
    assert cut("At 45 deg N, 122 deg W we stopped. It rained.") == ["At 45 deg N, 122 deg W we stopped.", "It rained."]
    assert cut("Dr. Smith met Prof. Lee in Jan. 2020. They left.") == ["Dr. Smith met Prof. Lee in Jan. 2020.", "They left."]
    assert cut("") == [] and cut("   ") == []


def test_longest_spans_are_those_of_the_plain_way():
    r = np.random.default_rng(2)
    for _ in range(50):
        spans = [(int(a), int(a + n)) for a, n in zip(r.integers(0, 60, 30), r.integers(1, 12, 30))]
        kept = []
        for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
            if all(b <= x or a >= y for x, y in kept):
                kept.append((a, b))
        assert coords.longest(spans) == sorted(kept)


def test_clusters_are_those_of_the_whole_matrix(spark):
    r = np.random.default_rng(3)
    rows = [(g, i, float(a), float(b)) for g in range(30) for i, (a, b) in enumerate(zip(r.normal(10, 2, g), r.normal(20, 2, g)))]
    rows += [(99, i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(0, 60, 1300), r.uniform(0, 60, 1300)))]
    got = {(x.g, x.i): (x.eps, x.cluster) for x in ex.cluster(spark.createDataFrame(rows, "g int, i int, lat double, lon double"), "g", "i").collect()}
    assert len(got) == len(rows)
    for g in {x[0] for x in rows}:
        p = np.radians([x[2:] for x in rows if x[0] == g])
        d = ex._distances(p[:, 0], p[:, 1], p[:, 0], p[:, 1])
        eps = 50.0 if len(p) < 3 else float(np.clip(1.5 * np.median(np.sort(d, 1)[:, 2]), 10, 200))
        label, now = np.full(len(p), -1), 0
        for i in range(len(p)):
            if label[i] < 0:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if label[j] < 0:
                        label[j] = now
                        todo += list(np.flatnonzero((d[j] <= eps) & (label < 0)))
                now += 1
        assert [got[g, i][1] for i in range(len(p))] == label.tolist() and got[g, 0][0] == pytest.approx(eps)


def test_files_go_to_the_first_parser_that_reads_them(spark, tmp_path):
    for name, raw in (("a.txt", b"Some words of a plain text file"), ("b.txt", b"\xff\xfe"), ("c.txt", b"few words")):
        (tmp_path / name).write_bytes(raw)

    def strict(raw):
        raise ValueError("not mine")
    got = {x.path.rsplit("/", 1)[1]: (x.text, x.error) for x in src.parsed_files(spark, str(tmp_path), [strict, lambda raw: [("h", raw.decode("utf-8"))]]).collect()}
    assert got["a.txt"] == ("Some words of a plain text file", None) and got["c.txt"] == (None, "too little text") and got["b.txt"][0] is None and "Unicode" in got["b.txt"][1]


def test_json_pages_and_vocabulary(spark, tmp_path):
    (tmp_path / "p1.json").write_text('[{"key": "A", "version": 1, "data": {"itemType": "book", "title": "T", "creators": [{"lastName": "L"}]}}, {"key": "B", "data": {"parentItem": "A"}}]')
    got = src.library_json(spark, str(tmp_path), 5).collect()
    assert [(x.key, x.creators[0].creator_type, x.creators[0].last_name) for x in got] == [("A", "author", "L")]
    (tmp_path / "v.jsonl").write_text('{"text": null}\n')
    assert [x.text for x in src.vocabulary(spark, str(tmp_path / "v.jsonl"), [("f", "c", 1.0)]).collect()] == ["f"]
    (tmp_path / "w.jsonl").write_text('{"text": "x", "category": "c", "priority": 1}\n')
    assert [x.text for x in src.vocabulary(spark, str(tmp_path / "w.jsonl"), [("f", "c", 1.0)]).collect()] == ["x"]


def test_title_bias_tables_and_validation_in_the_flagship(spark):
    sections = spark.createDataFrame([(1, 0, "Methods", "Samples were collected in Springfield. The plot lies at 45.123, -122.456 by a creek."), (1, 1, "References", "Springfield again at 10.123, 20.456."), (2, 0, "Methods", None)],
                                     "doc_id long, span_idx int, heading string, text string")
    gazetteer = spark.createDataFrame([("Springfield", 39.8, -89.6, 0.9), ("Springfield", 44.0, -123.0, 0.5), ("Oregon", 44.1, -120.5, 1.0)], "name string, lat double, lon double, priority double")
    tables = spark.createDataFrame([(1, 0, "Site\tLat\tLon\nA\t45.2\t-122.4")], "doc_id long, table_idx int, tbl string")
    titles = spark.createDataFrame([(1, "Creeks of Oregon")], "doc_id long, title string")
    got = ex.extract_pipeline(sections, gazetteer, ["Springfield", "Oregon"], tables, titles).collect()
    at = {(round(x.lat, 3), round(x.lon, 3)): x for x in got}
    assert (45.123, -122.456) in at and (45.2, -122.4) in at and (44.0, -123.0) in at and (10.123, 20.456) not in at
    assert at[45.2, -122.4].method == "table_parsing" and at[45.2, -122.4].source == "table" and all(0 <= x.validation <= 1 for x in got)
    without = ex.extract_pipeline(sections, gazetteer, ["Springfield", "Oregon"]).collect()
    assert (39.8, -89.6) in {(x.lat, x.lon) for x in without}


def test_cancelled_and_exact_means(spark):
    tasks = spark.createDataFrame([(1, "PENDING"), (2, "SUCCESS"), (3, "STARTED")], "task_id int, state string")
    got = {x.task_id: x.state for x in lib.cancelled(tasks, spark.createDataFrame([(1,), (2,), (1,)], "task_id int")).collect()}
    assert got == {1: "REVOKED", 2: "SUCCESS", 3: "STARTED"}
    means = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.05,)], "x double").agg(lib.exact_mean("x", 3).alias("m"), lib.exact_mean("x", 6).alias("n")).first()
    assert tuple(means) == (0.163, 0.1625)
    assert spark.createDataFrame([], "x double").agg(lib.exact_mean("x", 3)).first()[0] is None


def test_quality_of_texts(spark):
    s = spark.createDataFrame([(1, 0, "methods", "Sampling sites were located in the forests of the north."), (1, 1, "results", None)], "doc_id int, span_idx int, section string, text string")
    row = ex.text_quality(s).first()
    assert row.sections == 2 and 0 < row.quality < 1


def test_jvm_regular_expressions_of_references(spark):
    df = spark.createDataFrame([("see Table S1 and Supplementary Fig. 3",), ("Appendix B2",), ("nothing",), (None,)], "t string")
    assert [x[0] for x in df.select(tx.figure_ref(F.col("t"))).collect()] == ["Fig. 3", "Appendix B2", None, None]
