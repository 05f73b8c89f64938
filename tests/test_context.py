from pyspark.sql import functions as F

from terralit.operators import extraction as ex

LEAD = "Station Alpha was closed. See Table 1 for it. " + "We have walked on and on. " * 40


def test_context_is_the_sentence_of_the_entity(spark):
    text = LEAD + "The plot at Site Beta lies at 45.123, -122.456 near NATION_3. The end."
    df = spark.createDataFrame([(1, 0, "methods", "é𝄞 " + text)], "doc_id long, span_idx int, section string, text string")
    got = ex.extract_entities(df, ["NATION_3"])
    assert {r.entity_type for r in got.collect()} >= {"COORDINATE", "GPE", "SPATIAL_RELATION"}
    for r in got.collect():  # the indicator "Station" now leads to a name in the first sentence, which has its own
        assert r.context == ("é𝄞 Station Alpha was closed." if r.name == "Alpha" else "The plot at Site Beta lies at 45.123, -122.456 near NATION_3."), r
    c = got.filter("entity_type = 'COORDINATE'").select(ex.site_name().alias("site"), ex.method_of().alias("method"), ex.source_of().alias("source")).first()
    assert tuple(c) == ("Beta lies at", "regex", "text")


def test_context_without_a_sentence():
    assert ex.context_at("a" * 600 + "X" + "b" * 600, 600, []) == "a" * 250 + "X" + "b" * 249
    assert ex.context_at("One. Two. Three.", 6, [(0, 5), (5, 10), (10, 16)]) == "Two."
