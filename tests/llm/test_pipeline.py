import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, stage in cp.STAGES:
        out = stage(spark, kept, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out = cp.written(out, name)
            counts.append(out.count())
            assert out.filter("n_chars <> length(text)").isEmpty()
            kept = out
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    tokens = sum(len(r.text.split()) for r in kept.select("text").collect())
    assert out.agg({"length": "sum"}).first()[0] == tokens


WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in old tall trees near our quiet river bank and then fly home again before night falls on all of us here"
HARD = "doc_id long, text string, keep string, quality_score string, lines_removed string, pii_spans string, shard string, `a.b` string, __k1 string, n_chars int"


def _hard(spark, texts):
    return spark.createDataFrame([(i, t, "k", "q", "l", "p", "s", "ab", "k1", 0) for i, t in texts], HARD)


def test_stages_keep_clashing_columns_and_take_hard_rows(spark, tmp_path):
    labels = [(i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, " ".join(WORDS.split()[i % 7:]) + f" number {i} " + " ".join(reversed(WORDS.split()[:i % 11]))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "   "), (None, WORDS), (None, None), (3, rows[3][1]), (73, "word " * 40_000), (74, "mail a.b@mail.example.com now")]
    for name, stage in cp.STAGES:
        for some in (rows, rows[:0], [(1, None), (2, "")]):
            docs = _hard(spark, some)
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert {x.doc_id for x in out.collect()} == {i for i, t in some if t and t.strip()}
                continue
            assert out.dtypes == docs.dtypes
            got = out.collect()
            assert all(tuple(x)[2:9] == ("k", "q", "l", "p", "s", "ab", "k1") and x.n_chars == (None if x.text is None else len(x.text)) for x in got)
            assert len(got) <= len(some)
            if name == "near_dedup" and some is rows:
                assert sum(x.doc_id == 3 for x in got) == 1 and {70, 71, 72} <= {x.doc_id for x in got} and sum(x.doc_id is None for x in got) == 2
            if name == "pii":
                assert len(got) == len(some) and (some is not rows or [x.text for x in got if x.doc_id == 74] == ["mail [EMAIL] now"])


def test_run_sweeps_the_shared_folder(spark):
    from terralit.llm import common
    before = len(common.MADE)
    assert cp.run(spark, SF).count() > 0
    assert len(common.MADE) <= before + 3
