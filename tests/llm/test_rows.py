import random

from terralit.llm import ngram_join


def _text(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30))


def test_near_dedup_judges_rows_of_one_doc_id_by_their_texts(spark):
    a, b, c, d = map(_text, range(4))
    rows = [(1, a), (3, a), (3, c), (5, c), (7, b), (7, b), (8, d), (8, d + " end"), (None, a), (None, a), (9, None), (9, None)]
    got = [tuple(x) for x in ngram_join.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # Of (8, d) and its near copy the least hash comes first.
    eight = [x for x in got if x[0] == 8]
    assert len(eight) == 1
    rest = [x for x in got if x[0] != 8]
    assert sorted(rest, key=repr) == sorted([(1, a), (3, c), (7, b), (None, a), (None, a), (9, None), (9, None)], key=repr)
