from faultline.llm import setjoin

TEXTS = "doc_id long, text string"


def test_one_row_of_each_stays_whatever_the_ids(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, "d e f g h i j"), (None, "d e f g h i j"), (9, None), (None, "")]
    got = [tuple(r) for r in setjoin.one_of_each(spark.createDataFrame(rows, TEXTS)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, a), (5, b), (7, c), (None, "d e f g h i j"), (9, None), (None, "")]))
