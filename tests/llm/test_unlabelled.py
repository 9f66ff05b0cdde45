"""The language stage on input without labels."""

from pairlens.llm import rank_langid


def test_known_language_without_profiles(spark):
    schema = "doc_id long, text string, lang string"
    texts = ["some words here", None, "", "!!! 123", "ka lo"]
    none = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], schema)
    kept = rank_langid.known_language(spark, none, "")
    assert kept.columns == none.columns and {r.doc_id for r in kept.collect()} == {0, 4}
    blank = spark.createDataFrame([*[(i, t, None) for i, t in enumerate(texts)], *[(i, "123", "xx") for i in range(10, 20)]], schema)
    assert {r.doc_id for r in rank_langid.known_language(spark, blank, "").collect()} == {0, 4}
    assert rank_langid.known_language(spark, none.limit(0), "").count() == 0
