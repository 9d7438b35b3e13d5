"""The language stage without a model: only texts without letters go."""

from ledgerloom.llm import langid


def test_nothing_learned(spark):
    rows = [(1, "A clean text with words.", None), (2, "123 !", None), (3, None, None), (4, "Noch ein Text.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.accepted(docs).collect()) == [1, 4]
