"""Mixing: a very long document that overshoots the need doesn't leave the gap open."""

from ledgerloom.llm import mixing

DOCS = "doc_id long, text string, source string"


def test_long_document_is_passed_over(spark):
    rows = [(i, "w " * (20 + i * 7 % 31), "s") for i in range(300)] + [(1000, "w " * 9000, "s")]
    docs = spark.createDataFrame(rows, DOCS)
    for seed in ("a:", "b:", "c:", "d:"):
        got = mixing.mix(docs, share=1.68, seed=seed).collect()
        short = got[0]["target"] - sum(r["taken"] for r in got)
        rest = [r["size"] for r in got if r["copies"] == 1]
        assert short < min(rest), (seed, short)
