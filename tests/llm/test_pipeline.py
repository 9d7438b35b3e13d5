"""The pipeline: each stage against plain rules on its own input."""

import corpus_pipeline
from ledgerloom.llm import common, mixing
from tests.llm import test_packing, test_similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "secrets", "mixing", "packing"]

    spoken = common.staged(stages["language"](spark, docs, sf_dir), "t")
    assert spoken.columns == docs.columns and spoken.exceptAll(docs).isEmpty() and spoken.count() >= 0.99 * docs.count()

    single = common.staged(stages["near_duplicates"](spark, spoken, sf_dir), "t")
    rows = [tuple(r) for r in spoken.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == test_similar.survivors(rows)

    clean = common.staged(stages["secrets"](spark, single, sf_dir), "t")
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert clean.where("text rlike 'AKIA[A-Z0-9]{16}|[0-9a-f]{24}' or n_chars <> length(text)").isEmpty()
    assert clean.where("not text rlike '[\\\\[](assign|access|hex)]'").exceptAll(single).isEmpty()

    mixed = common.staged(stages["mixing"](spark, clean, sf_dir), "t")
    assert mixed.columns == docs.columns
    weight = mixing.length_weight(mixing.F.col("size"))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(clean, doc_weight=weight).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken

    packed = stages["packing"](spark, mixed, sf_dir)
    tokenizer = test_packing.Tokenizer.from_file(test_packing.PATH)
    test_packing.examine(tokenizer, [tuple(r) for r in mixed.select("doc_id", "text").collect()], packed.collect(), 2048, 0.0)


def test_run(spark, sf_dir):
    mark = common.made()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(common._made) == mark + 1  # the result


def test_odd_rows(spark, tmp_path):
    text = "The dog lies in the garden and sleeps all day long, as dogs do when the sun is out. "
    rows = [(i, text + f"Number {i} is here with {i * 7} words more, and {i * i} after those words. " * 3, "en", "s" if i % 3 else None, 10) for i in range(40)]
    rows += [(None, text * 3, "en", "s", 1), (None, text * 3, "en", "s", 1), (50, None, "en", "s", None), (51, "", None, None, 0), (3, "A repeated id with another text entirely, about nothing at all.", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_mixing_stage_on_null_and_repeated_ids(spark):
    """Sources that share ids, or have none, each get their own copies, row by row."""
    rows = [(i % 10 if k else None, "w " * 10, "en", s, 20) for k in (0, 1) for s in ("a", "b", "c") for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.mixture(spark, docs, "").groupBy("source").count().collect()
    goal = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert {r["source"]: abs(r["count"] * 10 - goal[r["source"]]) <= 10 for r in got} == {"a": True, "b": True, "c": True}
