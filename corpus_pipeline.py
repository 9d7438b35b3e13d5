"""Documents to training sequences, in five stages, each written as Parquet and read again by the next.

Every stage takes documents with COLUMNS and any others, which it leaves out; null and repeated ids, null sources and
languages, null, empty and very long texts, and repeated rows are rows like others, but as stated; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, mixing, packing, secrets, simhash
from ledgerloom.llm.common import clear, made, staged_at

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits in which one of so many fingerprints of near duplicates' distinct words may differ.
WORDS_RADIUS, WORD_HASHES = 4, 4
#: Least exact Jaccard similarity of five-word shingles of documents that link by their distinct words.
SIMILAR = 0.8
#: Includes a tokenizer; no SQL can express it.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others stay as they are. Null, empty and letterless texts have none and
    go."""
    return langid.accepted(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays.

    Texts link by their shingles as in the operator's query, and by their distinct words, as copies with a few words
    changed differ in many shingles; a link by distinct words must also be SIMILAR. Rows without doc_id can't be told
    apart and stay. An id that several rows have goes only if none of them is its group's smallest.
    """
    rows = docs.select(*COLUMNS)
    found = simhash.near_duplicates(rows, words_radius=WORDS_RADIUS, word_hashes=WORD_HASHES, least_similar=SIMILAR).where("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first")
    return rows.join(gone.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind, n_chars follows; every document stays, a null text stays null."""
    return secrets.scan(docs.select(*COLUMNS), rewrite=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and repeated ids are taken row by row. Texts without words go."""
    return mixing.repeated(docs.select(*COLUMNS), doc_weight=mixing.length_weight(F.col("size")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row a piece of a document; a null or empty text is its end token alone."""
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder. What a stage made on its way, and
    the result before it, are deleted once its own is written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        docs, path = staged_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, mark, path)
    return docs
