"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before kept, and is written and read
again before the next; run() writes to the folder that the cluster names in
spark.checkpoint.dir, and removes what is no longer read. All stages but the
last return the columns of docs, whichever those are besides doc_id and text;
n_chars follows the text where it is there. Null and empty texts, null ids,
repeated rows and empty tables have the results that the stages state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bestfit_packing, minhash_neardup, pii_spans, quality_classifier, substring_dedup
from tessera.llm.common import Written, read, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the cut go; labels are read from sf_dir.

    Null and empty texts have the score of no features; repeated rows go or stay
    together. Without labels all stay.
    """
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels"), sample=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Null, empty and blank texts are in no class but their own and stay. Rows that
    repeat an id stay together; null ids come last.
    """
    return minhash_neardup.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier, by id and place, are taken out of texts; n_chars follows the text.

    Null and empty texts stay as they are, and so do rows whose text goes whole.
    """
    return substring_dedup.dedup(docs, size_col="n_chars")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows the text. Null texts stay null."""
    return pii_spans.mask(docs, size_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with sequence and offset. A null text, or one that has become empty, has its end id only."""
    return bestfit_packing.pack_documents(docs.select("doc_id", "text"), bestfit_packing.tokenizer_bytes())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express the stages; tests/llm/test_pipeline.py compares them with plain Python on a small input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Written(spark), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scope():
            kept = store.write(stage(spark, docs, sf_dir))
        if k:
            store.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
