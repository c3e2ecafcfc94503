"""From raw documents to packed training sequences: five stages, each a table in Parquet.

A stage gets the documents its predecessor kept and decides on all of them; all but the last
return rows of ``documents`` unchanged. For every stage, a null text counts as empty, rows without id are judged by their text,
texts of any length are read whole, an empty table gives an empty result, and columns beside id and text only pass through
(quality and language learn from labels where there are any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, language_id, near_dedup, packing, quality
from graphloom.llm.shared import Shelf, owned, table

#: Below this share of the main language, a document is taken for a jumble of languages.
LEAST_SHARE = 0.3


def kept_rows(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``kept`` (doc_id, text_sha256; ``digest``: the latter of a row of ``docs``).

    Each row is judged by its own text, with an id or without. Of rows that repeat an id and its text, one stays.
    """
    own = "row key"
    while own in docs.columns:
        own += "_"
    key = lambda text: F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text), 256)
    ids = Shelf(docs.sparkSession, "kept").keep(kept.groupBy(key(F.col("text_sha256")).alias(own)).agg(F.count("*").alias("times")), "ids")
    rows = docs.withColumn(own, key(digest))
    out = rows.join(ids.where("times = 1").hint("merge"), own, "left_semi").select(docs.columns)
    if ids.where("times > 1").isEmpty():
        return out
    many = rows.join(ids.where("times > 1").hint("merge"), own, "left_semi").groupBy(own).agg(F.first(F.struct(*docs.columns)).alias("one"))
    return out.unionByName(many.select("one.*"))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; equal texts get equal verdicts, so repeated rows stay or go together."""
    return quality.keep_good(docs, quality.fit(docs))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; texts without a letter (null and empty ones too) go. Repeated rows stay or go together."""
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    return language_id.keep_known(docs, model, LEAST_SHARE)


def by_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return kept_rows(docs, exact_dedup.exact_dedup(docs).where("kept"), F.sha2(exact_dedup.normalised("text"), 256))


def by_likeness(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return kept_rows(docs, near_dedup.near_duplicates(docs).where("kept"), F.sha2(F.coalesce("text", F.lit("")), 256))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs, packing.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", by_quality), ("language ID", by_language), ("exact dedup", by_text), ("MinHash near-dedup", by_likeness), ("packing", packed)]
#: Trained scorers, mixtures, sketches and tokenizers can't be said in SQL; tests/llm holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again, and what it needed is deleted then."""
    shelf, docs = Shelf(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with owned() as shelves:
            docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shelf.keep(docs, f"stage{k}")
            for used in shelves:
                used.delete()
            if k:
                shelf.drop(f"stage{k - 1}")
    return docs
