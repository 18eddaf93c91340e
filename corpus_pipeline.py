"""Corpus cleaning: from the documents table to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm import decontamination, language, line_dedup, near_dedup, packing
from provspark.llm.queries import tokenizer_path
from provspark.llm.shared import mark, materialize, read_table, release

#: Language scores and whole packings aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the language model rejects; a missing lang is filled in.

    Null texts and texts without letters go; repeated rows are judged alike.
    Other columns are returned as they are.
    """
    model = language.fit(docs)
    found = language.predict(docs, model, docs.columns).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep repeated lines in one document only; a document left empty goes.

    Null and empty texts stay; n_chars, where there is such a column, follows the
    text.  Repeated rows of a doc_id are one document.
    """
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    done = done.where((F.col("n_dropped") == 0) | (F.length("kept_text") > 0))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return done.withColumns({c: new[c] for c in new if c in docs.columns}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every class: the one of least doc_id (null last), once.

    Documents are told apart by doc_id and text, so two texts under one doc_id
    are two documents; rows equal in both are one, whatever their other columns.
    """
    classes = near_dedup.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    keep = classes.groupBy("class_key").agg(first.alias("k")).select(F.col("k.doc_id").alias("__kept_id"), F.col("k.row_key").alias("__kept_key"))
    rows = docs.withColumn("__row_key", near_dedup.row_key())
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["__kept_id"]) & (rows["__row_key"] == keep["__kept_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row_key"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null texts hold none."""
    found = decontamination.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where(F.col("n_hit") == 0).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document; a null text is the end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's own tables are deleted when it is written."""
    docs = read_table(spark, sf_dir, "documents")
    begin = mark(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, begin, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
