"""A training corpus from the documents table, in stages; each stage is one operator's decision applied.

A stage takes (spark, docs, sf_dir) and returns what the next one works on: rows of documents
that stay, with their columns unchanged; the last one returns every piece of them with its place
in a training sequence. ``run`` writes every stage's result to the shared
staging folder and reads it again, so a later stage never repeats an earlier one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from notespark.llm import exact, packing, quality, similar
from notespark.session import staged


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but for the rows that ``dropped(id, key)`` names by id, null or not, and hash of the text.

    So a decision meets the rows that it was made for, also where an id is null or has several texts.
    """
    out = dropped.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_key(F.col("text")) == F.col("__key")), "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learned from the labels table.

    A text is judged for itself: null and empty ones like any other, repeated rows alike, rows
    without an id as well, though nothing is learned from them. Without labels all score 0.5 and go. No rows, no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality.quality_scores(docs, labels, carry={"key": _text_key(F.col("text"))})
    return _without(docs, scores.filter("predicted = 0"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest writing stays, then the smallest id; of a row that is repeated, one.

    Null counts as empty; a row without an id stays only where no equal text has one. No rows, no rows.
    """
    kept = _without(docs, exact.exact_duplicates(docs, carry={"key": F.xxhash64("text")}).filter("not kept"))
    twins = Window.partitionBy("doc_id", F.xxhash64(exact.without_blanks(F.col("text")))).orderBy(F.desc(F.length("text")), "text")
    return kept.withColumn("__twin", F.row_number().over(twins)).filter("__twin = 1").drop("__twin")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts tied by five-word shingles (Jaccard 0.8 or more, found by SimHash, verified) the smallest id stays.

    Texts without words are alike. Repeated rows share their fate; a row without an id goes where its group has one, else
    it stays. No rows, no rows.
    """
    return _without(docs, similar.near_texts(docs).filter("not id <=> component"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row has pieces of its own, also a repeated one or one without an id; a null or empty text is one token. No rows, no places.
    """
    found = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact_dedup),
          ("near-dedup", near_dedup), ("best-fit packing", packed)]

#: Trees, links and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
