"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, tokens.

Each stage works on all that the stage before kept. The first four return the columns of their input, whatever else it
has beside those of ``documents``; the last one returns doc_id, ids, n_tokens and round_trip, one row for each document
that is left. A stage's result is written as Parquet in the shared folder and read again. An empty table stays empty
through all stages; null texts are like empty ones, which every stage but the classifier keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecask.llm import bpe, decontaminate, neardup, quality, repeats
from tilecask.llm.common import fold, forget, written
from tilecask.llm.queries import table, vocabulary

#: A document is kept where its quality score is at least this.
QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality; learned from the labels of four fifths of the documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 5) != 0)
    score = "__quality"
    while score in map(str.lower, docs.columns):
        score += "_"
    out = quality.scored(docs, quality.train(docs, labels), score=score)
    return out.where(F.col(score) >= QUALITY).select(*docs.columns)


def without_copies(docs: DataFrame) -> DataFrame:
    """One row for each equal text among the rows of one doc_id, and among those of none: the least in its other columns."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("__digest")
    one = docs.groupBy("doc_id", digest).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return written(one.select("__row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows of one id are one document: all its texts stay, or none. Rows with a null id stay. Equal texts of one id, or of
    null ids, stay once.
    """
    docs = without_copies(docs)
    out = neardup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    return docs.join(out.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words that a document with a smaller id has out of the text; other texts stay as they are.

    ``n_chars`` follows the text. Documents of which nothing is left go.
    """
    out = repeats.without_repeats(docs).where("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every whole text (little-endian 32-bit) and whether decoding them gives the text again."""
    decoded = bpe.round_trip(docs.select("doc_id", "text"), vocabulary(spark))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return decoded.select("doc_id", "ids", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
