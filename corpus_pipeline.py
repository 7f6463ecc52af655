"""A corpus pipeline of five stages: quality, repeated lines, near duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Between stages the
rows are written as Parquet in the shared folder and read again, so a lost executor costs one stage's tasks and no more.

Every stage takes null ids, texts and sources, empty and very long texts, ties, repeated rows, an empty table and columns of any name:
none of them stops a stage, and columns that documents doesn't have are handed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.llm import line_dedup, mixing, near_copies, quality, sentencepiece
from pixkin.llm.catalog import piece_model
from pixkin.llm.common import set_aside, table
from pixkin.operators.skew import delete, new_path, scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects, row by row: each by its own text and id. Texts without words weigh 0."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a smaller doc_id has; n_chars follows the text where it changed. No row goes; null ids are one document after all others."""
    rows, back = set_aside(docs, "n_lines", "n_dropped")
    clean = line_dedup.dedup_lines(rows)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", chars).drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id (null ids last) of each group of near copies, by five-word shingles and a similarity of 0.8 or more. Texts without words are one group."""
    return near_copies.keep_one(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Texts without words are taken once or twice, or not, as their keys fall; they weigh nothing."""
    rows, back = set_aside(docs, "copies", "source_size", "target")
    return mixing.repeat_rows(mixing.mix_sources(rows)).withColumnsRenamed(back).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a null text has the begin and end ids alone."""
    encoded = sentencepiece.encode_documents(docs, piece_model(), spans=False, decode=False, arrays=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", new_lines),
    ("SimHash near-dedup", one_of_a_kind),
    ("mixing sources", mixture),
    ("SentencePiece encoding", token_ids),
]

#: The quality model and the fingerprints can't be had in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Rows between stages stand in the shared folder; a stage's input and its checkpoints go once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        path = new_path(spark, "pipeline")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs

