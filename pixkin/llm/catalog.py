"""Queries of this subpackage, each over its whole table with production parameters, and their DuckDB twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixkin.llm import ann, decontaminate, html_text, line_dedup, media, merkle, mixing, quality, sentencepiece, sharding, simhash, toxicity, whitening
from pixkin.llm.common import table


def piece_model() -> str:
    """Where the tokenizer's model is: PIECE_MODEL, else the installed public file."""
    import public_tokenizers

    return os.environ.get("PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, keep of every document. Null or empty texts weigh 0, long ones count whole; equal keys are kept or dropped together; only rows equal in id and text share their noise; clashing columns play no part; no rows for an empty table."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text (null: empty, begin and end only) and the text they decode to. Repeated rows and null ids keep their rows; no rows for an empty table."""
    return sentencepiece.piece_report(table(spark, sf_dir, "documents"), piece_model())


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; equal texts (null: empty) share one. Repeated rows and null ids have slots of their own, ties go by size and checksum; no rows for an empty table."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text (null: empty) as the coefficients of a progressive file, read back. Equal texts give equal values; repeated rows and null ids keep their rows; no rows for an empty table."""
    return media.media_report(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after dropping those that a smaller doc_id has. Null or empty texts have one empty line; rows of one id are one document, null ids one that follows all others; no rows for an empty table."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components. Texts without words have fingerprint zero and link like any other; every row is returned; null ids name no component unless it has no other; no rows for an empty table."""
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document. Null texts have size 0, a null source comes last, of rows that agree in id and text as many are taken as the cut says; no rows for an empty table."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text (null or empty: what no word says). The fit takes bounded labelled rows outside the held-out fold; null ids are scored, not held out; no rows for an empty table."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector. Null, zero and non-finite vectors and null ids take no part, repeated ids count once, ties go to the smaller id; no rows for an empty table."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. A null html is an empty page; odd or null urls are one host; copies of an article count once; every row is kept; no rows for an empty table."""
    return html_text.page_report(table(spark, sf_dir, "pages"))


def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items' windows every document holds. Null and empty texts have no words, long ones count whole; copies and repeated rows are all marked, repeated items count once; clashing columns play no part; no rows for an empty table, no marks for an empty benchmark."""
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf, a proof and what it verifies of every document. Nulls in any field are '-', null ids come first and aren't tampered with, rows of one id go by their digests, repeated rows have leaves of their own; long texts count whole; no rows for an empty table."""
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector. Null, non-finite and odd-length vectors have no rows; null and repeated ids keep theirs; components without variance are left out (equal vectors have none); no rows for an empty table."""
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_importance_resampling, op2_sentencepiece, op3_shard_documents, op4_progressive_jpeg, op5_line_dedup, op6_simhash_vp_tree, op7_mix_sources, op8_toxicity_cnn, op9_anisotropic_search, op10_site_templates, op11_positional_index, op12_merkle_manifest, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.LINE_REPORT_SQL, "op7_mix_sources": mixing.MIX_REPORT_SQL, "op11_positional_index": decontaminate.CONTAMINATION_SQL, "op12_merkle_manifest": merkle.MANIFEST_SQL}
