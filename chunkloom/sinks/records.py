"""Chunk records: nested JSON and flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.stages import FIELDS

META = (
    "document_id", "title", "source", "section", "parent_section", "heading_path", "content_type", "semantic_role", "language", "chunk_index", "total_chunks", "strategy", "unit", "size", "char_count",
    "word_count", "token_count", "sentence_count", "start_offset", "end_offset", "overlap_prefix_chars", "parent_id", "previous_chunk", "next_chunk", "duplicate_of", "similarity", "extra",
)


def to_record(fields: dict[str, Column]) -> Column:
    """JSON of the fields; null ones are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def nested(chunks: DataFrame, quality: bool = True) -> DataFrame:
    """The record's structure: id, content, metadata, and what there is of retrieval, quality, prefix and embedding."""
    have = set(chunks.columns)
    meta = F.struct(*[F.col(c) for c in META if c in have])
    out = [F.col("id"), F.col("content"), meta.alias("metadata")]
    if "retrieval" in have:
        some = F.size(F.concat(*[f"retrieval.{f}" for f in FIELDS])) > 0
        out.append(F.when(some, F.col("retrieval")).alias("retrieval"))
    if quality and "quality" in have:
        out.append(F.col("quality"))
    if "context_prefix" in have:
        out.append(F.nullif("context_prefix", F.lit("")).alias("context_prefix"))
    if "embedding" in have:
        out.append(F.col("embedding"))
    return chunks.select(*out)


def flat_keywords(terms: Column, most: int = 40) -> Column:
    return F.array_join(F.slice(terms, 1, most), "; ")


def flat(chunks: DataFrame) -> DataFrame:
    """Ten columns for spreadsheets."""
    terms = F.concat(*[F.coalesce(F.col(f"retrieval.{f}"), F.array().cast("array<string>")) for f in FIELDS if f != "questions"]) if "retrieval" in chunks.columns else F.array().cast("array<string>")
    score = F.col("quality.quality_score") if "quality" in chunks.columns else F.lit(None).cast("double")
    return chunks.select("id", "document_id", "title", "section", F.array_join("heading_path", " > ").alias("heading_path"), "content_type", "token_count", score.alias("quality_score"), flat_keywords(terms).alias("keywords"), "content")


def report(chunks: DataFrame) -> DataFrame:
    """A readable Markdown passage for each chunk."""
    lines = F.concat_ws("\n", F.concat(F.lit("## "), "id"), F.lit(""), F.concat(F.lit("- section: "), F.array_join("heading_path", " > ")), F.concat(F.lit("- type: "), "content_type", F.lit(", role: "), "semantic_role"), F.concat(F.lit("- tokens: "), F.col("token_count").cast("string")), F.lit(""), "content", F.lit(""))
    return chunks.select("document_id", "chunk_index", lines.alias("value"))
