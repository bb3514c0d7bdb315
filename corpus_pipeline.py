"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. Rows pass through as wholes, so further columns of any name stay as they are. Stages that compare documents
know rows by their places in the table, not by doc_id.

Defined results: rows with null texts fail the quality rules; rows with a null doc_id, or with one that others have as well,
are rows like others; of rows that are equal in every column near-dedup keeps one; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import copies, leaks, lines, pieces, quality
from logloom.llm.common import few, numbered, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of operator 7."""
    return quality.judged(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of their source or of all have; n_chars follows."""
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.source").cast("string").alias("host"), F.coalesce("row.text", F.lit("")).alias("text"))
    out = lines.framed(rows.withColumn("lines", F.split("text", "\n")))
    text = F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col("row.n_chars"))}
    return out.select(*((changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (by the method of operator 3, five-word shingles, similarity 0.8): that with the smallest doc_id, a null
    one last; of several with it, the one with the least hash of all its columns."""
    rows = numbered(docs)
    groups = stored(copies.near_copies(rows.select("id", "row.text")), "groups")
    shared = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("component_id")
    shared = groups.join(shared, "component_id", "left_semi")
    order = F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("doc_id"), F.xxhash64("row").alias("hash"), "id")
    placed = stored(rows.select("id", order.alias("place")).join(shared, "id"), "placed")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    others = few(placed.join(first, "component_id").where("place <> first").select("id"), "others")
    return rows.join(others, "id", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = numbered(docs)
    found = leaks.leaks(rows.select(F.col("id").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark"))
    bad = few(found.select(F.col("doc_id").alias("id")).distinct(), "leaking")
    return rows.join(bad, "id", "left_anti").select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their counts, and whether they decode to the text."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the covariance estimates, sketches and ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
