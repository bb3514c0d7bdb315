"""The operators without state, on streams of files. What needs the order of a session stays in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redaction import redact
from ..operators.policy import reason_of


def text_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def cleaned(rows: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """rows(..., text) without disqualified texts, the others redacted."""
    kept = rows.where(F.coalesce(reason_of(F.col("text"), True), F.lit("")) == "")
    return kept.withColumn("text", redact(F.col("text"), key, names))


def run(rows: DataFrame, out: str, checkpoint: str):
    """Writes what is there as Parquet and returns the finished query."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
