"""Session logs: trees of JSONL files, one a session; and pair files and name lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import GENERIC_NAMES
from ..functions.text import LINE_END, SPACE, blank, split_lines

LEAST_BYTES = 50_000


def session_files(spark: SparkSession, root: str, least_bytes: int = LEAST_BYTES, without: str | None = None) -> DataFrame:
    """session_id (the file's stem), path, file_bytes and content (bytes that are no UTF-8 become U+FFFD) of every *.jsonl
    below the root with that size; files whose path has `without` are left out. The size is tested before a file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    files = files.where(F.col("length") >= least_bytes)
    if without:
        files = files.where(~F.contains("path", F.lit(without)))
    return files.select(F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("session_id"), "path", F.col("length").alias("file_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def session_lines(files: DataFrame) -> DataFrame:
    """session_id, line_no, record (a variant) of every line that is JSON."""
    lines = files.select("session_id", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))
    return lines.select("session_id", "line_no", F.try_parse_json("line").alias("record")).where("record is not null")


def session_records(spark: SparkSession, root: str, least_bytes: int = LEAST_BYTES, without: str | None = None) -> DataFrame:
    """session_id, line_no, record (a variant) of every line that is JSON, of the files that `session_files` gives. Files are read
    in parts, so none has to fit a row; line_no is a struct that orders the lines of a file."""
    lines = _numbered_lines(spark, root, least_bytes, without)
    # the explode keeps the parser from being put into the filter as well
    return lines.select("session_id", "line_no", F.explode(F.array(F.try_parse_json("line"))).alias("record")).where("record is not null")


def last_records(spark: SparkSession, root: str, least_bytes: int = LEAST_BYTES, without: str | None = None) -> DataFrame:
    """session_id, n_records, last_line: how many lines are JSON, and the number (from 0) of the last one in its file."""
    lines = _numbered_lines(spark, root, least_bytes, without).select("session_id", "path", "line_no", F.try_parse_json("line").isNotNull().alias("good"))
    rows = lines.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).where("good")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_records"), F.max("n").alias("last_line"))


def _numbered_lines(spark: SparkSession, root: str, least_bytes: int, without: str | None) -> DataFrame:
    """session_id, path, line_no (a struct: the part's start in the file, the place in its task, the place between two \\n), line."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"), F.make_valid_utf8("value").alias("value"))
    rows = rows.where(F.col("size") >= least_bytes)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    if without:
        rows = rows.where(~F.contains(path, F.lit(without)))
    # \r before \n is part of that line end
    inner = F.split(F.regexp_replace("value", r"\r\z", ""), LINE_END, -1)
    rows = rows.select(F.regexp_extract(path, r"([^/]*)\.jsonl$", 1).alias("session_id"), "path", "part", "row", F.posexplode(inner).alias("at", "line"))
    return rows.select("session_id", "path", F.struct("part", "row", "at").alias("line_no"), "line")


def write_sessions(lines: DataFrame, folder: str) -> None:
    """lines(session_id, line_no, line): a file <session_id>.jsonl for each session in the folder. Lines are sorted within their
    session's partition and written as they come; a repeated attempt writes the same file again."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    fs, top = pafs.FileSystem.from_uri(uri)
    fs.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(uri)
        name, out = None, None
        for batch in batches:
            for session, line in zip(batch.column("session_id").to_pylist(), batch.column("line").to_pylist()):
                if session != name:
                    if out is not None:
                        out.close()
                    name, out = session, fs.open_output_stream(f"{top}/{session}.jsonl")
                out.write((line + "\n").encode())
        if out is not None:
            out.close()
        yield from ()

    rows = lines.select("session_id", "line_no", "line").repartition("session_id").sortWithinPartitions("session_id", "line_no")
    rows.mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def pair_rows(spark: SparkSession, path: str) -> DataFrame:
    """record (a variant) of every line that isn't blank; a line that is no JSON is an error."""
    return spark.read.text(path).where(~blank(F.col("value"))).select(F.parse_json("value").alias("record"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """Lower-cased names of 3 or more characters from a file of words, without generic ones."""
    words = spark.read.text(path).select(F.explode(F.split("value", f"{SPACE}+")).alias("name")).select(F.lower("name").alias("name"))
    return words.where((F.length("name") >= 3) & ~F.col("name").isin(GENERIC_NAMES)).distinct()


def names_shown(names: DataFrame) -> DataFrame:
    """The distinct names in order."""
    return names.select("name").distinct().orderBy("name")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Rows as JSON lines with null fields, in place of what is there."""
    pairs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
