"""What the corpus operators share: tables, rows by number, and files on any file system that Arrow opens."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fresh, stored

__all__ = ["Kept", "dealt", "few", "fresh", "numbered", "open_fs", "slices", "small_batches", "stored", "table", "texts"]

#: Rows and bytes of an Arrow batch. Texts run from a word to hundreds of kilobytes, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows of ids that are broadcast, at most: 16 MB.
FEW = 2_000_000
#: Rows of a file, as a power of two, for which row numbers have room.
FILE_ROWS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns named, and text with null as the empty text; other columns go, so none can clash."""
    return docs.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Batches of that size from here on in the session. Spark reads the setting when a plan runs, which is after the
    operator returned it, so it cannot be put back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def numbered(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as a struct) and id: a number of its own for each row, the same whenever it is read. It is
    made of the file's place in the sorted list of files and the row's place in it; a table that is not read from
    files is written first."""
    spark, row = docs.sparkSession, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column hides the place in the file")
        rows = docs.select(row, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        files = rows.select("file").distinct()
    except AnalysisException:
        rows = stored(docs.select(row), "rows").select("row", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        files = rows.select("file").distinct()
    paths = sorted(r.file for r in files.collect())  # as many as there are files
    places = spark.createDataFrame(list(enumerate(paths)), "n long, file string")
    return rows.join(F.broadcast(places), "file").select("row", (F.shiftleft("n", FILE_ROWS) + F.col("at")).alias("id"))


def few(ids: DataFrame, name: str) -> DataFrame:
    """A table of ids, written, and marked for broadcast if it has at most FEW rows; so what it is joined to need not be
    shuffled. A larger one is left to Spark."""
    ids = stored(ids, name)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def dealt(files: DataFrame) -> DataFrame:
    """files(path), dealt out to as many tasks as there are files, one each: in turn, from one partition. The number is
    given, for rows of paths are so small that Spark would otherwise put them all into one task."""
    return files.coalesce(1).repartition(max(1, files.count()))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have about `most` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Returns memory that is free to the system. A worker lives on after a task, and others need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Kept(dict):
    """A table of bounded size in two generations: when the new one is full it becomes the old one, and what is found in
    the old one moves to the new. Frequent keys stay, and at most twice `size` entries are held."""

    def __init__(self, size: int):
        self.size, self.old = size, {}

    def add(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def again(self, key):
        """The value from the old generation, or None."""
        value = self.old.get(key)
        if value is not None:
            self.add(key, value)
        return value
