"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, staged  # noqa: F401

#: A word of the text contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that separates such words.
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Table for str.translate that lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def id_text(c: Column) -> Column:
    """The text form of an id that the folds are drawn from; null ids give the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(c: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(id_text(c).cast("binary")) % n


def words_native(c: Column) -> Column:
    """The words of a text as an array; no words for null or empty text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    bare = F.trim(F.coalesce(c, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def row_hash(rows: DataFrame, row: str = "row") -> Column:
    """A hash of all columns of ``rows``, which ``row`` holds as a struct, so that rows alike in some are dealt alike in reruns. Maps don't take part."""
    return F.xxhash64(*(F.col(row)[f.name] for f in rows.schema.fields if "map<" not in f.dataType.simpleString()))


def release() -> None:
    """Gives memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows that a worker turns into Python objects at once: a batch of Spark's may hold 64 MB of text.
ROWS = 512


def in_parts(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of a bounded number of rows, none of them copied."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker gives back what a task has freed: Spark keeps idle workers beside those of the next stages."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return go
