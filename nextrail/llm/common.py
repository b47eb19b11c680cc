"""What several operators share: tables by name, batches of bounded size, tokenizer files."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer single text is worked on alone.
BATCH_BYTES = 4 << 20

#: What ``[\x20\x09-\x0D]`` matches, the white space of all word and line rules here.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it is written in expressions and schemas, whatever it is."""
    return "`" + name.replace("`", "``") + "`"


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, so that other columns can have any name."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def give_back() -> None:
    """Returns what a Python worker has freed to the system; it goes on to other tasks and other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


#: What empties the memory that an operator keeps in a worker from task to task.
KEEPERS: list[Callable[[], None]] = []


def forget() -> None:
    """Empties what other operators' tasks have kept in this Python worker; they build it anew when they come again."""
    for empty in KEEPERS:
        empty()
    give_back()


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with at most ``max_bytes`` in ``column``, or one row; gives freed memory back at the end."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = used = 0
        for row, length in enumerate(lengths):
            if used and used + (length or 0) > max_bytes:
                yield batch.slice(start, row - start)
                start, used = row, 0
            used += (length or 0) + 1
        if start < batch.num_rows:
            yield batch.slice(start)
    batch = None
    give_back()


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def crc_third(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: 1 marks held-out rows. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3
