"""Shared helpers: words, staged tables, Arrow plumbing.

Words are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased.
On UTF-8 bytes that class is: digits, a-z and every byte of a non-ASCII character, so one byte
translation plus ``bytes.split`` tokenises exactly and keeps byte offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stage import shared_dir, staged

__all__ = ["BROADCAST_BYTES", "SPACE_BYTES", "WORD_BYTES", "add_columns", "binaries", "bitmap_of", "first_rows", "in_bitmap", "set_aside", "shared_dir", "staged", "table", "words_of"]

WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
SPACE_BYTES = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))

#: A side is broadcast only when it was counted and is no larger than this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def binaries(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def add_columns(df: DataFrame, new: list[tuple[str, T.DataType]], fn: Callable, *needs: str) -> DataFrame:
    """Append the columns that ``fn(*columns as Arrow arrays) -> list of arrays`` makes for each batch.

    Input columns whose names clash with a new one (case-insensitively, as Spark compares) go.
    """
    taken = {name.lower() for name, _ in new}
    kept = [c for c in df.columns if c.lower() not in taken or c in needs]
    passed = [c for c in kept if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*[batch.column(batch.schema.get_field_index(c)) for c in needs])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays(arrays + list(made), names=passed + [n for n, _ in new])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def bitmap_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each value of a column's top ``bits`` bits, set where some row has it."""
    place = F.shiftrightunsigned(column, 64 - bits) + 1
    cut = df.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(1 << bits, 1 << 15) >> 3, np.uint8)
    for r in cut.toLocalIterator():  # pieces of 4 KB, as many as the bitmap has at most
        at = (r.k - 1) * len(r.bits)
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which of the 64-bit values may be among those that the bitmap was made of."""
    place = (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


#: A text above this share of a group's bytes is drawn only after all others.
LARGE_SHARE = 16


def first_rows(df: DataFrame, group: str, order: list, text_col: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Of each group the first ``most_rows`` rows with a text, as far as their texts hold ``most_bytes`` in all.

    Texts of more than a sixteenth of that come after all others, so that none keeps many out, and a group with
    any text has one row at least, even if that one is larger.
    """
    bytes_of = F.octet_length(text_col).cast("long")
    own = W.partitionBy(group).orderBy(bytes_of > most_bytes // LARGE_SHARE, *order, text_col)
    size = F.sum(bytes_of).over(own.rowsBetween(W.unboundedPreceding, 0))
    rows = df.where(F.col(text_col) != "").withColumn("_n", F.row_number().over(own)).withColumn("_size", size)
    return rows.where((F.col("_n") <= most_rows) & ((F.col("_size") <= most_bytes) | (F.col("_n") == 1))).drop("_size")


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """Rename columns that clash with ``names``; also the selection that gives ``df``'s columns back."""
    taken = {n.lower() for n in names}
    renamed = {c: f"_kept_{c}" for c in df.columns if c.lower() in taken}
    return df.withColumnsRenamed(renamed), [F.col(f"`{renamed.get(c, c)}`").alias(c) for c in df.columns]
