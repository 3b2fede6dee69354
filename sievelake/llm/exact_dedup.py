"""Exact deduplication with counting quotient filters and byte verification.

1. One pass over the texts gives each row a 64-bit fingerprint and the SHA-256 of its normalised text.
2. Each partition builds a counting quotient filter of its fingerprints: the top bits are the
   quotient, the sorted remainders of a quotient form its run, and each remainder has a counter. The
   fingerprint is kept whole (quotient + remainder), so filters merge without loss, quotient range by
   quotient range, as sorted runs. A range is sized to about ``RANGE_ROWS`` fingerprints.
3. Only fingerprints with a count above one matter. Their rows' texts are routed to byte
   verification: grouping by fingerprint and the normalised text itself, combined before the shuffle,
   so a text that a third of all rows hold moves once per task.

Routing tests membership in a broadcast sorted array where the counted fingerprints fit
``BROADCAST_BYTES``. Beyond that a broadcast bitmap of the repeated quotients (``BITMAP_BITS`` top bits,
32 MB at most) holds back nearly all other texts, and a shuffled semi-join decides on the rest.

Defined results: null text counts as empty; of rows with equal text the smallest doc_id stays, null ids
last; repeated rows (same id, same text) keep one of them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE_BYTES, add_columns, binaries, bitmap_of, in_bitmap, staged, table

RANGE_ROWS = 500_000
SEED = 0
BITMAP_BITS = 28


def normalised(raw: bytes | None) -> bytes:
    """Each run of space, tab, LF, VT, FF and CR becomes one space."""
    text = (raw or b"").translate(SPACE_BYTES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class CountingQuotientFilter:
    """Fingerprints as (quotient, remainder) with counters, runs sorted by remainder.

    ``starts[q]`` is where the run of the q-th quotient of the filter's range begins. Nothing is
    rounded, so a merge holds exactly the counts of both sides.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int = 16, low: int = 0, high: int | None = None):
        self.bits, self.low, self.high = quotient_bits, low, 1 << quotient_bits if high is None else high
        shift = np.uint64(64 - quotient_bits)
        self.starts = np.searchsorted(fingerprints >> shift, np.arange(self.low, self.high + 1, dtype=np.uint64)).astype(np.uint32)
        self.remainders = fingerprints & np.uint64((1 << int(shift)) - 1)
        self.counts = counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int = 16) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True), quotient_bits)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(self.low, self.high, dtype=np.uint64), np.diff(self.starts))
        return quotients << np.uint64(64 - self.bits) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Merge the sorted runs of two filters of one range; counters of equal remainders add up."""
        both = np.concatenate((self.fingerprints(), other.fingerprints()))
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate((self.counts, other.counts))[order]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        return CountingQuotientFilter(both[first], np.add.reduceat(counts, first) if len(first) else counts, self.bits, self.low, self.high)

    @classmethod
    def merged(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter | None:
        """All of ``filters`` merged, like sizes first: a fingerprint is moved a logarithmic number of times."""
        held: list[CountingQuotientFilter] = []
        for one in filters:
            held.append(one)
            while len(held) > 1 and len(held[-2].counts) <= 2 * len(held[-1].counts):
                last = held.pop()
                held[-1] = held[-1].merge(last)
        while len(held) > 1:
            last = held.pop()
            held[-1] = held[-1].merge(last)
        return held[0] if held else None

    def ranges(self, n: int) -> Iterator[tuple[int, bytes]]:
        """Cut into n quotient ranges: (range, packed remainders and counters), empty ones left out."""
        step = (self.high - self.low) // n
        for k in range(n):
            a, b = (int(self.starts[i]) for i in (k * step, (k + 1) * step))
            if b > a:
                runs = (self.starts[k * step : (k + 1) * step + 1] - self.starts[k * step]).astype("<u4")
                used = np.flatnonzero(np.diff(runs)).astype("<u4")
                head = np.array([len(used), b - a], "<u4").tobytes()
                yield k, head + used.tobytes() + np.diff(runs)[used].astype("<u4").tobytes() + self.remainders[a:b].astype("<u8").tobytes() + self.counts[a:b].astype("<u8").tobytes()

    @classmethod
    def unpack(cls, k: int, n: int, data: bytes, quotient_bits: int = 16) -> CountingQuotientFilter:
        step = (1 << quotient_bits) // n
        used_n, size = np.frombuffer(data, "<u4", 2)
        used, lengths = np.frombuffer(data, "<u4", 2 * int(used_n), 8).reshape(2, -1)
        rest = np.frombuffer(data, "<u8", 2 * int(size), 8 + 8 * int(used_n)).reshape(2, -1)
        quotients = np.repeat(used.astype(np.uint64) + np.uint64(k * step), lengths)
        return cls(quotients << np.uint64(64 - quotient_bits) | rest[0], rest[1].astype(np.int64), quotient_bits, k * step, (k + 1) * step)


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, a row number, the fingerprint and the SHA-256 of its normalised text."""
    from pyspark.sql import types as T

    def run(texts: pa.Array):
        fingerprints, digests = [], []
        for raw in binaries(texts):
            text = normalised(raw)
            fingerprints.append(xxhash.xxh64_intdigest(text, SEED))
            digests.append(hashlib.sha256(text).hexdigest())
        return [pa.array(np.array(fingerprints, np.uint64).view(np.int64), pa.int64()), pa.array(digests, pa.string())]

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return add_columns(keyed, [("fp", T.LongType()), ("text_sha256", T.StringType())], run, "text").select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", "fp", "text_sha256"
    )


def repeated_fingerprints(keys: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints that more than one row has, with their counts, by merging partition filters."""
    n = 256
    while n < 1 << 16 and n * RANGE_ROWS < n_rows:
        n *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = CountingQuotientFilter.merged(CountingQuotientFilter.of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) for b in batches)
        if whole is not None and (cut := list(whole.ranges(n))):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([d for _, d in cut], pa.binary())], names=["part", "data"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        whole = CountingQuotientFilter.merged(CountingQuotientFilter.unpack(k, n, data) for batch in batches for data in batch.column(1).to_pylist())
        many = whole.counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(whole.fingerprints()[many].view(np.int64)), pa.array(whole.counts[many], pa.int64())], names=["fp", "n"])

    return keys.select("fp").mapInArrow(build, "part int, data binary").groupBy("part").applyInArrow(merge, "fp long, n long")


def verified_groups(docs: DataFrame, repeated: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, text_sha256, group_size) of texts that byte comparison finds on several rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    small = repeated.count() * 8 <= broadcast_bytes
    if small:
        # As Arrow columns: eight bytes for each fingerprint on the driver, not a row object.
        shared = spark.sparkContext.broadcast(np.sort(repeated.select("fp").toArrow().column(0).to_numpy()))
    else:
        shared = spark.sparkContext.broadcast(bitmap_of(repeated, "fp", BITMAP_BITS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [normalised(raw) for raw in binaries(batch.column(0))]
            fp = np.array([xxhash.xxh64_intdigest(t, SEED) for t in clean], np.uint64).view(np.int64)
            known = shared.value
            if not small:
                keep = np.flatnonzero(in_bitmap(known, fp, BITMAP_BITS))
            else:
                at = np.minimum(np.searchsorted(known, fp), max(len(known) - 1, 0))
                keep = np.flatnonzero(known[at] == fp) if len(known) else at[:0]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array([clean[i].decode() for i in keep], pa.string())], names=["fp", "body"])

    routed = texts.mapInArrow(route, "fp long, body string")
    if not small:
        routed = routed.join(repeated.select("fp"), "fp", "left_semi")
    same = routed.groupBy("fp", "body").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return same.select("fp", F.sha2("body", 256).alias("text_sha256"), "group_size")


def exact_groups(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_no."""
    keys = staged(text_keys(docs, id_col, text_col), "text-keys")
    repeated = staged(repeated_fingerprints(keys, keys.count()), "repeated")
    same = verified_groups(docs, repeated, broadcast_bytes, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    first = (
        keys.join(repeated.select("fp"), "fp", "left_semi")
        .groupBy("fp", "text_sha256")
        .agg(F.min(order).alias("first"))
    )
    groups = same.join(first, ["fp", "text_sha256"]).select("fp", "text_sha256", "group_size", "first")
    return keys.join(staged(groups, "groups"), ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("first.row_no") == F.col("row_no"))).alias("kept"),
        "text_sha256",
        "row_no",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_no")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
