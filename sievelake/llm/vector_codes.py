"""Vector code compression: integer product quantization with partial-distance search.

Vectors are cut into ``PARTS`` equal consecutive parts, and each part position has a codebook of at most
``ENTRIES`` integer entries. A round assigns every part to its nearest entry (squared Euclidean distance,
ties to the lower index) and replaces each entry by the floor of its parts' mean; unused entries stay.

The nearest entry comes by partial-distance search. The dimensions of a part are taken in the order of the
codebook's variance, greatest first, and entries in blocks of ``BLOCK``. The first complete distances bound the
rest: a mask drops each pair of a part and an entry as soon as its integer distance so far strictly exceeds the
part's best complete distance, so ties survive. What is left of a block lowers the bounds for the next one.

Everything is in whole numbers, so sums do not depend on how the rows are split. A task adds up its own parts
and passes on one row per entry; the driver holds the codebooks only, whose size the parameters bound.

Defined results: vectors that are null, empty, or hold a null or a non-finite component are dropped. So are
vectors whose length is not that of the first kept one by vec_id or not a multiple of the parts, and those with a
component beyond +-2^20, whose distances 64 bits could not hold. Rows of one vec_id are ordered by their vectors,
null ids come last; repeated rows are each coded. With fewer vectors than entries the codebooks have fewer; a
codebook may hold equal entries, of which the lowest is used. Null labels are one label. Input columns other
than the three that are named go, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 8
LIMIT = float(1 << 20)
_SLICE = 4096


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry; both arguments hold int64 rows."""
    order = np.argsort(-codebook.var(axis=0), kind="stable")
    x, book = parts[:, order], codebook[:, order]
    code, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for first in range(0, len(book), BLOCK):
        entries = book[first : first + BLOCK]
        row, entry = np.divmod(np.arange(len(x) * len(entries)), len(entries))
        far = np.zeros(len(row), np.int64)
        for d in range(x.shape[1]):
            far = far + (x[row, d] - entries[entry, d]) ** 2
            stays = far <= best[row]
            if not stays.all():
                row, entry, far = row[stays], entry[stays], far[stays]
        if len(row):
            # Rows ascend, and entries within a row: the first smallest distance of each row is its lowest entry.
            head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.minimum.reduceat(far, head)
            hit = np.flatnonzero(far == np.repeat(least, np.diff(np.append(head, len(row)))))
            _, pick = np.unique(row[hit], return_index=True)
            chosen = hit[pick]
            better = far[chosen] < best[row[chosen]]  # an equal one of an earlier block has the lower index
            chosen = chosen[better]
            code[row[chosen]], best[row[chosen]] = entry[chosen] + first, far[chosen]
    return code, best


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, embedding) of the vectors that are kept."""
    v = F.col("embedding")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LIMIT))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & fine)


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of floor(SCALE * x); scaling by a power of two is exact."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(len(column), -1)


def _assign(column: pa.Array, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of a batch, both by row and part."""
    codes = np.empty((len(column), len(books)), np.int64)
    far = np.empty_like(codes)
    for a in range(0, len(column), _SLICE):
        cut = slice(a, min(a + _SLICE, len(column)))
        x = _integers(column.slice(a, _SLICE)).reshape(-1, len(books), books.shape[2])
        for p, book in enumerate(books):
            codes[cut, p], far[cut, p] = nearest(x[:, p], book)
    return codes, far


def retrained(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry the floor of the mean of its parts over all vectors."""
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((n_parts * n_entries, width), np.int64), np.zeros(n_parts * n_entries, np.int64)
        for batch in batches:
            column = batch.column(0)
            codes, _ = _assign(column, books)
            place = (codes + np.arange(n_parts) * n_entries).ravel()
            np.add.at(sums, place, _integers(column).reshape(-1, width))
            counts += np.bincount(place, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used].tolist(), pa.list_(pa.int64())), pa.array(counts[used])], names=["place", "sums", "n"])

    partial = vectors.select("embedding").mapInArrow(run, "place int, sums array<bigint>, n bigint")
    added = partial.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)])
    new = books.copy().reshape(-1, width)
    for r in added.collect():  # a row per entry at most
        new[r.place] = [r[f"s{k}"] // r.n for k in range(width)]
    return new.reshape(books.shape)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the first vectors by vec_id, or None without vectors of a fitting length."""
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    head = vectors.orderBy(*order).limit(1).select(F.size("embedding").alias("n")).first()
    if head is None or head.n % parts:
        return None
    rows = vectors.where(F.size("embedding") == head.n).orderBy(*order).limit(entries).select("embedding").toArrow()
    return _integers(rows.column(0).combine_chunks()).reshape(-1, parts, head.n // parts).transpose(1, 0, 2).copy()


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """(parts, entries, width) of codebooks learnt from all ``vectors`` (see `whole_vectors`)."""
    books = first_codebooks(vectors, parts, entries)
    if books is not None:
        fitting = vectors.where(F.size("embedding") == books.shape[0] * books.shape[2])
        for _ in range(rounds):
            books = retrained(fitting, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, code (two hex digits a part) and error of every vector of the codebooks' length."""
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])])
    fitting = vectors.where(F.size("embedding") == books.shape[0] * books.shape[2])
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, far = _assign(batch.column(2), books)
            text = pa.array(["".join(row) for row in digits[codes].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return fitting.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress_vectors(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: vec_id, label, code, error, label_error (of all rows of its label) and the
    codebooks' digest. ``entries`` is at most 256."""
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col, label_col)
    books = fit_codebooks(vectors, parts, entries, rounds)
    if books is None:
        none = vectors.where("false").select("vec_id", "label")
        return none.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = staged(encode(vectors, books), "vector-codes")
    # A group by and a join, not a window: a label that a third of all rows have is no task of its own.
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"pieces AS (SELECT vec_id, label, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"book0 AS (SELECT p, i, v AS c FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM pieces) WHERE i < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"near{k} AS (SELECT vec_id, any_value(label) AS label, p, any_value(v) AS v, min([{far}, i]) AS best FROM pieces JOIN book{k} USING (p) GROUP BY vec_id, p)")
        if k < ROUNDS:
            ctes += [
                f"""mean{k} AS (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM (
  SELECT p, best[2] AS i, k, sum(v[k])::BIGINT AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM pieces))) AS k) GROUP BY ALL) GROUP BY p, i)""",
                f"book{k + 1} AS (SELECT b.p, b.i, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.i = m.i)",
            ]
    return f"""
WITH {", ".join(ctes)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, i, k)) AS h FROM (SELECT p, i, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM book{ROUNDS}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, digest
"""


OP13_SQL = _sql()
