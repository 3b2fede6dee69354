"""Given pairs of files compared by their sets of shingles, a family of files at a time.

Joined posting by posting, a pair costs as many rows as its files have shingles, so a family of n alike files costs n * n
sets. Here pairs are dealt to tiles, by the first file that their later one meets: a set goes to each tile once, however
many pairs of the tile need it. Small families share tiles of about ``TILE`` shingles; a larger one is cut, each side by
its files, to tiles of that size, so that no task holds a family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged

#: Shingles of the files of a tile, about; a file with more is in a tile with few others.
TILE = 1 << 20

KEY = ("_tile", "_i", "_j")
SCHEMA = "user_id string, a_id long, b_id long, shared long, shared_logs double, a_n long, rest array<long>"
ARROW = pa.schema(
    [("user_id", pa.string()), ("a_id", pa.int64()), ("b_id", pa.int64()), ("shared", pa.int64()), ("shared_logs", pa.float64()), ("a_n", pa.int64()), ("rest", pa.list_(pa.int64()))]
)
PLACES = "user_id string, a_id long, b_id long, place int, at_a int, at_b int"
PLACES_ARROW = pa.schema([("user_id", pa.string()), ("a_id", pa.int64()), ("b_id", pa.int64()), ("place", pa.int32()), ("at_a", pa.int32()), ("at_b", pa.int32())])


def sets_of(rows: DataFrame, files: DataFrame, value: str = "rank") -> DataFrame:
    """(user_id, file_id, n, postings): the shingles of each of ``files`` with the rank or another ``value``, in one row."""
    own = rows.join(files, ["file_id", "user_id"], "left_semi")
    held = own.groupBy("user_id", "file_id").agg(F.collect_list(F.struct("shingle_hash", value)).alias("postings"))
    return held.select("user_id", "file_id", F.size("postings").cast("long").alias("n"), "postings")


def tiled(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (user_id, a_id, b_id) with the tile of each."""
    family = pairs.groupBy("user_id", "b_id").agg(F.min("a_id").alias("_family"))
    pairs = pairs.join(family, ["b_id", "user_id"])
    ends = pairs.select("user_id", "_family", F.inline(F.array(*[F.struct(F.col(f"{p}_id").alias("file_id"), F.lit(p).alias("_side")) for p in "ab"]))).distinct()
    weights = ends.join(sets.select("user_id", "file_id", "n"), ["file_id", "user_id"]).groupBy("user_id", "_family")
    weights = weights.agg(*[F.coalesce(F.sum(F.when(F.col("_side") == p, F.col("n"))), F.lit(0)).alias(f"_{p}") for p in "ab"])
    whole = sets.agg(F.sum("n")).first()[0] or 0
    cuts = lambda p: F.when(F.col("_a") + F.col("_b") > TILE, F.expr(f"cast(_{p} div {TILE // 2} + 1 AS int)")).otherwise(F.lit(1))
    weights = weights.select("user_id", "_family", cuts("a").alias("_cuts_a"), cuts("b").alias("_cuts_b"))
    number = F.xxhash64("user_id", "_family")
    tile = F.when(F.col("_cuts_a") + F.col("_cuts_b") > 2, number).otherwise(F.pmod(number, F.lit(4 * (whole // TILE) + 1)))
    part = lambda p: F.pmod(F.xxhash64(f"{p}_id"), F.col(f"_cuts_{p}")).cast("int")
    return pairs.join(weights, ["user_id", "_family"]).select("user_id", "a_id", "b_id", tile.alias("_tile"), part("a").alias("_i"), part("b").alias("_j"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(user_id, a_id, b_id, shared, shared_logs, a_n, rest) of ``pairs`` with a shared shingle: how many, the sum of the
    logs of their ranks in b, the size of a's set, and its shingles that b does not have. ``sets``: `sets_of`, stored."""

    def run(dealt: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        for key, (ha, _), (hb, ranks) in _met(dealt, held):
            hit, at = _within(ha, hb)
            if hit.any():
                rows.append((*key, int(hit.sum()), float(np.log(ranks[at]).sum()), len(ha), ha[~hit]))
        return _table(rows, ARROW)

    return _in_tiles(pairs, sets).applyInArrow(run, SCHEMA)


def first_shared(pairs: DataFrame, sets: DataFrame, top: int) -> DataFrame:
    """(user_id, a_id, b_id, place, at_a, at_b): the first ``top`` shared shingles of ``pairs`` by place in a; of a shingle
    that a file repeats, the last place counts. ``sets``: `sets_of` with start_offset, stored."""

    def run(dealt: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        for key, (ha, at_a), (hb, at_b) in _met(dealt, held):
            hit, at = _within(ha, hb)
            places = sorted(zip(at_a[hit].tolist(), at_b[at].tolist(), strict=True))[:top]
            rows += [(*key, k, *place) for k, place in enumerate(places, 1)]
        return _table(rows, PLACES_ARROW)

    return _in_tiles(pairs, sets).applyInArrow(run, PLACES)


def _in_tiles(pairs: DataFrame, sets: DataFrame):
    """Pairs of each tile beside the sets that they need, each once."""
    dealt = staged(tiled(pairs, sets), "tiles")
    ends = dealt.select(*KEY, "user_id", F.explode(F.array("a_id", "b_id")).alias("file_id")).distinct()
    held = ends.join(sets.select("user_id", "file_id", "postings"), ["file_id", "user_id"])
    held = held.select(*[F.col(c).alias(f"set{c}") for c in KEY], F.col("user_id").alias("set_user"), F.col("file_id").alias("set_file"), F.col("postings").alias("set_postings"))
    return dealt.groupBy(*KEY).cogroup(held.groupBy(*[f"set{c}" for c in KEY]))


def _within(ha: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``ha`` are in ``hb`` (both sorted and distinct), and where."""
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    hit = hb[at] == ha
    return hit, at[hit]


def _met(dealt: pa.Table, held: pa.Table) -> Iterator[tuple]:
    """(user_id, a_id, b_id), a's and b's hashes, ascending, and values; of a hash that repeats the greatest value."""
    postings = held.column("set_postings").combine_chunks()
    cuts = postings.offsets.to_numpy()
    hashes, values = (postings.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    place = {file: k for k, file in enumerate(zip(held.column("set_user").to_pylist(), held.column("set_file").to_pylist(), strict=True))}
    ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def own(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in ordered:
            h, v = hashes[cuts[k] : cuts[k + 1]], values[cuts[k] : cuts[k + 1]]
            by = np.lexsort((v, h))
            h, v = h[by], v[by]
            last = np.append(h[1:] != h[:-1], True)
            ordered[k] = h[last], v[last]
        return ordered[k]

    for user, a, b in zip(*[dealt.column(c).to_pylist() for c in ("user_id", "a_id", "b_id")], strict=True):
        i, j = place.get((user, a)), place.get((user, b))
        if i is not None and j is not None:
            yield (user, a, b), own(i), own(j)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
