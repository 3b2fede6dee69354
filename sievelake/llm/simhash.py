"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints within radius 3 leave at most 2 differing bits outside at least one of four 16-bit
blocks (if any bit differs, some block holds one). So for each block left open, every distinct
fingerprint emits all variants of the other 48 bits within half of that radius: itself and its 48
one-bit flips. Two linked fingerprints meet in a common variant in the middle. Emitting half of the
odd radius 3 rounded up would take 2,081 variants for a fingerprint; this takes 196, and the 48-bit
keys keep chance meetings rare. Variants are shuffled, sorted and scanned run by run; each meeting is
verified on all 64 bits.

A run holds distinct fingerprints around one variant, at most 49 * 2**16 however many documents there
are. Short runs are compared directly; long ones look up each member's neighbours by open block, in
time linear in the run. A run gives a spanning forest of its links, never all pairs.

Components come from minimum labels with pointer jumping over tables in the shared folder. Exact copies
share one fingerprint and count as one node, so a huge group of copies is one node.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows share
a component; a component's id is its smallest doc_id (rows with null ids join a component but never name
it unless all are null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, add_columns, binaries, set_aside, staged, table

RADIUS = 3
SEED = 42
LONG_RUN = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_OPEN = 16
_CLOSED = 64 - _OPEN


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    n, ones = len(octets), np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(octets[k : k + 8192], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", name: str = "fp") -> DataFrame:
    def run(texts: pa.Array):
        return [pa.array(np.array([fingerprint(raw, width) for raw in binaries(texts)], np.uint64).view(np.int64), pa.int64())]

    return add_columns(docs, [(name, T.LongType())], run, text_col)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, code) of every variant: for each open block, the closed 48 bits within radius 1.

    The code holds the open block's bits and which closed bit was flipped; with the key it gives the
    fingerprint back, in fewer bytes to shuffle than the fingerprint.
    """
    one = np.uint64(1)
    flips = np.concatenate(([np.uint64(0)], one << np.arange(_CLOSED, dtype=np.uint64)))
    which = np.arange(_CLOSED + 1, dtype=np.int32) << _OPEN
    keys, codes = [], []
    for block in range(64 // _OPEN):
        low = np.uint64(block * _OPEN)
        closed = fps & ((one << low) - one) | (fps >> (low + np.uint64(_OPEN)) << low if block < 3 else np.uint64(0))
        opened = (fps >> low & np.uint64((1 << _OPEN) - 1)).astype(np.int32)
        keys.append((np.uint64(block << _CLOSED) | (closed[:, None] ^ flips[None, :])).ravel())
        codes.append((opened[:, None] | which[None, :]).ravel())
    return np.concatenate(keys), np.concatenate(codes)


def owners(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The fingerprints that emitted these variants."""
    one = np.uint64(1)
    flip = (codes >> _OPEN).astype(np.uint64)
    closed = keys & ((one << np.uint64(_CLOSED)) - one)
    closed ^= np.where(flip > 0, one << (np.maximum(flip, one) - one), np.uint64(0))
    low = (keys >> np.uint64(_CLOSED)) * np.uint64(_OPEN)
    opened = (codes & ((1 << _OPEN) - 1)).astype(np.uint64)
    below = closed & ((one << low) - one)
    above = np.where(low < _CLOSED, closed >> low << np.minimum(low + np.uint64(_OPEN), np.uint64(63)), np.uint64(0))
    return below | opened << low | above


def forest(members: np.ndarray, block: int) -> list[tuple[int, int]]:
    """Verified links that connect what is linked among the distinct members of one run."""
    n = len(members)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    made: list[tuple[int, int]] = []

    def unite(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
                made.append((int(members[a]), int(members[b])))

    if n <= LONG_RUN:
        for i in range(n - 1):
            if len(made) == n - 1:
                break
            near = np.flatnonzero(np.bitwise_count(members[i + 1 :] ^ members[i]) <= RADIUS)
            unite(np.full(len(near), i), near + i + 1)
        return made
    # Sorted by (open, closed): equal open values differ in 2 closed bits at most and are all linked.
    low = np.uint64(block * _OPEN)
    opened = members >> low & np.uint64((1 << _OPEN) - 1)
    closed = members & ~(np.uint64((1 << _OPEN) - 1) << low)
    order = np.lexsort((closed, opened))
    members, opened, closed = members[order], opened[order], closed[order]
    head = np.flatnonzero(np.concatenate(([True], opened[1:] != opened[:-1])))
    tail = np.append(head[1:], n)
    unite(np.repeat(head, tail - head), np.arange(n))
    kinds, inverse = np.unique(closed, return_inverse=True)
    codes = opened.astype(np.int64) * len(kinds) + inverse  # ascending, as members are
    values = opened[head]
    near_kinds = [np.flatnonzero(np.bitwise_count(kinds ^ k) <= 1) for k in kinds]
    bits = [1 << i for i in range(_OPEN)]
    for a in range(_OPEN):
        _look(values, head, bits[a], unite)
        for b in range(a):
            for k, mates in enumerate(near_kinds):
                rows = np.flatnonzero(inverse == k)
                for m in mates:
                    _meet(codes, rows, opened, bits[a] | bits[b], int(m), len(kinds), unite)
            for c in range(b):
                mask = bits[a] | bits[b] | bits[c]
                want = (opened.astype(np.int64) ^ mask) * len(kinds) + inverse
                at = np.minimum(np.searchsorted(codes, want), n - 1)
                hit = np.flatnonzero(codes[at] == want)
                unite(hit, at[hit])
    return made


def _look(values: np.ndarray, head: np.ndarray, mask: int, unite) -> None:
    want = values ^ np.uint64(mask)
    at = np.minimum(np.searchsorted(values, want), len(values) - 1)
    hit = np.flatnonzero(values[at] == want)
    unite(head[hit], head[at[hit]])


def _meet(codes: np.ndarray, rows: np.ndarray, opened: np.ndarray, mask: int, kind: int, n_kinds: int, unite) -> None:
    want = (opened[rows].astype(np.int64) ^ mask) * n_kinds + kind
    at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
    hit = np.flatnonzero(codes[at] == want)
    unite(rows[hit], at[hit])


def run_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys; both arrays sorted by key."""
    if not len(keys):
        return keys, fps
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(head, len(keys)))
    left, right = [], []
    for k in np.unique(size[size > 1]).tolist():
        runs = head[size == k]
        if k > 64:
            groups = [(h, fps[h : h + k]) for h in runs]
        else:
            square = fps[runs[:, None] + np.arange(k)]
            near = np.bitwise_count(square[:, 1:] ^ square[:, :1]) <= RADIUS
            star = near.all(axis=1)  # all linked to the first: a spanning tree already
            left.append(np.repeat(square[star, 0], k - 1))
            right.append(square[star, 1:].ravel())
            groups = [(h, m) for h, m in zip(runs[~star], square[~star], strict=True)] if k > 2 else []
        for h, members in groups:
            if made := forest(members, int(keys[h]) >> _CLOSED):
                a, b = zip(*made, strict=True)
                left.append(np.array(a, np.uint64))
                right.append(np.array(b, np.uint64))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b) of linked distinct fingerprints, enough of them to connect every component."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), 2048):
                keys, codes = variants(fps[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(codes)], names=["key", "code"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the run that the last batch ended in

        def links(parts):
            keys, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
            many = np.concatenate(([False], keys[1:] == keys[:-1], [False]))
            many = many[1:] | many[:-1]
            a, b = run_links(keys[many], owners(keys[many], codes[many]))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            codes = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield links([*held, (keys[:cut], codes[:cut])])
                held = []
            held.append((keys[cut:].copy(), codes[cut:].copy()))
        if held:
            yield links(held)

    met = nodes.select("fp").mapInArrow(emit, "key long, code int").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(scan, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links``; label is the component's smallest node.

    Rounds of minimum label over neighbours, then pointer jumping, until nothing changes.
    """
    both = staged(links.union(links.select("b", "a")).toDF("u", "v"), "links")
    state = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(state, both.v == state.node).groupBy("u").agg(F.min("label").alias("m"))
        lower = state.join(near, state.node == near.u).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        lower = staged(lower, "lower")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = staged(lower.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        state = new.select("node", "label")


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) for rows (doc_id, fp); root is the component's smallest fingerprint."""
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    labels = components(near_links(nodes))
    named = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return staged(named.join(smallest, "root").select("fp", "root", "component_id"), "components")


def near_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(with_fingerprints(rows, width).select("doc_id", "fp"), "fingerprints")
    return rows.join(fingerprint_components(rows).drop("root"), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (of repeated rows, one)."""
    safe, back = set_aside(docs, ("fp", "row_no"))
    rows = staged(with_fingerprints(safe, width, text_col).withColumn("row_no", F.monotonically_increasing_id()), "documents")
    narrow = rows.select(F.col(f"`{id_col}`").alias("doc_id"), "fp", "row_no")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    by_fp = narrow.groupBy("fp").agg(F.min(order).alias("first"))
    stay = by_fp.join(fingerprint_components(narrow), "fp").groupBy("root").agg(F.min("first").alias("first"))
    stay = staged(stay.select("first.row_no"), "stay")
    gone = staged(narrow.select("row_no").join(stay, "row_no", "left_anti"), "gone")
    if gone.count() * 8 <= broadcast_bytes:
        gone = F.broadcast(gone)
    return rows.join(gone, "row_no", "left_anti").select(*back)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
