"""Near copies: SimHash candidates by meet-in-the-middle ball hashing, judged by their texts.

A fingerprint is taken over a text's distinct words, as that stays close under small edits wherever they stand:
two texts of which a few words differ are within ``RADIUS`` bits of 64. Alone it would also join texts of
like vocabulary, so every link is checked: texts link when their sets of five-word shingles have a
similarity of 4/5 or more. The contract of `simhash` fixes other fingerprints, a radius of 3 and no check.

Of six bits that differ over four 16-bit blocks, at most two stand outside the two blocks that hold most. So
for each of the six pairs of open blocks, a fingerprint emits all variants of its other 32 bits within half of
two bits: 6 * 33 = 198. Two fingerprints within the radius meet in a common variant, and each meeting is verified
on all 64 bits. Variants of 32 bits also meet by chance, about 8 times a variant for 10^9 fingerprints.

Nodes are classes of equal shingle sets, so copies count once. No group is expanded into all its pairs: first each
fingerprint's texts meet that of its nearest fingerprint and each other's first, and what links is joined. Then all
that is still apart is looked up, exactly: pairs of runs of up to ``SMALL_RUN`` were kept; the texts of larger runs
and of repeated fingerprints (`wide`) are found by what a link needs: a common rare shingle, at places that leave
room for the overlap (`jaccard_join`), and fingerprints within the radius. They, too, first meet the hubs of their
shingles. So a family of like texts that do not link is not listed pair by pair. A pair that was never looked at is in one component.

A run of one variant is compared in tiles of bounded memory, each member with each other (distinct fingerprints
only). Only texts whose fingerprints meet another's are read again; a bitmap of their classes picks them, so nothing
that grows is collected.

Defined results: texts without words, null and empty ones among them, are one group; fewer than five words are one
shingle; texts of any length are read whole; of a group the smallest id stays, null ids last, of repeated rows
one; an empty table gives an empty result; columns that clash with those in use come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, add_columns, binaries, bitmap_of, in_bitmap, set_aside, staged
from .jaccard_join import TILE, apart_pairs, digest, joined_labels, near_pairs, ngram_set, prefixes, rarity, set_keys, shared_prefixes, suffix_filtered, verified
from .simhash import SEED, components

RADIUS = 6
WIDTH = 5
NUM, DEN = 4, 5
TILE_CELLS = 1 << 22
SMALL_RUN = 16
BITMAP_BITS = 25  # 4 MB
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.uint64(16)
_BLOCK = np.uint64((1 << 16) - 1)
_CLOSED = list(combinations(range(4), 2))
_FLIP_BITS = 6


def word_fingerprint(raw: bytes | None) -> int:
    words = set((raw or b"").translate(_LOWER).split())
    if not words:
        return 0
    octets = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(octets), 8192):
        ones += np.unpackbits(octets[k : k + 8192], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(octets)).tobytes(), "big")


def with_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with fp, its fingerprint, and sig, the digest of its shingle set (no bytes without words)."""

    def run(texts: pa.Array):
        raws = binaries(texts)
        fps = np.array([word_fingerprint(raw) for raw in raws], np.uint64).view(np.int64)
        sets = (ngram_set(raw, WIDTH) for raw in raws)
        return [pa.array(fps, pa.int64()), pa.array([digest(own) if len(own) else b"" for own in sets], pa.binary())]

    return add_columns(docs, [("fp", T.LongType()), ("sig", T.BinaryType())], run, text_col)


def _block(fps: np.ndarray, k: int) -> np.ndarray:
    return fps >> np.uint64(16 * k) & _BLOCK


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, code) of every variant, fingerprint after fingerprint within each pair of closed blocks: the key holds
    which pair, the variant and the flipped bit; the code holds the open bits. Together they give the fingerprint."""
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(32, dtype=np.uint64)))
    which = np.arange(33, dtype=np.uint64)
    keys, codes = [], []
    for c, (x, y) in enumerate(_CLOSED):
        u, v = (k for k in range(4) if k not in (x, y))
        closed = _block(fps, x) | _block(fps, y) << _BITS
        opened = (_block(fps, u) | _block(fps, v) << _BITS).astype(np.uint32).view(np.int32)
        run = np.uint64(c << 32) | (closed[:, None] ^ flips)
        keys.append((run << np.uint64(_FLIP_BITS) | which).ravel())
        codes.append(np.repeat(opened, 33))
    return np.concatenate(keys), np.concatenate(codes)


def owners(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The fingerprints that emitted these variants."""
    flip = keys & np.uint64((1 << _FLIP_BITS) - 1)
    one = np.uint64(1)
    closed = keys >> np.uint64(_FLIP_BITS) & np.uint64((1 << 32) - 1)
    closed ^= np.where(flip > 0, one << (np.maximum(flip, one) - one), np.uint64(0))
    opened = codes.view(np.uint32).astype(np.uint64)
    pair = (keys >> np.uint64(32 + _FLIP_BITS)).astype(np.int64)
    fps = np.zeros(len(keys), np.uint64)
    for c, (x, y) in enumerate(_CLOSED):
        u, v = (k for k in range(4) if k not in (x, y))
        own = pair == c
        for half, low, high in ((closed[own], x, y), (opened[own], u, v)):
            fps[own] |= (half & _BLOCK) << np.uint64(16 * low) | (half >> _BITS) << np.uint64(16 * high)
    return fps


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of one variant."""
    runs = keys >> np.uint64(_FLIP_BITS)
    head = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    return head, np.diff(np.append(head, len(keys)))


def nearest(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, its nearest in the run, bits between them) of all with another within the radius; sorted by key."""
    head, size = _runs(keys)
    found = []
    for k in np.unique(size[size > 1]).tolist():
        starts = head[size == k]
        tall = max(1, TILE_CELLS // (k * k))
        for at in range(0, len(starts), tall):
            square = fps[starts[at : at + tall, None] + np.arange(k)]
            wide = max(1, TILE_CELLS // (len(square) * k))
            for i in range(0, k, wide):
                part = square[:, i : i + wide]
                bits = np.bitwise_count(part[:, :, None] ^ square[:, None, :])
                own = np.arange(part.shape[1])
                bits[:, own, own + i] = 255
                best = bits.argmin(axis=2)
                least = np.take_along_axis(bits, best[:, :, None], 2)[:, :, 0]
                near = least <= RADIUS
                found.append((part[near], np.take_along_axis(square, best, 1)[near], least[near].astype(np.int32)))
    if not found:
        return fps[:0], fps[:0], np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def close(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, fp, bits between them) of each pair within the radius in runs of at most ``SMALL_RUN``; sorted by key."""
    head, size = _runs(keys)
    found = [(fps[:0], fps[:0], np.zeros(0, np.int32))]
    for k in np.unique(size[size > 1]).tolist():
        square = fps[head[size == k, None] + np.arange(k)]
        for i in range(k - 1):
            bits = np.bitwise_count(square[:, i + 1 :] ^ square[:, i, None])
            run, j = np.nonzero(bits <= RADIUS)
            found.append((square[run, i], square[run, i + 1 + j], bits[run, j].astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def apart(keys: np.ndarray, fps: np.ndarray, labels: list[bytes]) -> Iterator[tuple]:
    """(fps, labels, fps, labels) of pairs within the radius in a run whose labels differ, tile by tile: what the second
    turn has to look at, listed in full. The stage itself asks `wide_pairs`; tests compare with this."""
    code_of: dict[bytes, int] = {}
    codes = np.array([code_of.setdefault(x, len(code_of)) for x in labels], np.int64)
    names = list(code_of)
    for start, n in zip(*_runs(keys), strict=True):
        own, member = codes[start : start + n], fps[start : start + n]
        if n < 2 or (own == own[0]).all():
            continue
        tall = max(1, TILE_CELLS // int(n))
        for i in range(0, int(n), tall):
            rows = slice(i, i + tall)
            hit = (np.bitwise_count(member[rows, None] ^ member) <= RADIUS) & (own[rows, None] < own)
            a, b = np.nonzero(hit)
            if len(a):
                a += i
                yield member[a], [names[k] for k in own[a]], member[b], [names[k] for k in own[b]]


def _met(fps: DataFrame) -> DataFrame:
    """The variants of ``fps`` (fp), runs together in sorted partitions."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(own), 2048):
                keys, codes = variants(own[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(codes)], names=["key", "code"])

    made = fps.mapInArrow(emit, "key long, code int")
    return made.repartition(F.shiftright("key", _FLIP_BITS)).sortWithinPartitions("key")


def _by_runs(batches: Iterator[pa.RecordBatch], scan: Callable) -> Iterator[pa.RecordBatch]:
    """``scan`` over whole runs of sorted batches; a run that goes on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("key").to_numpy(zero_copy_only=False) >> _FLIP_BITS
        cut = int(np.searchsorted(runs, runs[-1]))
        if held and (cut or held[-1].column("key")[-1].as_py() >> _FLIP_BITS != runs[0]):
            yield from scan(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield from scan(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield from scan(pa.Table.from_batches(held))


def _many(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of the rows in runs of more than one."""
    keys = part.column("key").to_numpy().view(np.uint64)
    head, size = _runs(keys)
    at = np.flatnonzero(np.repeat(size > 1, size))
    return keys[at], owners(keys[at], part.column("code").to_numpy()[at])


def met_pairs(fps: DataFrame) -> DataFrame:
    """(a, b, bits, large) of distinct fingerprints within the radius: all that meet in a run of at most ``SMALL_RUN``,
    and from larger runs each one's nearest, marked large."""

    def scan(part: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, own = _many(part)
        size = _runs(keys)[1]
        big = np.repeat(size > SMALL_RUN, size)
        for far, found in ((False, close(keys[~big], own[~big])), (True, nearest(keys[big], own[big]))):
            x, y, bits = found
            x, y = x.view(np.int64), y.view(np.int64)
            columns = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(bits), pa.array(np.full(len(x), far))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "bits", "large"])

    met = _met(fps).mapInArrow(lambda batches: _by_runs(batches, scan), "a long, b long, bits int, large boolean")
    return met.groupBy("a", "b", "bits").agg(F.max("large").alias("large"))


def class_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, text): one text of each wanted class (sig). ``rows``: sig, text; a text of no wanted class does not move,
    unless it falls on the bit of one."""
    hashed = F.xxhash64("sig").alias("h")
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(hashed), "h", BITMAP_BITS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["sig", "text"]).filter(pa.array(in_bitmap(bitmap.value, batch.column("h").to_numpy(zero_copy_only=False), BITMAP_BITS)))

    own = rows.where("sig <> X''").select("sig", F.col("text"), hashed).mapInArrow(pick, "sig binary, text string")
    return own.join(wanted, "sig", "left_semi").dropDuplicates(["sig"])


def class_grams(texts: DataFrame) -> DataFrame:
    """(sig, grams) of `class_texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sig, raw in zip(batch.column("sig"), binaries(batch.column("text")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([sig.as_py()], pa.binary()), pa.array([ngram_set(raw, WIDTH).tobytes()], pa.binary())], names=["sig", "grams"])

    return texts.mapInArrow(run, "sig binary, grams binary")


class Wide:
    """The classes of large runs and of repeated fingerprints. ``texts``: sig, fp, text."""

    def __init__(self, texts: DataFrame):
        own = texts.select(F.col("sig").alias("doc_id"), "text")
        made = staged(set_keys(own, WIDTH), "near-keys")
        self.classes = staged(made.where("sig IS NOT NULL").select("sig", "n", "cuts"), "near-cuts")
        self.shared = staged(shared_prefixes(prefixes(own, rarity(made), WIDTH, NUM, DEN)), "near-prefixes")
        self.fps = texts.select("sig", "fp")

    def _fitting(self, pairs: DataFrame) -> DataFrame:
        side = lambda p: self.fps.select(F.col("sig").alias(p), F.col("fp").alias(f"{p}_fp"))
        near = suffix_filtered(pairs, self.classes, NUM, DEN).join(side("a"), "a").join(side("b"), "b")
        return near.where(F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= RADIUS).select("a", "b")

    def hub_pairs(self) -> DataFrame:
        """(a, b) that may link, as many as there are shared shingles at most."""
        return self._fitting(near_pairs(self.shared, NUM, DEN))

    def apart_pairs(self, labels: DataFrame) -> DataFrame:
        """All (a, b) that may link and that ``labels`` (node, label) do not connect."""
        return self._fitting(apart_pairs(self.shared, labels, NUM, DEN, TILE))


def class_labels(rows: DataFrame) -> DataFrame:
    """(node, label) of the shingle-set classes that link with any other. ``rows``: text, fp, sig."""
    classes = staged(rows.where("sig <> X''").select("sig", "fp").dropDuplicates(["sig"]), "near-classes")
    fps = staged(classes.groupBy("fp").agg(F.min("sig").alias("sig"), F.count("*").alias("n")), "near-fps")
    links = staged(met_pairs(fps.select("fp")), "near-met")
    both = links.select(F.col("a").alias("fp"), F.col("b").alias("other"), "bits", "large").union(links.select("b", "a", "bits", "large"))
    nearest_of = staged(both.groupBy("fp").agg(F.min(F.struct("bits", "other")).alias("near"), F.max("large").alias("large")), "nearest")
    meeting = fps.join(nearest_of, "fp", "left").where("near IS NOT NULL OR n > 1").select("fp", (F.coalesce("large", F.lit(False)) | (F.col("n") > 1)).alias("wide"))
    meeting = staged(classes.join(meeting, "fp"), "near-meeting")
    texts = staged(class_texts(rows, meeting.select("sig")), "near-texts")
    sets = staged(class_grams(texts), "near-sets")

    def checked(pairs: DataFrame) -> DataFrame:
        near = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        return staged(verified(near, sets, NUM, DEN), "near-links")

    of = lambda fp, sig: fps.select(F.col("fp").alias(fp), F.col("sig").alias(sig))
    first = nearest_of.select("fp", "near.other").join(of("fp", "a"), "fp").join(of("other", "b"), "other").select("a", "b")
    alike = classes.alias("c").join(fps.where("n > 1").alias("f"), "fp").where("c.sig <> f.sig").select(F.col("f.sig").alias("a"), F.col("c.sig").alias("b"))
    found = first.union(alike)
    several = meeting.where("wide")
    wide = None if several.isEmpty() else Wide(staged(several.select("sig", "fp").join(texts, "sig"), "near-wide"))
    labels = components(checked(found.union(wide.hub_pairs()) if wide else found))

    # Pairs of two wide classes are the second turn's; with one of another kind, a pair met in a small run.
    labelled = meeting.join(labels, meeting.sig == labels.node, "left").select("fp", "sig", "wide", F.coalesce("label", "sig").alias("label"))
    labelled = staged(labelled, "near-labelled")
    side = lambda p: labelled.select(F.col("fp").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("label", "sig", "wide")])
    pairs = links.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("a_label <> b_label AND NOT (a_wide AND b_wide)")
    pairs = pairs.select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"))
    more = checked(pairs.union(wide.apart_pairs(labels)) if wide else pairs)
    return labels if more.isEmpty() else staged(joined_labels(labels, more), "near-labels")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id (of repeated rows, one)."""
    safe, back = set_aside(docs, ("fp", "sig", "row_no"))
    rows = staged(with_keys(safe, text_col).withColumn("row_no", F.monotonically_increasing_id()), "near-documents")
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    labels = class_labels(rows.select(text, "fp", "sig"))
    narrow = rows.select(F.col(f"`{id_col}`").alias("doc_id"), "sig", "row_no")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    by_sig = narrow.groupBy("sig").agg(F.min(order).alias("first"))
    named = by_sig.join(labels, by_sig.sig == labels.node, "left").select("first", F.coalesce("label", "sig").alias("root"))
    stay = staged(named.groupBy("root").agg(F.min("first").alias("first")).select("first.row_no"), "near-stay")
    gone = staged(narrow.select("row_no").join(stay, "row_no", "left_anti"), "near-gone")
    if gone.count() * 64 <= broadcast_bytes:  # what a row takes in a joined map
        gone = F.broadcast(gone)
    return rows.join(gone, "row_no", "left_anti").select(*back)
