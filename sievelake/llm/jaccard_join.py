"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its distinct word n-grams; documents with one set are one class,
known by a 128-bit digest, so copies are compared once however many there are. Two sets of n and m link at a
Jaccard similarity of ``num`` / ``den``, that is at an overlap of need(n, m) = ceil(num * (n + m) / (num + den)).

1. One narrow pass gives each document its size, digest and cuts (4.), and each task's counts of all n-grams, folded to
   ``SKETCH`` counters. The counters of all tasks added up put every n-gram in one global order, rarest
   first. Any order gives the same links; a collision only makes an n-gram look more frequent.
2. Prefix filter: a link shares an n-gram within the first n - ceil(num * n / den) + 1 of both sets. Each class
   emits those with its size and their places; they are shuffled by n-gram, and all that only one class has are
   dropped.
3. Length filter: num * m <= den * n. Positional filter: meeting at places i and j, at most
   1 + min(n - i - 1, m - j - 1) can be shared if it is the first n-gram that both have, which it is at one
   meeting of each link. Pairs are made distinct, so each is verified once.
4. Suffix filter: sets are cut at ``PIVOTS`` - 1 fixed pivots of the hashes; the smaller of both parts, added
   up, bounds the overlap. It is taken from a narrow table, before any set moves.
5. Pairs that are left are verified on the whole sets, which are made again from the texts of their classes only.

Only components are asked for, so pairs that are connected already need no look. The meetings come in two
turns: first each member of a group of one n-gram with its ``HUBS`` members that share most n-grams with others, the
least changed of a family, and with those 1, 2, 4 and 8 places before it by size; then all members whose
components still differ. A group of like texts is connected by the first turn, with links as many as members, and
never gives all its pairs; what the first turn leaves apart is looked up exactly, whatever its number, and joins
components, not members. Groups above ``TILE`` members are cut to tiles, and each two tiles are a task.

Defined results: null, empty and blank texts have no set and link with nothing; with fewer words than n the whole
sequence is the one n-gram; long texts are hashed in pieces; a component's id is its smallest doc_id, null ids
never name one unless all are null; repeated rows are of one class; columns beyond id and text are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, binaries, staged, table
from .simhash import components

WIDTH = 3
NUM, DEN = 90, 100
SEED = 7
SKETCH_BITS = 22
CHUNK_BITS = 16
PIVOTS = 64
TILE = 1024
STRIDES = (1, 2, 4, 8)
HUBS = 4
PIECE_WORDS = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ngram_set(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; empty without words."""
    words = (raw or b"").translate(_LOWER).split()
    if len(words) < width:
        grams = [b" ".join(words)] if words else []
        return np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64)
    parts = []
    for a in range(0, len(words) - width + 1, PIECE_WORDS):
        own = words[a : a + PIECE_WORDS + width - 1]
        digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*[own[i:] for i in range(width)], strict=False)), repeat(SEED)))
        parts.append(np.unique(np.frombuffer(digests, ">u8").astype(np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def need(n, m, num: int = NUM, den: int = DEN):
    """The overlap that links sets of n and m."""
    return -(-num * (n + m) // (num + den))


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def cuts(grams: np.ndarray) -> np.ndarray:
    """How many hashes stand in each of ``PIVOTS`` equal parts of their range."""
    ends = np.arange(1, PIVOTS, dtype=np.uint64) * np.uint64((1 << 64) // PIVOTS)
    return np.diff(np.searchsorted(grams, ends), prepend=0, append=len(grams)).astype(np.int32)


def set_keys(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per document (doc_id, n, sig, cuts; sig null without words) and rows of the tasks' counters (chunk, counts)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "n", "sig", "cuts", "chunk", "counts"]
        for batch in batches:
            sizes, sigs, parts, waiting, held = [], [], [], [], 0
            for raw in binaries(batch.column(1)):
                grams = ngram_set(raw, width)
                sizes.append(len(grams))
                sigs.append(digest(grams) if len(grams) else None)
                parts.append(cuts(grams))
                waiting.append((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                held += len(grams)
                if held > 1 << 21:
                    counters += np.bincount(np.concatenate(waiting), minlength=len(counters)).astype(np.int32)
                    waiting, held = [], 0
            if waiting:
                counters += np.bincount(np.concatenate(waiting), minlength=len(counters)).astype(np.int32)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(parts, pa.list_(pa.int32())), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for k, part in enumerate(counters.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                none = pa.nulls(1)
                own = pa.array([zlib.compress(part.astype("<i4").tobytes(), 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([none.cast(batch.schema.field(0).type), none.cast(pa.int64()), none.cast(pa.binary()), pa.nulls(1, pa.list_(pa.int32())), pa.array([k], pa.int32()), own], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, n long, sig binary, cuts array<int>, chunk int, counts binary")


def rarity(keys: DataFrame) -> np.ndarray:
    """For each counter its place among 256 grades of frequency: exact up to 127, then by doublings in eighths."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                body = zlib.decompress(data)
                total += np.frombuffer(body, "<i4" if len(body) == 4 << CHUNK_BITS else "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    own = keys.where("chunk IS NOT NULL").select("chunk", "counts")
    # In two steps, so that no task takes the counters of all tasks at once.
    some = own.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary")
    grades = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").toLocalIterator():
        count = np.frombuffer(zlib.decompress(r.counts), "<i8")
        high = 127 + 8 * np.log2(np.maximum(count, 127) / 127)
        grades[r.chunk << CHUNK_BITS : r.chunk + 1 << CHUNK_BITS] = np.minimum(np.where(count < 128, count, high), 255)
    return grades


def prefixes(docs: DataFrame, grades: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """(gram, sig, n, place): the rarest n-grams of each class, each class once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(grades)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        order = shared.value
        for batch in batches:
            grams, sigs, sizes, lengths = [], [], [], []
            for raw in binaries(batch.column(0)):
                own = ngram_set(raw, width)
                if not len(own) or (sig := digest(own)) in seen:
                    continue
                seen.add(sig)
                k = prefix_length(len(own), num, den)
                grade = order[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                grams.append(own[np.argsort(grade, kind="stable")[:k]])  # by grade, then by hash
                sigs.append(sig)
                sizes.append(len(own))
                lengths.append(k)
            if grams:
                which = np.repeat(np.arange(len(sigs)), lengths)
                places = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(sigs, pa.binary()).take(pa.array(which)), pa.array(np.array(sizes, np.int32)[which]), pa.array(places)],
                    names=["gram", "sig", "n", "place"],
                )

    return docs.select("text").mapInArrow(run, "gram long, sig binary, n int, place int")


def shared_prefixes(found: DataFrame) -> DataFrame:
    """The rows of n-grams that several classes have in their prefixes, each class once."""
    own = W.partitionBy("gram")
    several = found.withColumn("_a", F.min("sig").over(own)).withColumn("_b", F.max("sig").over(own)).where("_a <> _b")
    return several.dropDuplicates(["gram", "sig"]).drop("_a", "_b")


def _filters(num: int, den: int) -> str:
    """Length and positional filter on the n and place of both sides; b is the larger set."""
    most = "least(a_n - a_place, b_n - b_place)"  # this n-gram and what is behind it
    return f"{num}L * b_n <= {den}L * a_n AND {num + den}L * ({most}) >= {num}L * (a_n + b_n)"


def near_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b): each class of an n-gram with its hubs, and with those a few places before it by size."""
    degrees = shared.groupBy("sig").agg(F.count("*").alias("degree"))
    by_size = W.partitionBy("gram").orderBy("n", "sig")
    by_degree = W.partitionBy("gram").orderBy(F.desc("degree"), "sig").rowsBetween(W.unboundedPreceding, 0)
    other = F.struct("sig", "n", "place")
    others = [F.lag(other, k).over(by_size) for k in STRIDES] + [F.nth_value(other, k).over(by_degree) for k in range(1, HUBS + 1)]
    met = shared.join(degrees, "sig").withColumn("others", F.array(*others)).withColumn("x", F.explode("others"))
    met = met.where("x.sig IS NOT NULL AND x.sig <> sig").select(F.struct("sig", "n", "place").alias("y"), "x")
    # The larger set is b.
    small, large = F.when(F.col("x.n") <= F.col("y.n"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.n") <= F.col("y.n"), F.col("y")).otherwise(F.col("x"))
    met = met.select(small.alias("s"), large.alias("l")).select(*[F.col(f"{v}.{c}").alias(n) for v, p in (("s", "a"), ("l", "b")) for c, n in (("sig", p), ("n", f"{p}_n"), ("place", f"{p}_place"))])
    return _distinct(met.where(_filters(num, den)))


def apart_pairs(shared: DataFrame, labels: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """Distinct (a, b): all classes with an n-gram in common that ``labels`` (node, label) do not connect yet."""
    own = W.partitionBy("gram")
    rows = shared.join(labels, shared.sig == labels.node, "left").withColumn("label", F.coalesce("label", "sig")).drop("node")
    rows = rows.withColumn("_a", F.min("label").over(own)).withColumn("_b", F.max("label").over(own)).where("_a <> _b").drop("_a", "_b")
    rank = F.row_number().over(own.orderBy("n", "sig"))
    rows = rows.withColumn("rank", rank).withColumn("tile", F.expr(f"cast((rank - 1) div {tile} AS int)")).withColumn("last", F.max("tile").over(own))
    side = lambda p, x, y: rows.select("gram", *[F.col(c).alias(f"{p}_{c}") for c in ("sig", "n", "place", "label", "rank")], x.alias("x"), y.alias("y"))
    a = side("a", F.col("tile"), F.explode(F.sequence("tile", "last")))
    b = side("b", F.explode(F.sequence(F.lit(0), F.col("tile"))), F.col("tile"))
    met = a.join(b, ["gram", "x", "y"]).where("a_rank < b_rank AND a_label <> b_label").where(_filters(num, den))
    return _distinct(met.withColumnsRenamed({"a_sig": "a", "b_sig": "b"}))


def _distinct(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def suffix_filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose cuts leave room for the overlap. ``classes``: sig, n, cuts."""
    side = lambda p: classes.select(F.col("sig").alias(p), F.col("n").alias(f"{p}_n"), F.col("cuts").alias(f"{p}_cuts"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.aggregate(F.zip_with("a_cuts", "b_cuts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return both.where((num + den) * most.cast("long") >= num * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def class_sets(docs: DataFrame, keys: DataFrame, wanted: DataFrame, width: int, broadcast_bytes: int) -> DataFrame:
    """(sig, grams) of the wanted classes (sig), made again from one text of each."""
    first = staged(keys.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("first_id")), "first-ids")
    ids, sigs = first.select("first_id").distinct(), first.select("sig")
    if first.count() * 32 <= broadcast_bytes:
        ids, sigs = F.broadcast(ids), F.broadcast(sigs)
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.first_id), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for raw in binaries(batch.column(0)):
                own = ngram_set(raw, width)
                if not len(own) or (sig := digest(own)) in seen:
                    continue
                seen.add(sig)
                yield pa.RecordBatch.from_arrays([pa.array([sig], pa.binary()), pa.array([own.tobytes()], pa.binary())], names=["sig", "grams"])

    return texts.mapInArrow(run, "sig binary, grams binary").join(sigs, "sig", "left_semi").dropDuplicates(["sig"])


def verified(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``near`` whose whole sets link."""
    whole = near.join(sets.select(F.col("sig").alias("a"), F.col("grams").alias("a_grams")), "a")
    whole = whole.join(sets.select(F.col("sig").alias("b"), F.col("grams").alias("b_grams")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for left, right in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                common = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                fits.append(common >= need(len(x), len(y), num, den))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return whole.select("a", "b", "a_grams", "b_grams").mapInArrow(check, "a binary, b binary")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further ``links``, which join components as a whole."""
    for p in "ab":
        own = labels.select(F.col("node").alias(p), F.col("label").alias(f"{p}_label"))
        links = links.join(own, p, "left").withColumn(f"{p}_label", F.coalesce(f"{p}_label", p))
    upper = components(links.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()).toDF("label", "top")
    named = labels.join(upper, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    # Classes that no link had before stand in for themselves.
    alone = upper.join(labels.select(F.col("node").alias("label")), "label", "left_anti").toDF("node", "label")
    return named.unionByName(alone)


def jaccard_components(
    docs: DataFrame,
    num: int = NUM,
    den: int = DEN,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    tile: int = TILE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; links are at a similarity of num / den."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = staged(set_keys(docs, width), "set-keys")
    keys = made.where("chunk IS NULL").select("doc_id", "n", "sig")
    shared = staged(shared_prefixes(prefixes(docs, rarity(made), width, num, den)), "shared-prefixes")
    classes = staged(made.where("sig IS NOT NULL").select("sig", "n", "cuts").dropDuplicates(["sig"]), "classes")

    def links_of(pairs: DataFrame) -> DataFrame:
        near = staged(suffix_filtered(pairs, classes, num, den), "near-pairs")
        ends = near.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        return staged(verified(near, staged(class_sets(docs, keys, ends, width, broadcast_bytes), "class-sets"), num, den), "links")

    labels = components(links_of(near_pairs(shared, num, den)))
    more = links_of(apart_pairs(shared, labels, num, den, tile))
    if not more.isEmpty():
        labels = joined_labels(labels, more)
    classes = keys.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("first_id"))
    named = classes.join(labels, classes.sig == labels.node, "left").select("sig", "first_id", F.coalesce("label", "sig").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = staged(named.join(smallest, "root").select("sig", "component_id"), "class-components")
    return keys.join(of_class, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
spans AS (SELECT doc_id, i, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS g FROM words),
grams AS (SELECT DISTINCT doc_id, g FROM spans WHERE i = 1 OR i <= n - {WIDTH - 1}),
sizes AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
half AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
shared AS (SELECT a, b, c FROM half UNION ALL SELECT b, a, c FROM half),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(r) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""
