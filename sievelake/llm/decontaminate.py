"""Benchmark decontamination with a generalised suffix automaton over normalised item words.

The automaton of the items is streamed over a document: the state after a word carries the longest suffix
of the document that occurs in some item. Where that length reaches the window, the last ``window`` words
stand in an item; items shorter than the window match whole.

Items of up to ``SHARD_WORDS`` words make one automaton, which is broadcast; every document is judged where it
is read, without a shuffle. A larger benchmark is read once and dealt to shards of that size; items that are
longer are cut into parts that share ``window - 1`` words, so no window is lost. Then

1. hashes of all windows are staged with their shards, and a bitmap of them (32 MB at most) is broadcast;
2. one pass over the documents keeps the hashes of their windows that the bitmap may hold, and a join with
   the staged ones, on the few that are left, says which documents need which shards;
3. only those documents move, to their shards' tasks. Such a task first reads its shard's items, builds the
   automaton once and streams its documents through it; a shard that many documents need is dealt to as many
   tasks. Nothing but the bitmap is held by all executors, and each task holds one automaton.

Hits of one document in several shards are merged. Both ways give the same rows.

Defined results: a null or empty text has no words and is clean; items that are null, have a null id
or have no words are ignored; repeated items count once by id; repeated documents are each judged;
an empty table gives an empty result; input columns that clash with the result's names are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, WORD_BYTES, add_columns, binaries, bitmap_of, in_bitmap, set_aside, staged, table, words_of

WINDOW = 13
RESULT = ("n_words", "n_hit", "spans", "items", "n_items", "items_sha256", "contaminated")
SHARD_WORDS = 400_000
#: Bits of the window bitmap, at most, and for each window where there are fewer.
BITMAP_BITS, BITS_EACH = 28, 16
#: Documents that a task takes through a shard.
ROUTED_ROWS = 20_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class ItemAutomaton:
    """Generalised suffix automaton over word ids with, for each state, the items that hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        items = [(key, words) for key, words in items if words]
        coded = [(key, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for key, words in items]
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        for _, ids in coded:
            at = 0
            for c in ids:
                at = self._extend(at, c)
        holds: list[set[str]] = [set() for _ in self.next]
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for key, ids in coded:
            at = 0
            for c in ids:
                at = self.next[at][c]
                holds[at].add(key)
            if len(ids) < window:
                self.whole.setdefault(at, []).append((len(ids), key))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        for v in reversed(order[1:]):
            holds[self.link[v]] |= holds[v]
        #: The state of the last ``window`` words, and the nearest state at or above with whole items.
        self.at_window = [-1] * len(self.next)
        self.at_whole = [-1] * len(self.next)
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
            self.at_whole[v] = v if v in self.whole else (self.at_whole[up] if up >= 0 else -1)
        self.items = {v: frozenset(holds[v]) for v in set(self.at_window) if v >= 0}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def scan(self, words: list[bytes], hit: set[int], found: set[str]) -> None:
        """Add the positions that stand in a window, and the items of those windows."""
        if len(words) < self.shortest or not self.vocab:
            return
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        # Only unbroken runs of item words can hold a window.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        window, nxt, link, length = self.window, self.next, self.link, self.length
        for k in np.flatnonzero(ends - starts >= self.shortest):
            v = n = 0
            for i, c in enumerate(ids[starts[k] : ends[k]].tolist(), int(starts[k])):
                while c not in nxt[v]:
                    if v == 0:
                        n = -1
                        break
                    v = link[v]
                    n = length[v]
                if n < 0:
                    n = 0
                    continue
                v = nxt[v][c]
                n += 1
                if n >= window:
                    u = v if length[link[v]] < window else self.at_window[v]
                    hit.update(range(i - window + 1, i + 1))
                    found |= self.items[u]
                u = self.at_whole[v]
                while u >= 0:
                    for size, key in self.whole[u]:
                        if size <= n:
                            hit.update(range(i - size + 1, i + 1))
                            found.add(key)
                    u = self.at_whole[link[u]] if u else -1


def usable_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of the items that have an id and a text."""
    known = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))


def item_parts(items: DataFrame, shards: int, window: int, shard_words: int) -> DataFrame:
    """(shard, key, body, n): items as words joined by spaces, cut where they are longer than a shard."""
    step = max(shard_words, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                words = words_of(raw)
                for at in range(0, max(len(words) - window + 1, 1) if words else 0, step):
                    part = words[at : at + step + window - 1]
                    body = b" ".join(part)
                    rows.append((xxhash.xxh64_intdigest(body) % shards, key, body.decode(), len(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["shard", "key", "body", "n"])

    return items.mapInArrow(cut, "shard int, key string, body string, n int").distinct()


def window_hashes(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """Hashes of all runs of the given numbers of words."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    found = []
    for n in sizes:
        if len(own) >= n:
            h = np.full(len(own) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ own[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append(h)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def routed_documents(texts: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """(row_no, shard) of the shards whose items may stand in a document. ``texts``: row_no, text."""
    spark = texts.sparkSession
    sizes = sorted(r.n for r in parts.select(F.least("n", F.lit(window)).alias("n")).distinct().collect())  # window rows at most

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw, n in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                h = window_hashes(raw.split(), [min(n, window)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([shard] * len(h), pa.int32())], names=["h", "shard"])

    windows = staged(parts.select("shard", "body", "n").mapInArrow(of_parts, "h long, shard int").distinct(), "windows")
    n_windows = windows.count()
    bits = min(BITMAP_BITS, max(15, (BITS_EACH * n_windows).bit_length()))
    bitmap = spark.sparkContext.broadcast(bitmap_of(windows, "h", bits))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for batch in batches:
            made = [window_hashes(words_of(raw or b""), sizes).view(np.int64) for raw in binaries(batch.column(1))]
            kept = [h[in_bitmap(known, h, bits)].view(np.uint64) for h in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), _long_lists(kept)], names=["row_no", "hs"])

    near = texts.mapInArrow(of_texts, "row_no long, hs array<long>").select("row_no", F.explode("hs").alias("h"))
    if n_windows * 12 <= BROADCAST_BYTES:
        windows = F.broadcast(windows)
    return near.join(windows, "h").select("row_no", "shard").distinct()


def _by_shards(docs: DataFrame, items: DataFrame, shards: int, window: int, text_col: str, shard_words: int) -> DataFrame:
    """``docs`` with _hits: (spans, items) of each shard in which it has any."""
    parts = staged(item_parts(items, shards, window, shard_words), "item-parts")
    docs = staged(docs.withColumn("_row_no", F.monotonically_increasing_id()), "judged")
    texts = docs.select(F.col("_row_no").alias("row_no"), F.col(text_col).alias("text"))
    routed = staged(routed_documents(texts, parts, window), "routed")
    tasks = routed.groupBy("shard").agg(F.ceil(F.count("*") / ROUTED_ROWS).cast("int").alias("tasks"))
    tasks = F.broadcast(tasks) if shards * 8 <= BROADCAST_BYTES else tasks
    own = parts.join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("long").alias("row_no"), "key", F.col("body").alias("text"))
    sent = routed.join(tasks, "shard").join(texts, "row_no").select("shard", F.pmod(F.xxhash64("row_no"), F.col("tasks")).cast("int").alias("task"), "row_no", F.lit(None).cast("string").alias("key"), "text")
    hits = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, automaton = None, [], None
        for batch in batches:
            rows = []
            for shard, task, row_no, key, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), binaries(batch.column(4)), strict=True):
                if (shard, task) != at:
                    at, held, automaton = (shard, task), [], None
                if row_no is None:
                    held.append((key, raw.split()))
                    continue
                if automaton is None:
                    automaton, held = ItemAutomaton(held, window), []
                hit: set[int] = set()
                found: set[str] = set()
                automaton.scan(words_of(raw or b""), hit, found)
                if hit:
                    rows.append((row_no, spans_of(hit), sorted(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), _SPANS, pa.list_(pa.string())), strict=True)], names=["row_no", "spans", "items"])

    # A group's items come first.
    dealt = own.union(sent).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("row_no").asc_nulls_first())
    found = dealt.mapInArrow(scan, hits).groupBy(F.col("row_no").alias("_row_no")).agg(F.collect_list(F.struct("spans", "items")).alias("_hits"))
    return docs.join(staged(found, "hits"), "_row_no", "left").drop("_row_no")


def spans_of(hit: set[int]) -> list[dict]:
    spans: list[dict] = []
    for i in sorted(hit):
        if spans and spans[-1]["end"] == i:
            spans[-1]["end"] = i + 1
        else:
            spans.append({"start": i, "end": i + 1})
    return spans


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_hit: int = 1,
    coverage: tuple[int, int] = (1, 20),
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, spans (word ranges, end exclusive), items,
    n_items, items_sha256 and contaminated: n_hit >= min_hit and n_hit / n_words >= coverage."""
    num, den = coverage
    final = [
        ("n_words", T.LongType()),
        ("n_hit", T.LongType()),
        ("spans", SPANS),
        ("items", T.ArrayType(T.StringType())),
        ("n_items", T.LongType()),
        ("items_sha256", T.StringType()),
        ("contaminated", T.BooleanType()),
    ]
    types = [pa.int64(), pa.int64(), _SPANS, pa.list_(pa.string()), pa.int64(), pa.string(), pa.bool_()]
    items = usable_items(benchmark, item_id, item_text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Empty strings at the ends count as words here, two a text at most.
    size = items.agg(F.sum(F.size(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(-(-(size.words or 0) // shard_words), -(-(size.bytes or 0) // BROADCAST_BYTES))

    def verdicts(rows: list[tuple[int, set[int], set[str]]]) -> list[pa.Array]:
        made = []
        for n, hit, found in rows:
            keys = sorted(found)
            digest = hashlib.sha256(",".join(keys).encode()).hexdigest()
            made.append((n, len(hit), spans_of(hit), keys, len(keys), digest, bool(hit) and len(hit) >= min_hit and den * len(hit) >= num * n))
        return [pa.array([r[c] for r in made], t) for c, t in enumerate(types)]

    if shards <= 1:
        listed = [(r.key, words_of(r.text.encode())) for r in items.collect()]  # a shard's words and 32 MB at most
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(listed, window))

        def run(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for raw in binaries(texts):
                words = words_of(raw or b"")
                rows.append((len(words), set(), set()))
                shared.value.scan(words, *rows[-1][1:])
            return verdicts(rows)

        return add_columns(docs, final, run, text_col)

    def merge(texts: pa.Array, hits: pa.Array) -> list[pa.Array]:
        rows = []
        for raw, parts in zip(binaries(texts), hits.to_pylist(), strict=True):
            hit = {i for p in parts or () for s in p["spans"] for i in range(s["start"], s["end"])}
            rows.append((len(words_of(raw or b"")), hit, {k for p in parts or () for k in p["items"]}))
        return verdicts(rows)

    clash = {n.lower() for n, _ in final} - {text_col.lower()}
    routed = _by_shards(docs.drop(*[c for c in docs.columns if c.lower() in clash]), items, shards, window, text_col, shard_words)
    return add_columns(routed, final, merge, text_col, "_hits").drop("_hits")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, cut: bool = False, **options) -> DataFrame:
    """``docs`` without contaminated rows, or (``cut``) with their matched spans cut out of the text.

    Columns and clean rows stay as they are.
    """
    text_col = options.get("text_col", "text")
    safe, back = set_aside(docs, RESULT)
    judged = find_contamination(safe, benchmark, **options)
    if not cut:
        return judged.where(~F.col("contaminated")).select(*back)
    field = [("_cut", T.StringType())]

    def run(texts: pa.Array, spans: pa.Array, bad: pa.Array):
        made = []
        for text, ranges, gone in zip(binaries(texts), spans.to_pylist(), bad.to_pylist(), strict=True):
            if gone:
                at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
                for r in reversed(ranges):
                    text = text[: at[r["start"]][0]] + text[at[r["end"] - 1][1] :]
            made.append(None if text is None else text.decode())
        return [pa.array(made, pa.string())]

    done = add_columns(judged, field, run, text_col, "spans", "contaminated")
    return done.select(*[F.col("_cut").alias(c) if c == text_col else old for c, old in zip(docs.columns, back, strict=True)])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM norm, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
matched AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN grams USING (n, g)),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM matched) m, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM matched GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
