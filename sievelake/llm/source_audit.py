"""Source divergence audit: every group of a language against every other, by systolic rotation.

A group is a source within a language, a term a run of letters. Terms in at least ``MIN_DOCS`` documents of a
language are kept; a group's p of a term is 1 + floor(ONE * (count + 1) / (N + V)), with V kept terms and N their
occurrences in the group, and f = floor((p - q)^2 / q) is what it diverges from a q. All in whole numbers.

1. A narrow pass counts terms by group, with the documents that hold them, in dictionaries of bounded size,
   so the rows that are shuffled are counts, combined per task however hot the group or the term.
2. The kept terms of a language are dealt to shards of about ``SHARD_COUNTS`` counts. A group's part of a
   shard is packed into a compressed vector (gaps between term numbers, and counts). Meanwhile a local heap
   keeps the shard's ``TOP`` best terms of the group against its language; the heaps of all shards are merged.
3. In each shard the groups are dealt to an odd number of blocks, at most ``BLOCKS``. A block stays resident in its
   partition while its peers' compressed vectors circulate: in round r block i meets block i + r, so after all
   rounds each two blocks have met once (round 0 is the block with itself), and a meeting of two groups gives both
   directions. Rounds do not depend on each other, so Spark runs them as one shuffle, a task for each meeting;
   one that is lost is done again. A vector is copied once for each block.
4. Shards' sums are added up, and ranked within a group.

A pair of groups costs the terms that one of them has: those that neither has diverge alike and are counted.

Defined results: null texts, languages and sources are ''; texts without a letter and groups without a kept term
take part with count 0; a language without kept terms gives pairs of value 0; equal values rank by name;
repeated documents count each time; columns beyond text, lang and source are not read; an empty table gives
an empty result. Texts are taken in pieces of ``PIECE`` bytes; only the distinct terms of one are held.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binaries, staged, table

ONE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
SHARD_COUNTS = 1_000_000
BLOCKS = 15
HELD_BYTES = 64 << 20
PIECE = 1 << 20
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a piece ends where a term does."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and LETTERS[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(LETTERS).split()
        at = end


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; each group also has a row with a null term."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, found) in held.items():
                terms = [None, *times]
                n, docs_n = [0, *times.values()], [0, *map(found.__getitem__, times)]
                for a in range(0, len(terms), 100_000):
                    cut = slice(a, a + 100_000)
                    own = pa.array(terms[cut], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), own, pa.array(n[cut], pa.int64()), pa.array(docs_n[cut], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), strict=True):
                times, found = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(times), set()
                for words in terms_of(raw):
                    times.update(words)
                    own.update(words)
                found.update(own)
                # What a new entry of two dictionaries takes, and its letters (a text's mean word stands for them).
                size += (len(times) - before) * (300 + len(raw) // max(len(own), 1)) + 1000
                if size > HELD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, all_counts: int, n_terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / (all_counts + n_terms)), in steps that stay within 64 bits."""
    rest, out, whole = count + 1, np.zeros_like(count), all_counts + n_terms
    out = rest // whole  # 0, or 1 where all counts are this term's
    rest = rest - out * whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending term numbers as gaps, and counts, in the fewest bytes that hold them, compressed."""
    gaps = np.diff(places, prepend=0)
    widths = [next(k for k in (1, 2, 4, 8) if not len(x) or x.max() < 1 << 8 * k - (k == 8)) for x in (gaps, counts)]
    body = b"".join(x.astype(f"<u{k}").tobytes() for x, k in zip((gaps, counts), widths, strict=True))
    return bytes(widths) + zlib.compress(body, 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = data[0], data[1]
    body = zlib.decompress(data[2:])
    n = len(body) // (a + b)
    return np.cumsum(np.frombuffer(body, f"<u{a}", n).astype(np.int64)), np.frombuffer(body, f"<u{b}", n, a * n).astype(np.int64)


def diverge(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Group:
    """A group's part of one shard: where it has terms, its p there, and its p elsewhere."""

    def __init__(self, data: bytes | None, all_counts: int, n_terms: int):
        self.places, counts = unpack(data) if data is not None else (np.zeros(0, np.int64),) * 2
        self.p = shares(counts, all_counts, n_terms) if len(counts) else counts
        self.other = int(shares(np.zeros(1, np.int64), all_counts, n_terms)[0]) if n_terms else 1

    def meet(self, peer: Group, shard_terms: int) -> tuple[int, int]:
        """What this group diverges from its peer, and the peer from it, over the shard's terms."""
        places = np.union1d(self.places, peer.places)
        p, q = np.full(len(places), self.other), np.full(len(places), peer.other)
        p[np.searchsorted(places, self.places)] = self.p
        q[np.searchsorted(places, peer.places)] = peer.p
        neither = shard_terms - len(places)
        one, two = np.array([self.other]), np.array([peer.other])
        return int(diverge(p, q).sum()) + neither * int(diverge(one, two)[0]), int(diverge(q, p).sum()) + neither * int(diverge(two, one)[0])


def packed_groups(counts: DataFrame, kept: DataFrame, groups: DataFrame, n_shards: int, top: int) -> DataFrame:
    """A row per group and shard: the packed vector (null without terms), its heap of best terms, and totals.

    ``kept``: lang, term, shard, place, lang_n; ``groups``: lang, source, total, lang_total, n_terms.
    """
    rows = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).join(groups, ["lang", "source"])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).sort_by("place")
        places, n, lang_n = (whole.column(c).to_numpy() for c in ("place", "n", "lang_n"))
        total, lang_total, n_terms = (whole.column(c)[0].as_py() for c in ("total", "lang_total", "n_terms"))
        p, q = shares(n, total, n_terms), shares(lang_n, lang_total, n_terms)
        value = diverge(p, q)
        more = np.flatnonzero(p > q)
        terms = binaries(whole.column("term").combine_chunks().take(pa.array(more)))
        best = heapq.nsmallest(top, zip((-value[more]).tolist(), terms, strict=True))
        heap = [{"item": t.decode(), "value": -v} for v, t in best]
        kind = pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([pack(places, n)], pa.binary()), pa.array([heap], kind)], names=["lang", "source", "shard", "vector", "heap"])

    made = rows.groupBy("lang", "source", "shard").applyInArrow(run, "lang string, source string, shard int, vector binary, heap array<struct<item: string, value: bigint>>")
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    return every.join(made, ["lang", "source", "shard"], "left")


def tournament(vectors: DataFrame, blocks: int) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of groups of a language.

    ``vectors``: lang, source, shard, shard_terms, total, n_terms, vector. ``blocks`` is odd, so that each two
    blocks meet once in the rounds up to half of it.
    """
    half = (blocks - 1) // 2
    dealt = vectors.withColumn("block", F.expr(f"cast(pmod(row_number() OVER (PARTITION BY lang, shard ORDER BY source), {blocks}) AS int)"))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(half))).alias("round")
    resident = dealt.select("*", rounds, F.lit(True).alias("stays")).withColumn("at", F.col("block"))
    # In round r the block that stays at i meets the one that comes from i + r.
    peer = dealt.select("*", rounds, F.lit(False).alias("stays")).where("round > 0").withColumn("at", F.expr(f"pmod(block - round, {blocks})"))

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay, come = [], []
        shard_terms = 0
        for batch in batches:
            for r in batch.to_pylist():
                shard_terms = r["shard_terms"]
                (stay if r["stays"] else come).append((r["source"], Group(r["vector"], r["total"], r["n_terms"])))
        left, right, values = [], [], []
        for k, (a, one) in enumerate(stay):
            for b, two in come if key[3].as_py() else stay[:k]:
                left += [a, b]
                right += [b, a]
                values += one.meet(two, shard_terms)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])

    meetings = resident.unionByName(peer).groupBy("lang", "shard", "at", "round")
    met = meetings.applyInArrow(meet, "lang string, source string, item string, value long")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    blocks: int = BLOCKS,
    shard_counts: int = SHARD_COUNTS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' with every other source of the language, part
    'term' with the group's ``top`` terms against its language."""
    counts = staged(count_terms(docs, lang_col, source_col, text_col), "term-counts")
    by_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("held"))
    kept = staged(by_lang.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    n_shards = max(1, -(-(kept.agg(F.sum("held")).first()[0] or 0) // shard_counts))
    shard = F.pmod(F.xxhash64("term"), F.lit(n_shards)).cast("int")
    place = F.row_number().over(W.partitionBy("lang", "shard").orderBy("term")).cast("long") - 1
    placed = staged(kept.withColumn("shard", shard).withColumn("place", place).select("lang", "term", "shard", "place", "lang_n"), "placed-terms")

    langs = placed.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("n_terms"))
    totals = counts.join(placed.select("lang", "term"), ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = staged(groups.na.fill(0, ["total", "lang_total", "n_terms"]), "groups")

    packed = packed_groups(counts, placed, groups, n_shards, top)
    sizes = placed.groupBy("lang", "shard").agg(F.count("*").alias("shard_terms"))
    packed = staged(packed.join(sizes, ["lang", "shard"], "left").na.fill(0, ["shard_terms"]), "group-vectors")

    pairs = tournament(packed.drop("heap"), blocks).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = packed.select("lang", "source", F.lit("term").alias("part"), F.inline("heap"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(order)) for rows in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, k.c AS lc, coalesce(c.c, 0) AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (SELECT e.*, 1 + {ONE}::HUGEINT * (c + 1) // ((sum(c) OVER (PARTITION BY e.lang, source)) + v) AS p, 1 + {ONE}::HUGEINT * (lc + 1) // (n + v) AS q FROM every e JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM all_pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
