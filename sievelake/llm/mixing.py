"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source's rows, in the order of a hash of their id, form blocks of ``block_rows``, and each block gets
a slot of its own. By default weights are met exactly and any number of sources is scheduled: sources are
the leaves of a binary tree that halves the weight as well as it can, and at each node the t-th slot is
the left branch's where round(t * p) steps, p being its share of the node's weight. A node is never more
than half a slot from its share and passes on only its branch's part of that, so after any number of slots
each source is less than two blocks from its share (`worst_deviation`). A block's slot follows in closed form
from its place in its source, up the tree; places come from counts of rows in ranges of slots. Shares are
held to a part in 2^30, which is less than a block in 10^9 slots; a weight of 0 comes last, sources of it in turns.

With ``slots`` given, weights become whole parts c of that period Q (one part each, the rest in proportion
with largest remainder). Block i of a source is released at floor(i * Q / c) and due at
ceil((i + 1) * Q / c); each slot goes to the released block with the earliest deadline. As the parts fill the
period, every deadline is met, so after any number of slots each source is less than one block away from its
parts; the parts are off the weights by their rounding, which adds up over periods. The schedule repeats after
Q slots, so one period is computed, as a fold over Q slots on one row. More sources than slots is an error
there. `op5_mix_sources` has the period of 1,000 slots that its SQL has, while its sources fit;
`op5_mix_weights` and the pipeline meet the weights.

Either way no global sort is needed. Where a source has run out, its slots are skipped and the others go on
in proportion; no row is lost, repeated or cut. The one table of sources (name and rows) is gathered on the
driver for the tree.

Ranks within a source need no window over the source: rows are ranked in (source, hash prefix) groups of
about ``GROUP_ROWS`` and the groups' counts are summed, so a source with a third of all rows is split
like any other. With a period, what is broadcast has at most Q rows.

Defined results: a null source is the source ''; weights name sources, a source without one takes
``default_weight``; weights of absent sources are ignored; null ids come first in their source; rows
of one id keep places of their own, in the order of a hash of their columns; an empty table gives an empty
result; clashing columns are replaced.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import set_aside, table

BLOCK_ROWS = 16
SLOTS = 1000
GROUP_ROWS = 50_000
ONE = 1 << 30
LAST_SLOT = 1 << 32
RANGE_SLOTS = 2_000
BROADCAST_SOURCES = 10_000
RESULT = ("mix_source", "mix_block", "mix_slot", "mix_position")


def source_parts(counts: DataFrame, weights: dict[str, float] | None, default_weight: float, slots: int) -> DataFrame:
    """(mix_source, n, c): whole parts of the period by largest remainder. ``counts``: a row per source."""
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        weight = F.coalesce(known[F.col("mix_source")], F.lit(default_weight)) if weights else F.lit(default_weight)
    everything = W.partitionBy(F.lit(0))
    share = F.col("weight") / F.sum("weight").over(everything) * (slots - F.count("*").over(everything))
    whole = counts.select("mix_source", "n", weight.alias("weight")).select("mix_source", "n", share.alias("share"))
    floor = 1 + F.floor("share")
    left = slots - F.sum(floor).over(everything)
    place = F.row_number().over(everything.orderBy(F.desc(F.col("share") - F.floor("share")), "mix_source"))
    return whole.select("mix_source", "n", (floor + (place <= left).cast("int")).cast("long").alias("c"))


def period(parts: DataFrame, slots: int) -> DataFrame:
    """One row per slot of the period: mix_source, j (its j-th block in the period), slot, before (blocks
    of each source in earlier slots of the period), and arrays n and c over all sources."""
    one = parts.groupBy().agg(F.sort_array(F.collect_list(F.struct("mix_source", "n", "c"))).alias("s"))
    one = one.where(
        F.when(F.size("s") > slots, F.raise_error(F.lit(f"more sources than the period's {slots} slots"))).otherwise(F.size("s") > 0)
    ).select(F.col("s.mix_source").alias("names"), F.col("s.n").alias("n"), F.col("s.c").alias("c"))
    fold = f"""
        aggregate(sequence(0L, {slots - 1}L),
          named_struct('done', transform(c, x -> 0L),
                       'out', cast(array() AS array<struct<pick: int, j: bigint, before: array<bigint>>>)),
          (acc, t) -> transform(
            array(array_min(transform(c, (x, s) -> named_struct(
              'due', if(acc.done[s] * {slots}L div x > t, {1 << 60}L, ((acc.done[s] + 1L) * {slots}L + x - 1L) div x),
              's', s))).s),
            p -> named_struct(
              'done', transform(acc.done, (d, s) -> if(s = p, d + 1L, d)),
              'out', concat(acc.out, array(named_struct('pick', p, 'j', acc.done[p], 'before', acc.done)))))[0],
          acc -> acc.out)
    """
    listed = one.select("names", "n", "c", F.posexplode(F.expr(fold)).alias("slot", "o"))
    return listed.select(
        F.col("names")[F.col("o.pick")].alias("mix_source"),
        F.col("c")[F.col("o.pick")].alias("own_c"),
        F.col("o.j").alias("j"),
        F.col("slot").cast("long").alias("slot"),
        F.col("o.before").alias("before"),
        F.col("n").alias("all_n"),
        F.col("c").alias("all_c"),
    )


def tree_paths(weight: dict[str, float]) -> dict[str, list[tuple[int, bool]]]:
    """For each source its steps from the leaf up: the branch's share of the node, of ``ONE``, and whether it is left."""
    names = sorted(weight, key=lambda s: (weight[s], s))  # small ones first, so that sums keep them
    sums = [0.0, *itertools.accumulate(weight[s] for s in names)]
    paths: dict[str, list[tuple[int, bool]]] = {s: [] for s in names}
    nodes, splits = [(0, len(names))], []
    while nodes:
        a, b = nodes.pop()
        if b - a < 2:
            continue
        m = min(max(bisect.bisect(sums, (sums[a] + sums[b]) / 2, a, b + 1), a + 1), b - 1)
        if m - 1 > a and sums[m] + sums[m - 1] > sums[a] + sums[b]:
            m -= 1  # the cut that is nearer to half
        total = sums[b] - sums[a]
        left = (sums[m] - sums[a]) / total if total > 0 else (m - a) / (b - a)
        splits.append((a, m, b, min(max(round(left * ONE), 1), ONE - 1)))
        nodes += [(a, m), (m, b)]
    for a, m, b, left in reversed(splits):
        for k in range(a, b):
            paths[names[k]].append((left, True) if k < m else (ONE - left, False))
    return paths


def worst_deviation(path: list[tuple[int, bool]]) -> float:
    """What a source with this path can be off its share, in blocks."""
    off = 0.0
    for share, _ in reversed(path):
        off = 0.5 + share / ONE * off
    return off


def slotted(docs: DataFrame, weights: dict[str, float] | None, default_weight: float, block_rows: int, source_col: str, id_col: str) -> tuple[DataFrame, list]:
    """``_ranked`` rows with mix_slot, by exact weights, and the selection of the input's columns."""
    ranked, counts, kept = _ranked(docs, block_rows, source_col, id_col)
    n_rows = {r.mix_source: r.n for r in counts.collect()}  # a row per source
    weight = {s: math.sqrt(n) if weights is None else float(weights.get(s, default_weight)) for s, n in n_rows.items()}
    paths = docs.sparkSession.createDataFrame(list(tree_paths(weight).items()), "mix_source string, _path array<struct<share: bigint, left: boolean>>")
    if len(n_rows) <= BROADCAST_SOURCES:
        paths = F.broadcast(paths)
    # In whole numbers, so that the two branches of a node never claim one slot.
    half = f"(2L * j + 1L) * {ONE // 2}L"
    slot = F.expr(f"aggregate(_path, mix_block, (j, x) -> least(if(x.left, ({half} - 1L) div x.share, {half} div x.share), {LAST_SLOT}L))")
    placed = ranked.join(paths, "mix_source").withColumn("mix_slot", slot).drop("_path")
    # What comes after all slots that are told apart, as all of a weight of 0 does, takes turns block by block.
    return placed.withColumn("mix_slot", F.when(F.col("mix_slot") < LAST_SLOT, F.col("mix_slot")).otherwise(LAST_SLOT + F.col("mix_block"))), kept


def _by_weights(docs: DataFrame, *options) -> DataFrame:
    placed, kept = slotted(docs, *options)
    near = placed.withColumn("_range", F.expr(f"mix_slot div {RANGE_SLOTS}"))
    ranges = near.groupBy("_range").agg(F.count("*").alias("_n"))
    coarse = ranges.withColumn("_top", F.expr(f"_range div {RANGE_SLOTS}"))
    tops = coarse.groupBy("_top").agg(F.sum("_n").alias("_tn"))
    tops = tops.select("_top", (F.sum("_tn").over(W.partitionBy(F.lit(0)).orderBy("_top")) - F.col("_tn")).alias("_tb"))
    within = F.sum("_n").over(W.partitionBy("_top").orderBy("_range")) - F.col("_n")
    starts = coarse.select("_top", "_range", within.alias("_rb")).join(tops, "_top").select("_range", (F.col("_tb") + F.col("_rb")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy("mix_slot", "mix_source", "_rank"))
    done = near.withColumn("_place", place).join(starts, "_range")
    return done.select(*kept, "mix_source", "mix_block", "mix_slot", (F.col("_before") + F.col("_place") - 1).alias("mix_position"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    block_rows: int = BLOCK_ROWS,
    slots: int | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with mix_source, mix_block (its block in its source), mix_slot and mix_position (its place
    in the mixture, from 0). Without weights a source weighs the square root of its rows. ``slots``: a fixed
    period instead of exact weights."""
    if slots is None:
        return _by_weights(docs, weights, default_weight, block_rows, source_col, id_col)
    ranked, counts, kept = _ranked(docs, block_rows, source_col, id_col)
    slots_of = F.broadcast(period(source_parts(counts, weights, default_weight, slots), slots))
    of_source = slots_of.groupBy("mix_source").agg(F.first("own_c").alias("own_c"))
    ranked = ranked.join(F.broadcast(of_source), "mix_source")  # at most a row per slot
    ranked = ranked.withColumn("_k", F.expr("mix_block div own_c")).withColumn("j", F.expr("mix_block % own_c"))
    placed = ranked.join(slots_of.drop("own_c"), ["mix_source", "j"])
    before = F.expr(
        f"aggregate(zip_with(all_n, zip_with(all_c, before, (c, b) -> (_k * c + b) * {block_rows}L), (n, m) -> least(n, m)), 0L, (a, x) -> a + x)"
    )
    return placed.select(
        *kept,
        "mix_source",
        "mix_block",
        (F.col("_k") * slots + F.col("slot")).alias("mix_slot"),
        (before + F.expr(f"_rank % {block_rows}")).alias("mix_position"),
    )


def _ranked(docs: DataFrame, block_rows: int, source_col: str, id_col: str) -> tuple[DataFrame, DataFrame, list]:
    """``docs`` with mix_source, _rank and mix_block, the rows (n) of each source, and the selection that
    gives the input's columns back."""
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    # The input's columns go under other names meanwhile, so that none clashes with what is added.
    own_names = {c: f"_in{k}" for k, c in enumerate(docs.columns)}
    docs = docs.toDF(*own_names.values())
    id_col, source_col = own_names[id_col], own_names[source_col]
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(own_names[c]) for c in kept], source.alias("mix_source"), digest.alias("_h"))
    n_rows = docs.count()
    digits = 2
    while 16**digits * GROUP_ROWS < n_rows:
        digits += 1
    rows = rows.withColumn("_g", F.substring("_h", 1, digits))

    groups = rows.groupBy("mix_source", "_g").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("mix_source").orderBy("_g")) - F.col("_n")
    groups = groups.select("mix_source", "_g", earlier.alias("_earlier"))
    counts = rows.groupBy("mix_source").agg(F.count("*").alias("n"))

    # Rows of one id go by their contents, so that a task that runs again gives them the same places.
    alike = [F.col(own_names[c]) for c in kept if not re.search("map<|variant", docs.schema[own_names[c]].dataType.simpleString())]
    own = W.partitionBy("mix_source", "_g").orderBy("_h", id_col, F.xxhash64(F.lit(0), *alike))
    ranked = rows.withColumn("_rn", F.row_number().over(own)).join(groups, ["mix_source", "_g"])
    ranked = ranked.withColumn("_rank", F.col("_earlier") + F.col("_rn") - 1)
    ranked = ranked.withColumn("mix_block", F.expr(f"_rank div {block_rows}"))
    return ranked, counts, [F.col(own_names[c]).alias(c) for c in kept]


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs``, columns as they are, dealt to partitions and sorted by their place in the mixture."""
    safe, back = set_aside(docs, RESULT)
    given = {"weights": None, "default_weight": 1.0, "block_rows": BLOCK_ROWS, "source_col": "source", "id_col": "doc_id"} | options
    mixed, kept = slotted(safe, **given)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["mix_slot", "mix_source", "_rank"]
    return mixed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*kept).select(*back)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    names = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s")).distinct()
    # The SQL's period where it holds all sources.
    slots = SLOTS if names.limit(SLOTS + 1).count() <= SLOTS else None
    return mix_sources(docs, slots=slots).select("doc_id", *RESULT)


def op5_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", *RESULT)


OP5_SQL = f"""
WITH RECURSIVE
src AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
shares AS (SELECT s, n, sqrt(n) / sum(sqrt(n)) OVER () * ({SLOTS} - count(*) OVER ()) AS share FROM src),
floors AS (SELECT *, 1 + floor(share)::BIGINT AS f, row_number() OVER (ORDER BY share - floor(share) DESC, s) AS place FROM shares),
parts AS (SELECT s, n, f + (place <= {SLOTS} - sum(f) OVER ())::BIGINT AS c FROM floors),
lists AS (SELECT list(s ORDER BY s) AS names, list(c ORDER BY s) AS cs FROM parts),
fold(t, done, pick, j, names, cs) AS (
  SELECT -1::BIGINT, list_transform(cs, lambda x: 0::BIGINT), NULL::BIGINT, NULL::BIGINT, names, cs FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + (i = p)::BIGINT), p, done[p], names, cs
  FROM (
    SELECT *, list_min(list_transform(cs, lambda c, i: struct_pack(
        due := CASE WHEN done[i] * {SLOTS} // c > t + 1 THEN {1 << 60} ELSE ((done[i] + 1) * {SLOTS} + c - 1) // c END, i := i))).i AS p
    FROM fold WHERE t < {SLOTS - 1})),
period AS (SELECT names[pick] AS s, cs[pick] AS c, j, t FROM fold WHERE t >= 0),
ranked AS (
  SELECT doc_id, coalesce(source, '') AS s,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r
  FROM documents),
slotted AS (
  SELECT doc_id, s, r, r // {BLOCK_ROWS} AS b, (r // {BLOCK_ROWS}) // p.c * {SLOTS} + q.t AS slot
  FROM ranked JOIN parts p USING (s) JOIN period q USING (s) WHERE q.j = (r // {BLOCK_ROWS}) % p.c)
SELECT doc_id, s AS mix_source, b AS mix_block, slot AS mix_slot, row_number() OVER (ORDER BY slot, r) - 1 AS mix_position
FROM slotted
"""
