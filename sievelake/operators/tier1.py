"""Tier 1: identical bytes of a tenant share one blob."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.library import blob_path


def blobs(uploads: DataFrame) -> DataFrame:
    """One row per (user, hash): the first upload owns it, every upload refers to it. A map-side combined
    aggregate, so any number of copies of one file moves one row per task."""
    grouped = uploads.groupBy("user_id", "sha256_hash").agg(
        F.min("upload_seq").alias("first_seq"), F.first("size_bytes").alias("size_bytes"), F.count("*").alias("ref_count")
    )
    return grouped.withColumn("storage_path", blob_path("user_id", "sha256_hash"))


def with_tier1(uploads: DataFrame) -> DataFrame:
    """``uploads`` with deduplicated: whether its bytes were already there when it came."""
    first = blobs(uploads).select("user_id", "sha256_hash", "first_seq")
    joined = uploads.join(first, ["user_id", "sha256_hash"])
    return joined.withColumn("deduplicated", F.col("upload_seq") > F.col("first_seq")).drop("first_seq")


def lookup(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads with the stored blob of the same tenant and hash, null if there is none."""
    return uploads.join(stored.select("user_id", "sha256_hash", F.col("id").alias("blob_id")), ["user_id", "sha256_hash"], "left")


def increment_refs(stored: DataFrame, hits: DataFrame) -> DataFrame:
    """Blobs with one more reference for each hit (user_id, sha256_hash)."""
    more = hits.groupBy("user_id", "sha256_hash").agg(F.count("*").alias("_n"))
    joined = stored.join(more, ["user_id", "sha256_hash"], "left")
    return joined.withColumn("ref_count", F.col("ref_count") + F.coalesce("_n", F.lit(0))).select(*stored.columns)


def running_file_count(uploads: DataFrame) -> DataFrame:
    """(user_id, file_id, n_files): a tenant's files up to and with this one; with ``gone_seq``, those still there.

    Counted by buckets of the upload order and then within each, so that one large tenant is split.
    """
    if "gone_seq" in uploads.columns:
        return _living_file_count(uploads)
    bucket = F.expr("upload_seq div 4096")
    rows = uploads.select("user_id", "file_id", "upload_seq", bucket.alias("_b"))
    sums = rows.groupBy("user_id", "_b").agg(F.count("*").alias("_n"))
    sums = sums.select("user_id", "_b", (F.sum("_n").over(W.partitionBy("user_id").orderBy("_b")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("user_id", "_b").orderBy("upload_seq", "file_id"))
    return rows.withColumn("_rn", own).join(sums, ["user_id", "_b"]).select("user_id", "file_id", (F.col("_before") + F.col("_rn")).alias("n_files"))


def _living_file_count(uploads: DataFrame) -> DataFrame:
    """As `running_file_count`, over arrivals that add one and deletes that take one away."""
    came = uploads.select("user_id", F.col("upload_seq").alias("_at"), F.lit(1).alias("_step"), "file_id")
    went = uploads.where("gone_seq IS NOT NULL").select("user_id", F.col("gone_seq").alias("_at"), F.lit(-1).alias("_step"))
    steps = came.unionByName(went, allowMissingColumns=True).withColumn("_b", F.expr("_at div 4096"))
    sums = steps.groupBy("user_id", "_b").agg(F.sum("_step").alias("_n"))
    sums = sums.select("user_id", "_b", (F.sum("_n").over(W.partitionBy("user_id").orderBy("_b")) - F.col("_n")).alias("_before"))
    own = W.partitionBy("user_id", "_b").orderBy("_at", "file_id").rowsBetween(W.unboundedPreceding, 0)
    counted = steps.withColumn("_sum", F.sum("_step").over(own)).where("_step = 1").join(sums, ["user_id", "_b"])
    return counted.select("user_id", "file_id", (F.col("_before") + F.col("_sum")).alias("n_files"))


#: Places of the event order that one group of `with_living_tier1` spans.
LIFE_RANGE = 1 << 16


def with_living_tier1(uploads: DataFrame) -> DataFrame:
    """``uploads`` (with gone_seq, null while a file is there) with deduplicated: whether a file of the same bytes
    was still there when it came. The last of them to go takes the blob along, and the next upload stores it anew.

    The latest end of the files before is carried over ranges of the event order, then taken within each, so
    that copies which a tenant holds by the million are not ordered in one group.
    """
    never = F.coalesce("gone_seq", F.lit((1 << 63) - 1))
    rows = uploads.withColumn("_end", never).withColumn("_range", F.expr(f"upload_seq div {LIFE_RANGE}"))
    ends = rows.groupBy("user_id", "sha256_hash", "_range").agg(F.max("_end").alias("_last"))
    over = W.partitionBy("user_id", "sha256_hash").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("user_id", "sha256_hash", "_range", F.max("_last").over(over).alias("_before"))
    own = W.partitionBy("user_id", "sha256_hash", "_range").orderBy("upload_seq", "file_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.max("_end").over(own)).join(ends, ["user_id", "sha256_hash", "_range"])
    held = F.greatest(F.coalesce("_own", F.lit(-1)), F.coalesce("_before", F.lit(-1)))
    return rows.select(*uploads.columns, (held > F.col("upload_seq")).alias("deduplicated"))
