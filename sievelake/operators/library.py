"""File lists, statistics, lifecycle and tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores


def scoped(df: DataFrame, user_id: str) -> DataFrame:
    """The rows of one tenant."""
    return df.where(F.col("user_id") == user_id)


def scoped_objects(objects: DataFrame, user_id: str, bucket: str = "files") -> DataFrame:
    """Objects of the bucket under the tenant's own folder."""
    return objects.where((F.col("bucket_id") == bucket) & (F.split("name", "/")[0] == user_id))


def write_violations(rows: DataFrame, user_id: str) -> DataFrame:
    """Rows that a tenant may not write; must be empty."""
    return rows.where(~F.col("user_id").eqNullSafe(user_id))


def file_list(files: DataFrame, blobs: DataFrame, pending: DataFrame) -> DataFrame:
    """Files with their blob's references and badges, newest first."""
    refs = blobs.select("user_id", "sha256_hash", "ref_count")
    joined = files.join(refs, ["user_id", "sha256_hash"], "left").join(pending, ["user_id", "file_id"], "left")
    n, dups = F.coalesce("ref_count", F.lit(1).cast("long")), F.coalesce("pending", F.lit(0).cast("long"))
    shared = F.when(n > 1, F.concat(F.lit("Shared storage ×"), n.cast("string")))
    near = F.when(dups > 0, F.concat(dups.cast("string"), F.lit(" possible dup"), F.when(dups == 1, "").otherwise("s")))
    return joined.select(
        "user_id", "file_id", "filename", "upload_seq", scores.format_bytes(F.col("size_bytes")).alias("size"), n.alias("ref_count"),
        dups.alias("pending"), F.when(shared.isNull() & near.isNull(), "—").otherwise(F.concat_ws(" ", shared, near)).alias("badges"),
    ).orderBy(F.desc("upload_seq"))


def library_stats(files: DataFrame, blobs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per tenant: counts, bytes uploaded and stored, ratio, bytes saved, pending pairs."""
    total = files.groupBy("user_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("uploaded"))
    kept = blobs.groupBy("user_id").agg(F.count("*").alias("n_blobs"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("stored"))
    waiting = pairs.where("status = 'pending'").groupBy("user_id").agg(F.count("*").alias("pending"))
    joined = total.join(kept, "user_id", "left").join(waiting, "user_id", "left").na.fill(0)
    return joined.select("*", scores.dedup_ratio(F.col("uploaded"), F.col("stored")).alias("ratio"), F.greatest(F.col("uploaded") - F.col("stored"), F.lit(0)).alias("saved"))


def delete_files(files: DataFrame, blobs: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files left, blobs left with their references, freed blobs). ``deletes``: user_id, file_id.

    Only a tenant's own files go. References are counted from the files that are left.
    """
    left = files.join(deletes.select("user_id", "file_id").distinct(), ["user_id", "file_id"], "left_anti")
    live = left.groupBy("user_id", "sha256_hash").agg(F.count("*").alias("_n"))
    counted = blobs.join(live, ["user_id", "sha256_hash"], "left")
    kept = counted.where("_n IS NOT NULL").withColumn("ref_count", F.col("_n")).select(*blobs.columns)
    freed = counted.where("_n IS NULL").select("user_id", "sha256_hash", "storage_path", "size_bytes")
    return left, kept, freed


def delete_results(files: DataFrame, blobs: DataFrame, deletes: DataFrame) -> DataFrame:
    """For each file deleted, whether its blob went with it and then its path, and the same as ``result`` in JSON.

    Deletes are taken one after another, by ``delete_seq`` if they have it, else by file: the one that takes
    the last reference frees the blob, so each freed blob is told once. Deletes of the same file count once,
    those of files that are not the caller's not at all (see `owned`).
    """
    _, _, freed = delete_files(files, blobs, deletes)
    place = F.col("delete_seq") if "delete_seq" in deletes.columns else F.lit(0).cast("long")
    placed = deletes.select("user_id", "file_id", place.alias("_seq")).groupBy("user_id", "file_id").agg(F.min("_seq").alias("_seq"))
    gone = files.select("user_id", "file_id", "sha256_hash").join(placed, ["user_id", "file_id"])
    last = gone.groupBy("user_id", "sha256_hash").agg(F.max(F.struct("_seq", "file_id")).alias("_last"))
    last = last.join(freed.select("user_id", "sha256_hash", "storage_path"), ["user_id", "sha256_hash"])
    last = last.select("user_id", F.col("_last.file_id").alias("file_id"), "storage_path")
    rows = gone.select("user_id", "file_id").join(last, ["user_id", "file_id"], "left")
    rows = rows.select("user_id", "file_id", F.lit(True).alias("deleted"), F.col("storage_path").isNotNull().alias("blob_deleted"), "storage_path")
    return rows.withColumn("result", F.to_json(F.struct("deleted", "blob_deleted", "storage_path"), {"ignoreNullFields": "false"}))


def cascade(child: DataFrame, deletes: DataFrame, *keys: str) -> DataFrame:
    """Rows of a child table whose file (by any of ``keys``) is not deleted."""
    gone = deletes.select("user_id", F.col("file_id").alias("_gone")).distinct()
    for key in keys or ("file_id",):
        child = child.join(gone.withColumnRenamed("_gone", key), ["user_id", key], "left_anti")
    return child


def foreign_deletes(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """Deletes of files that are not there or not the caller's; must be empty."""
    return deletes.join(files.select("user_id", "file_id"), ["user_id", "file_id"], "left_anti")


def owned(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """``deletes`` as they are; reading them fails where a file is not there or not the caller's."""
    mine = files.select("user_id", "file_id", F.lit(True).alias("_mine")).distinct()
    refused = F.raise_error(F.lit("logical file not found or not owned by caller")).cast("boolean")
    return deletes.join(mine, ["user_id", "file_id"], "left").where(F.when(F.col("_mine"), F.lit(True)).otherwise(refused)).select(*deletes.columns)


def rename_files(files: DataFrame, renames: DataFrame) -> DataFrame:
    """New names (user_id, file_id, new_name) laid over files; blank ones change nothing."""
    parts = renames.select("user_id", "file_id", names.rename_parts(F.col("new_name")).alias("_new"))
    joined = files.join(parts, ["user_id", "file_id"], "left")
    for c in ("filename", "filename_stem", "extension"):
        joined = joined.withColumn(c, F.coalesce(f"_new.{c}", c))
    return joined.select(*files.columns)
