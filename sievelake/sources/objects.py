"""Objects of the blob store, put and removed by tasks, with an outcome for each.

An object's path is its tenant and hash, so what is written twice is the same. It is written under a name of the
attempt and then renamed: a task that is lost or runs twice leaves no half object, and the one that is there stays
as it is. What cannot be put or removed gives a row with the reason and fails nothing else; the tables are right
without the object's removal. Outcomes are staged, so that reading them again repeats no side effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library import blob_path
from .stage import staged


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def put_objects(uploads: DataFrame, root: str) -> DataFrame:
    """Store (user_id, sha256_hash, content) under ``root``, each once: rows with storage_path, and outcome
    'stored', 'already exists' or 'failed' with the reason as storage_warning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(root)
        for batch in batches:
            outcomes, warnings = [], []
            for path, content in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                target = f"{base}/{path}"
                outcome, warning = "already exists", None
                try:
                    if system.get_file_info(target).type == pafs.FileType.NotFound:
                        system.create_dir(target.rpartition("/")[0], recursive=True)
                        own = f"{target}.{uuid.uuid4().hex}"
                        with system.open_output_stream(own) as out:
                            out.write(content.as_buffer())
                        system.move(own, target)
                        outcome = "stored"
                except OSError as e:
                    outcome, warning = "failed", f"storage upload failed: {e.strerror or e}"
                outcomes.append(outcome)
                warnings.append(warning)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(outcomes), pa.array(warnings, pa.string())], names=["user_id", "sha256_hash", "storage_path", "outcome", "storage_warning"])

    each = uploads.groupBy("user_id", "sha256_hash").agg(F.first("content").alias("content"))
    rows = each.select("user_id", "sha256_hash", blob_path("user_id", "sha256_hash").alias("storage_path"), "content")
    return staged(rows.mapInArrow(run, "user_id string, sha256_hash string, storage_path string, outcome string, storage_warning string"), "put-outcomes")


def remove_objects(freed: DataFrame, root: str) -> DataFrame:
    """Remove the objects at storage_path: rows with whether it is gone and, where not, the reason as
    storage_warning. One that is not there is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(root)
        for batch in batches:
            warnings = []
            for path in batch.column(0).to_pylist():
                warning = None
                try:
                    if system.get_file_info(f"{base}/{path}").type != pafs.FileType.NotFound:
                        system.delete_file(f"{base}/{path}")
                except FileNotFoundError:  # another attempt of this task was first
                    pass
                except OSError as e:
                    warning = str(e.strerror or e)
                warnings.append(warning)
            kept = pa.array(warnings, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kept.is_null(), kept], names=["storage_path", "removed", "storage_warning"])

    paths = freed.where("storage_path IS NOT NULL").select("storage_path").distinct()
    return staged(paths.mapInArrow(run, "storage_path string, removed boolean, storage_warning string"), "removals")


def with_storage_warnings(results: DataFrame, removals: DataFrame) -> DataFrame:
    """Results of deletes with the warnings of what could not be removed, also in their JSON."""
    joined = results.join(removals.select("storage_path", "storage_warning"), "storage_path", "left")
    plain = F.to_json(F.struct("deleted", "blob_deleted", "storage_path"), {"ignoreNullFields": "false"})
    warned = F.to_json(F.struct("deleted", "blob_deleted", "storage_path", "storage_warning"), {"ignoreNullFields": "false"})
    return joined.withColumn("result", F.when(F.col("storage_warning").isNull(), plain).otherwise(warned))
