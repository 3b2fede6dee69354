"""Table schemas of a library and the checks on its pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIDENCES = ("high", "provisional", "metadata-only")
STATUSES = ("pending", "kept", "resolved")


def _schema(ddl: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "d": T.DoubleType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in ddl.split())])


BLOBS = _schema("id:s user_id:s sha256_hash:s storage_path:s size_bytes:l ref_count:i created_at:t")
FILES = _schema("id:s user_id:s blob_id:s filename:s filename_stem:s extension:s size_bytes:l page_count:i uploaded_at:t created_at:t")
TEXTS = _schema("logical_file_id:s user_id:s extracted_text:s extraction_ok:b expected_min_chars:i actual_chars:i extraction_reason:s created_at:t")
SHINGLES = _schema("logical_file_id:s user_id:s shingle_hash:l start_offset:i created_at:t")
DOC_FREQUENCY = _schema("user_id:s shingle_hash:l doc_count:i")
PAIRS = _schema("user_id:s file_a_id:s file_b_id:s content_score:d filename_score:d composite_score:d confidence:s status:s")


def pair_violations(pairs: DataFrame) -> DataFrame:
    """Rows that break a check, or share their pair of files with another row; must be empty."""
    checked = pairs.withColumn("violation", F.when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "confidence").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status").when(F.col("file_a_id") == F.col("file_b_id"), "self"))
    twice = pairs.groupBy("file_a_id", "file_b_id").count().where("count > 1").select("file_a_id", "file_b_id", F.lit("repeated").alias("violation"))
    return checked.where("violation IS NOT NULL").select("file_a_id", "file_b_id", "violation").unionByName(twice)


def blob_violations(blobs: DataFrame) -> DataFrame:
    """(user, hash) keys that more than one blob has; must be empty."""
    return blobs.groupBy("user_id", "sha256_hash").count().where("count > 1")
