"""Sources and sinks: uploads from files or from a table of texts, and content-addressed storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

EXTENSIONS = ("txt", "md", "csv", "docx", "pptx", "xlsx", "pdf", "png")


def read_uploads(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """One row per non-empty file under ``path``, in the order of its modification time and name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return uploads_of_files(files, user_id)


def uploads_of_files(files: DataFrame, user_id: str) -> DataFrame:
    """``files``: path, modificationTime, length, content, batch or stream."""
    name = F.coalesce(F.nullif(F.element_at(F.split("path", "/"), -1), F.lit("")), F.lit("untitled"))
    return with_identity(files.where("length > 0").select(F.lit(user_id).alias("user_id"), F.col("modificationTime").alias("uploaded_at"), name.alias("filename"), "content"))


def with_identity(uploads: DataFrame) -> DataFrame:
    """Add extension, stem, size and SHA-256 of the bytes."""
    return uploads.select(
        "*",
        names.extension_of(F.col("filename")).alias("extension"),
        names.stem_of(F.col("filename")).alias("filename_stem"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256_hash"),
    )


def decode_text(content):
    """Bytes as UTF-8; malformed parts become U+FFFD and one leading byte-order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\x{FEFF}", "")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def library_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents as one upload each: the language is the tenant, the id is the order.

    Extension and page, slide or cell counts follow from the id, the stem from the first line. A null language
    is the tenant ''; a row without an id or without a byte of text is no upload (see `refused_documents`).
    """
    stem = F.substring(F.regexp_replace(F.split("text", "\n", 2)[0], "[^A-Za-z0-9 ]", ""), 1, 40)
    kinds = F.array(*[F.lit(e) for e in EXTENSIONS])
    extension = F.element_at(kinds, (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return _documents(spark, sf_dir).where("doc_id IS NOT NULL AND text <> ''").select(
        F.col("lang").alias("user_id"),
        F.col("doc_id").alias("file_id"),
        F.col("doc_id").alias("upload_seq"),
        F.concat(stem, F.lit("."), extension).alias("filename"),
        stem.alias("filename_stem"),
        extension.alias("extension"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.pmod("doc_id", F.lit(5)) + 1).cast("int").alias("units"),
        F.sha2("text", 256).alias("sha256_hash"),
        "text",
    )


def refused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refused(_documents(spark, sf_dir))


def refused(rows: DataFrame) -> DataFrame:
    """Rows (lang, doc_id, text) that are no uploads, with the reason and the status that an upload of them would get."""
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.col("text") == "", "empty file")
    rows = rows.select(F.col("lang").alias("user_id"), F.col("doc_id").alias("file_id"), reason.alias("reason"))
    return rows.where("reason IS NOT NULL").withColumn("status", F.lit(400))


def refused_files(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """The empty files under ``path``, which `read_uploads` does not take, with the reason and the status that
    an upload of them would get. They are listed by the driver, as any input's files are."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, empty = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            empty.append((user_id, status.getPath().toString(), "empty file", 400))
    return spark.createDataFrame(empty, "user_id string, path string, reason string, status int")


def blob_path(user_id, sha256):
    return F.concat_ws("/", user_id, sha256)


def new_blobs(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """The objects to write: one per (user, hash) that is not stored yet. Writing again is harmless."""
    first = uploads.groupBy("user_id", "sha256_hash").agg(F.first("size_bytes").alias("size_bytes"))
    fresh = first.join(stored.select("user_id", "sha256_hash"), ["user_id", "sha256_hash"], "left_anti")
    return fresh.withColumn("storage_path", blob_path("user_id", "sha256_hash"))


BLOBS = "sha256_hash string, content binary, user_id string"


def write_blobs(uploads: DataFrame, path: str) -> None:
    """Store contents once per (user, hash), partitioned by user; what is there already stays as it is."""
    spark = uploads.sparkSession
    kept = uploads.select("user_id", "sha256_hash", "content").dropDuplicates(["user_id", "sha256_hash"])
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        kept = kept.join(read_blobs(spark, path).select("user_id", "sha256_hash"), ["user_id", "sha256_hash"], "left_anti")
    kept.write.partitionBy("user_id").mode("append").parquet(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    # The tenant '' comes back as null from the name of its folder.
    return spark.read.schema(BLOBS).parquet(path).withColumn("user_id", F.coalesce("user_id", F.lit("")))


def register_buckets(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Insert where the id is not there yet."""
    return existing.unionByName(wanted.join(existing.select("id"), "id", "left_anti"))


def upload_log(uploads: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """One message per upload. ``uploads``: user_id, file_id, filename, deduplicated, extraction_ok, extraction_reason."""
    note = F.when(F.col("extraction_ok"), "text extracted").otherwise(F.format_string("metadata-only (%s)", F.coalesce("extraction_reason", F.lit("no text"))))
    stored = F.format_string("%s: stored — %s; %d possible duplicate(s).", "filename", note, F.coalesce("n_pairs", F.lit(0).cast("long")))
    shared = F.format_string("%s: identical bytes already stored — shared blob (Tier 1).", "filename")
    joined = uploads.join(pair_counts, ["user_id", "file_id"], "left")
    return joined.select("file_id", F.when(F.col("deduplicated"), shared).otherwise(stored).alias("message"))
