"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality rejects go, one document of each near-duplicate group stays (SimHash candidates, five-word shingles
0.8 alike), contaminated documents go, the rest is put in mixed order of sources, and its token ids are packed in that order: packed rows by (shard, row) follow
the mixture, as the packing stage takes the places again from what it reads. A stage judges all that its
predecessor kept, and all but the last return the columns of documents as they came.

Defined results of the stages, in their order:

1. a null or empty text scores at the model's intercept and is kept or rejected by it; equal texts alike; with
   no labels of one class the base rate decides;
2. texts without words, null and empty ones too, are one group; of a group the smallest id stays, null ids last, of
   repeated rows one;
3. null and empty texts are clean; with no items all rows stay;
4. no row goes; a null source is the source '', null ids come first in it, equal ids go by their contents;
5. a null or empty text is one end mark, null ids stay null, texts of any length are split without loss.

Columns beyond those of documents pass through the first four stages, also where they are named like a
column that a stage adds; an empty table of documents gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import common, decontaminate, mixing, near_copies, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = quality.open_labels(common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.keep_good(docs, quality.fit_quality(docs, labels))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = common.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.remove_contamination(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def pack_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # What was written comes back in any order of files, so the places in the mixture are taken again.
    return packing.pack_documents(mixing.in_mixed_order(docs), in_order=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", pack_token_ids),
]

#: Compression, fingerprints and byte-pair encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, f"pipeline-{k}")
    return docs
