"""Shingles, postings and document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import with_shingle_sets, with_shingles


def file_shingles(texts: DataFrame) -> DataFrame:
    """(user_id, file_id, upload_seq, shingle_hash, start_offset) of every window of five words, repeats
    included. ``texts``: user_id, file_id, upload_seq, extracted_text."""
    made = with_shingles(texts.select("user_id", "file_id", "upload_seq", "extracted_text"), "extracted_text")
    return made.select("user_id", "file_id", "upload_seq", F.inline("shingles"))


def file_hashes(texts: DataFrame) -> DataFrame:
    """(user_id, file_id, upload_seq, hashes): the distinct shingles of each file that has any, in one row. ``texts`` as
    `file_shingles` takes them; no row is shuffled."""
    made = with_shingle_sets(texts.select("user_id", "file_id", "upload_seq", "extracted_text"), "extracted_text")
    return made.where(F.size("hashes") > 0)


def one_row_each(hashes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``hashes`` of `file_hashes` with rows of one file joined, where there are any; ``files``: a stored table of the same
    files, so that no text is shingled to see whether one repeats."""
    keys = ["user_id", "file_id", "upload_seq"]
    if (hashes if files is None else files).groupBy(*keys).count().where("count > 1").isEmpty():
        return hashes
    return hashes.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))


def hash_frequency(hashes: DataFrame) -> DataFrame:
    """`doc_frequency` from one row of ``hashes`` for each file: counted where they are, and shuffled once."""
    return hashes.select("user_id", F.explode("hashes").alias("shingle_hash")).groupBy("user_id", "shingle_hash").agg(F.count("*").cast("int").alias("doc_count"))


def frequency_sums(hashes: DataFrame) -> DataFrame:
    """(user_id, file_id, n, total): each file's distinct shingles and the sum of their document frequencies.

    Postings are shuffled once: those of one shingle are counted where they meet, and come back as sums of files.
    """
    rows = hashes.select("user_id", F.explode("hashes").alias("shingle_hash"), "file_id")
    met = rows.withColumn("doc_count", F.count("*").over(W.partitionBy("shingle_hash", "user_id")))
    # Shingles of one file only count 1 each; what is left to add up is what the shared ones have beyond that.
    more = met.where("doc_count > 1").groupBy("user_id", "file_id").agg(F.sum(F.col("doc_count") - 1).alias("_more"))
    own = hashes.select("user_id", "file_id", F.size("hashes").cast("long").alias("n"))
    return own.join(more, ["user_id", "file_id"], "left").select("user_id", "file_id", "n", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("total"))


def shared_postings(hashes: DataFrame, sizes: bool = False) -> DataFrame:
    """Postings with rank, as `ranked_postings` has them, of the shingles that two or more files of a tenant hold.

    The others, most of a library, meet nobody and count 1 on arrival, so they only stand in their files' sizes.
    Postings are shuffled once; those of one shingle pass a task as a sorted stream, which spills. ``sizes``: with a row of
    each file beside them that has no tenant, and as its shingle_hash how many shingles the file has, so that no text is
    shingled and no hash written only to count them.
    """
    if sizes:
        hashes = hashes.withColumn("_n", F.size("hashes").cast("long")).withColumn("hashes", F.array_append("hashes", F.lit(None).cast("long")))
    rows = hashes.withColumn("shingle_hash", F.explode("hashes"))
    if sizes:
        rows = rows.withColumn("user_id", F.when(F.col("shingle_hash").isNotNull(), F.col("user_id"))).withColumn("shingle_hash", F.coalesce("shingle_hash", "_n"))
    rows = rows.select("user_id", "shingle_hash", "file_id", "upload_seq")
    # Hashes tell rows apart where they are sorted; tenants are few, and their names would be compared every time.
    own = W.partitionBy("shingle_hash", "user_id").orderBy("upload_seq", "file_id")
    ranked = rows.withColumn("rank", F.row_number().over(own)).withColumn("_next", F.lead("file_id").over(own))
    return ranked.where("rank > 1 OR _next IS NOT NULL OR user_id IS NULL").drop("_next")


def met_postings(old: DataFrame, own: DataFrame) -> DataFrame:
    """Postings ``old`` and ``own`` of the shingles that two or more files hold, one of them of ``own``, with newer: whether
    it is one of ``own``. All postings are shuffled once."""
    both = old.withColumn("newer", F.lit(False)).unionByName(own.withColumn("newer", F.lit(True)))
    shingle = W.partitionBy("shingle_hash", "user_id")
    counted = both.withColumn("_n", F.count("*").over(shingle)).withColumn("_any", F.max("newer").over(shingle))
    return counted.where("_n > 1 AND _any").drop("_n", "_any")


def postings(shingles: DataFrame) -> DataFrame:
    """Distinct (user_id, shingle_hash, file_id, upload_seq)."""
    return shingles.select("user_id", "shingle_hash", "file_id", "upload_seq").distinct()


def doc_frequency(shingles: DataFrame) -> DataFrame:
    """(user_id, shingle_hash, doc_count)."""
    return postings(shingles).groupBy("user_id", "shingle_hash").agg(F.count("*").cast("int").alias("doc_count"))


def bump_frequency(current: DataFrame, added: DataFrame) -> DataFrame:
    """Add the frequencies of newly shingled files to the stored ones."""
    both = current.select("user_id", "shingle_hash", "doc_count").unionByName(doc_frequency(added))
    return both.groupBy("user_id", "shingle_hash").agg(F.sum("doc_count").cast("int").alias("doc_count"))


def drop_frequency(current: DataFrame, removed: DataFrame) -> DataFrame:
    """Subtract the frequencies of deleted files' shingles; entries that come to nothing go."""
    less = doc_frequency(removed).withColumnRenamed("doc_count", "_less")
    joined = current.join(less, ["shingle_hash", "user_id"], "left")
    left = joined.withColumn("doc_count", F.col("doc_count") - F.coalesce("_less", F.lit(0)))
    return left.where("doc_count > 0").select("user_id", "shingle_hash", "doc_count")


def shingled_file_count(shingles: DataFrame) -> DataFrame:
    """(user_id, n_files) with at least one shingle."""
    return shingles.select("user_id", "file_id").distinct().groupBy("user_id").agg(F.count("*").alias("n_files"))


def frequencies_of(frequency: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored frequencies of the wanted (user_id, shingle_hash)."""
    return frequency.join(wanted.select("user_id", "shingle_hash").distinct(), ["user_id", "shingle_hash"], "left_semi")


def shingles_of(shingles: DataFrame, files: DataFrame) -> DataFrame:
    """Stored shingles of the wanted (user_id, file_id)."""
    return shingles.join(files.select("user_id", "file_id").distinct(), ["user_id", "file_id"], "left_semi").select("user_id", "file_id", "shingle_hash", "start_offset")


#: Files of a tenant whose postings of one shingle are ordered in one group, at most (by their places).
RANK_FILES = 1 << 20


def counted_until(postings: DataFrame, wanted: DataFrame, one_range: bool | None = None) -> DataFrame:
    """``wanted`` (user_id, shingle_hash, upload_seq, ...) with df: the postings of its shingle up to then, less those
    of files that were gone by then where the postings have gone_seq.

    Counted within ranges of ``RANK_FILES`` places and then over the ranges, so that the postings of a shingle
    that most files hold are never ordered in one group. ``one_range``: whether there is but one, if known.
    """
    keys = ["shingle_hash", "user_id", "_range"]
    ranged = lambda df: df.withColumn("_range", F.expr(f"upload_seq div {RANK_FILES}"))
    here = ranged(_steps(postings))
    asked = ranged(wanted).withColumn("_one", F.lit(0))
    order = W.partitionBy(*keys).orderBy("upload_seq").rangeBetween(W.unboundedPreceding, 0)
    both = asked.unionByName(here, allowMissingColumns=True).withColumn("df", F.sum("_one").over(order)).where("_one = 0")
    if one_range_of(postings) if one_range is None else one_range:
        return both.select(*wanted.columns, "df")
    earlier = _before(here.groupBy(*keys).agg(F.sum("_one").alias("_n")))
    joined = _asof_range(both, earlier)
    return joined.select(*wanted.columns, (F.col("df") + F.col("_before")).alias("df"))


def _steps(postings: DataFrame) -> DataFrame:
    """(user_id, shingle_hash, upload_seq, _one): 1 where a file comes, -1 where it goes."""
    came = postings.select("user_id", "shingle_hash", "upload_seq", F.lit(1).alias("_one"))
    if "gone_seq" not in postings.columns:
        return came
    went = postings.where("gone_seq IS NOT NULL").select("user_id", "shingle_hash", F.col("gone_seq").alias("upload_seq"), F.lit(-1).alias("_one"))
    return came.unionByName(went)


def one_range_of(postings: DataFrame) -> bool:
    last = F.greatest("upload_seq", "gone_seq") if "gone_seq" in postings.columns else F.col("upload_seq")
    ends = postings.agg(F.min("upload_seq").alias("a"), F.max(last).alias("b")).first()
    return ends.a is None or ends.a // RANK_FILES == ends.b // RANK_FILES


def _before(ranges: DataFrame) -> DataFrame:
    """(user_id, shingle_hash, _from, _upto, _before): postings before the ranges from _from, up to _upto."""
    own = W.partitionBy("user_id", "shingle_hash").orderBy("_range")
    upto = F.coalesce(F.lead("_range").over(own), F.lit(1 << 62))
    return ranges.select("user_id", "shingle_hash", (F.col("_range") + 1).alias("_from"), upto.alias("_upto"), F.sum("_n").over(own).alias("_before"))


def _asof_range(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    spans = earlier.withColumnsRenamed({"user_id": "_u", "shingle_hash": "_h"})
    inside = (F.col("user_id") == F.col("_u")) & (F.col("shingle_hash") == F.col("_h")) & F.col("_range").between(F.col("_from"), F.col("_upto"))
    return rows.join(spans, inside, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))


def ranked_postings(shingles: DataFrame) -> DataFrame:
    """Postings with rank: the shingle's document frequency when this file came, itself included."""
    rows, one_range = postings(shingles), one_range_of(shingles)
    order = W.partitionBy("shingle_hash", "user_id", "_range").orderBy("upload_seq", "file_id")
    ranked = rows.withColumn("_range", F.expr(f"upload_seq div {RANK_FILES}")).withColumn("rank", F.row_number().over(order))
    if not one_range:
        earlier = _before(ranked.groupBy("user_id", "shingle_hash", "_range").agg(F.count("*").alias("_n")))
        ranked = _asof_range(ranked, earlier).withColumn("rank", (F.col("rank") + F.col("_before")).cast("int"))
    return ranked.select(*rows.columns, "rank")


def living_postings(shingles: DataFrame, lives: DataFrame) -> DataFrame:
    """Postings with gone_seq and rank: how many files that were there held the shingle when this one came, itself
    included. ``lives``: user_id, file_id, gone_seq (null while the file is there)."""
    return living_ranks(postings(shingles), lives)


def living_ranks(rows: DataFrame, lives: DataFrame) -> DataFrame:
    """`living_postings` of the distinct postings ``rows``, which hold all of each of their shingles."""
    rows = rows.join(lives.select("user_id", "file_id", "gone_seq"), ["file_id", "user_id"])
    rows = rows.select("user_id", "shingle_hash", "file_id", "upload_seq", "gone_seq")
    ranked = counted_until(rows, rows, one_range_of(lives.select("upload_seq", "gone_seq")) if "upload_seq" in lives.columns else None)
    return ranked.withColumn("rank", F.col("df").cast("int")).drop("df")
