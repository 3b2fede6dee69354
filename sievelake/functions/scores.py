"""Confidence floors, pair scores and display formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters expected of a page, slide or cell, and the share of them that must be there.
PAGE_CHARS, SLIDE_CHARS, CELL_CHARS, FLOOR_SHARE = 1500, 150, 4, 0.2
# Weights of content and name, and from where a pair is flagged.
CONTENT_WEIGHT, NAME_WEIGHT, FLAG_COMPOSITE, FLAG_NAME = 0.7, 0.3, 0.55, 0.8
# Below this many shingled files a score is provisional; size bands; the blocking ceiling.
PROVISIONAL_FILES, SIZE_RATIO, FULL_COMPARE_FILES = 10, 1.2, 2000
# Labels of confidence.
LABELS = {
    "high": "High confidence",
    "metadata-only": "Metadata only — content couldn't be compared",
    "provisional": "Provisional — still learning your library",
}


def expected_chars(fmt: Column, pages: Column, slides: Column, cells: Column) -> Column:
    at_least = lambda n: F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))
    return (
        F.when(fmt == "docx", F.lit(PAGE_CHARS))
        .when(fmt == "pptx", at_least(slides) * SLIDE_CHARS)
        .when(fmt == "xlsx", at_least(cells) * CELL_CHARS)
        .when(fmt == "pdf", at_least(pages) * PAGE_CHARS)
        .otherwise(F.lit(0))
        .cast("int")
    )


def passes_floor(actual: Column, expected: Column) -> Column:
    return actual >= expected * F.lit(FLOOR_SHARE)


def extraction_ok(fmt: Column, actual: Column, expected: Column) -> Column:
    return F.when(fmt == "unsupported", False).when(fmt == "plain", actual > 0).otherwise(passes_floor(actual, expected))


def extraction_reason(fmt: Column, extension: Column, ok: Column) -> Column:
    # The reasons.
    good = {"plain": "plain-text read directly", "docx": "docx XML text nodes parsed", "pptx": "pptx slide text parsed", "xlsx": "xlsx shared/inline strings parsed", "pdf": "pdf text layer extracted"}
    thin = {"plain": "empty plain-text file", "docx": "docx text layer below confidence floor", "pptx": "pptx text below confidence floor", "xlsx": "xlsx text below confidence floor", "pdf": "scanned/pdf text layer below confidence floor"}
    of = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[fmt]
    return F.when(fmt == "unsupported", F.concat(F.lit("unsupported format: ."), extension)).when(ok, of(good)).otherwise(of(thin))


def size_bucket(size: Column) -> Column:
    return F.floor(F.ln(F.greatest(size, F.lit(1)).cast("double")) / F.ln(F.lit(SIZE_RATIO))).cast("long")


def size_band(size: Column) -> tuple[Column, Column]:
    """The closed range of sizes that a newer file of this size is compared with."""
    b = size_bucket(size)
    low = F.ceil(F.pow(F.lit(SIZE_RATIO), b - 1)).cast("long")
    return low, (F.floor(F.pow(F.lit(SIZE_RATIO), b + 2)) - 1).cast("long")


def composite(content: Column, name: Column) -> Column:
    return F.when(content.isNull(), name).otherwise(F.lit(CONTENT_WEIGHT) * content + F.lit(NAME_WEIGHT) * name)


def flagged(content: Column, name: Column) -> Column:
    return F.when(content.isNull(), name >= FLAG_NAME).otherwise(composite(content, name) >= FLAG_COMPOSITE)


def confidence(content: Column, provisional: Column) -> Column:
    return F.when(content.isNull(), "metadata-only").when(provisional, "provisional").otherwise("high")


def confidence_label(value: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[value]


def format_bytes(n: Column) -> Column:
    n = n.cast("double")
    i = F.least(F.floor(F.ln(n) / F.ln(F.lit(1024.0))), F.lit(4))
    value = n / F.pow(F.lit(1024.0), i)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), (i + 1).cast("int"))
    shown = F.when(i == 0, F.format_string("%.0f %s", value, unit)).otherwise(F.format_string("%.1f %s", value, unit))
    plain = n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf"))
    return F.when(plain, "0 B").otherwise(shown)


def format_percent(x: Column) -> Column:
    """Half rounds up, towards positive infinity."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, "—").otherwise(F.concat(F.floor(x * 100 + F.lit(0.5)).cast("string"), F.lit("%")))


def format_date(value: Column) -> Column:
    at = F.try_to_timestamp(value)
    return F.coalesce(F.date_format(at, "MMM d, yyyy, hh:mm a"), F.lit("—"))


def dedup_ratio(uploaded: Column, stored: Column) -> Column:
    return F.when(stored > 0, uploaded / stored).otherwise(F.lit(1.0))


def format_ratio(x: Column) -> Column:
    """Two decimals, as the dashboard shows a ratio."""
    return F.concat(F.format_string("%.2f", x.cast("double")), F.lit("×"))
