"""File names: extensions, stems, formats and similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by format.
FORMATS = {"docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "pdf": "pdf", "txt": "plain", "md": "plain", "csv": "plain"}


def extension_of(name: Column) -> Column:
    """Lower-cased part after the last dot; '' without a dot. Directories are not stripped."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def stem_of(name: Column) -> Column:
    """Base name without its last extension; a leading dot starts no extension."""
    base = F.regexp_extract(name, r"(?s)([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(?s)^(.+)\.[^.]*$", "$1")


def rename_parts(name: Column) -> Column:
    """Struct(filename, filename_stem, extension) of a new name; null where it is blank."""
    new = js_trim(name)
    dotted = F.instr(new, ".") > 0
    stem = F.when(dotted, F.regexp_replace(new, r"(?s)\.[^.]*$", "")).otherwise(new)
    return F.when(new != "", F.struct(new.alias("filename"), stem.alias("filename_stem"), extension_of(new).alias("extension")))


def format_of(extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(known[F.lower(extension)], F.lit("unsupported"))


#: White space as ECMAScript sees it; Java's \s knows fewer and U+0085 is not among them.
JS_SPACE = r"\t\n\x0B\f\r    -     　﻿"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def filename_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, ignoring case; 1 for equal names."""
    a, b = F.lower(a), F.lower(b)
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
