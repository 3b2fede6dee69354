"""Text: entities, cleaning, words, shingles and their hashes, excerpts and word differences."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import JS_SPACE, js_trim

WINDOW = 5
_WORD = re.compile(r"[^\t\n\x0b\x0c\r    -     　﻿]+")
SHINGLES = T.ArrayType(T.StructType([T.StructField("shingle_hash", T.LongType()), T.StructField("start_offset", T.IntegerType())]))
# 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def decode_entities(text: Column) -> Column:
    """The named entities, then decimal references, then ampersands last.

    A reference beyond U+10FFFF raises, as it has no character. Spark evaluates the numeric step only for
    texts that hold a reference.
    """
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    text = F.when(text.rlike(r"&#\d+;"), _decode_numbers(text)).otherwise(text)
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


@F.pandas_udf(T.StringType())
def _decode_numbers(texts):
    return texts.map(decode_numbers, na_action="ignore")


def decode_numbers(text: str) -> str:
    def one(m: re.Match) -> str:
        code = int(m[1])
        return "�" if 0xD800 <= code <= 0xDFFF else chr(code)

    return re.sub(r"&#([0-9]+);", one, text)


def clean_text(text: Column) -> Column:
    """Entities decoded, line ends unified, blanks before them dropped, at most one empty line, trimmed."""
    text = F.regexp_replace(decode_entities(text), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return js_trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{JS_SPACE}]+"), F.lit(0))


def fnv1a(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signed 64-bit FNV-1a of the byte ranges, all of them stepping together."""
    size = ends - starts
    longest = int(size.max()) if len(size) else 0
    order = np.argsort(-size if longest >= 1 << 15 else (-size).astype(np.int16), kind="stable")
    at = starts[order]
    # How many ranges are longer than each number of steps.
    going = np.searchsorted(-size[order], -np.arange(longest), side="left").tolist()
    h = np.full(len(at), FNV_OFFSET, np.uint64)
    prime = np.uint64(FNV_PRIME)
    for k, n in enumerate(going):
        part = h[:n]
        part ^= buffer[k:].take(at[:n])
        part *= prime
    out = np.empty_like(h)
    out[order] = h
    return out.view(np.int64)


def shingle_hash(text: str) -> int:
    """The hash of one shingle: lower case, white space collapsed, trimmed."""
    raw = np.frombuffer(" ".join(_WORD.findall(text.lower())).encode(), np.uint8)
    return int(fnv1a(raw, np.array([0]), np.array([len(raw)]))[0])


def shingle_text(text: str | None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start offset) of each run of ``window`` words; none where there are fewer words."""
    found = list(_WORD.finditer(text or ""))
    n = len(found) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    lowered = [m[0].lower().encode() for m in found]
    ends = np.cumsum([len(w) + 1 for w in lowered]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    buffer = np.frombuffer(b" ".join(lowered), np.uint8)
    return fnv1a(buffer, starts[:n], ends[window - 1 :]), np.array([m.start() for m in found[:n]], np.int32)


def shingle_sets(texts: list[str | None], window: int = WINDOW) -> list[np.ndarray]:
    """The distinct hashes of `shingle_text` of each text, ascending; all texts step together."""
    lowered = [_one_spaced(t or "") for t in texts]
    # A text ends with a blank too, so that every word has one after it.
    buffer = np.frombuffer(b"".join([b for t in lowered for b in (t, b" ")]), np.uint8)
    ends = np.flatnonzero(buffer == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = np.array([t.count(b" ") + 1 for t in lowered], np.int64)
    past = np.cumsum(count)
    n = np.where(np.array([len(t) > 0 for t in lowered], bool), np.maximum(count - window + 1, 0), 0)
    first = np.repeat(past - count - (np.cumsum(n) - n), n) + np.arange(n.sum())
    hashes = fnv1a(buffer, starts[first], ends[first + window - 1])
    return [np.unique(h) for h in np.split(hashes, np.cumsum(n)[:-1])] if texts else []


def _one_spaced(text: str) -> bytes:
    """The words of a text in lower case, a blank between two."""
    if text.isascii():
        return b" ".join(text.encode().lower().split())
    # A blank ends what a letter's lower case may depend on, as the text's own white space does.
    return " ".join(_WORD.findall(text)).lower().encode()


def with_shingles(df: DataFrame, text_col: str, name: str = "shingles", window: int = WINDOW) -> DataFrame:
    """Replace the text by its array of (shingle_hash, start_offset), in Arrow batches."""
    passed = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField(name, SHINGLES)])
    kind = pa.list_(pa.struct([("shingle_hash", pa.int64()), ("start_offset", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, text_col):
            made = [shingle_text(t.as_py(), window) for t in batch.column(batch.schema.get_field_index(text_col))]
            flat = [np.concatenate(x) for x in zip(*made, strict=True)]
            values = pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int32())], fields=list(kind.value_type))
            column = pa.ListArray.from_arrays(_list_offsets(made), values)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays([*arrays, column], names=[*passed, name])

    return df.select(*passed, text_col).mapInArrow(run, schema)


def with_shingle_sets(df: DataFrame, text_col: str, name: str = "hashes", window: int = WINDOW) -> DataFrame:
    """Replace the text by the array of its distinct shingle hashes, in Arrow batches."""
    passed = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, text_col):
            made = shingle_sets(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), window)
            column = pa.ListArray.from_arrays(_list_offsets([(h,) for h in made]), pa.array(np.concatenate(made), pa.int64()))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays([*arrays, column], names=[*passed, name])

    return df.select(*passed, text_col).mapInArrow(run, schema)


#: Bytes of text whose shingles a task holds at once; a longer text is taken alone.
HELD_TEXT = 1 << 21


def _by_bytes(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """``batches`` cut to parts of at most ``HELD_TEXT`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + HELD_TEXT, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _list_offsets(made: list[tuple]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum([len(m[0]) for m in made]))).astype(np.int32), pa.int32())


def excerpt(text: Column, offset: Column, radius: int = 100) -> Column:
    """Up to ``radius`` characters on either side, white space collapsed, an ellipsis where it is cut."""
    start = F.greatest(F.lit(0), offset - radius)
    end = F.least(F.length(text), offset + radius)
    body = js_trim(F.regexp_replace(text.substr(start + 1, end - start), f"[{JS_SPACE}]+", " "))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


DIFF = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("value", T.StringType())]))


_TOKEN = re.compile(r"""[^\S\r\n]+|[()\[\]{}'"\r\n]|\w+|[^\w\s()\[\]{}'"]+""")
#: Bits of alignment rows that are held at once; beyond that the texts are halved.
HELD_BITS = 1 << 27


def diff_words(a: str | None, b: str | None) -> list[tuple[str, str]]:
    """Shortest edit script from a to b over words, marks and blanks: (equal | removed | added, text).

    Any two pieces of white space are equal, and what is equal is shown as b has it. The longest common
    subsequence is found bit-parallel, a row of bits for each token of b, in linear space: texts whose
    rows would not fit are cut at the middle of b, where the rows of both halves meet best.
    """
    x, y = (_TOKEN.findall(t or "") for t in (a, b))
    u, v = ([" " if t.isspace() else t for t in side] for side in (x, y))
    steps: list[tuple[str, str]] = []
    i = j = 0
    for p, q in [*_common(u, v), (len(u), len(v))]:
        steps += [("removed", t) for t in x[i:p]] + [("added", t) for t in y[j:q]] + [("equal", t) for t in y[q : q + 1]]
        i, j = p + 1, q + 1
    return [(op, "".join(t for _, t in group)) for op, group in itertools.groupby(steps, key=lambda s: s[0])]


def _common(u: list[str], v: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    out: list[tuple[int, int]] = []
    parts = [(0, len(u), 0, len(v))]
    while parts:
        a, b, c, d = parts.pop()
        tail = 0
        while a < b and c < d and u[a] == v[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and u[b - 1] == v[d - 1]:
            b, d, tail = b - 1, d - 1, tail + 1
        out += [(b + k, d + k) for k in range(tail)]
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= HELD_BITS or d - c == 1:
            out += [(a + i, c + j) for i, j in _aligned(u[a:b], v[c:d])]
            continue
        m = (c + d) // 2
        ahead = _lengths(u[a:b], v[c:m])
        back = _lengths(u[a:b][::-1], v[m:d][::-1])[::-1]
        k = a + int(np.argmax(ahead + back))
        parts += [(a, k, c, m), (k, b, m, d)]
    return sorted(out)


def _rows(u: list[str], v: list[str]) -> Iterator[int]:
    """For each token of v, a row with a 0 bit wherever one more token of u lengthens the common subsequence."""
    places: dict[str, int] = dict.fromkeys(v, 0)
    for i, t in enumerate(u):
        if t in places:
            places[t] |= 1 << i
    full = (1 << len(u)) - 1
    row = full
    for t in v:
        if hit := row & places[t]:
            row = (row + hit | row - hit) & full
        yield row


def _lengths(u: list[str], v: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of v and each prefix of u."""
    row = (1 << len(u)) - 1
    for row in _rows(u, v):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(u) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(u)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(u: list[str], v: list[str]) -> list[tuple[int, int]]:
    rows = [row.to_bytes(len(u) // 8 + 1, "little") for row in _rows(u, v)]
    out, i, j = [], len(u) - 1, len(v) - 1
    while i >= 0 and j >= 0:
        if rows[j][i >> 3] >> (i & 7) & 1:
            i -= 1
        elif j and not rows[j - 1][i >> 3] >> (i & 7) & 1:
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out


@F.pandas_udf(DIFF)
def word_diff(a, b):
    import pandas as pd

    return pd.Series([[{"op": op, "value": v} for op, v in diff_words(s, t)] for s, t in zip(a, b, strict=True)])
