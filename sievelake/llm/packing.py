"""Token ids packed into fixed-length rows, best fit decreasing.

Each task tokenises its documents, ends each with ``eos``, splits what is longer than a row into pieces
without losing a token, and gathers pieces until a window holds ``window_tokens``. A window is packed by
best fit decreasing: pieces from longest to shortest, each into the fullest row that still takes it. A
segment tree over remaining capacities finds that row in logarithmic time. Windows are packed where their
texts were read: no token is shuffled, and a task holds one window and one batch of texts.

A row holds its ids as a little-endian binary of exactly ``row_tokens`` ids (padded), the cumulative
segment lengths, the places where positions restart, and for each segment its document and the offset in
that document's tokens. ``unpack`` gives documents back exactly; ``write_matrices`` writes id matrices.

Defined results: a null or empty text is one ``eos``; ids are of any type that Arrow carries and come back
in it, null ids stay null; repeated documents are each packed; a text may be of any length and hold runs of
blanks of any length (``encode_text``); of pieces of one length those read first are placed first, and of
rows equally full the one that came to that fill last is taken; columns other than the id and the text are
not read, so none can clash; an empty table gives no rows. Which documents share a row depends on how the
table is read, the tokens of each document do not. The vocabulary file is read on each executor from
``tokenizer``.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text before byte-pair merging, as the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOS = 50256
ROW_TOKENS = 2048
WINDOW_TOKENS = 1 << 20
#: White space as the pattern's engine sees it, in runs that its backtracking stack might not hold.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
COLUMNS = {
    "shard": T.IntegerType(), "row": T.LongType(), "n_tokens": T.IntegerType(), "input_ids": T.BinaryType(), "cu_seqlens": T.ArrayType(T.IntegerType()),
    "position_resets": T.ArrayType(T.IntegerType()), "doc_ids": None, "doc_offsets": T.ArrayType(T.LongType()),
}

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once in a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode_text(tokenizer, text: str) -> list[int]:
    """What ``encode_ordinary`` gives, also where a run of blanks is too long for the pattern's engine.

    A run begins a piece of its own, up to its end or, before other text, to its last blank, which goes
    with that text. Such a piece is merged without the pattern; what is between runs is encoded as ever.
    """
    ids, at = [], 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += tokenizer.encode_ordinary(text[at : run.start()])
        ids += tokenizer._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + tokenizer.encode_ordinary(text[at:] if at else text)


class CapacityTree:
    """Open rows by remaining capacity; a segment tree finds the smallest capacity that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.used = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        if not self.rows[capacity]:
            k = self.size + capacity
            while k and not self.used[k]:
                self.used[k] = 1
                k >>= 1
        self.rows[capacity].append(row)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row that takes ``need``, removed from the tree."""
        k = self.size + need
        if not self.used[k]:
            while k > 1 and (k & 1 or not self.used[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.used[2 * k] else 2 * k + 1
        capacity = k - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.used[k] = 0
            k >>= 1
            while k and not (self.used[2 * k] or self.used[2 * k + 1]):
                self.used[k] = 0
                k >>= 1
        return capacity, row


def best_fit_decreasing(sizes: list[int], row_tokens: int) -> list[list[int]]:
    """Indices of the pieces in each row. Every size is between 1 and ``row_tokens``."""
    tree, rows = CapacityTree(row_tokens), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = row_tokens, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(i)
        if capacity > sizes[i]:
            tree.put(capacity - sizes[i], row)
    return rows


def pack_documents(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    row_tokens: int = ROW_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
    eos: int = EOS,
    pad: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    in_order: bool = False,
) -> DataFrame:
    """Packed rows of all documents; see ``COLUMNS``. ``in_order``: a window's rows go by the mean place of
    their pieces in what was read."""
    kind = "<u2" if eos < 1 << 16 else "<u4"
    schema = T.StructType([T.StructField(n, t or T.ArrayType(docs.schema[id_col].dataType)) for n, t in COLUMNS.items()])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def packed(pieces: list, shard: int, first: int) -> pa.RecordBatch:
        rows = []
        packs = best_fit_decreasing([len(p[2]) for p in pieces], row_tokens)
        if in_order:
            packs = sorted(packs, key=lambda members: sum(members) / len(members))
        for n, members in enumerate(packs):
            ids = np.full(row_tokens, pad, kind)
            ends = np.cumsum([len(pieces[i][2]) for i in members])
            for i, end in zip(members, ends, strict=True):
                ids[end - len(pieces[i][2]) : end] = pieces[i][2]
            bounds = [0, *ends.tolist()]
            rows.append((shard, first + n, bounds[-1], ids.tobytes(), bounds, bounds[:-1], [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        pieces, held, made = [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode_text(merges, text.as_py() or ""), eos], kind)
                for at in range(0, len(ids), row_tokens):
                    pieces.append((doc, at, ids[at : at + row_tokens]))
                held += len(ids)
                if held >= window_tokens:
                    out = packed(pieces, shard, made)
                    made += out.num_rows
                    pieces, held = [], 0
                    yield out
        if pieces:
            yield packed(pieces, shard, made)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def unpack(rows, id_bytes: int = 2) -> dict:
    """Token ids of each document from all of its packed rows (for documents with different ids)."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r.input_ids, f"<u{id_bytes}")
        for k, (doc, at) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)):
            parts.setdefault(doc, []).append((at, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    return {doc: [i for _, p in sorted(own) for i in p] for doc, own in parts.items()}


def write_matrices(packed: DataFrame, folder: str, row_tokens: int = ROW_TOKENS, id_bytes: int = 2) -> DataFrame:
    """Write each partition as files under ``folder``, a path that all executors mount; one row for each.

    ``<n>.ids``: the id matrix, row after row; ``<n>.cu``: for each row its number of bounds, then the
    bounds; ``<n>.pos``: each token's position, from 0 at each reset. A file is written under another
    name and renamed, so an attempt that is lost leaves nothing that is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{context.partitionId():06d}"
        own = f"{name}.{context.taskAttemptId()}"
        n = 0
        with open(f"{own}.ids", "wb") as ids, open(f"{own}.cu", "wb") as cu, open(f"{own}.pos", "wb") as pos:
            for batch in batches:
                for row in batch.select(["input_ids", "cu_seqlens"]).to_pylist():
                    bounds = np.array(row["cu_seqlens"], "<i4")
                    ids.write(row["input_ids"])
                    cu.write(np.array([len(bounds)], "<i4").tobytes() + bounds.tobytes())
                    at = np.arange(row_tokens) - np.repeat([*bounds[:-1], bounds[-1]], np.diff([*bounds, row_tokens]))
                    pos.write(at.astype("<i4").tobytes())
                    n += 1
        for kind in ("ids", "cu", "pos"):
            os.replace(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([row_tokens], pa.int32()), pa.array([id_bytes], pa.int32())], names=["file", "n_rows", "row_tokens", "id_bytes"])

    return packed.mapInArrow(run, "file string, n_rows long, row_tokens int, id_bytes int")


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
