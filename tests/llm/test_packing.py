"""Packing: exact round trips, the bin choice against brute force, and files."""

import os
import random

import numpy as np
import pytest

from sievelake.llm import packing
from tests.llm import cases

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary files here")


def brute_best_fit(sizes, most):
    rows, left = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if left[r] >= sizes[i]]
        if fits:
            r = min(fits, key=lambda r: left[r])
        else:
            r = len(rows)
            rows.append([])
            left.append(most)
        rows[r].append(i)
        left[r] -= sizes[i]
    return rows, left


@pytest.mark.parametrize("most", [1, 2, 7, 64, 100])
def test_best_fit_takes_the_fullest_row(most):
    rng = random.Random(most)
    for _ in range(40):
        sizes = [rng.randint(1, most) for _ in range(rng.randrange(60))]
        got = packing.best_fit_decreasing(sizes, most)
        rows, left = brute_best_fit(sizes, most)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        # Ties between equally full rows may differ; how full the rows are may not.
        assert sorted(most - sum(sizes[i] for i in r) for r in got) == sorted(left)


def test_round_trip(spark):
    texts = [(1, None), (2, ""), (3, "a"), (4, "Hello wörld 🙂 <|endoftext|>"), (5, "x" * 5000), (6, "word " * 3000), (7, "\n\n  tabs\t"), (8, "a"), (-9, "z")]
    packed = packing.pack_documents(cases.docs(spark, texts), row_tokens=64, window_tokens=500).collect()
    back = packing.unpack(packed)
    encode = packing.encoder(packing.TOKENIZER)
    assert back == {k: [*encode.encode_ordinary(t or ""), packing.EOS] for k, t in texts}
    assert {k: encode.decode(v[:-1]) for k, v in back.items()} == {k: t or "" for k, t in texts}
    for r in packed:
        assert len(r.input_ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_offsets) == len(r.cu_seqlens) - 1


def test_long_runs(spark):
    encode = packing.encoder(packing.TOKENIZER)
    rng = random.Random(4)
    blanks = " \n\t\r\x85\xa0\u2003\u3000\x1c"
    for _ in range(300):  # cut and uncut encodings agree where both can be had
        parts = [rng.choice(["a", " b", "7", "é", "!", "\x1c", "".join(rng.choices(blanks, k=rng.choice([1, 2, 30]))), rng.choice(blanks[:8]) * rng.choice([9_999, 10_000, 10_001])]) for _ in range(rng.randrange(1, 6))]
        text = "".join(parts)
        assert packing.encode_text(encode, text) == encode.encode_ordinary(text)
    texts = [(1, " " * 2_000_000 + "a"), (2, "x" * 1_000_000), (3, "\n" * 1_000_000), (4, "a" + "\n " * 600_000 + " z")]
    back = packing.unpack(packing.pack_documents(cases.docs(spark, texts)).collect())
    assert {k: encode.decode(v[:-1]) for k, v in back.items()} == dict(texts)


def test_ids_of_other_types(spark):
    rows = [("a-1", "one"), (None, "two"), ("b", None)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted((d or "" for r in packed.collect() for d in r.doc_ids)) == ["", "a-1", "b"]
    assert packed.schema["doc_ids"].dataType.simpleString() == "array<string>"


def test_null_ids_repeats_and_empty(spark):
    packed = packing.pack_documents(cases.docs(spark, [(None, "a b"), (1, "c"), (1, "c")])).collect()
    assert sorted((d is None, d or 0) for r in packed for d in r.doc_ids) == [(False, 1), (False, 1), (True, 0)]
    assert packing.pack_documents(cases.empty(spark)).collect() == []


def test_matrices(spark, tmp_path):
    packed = packing.pack_documents(cases.docs(spark, [(k, "ab " * (5 * k)) for k in range(20)]).coalesce(1), row_tokens=32)
    rows = packed.collect()
    files = packing.write_matrices(packed, str(tmp_path / "out"), row_tokens=32).collect()
    assert sum(f.n_rows for f in files) == len(rows)
    f = next(f for f in files if f.n_rows)
    ids = np.fromfile(f"{f.file}.ids", "<u2").reshape(-1, 32)
    assert ids.tobytes() == b"".join(r.input_ids for r in rows)
    pos = np.fromfile(f"{f.file}.pos", "<i4").reshape(-1, 32)
    cu, at = np.fromfile(f"{f.file}.cu", "<i4"), 0
    for k, r in enumerate(rows):
        assert cu[at + 1 : at + 1 + cu[at]].tolist() == r.cu_seqlens
        at += 1 + cu[at]
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert pos[k, a:b].tolist() == list(range(b - a))
    assert {x.rsplit(".", 1)[1] for x in os.listdir(tmp_path / "out")} == {"ids", "cu", "pos"}
