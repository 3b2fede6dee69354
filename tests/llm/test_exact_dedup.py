"""Exact dedup against dictionaries, and the filter's merges."""

import hashlib
import random
import re

import numpy as np

from sievelake.llm import common
from sievelake.llm import exact_dedup as e
from tests.llm import cases


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 300, dtype=np.uint64)
    parts = [rng.choice(pool, 200) for _ in range(4)] + [np.zeros(0, np.uint64), np.array([0, 2**64 - 1, 0], np.uint64)]
    whole = e.CountingQuotientFilter.of(parts[0])
    for p in parts[1:]:
        whole = whole.merge(e.CountingQuotientFilter.of(p))
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    together = e.CountingQuotientFilter.merged(e.CountingQuotientFilter.of(p) for p in parts)
    for one in (whole, together):
        assert (one.fingerprints() == values).all() and (one.counts == counts).all()
    assert e.CountingQuotientFilter.merged([]) is None
    back = [e.CountingQuotientFilter.unpack(k, 256, data) for k, data in whole.ranges(256)]
    assert (np.concatenate([b.fingerprints() for b in back]) == values).all()
    assert (np.concatenate([b.counts for b in back]) == counts).all()


def test_bitmap_has_the_repeated_quotients(spark):
    fps = [0, 1, -1, 5 << 36, (5 << 36) + 7, 32767 << 36, 32768 << 36, -(1 << 63)]
    bits = np.unpackbits(common.bitmap_of(spark.createDataFrame([(v,) for v in fps], "fp long"), "fp", e.BITMAP_BITS), bitorder="little")
    assert np.flatnonzero(bits).tolist() == sorted({(v % (1 << 64)) >> 36 for v in fps})


def brute(rows):
    clean = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (k, _), c in zip(rows, clean, strict=True):
        same = [r[0] for r, x in zip(rows, clean, strict=True) if x == c]
        out.append((k, min(same), len(same), k == min(same), hashlib.sha256(c.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["a b", "a\t b", " a b", "a b ", "", " ", "\n\n", None, "é  x", "é x", "long " * 9000, "long\n" * 9000, "a b"]
    rows = [(k, rng.choice(texts)) for k in rng.sample(range(-50, 400), 200)]
    docs = cases.docs(spark, rows)
    for limit in (1 << 20, -1):  # a broadcast set, and the shuffled semi-join
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in e.exact_groups(docs, limit).collect())
        assert got == brute(rows)


def test_repeats_null_ids_and_empty(spark):
    rows = e.exact_groups(cases.docs(spark, [(5, "x"), (5, "x"), (None, "x"), (None, "y"), (7, "z")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in rows) == [(0, 0, 1), (0, 5, 3), (5, 5, 3), (5, 5, 3), (7, 7, 1)]
    assert sum(r.kept for r in rows) == 3
    assert e.exact_groups(cases.empty(spark)).collect() == []
