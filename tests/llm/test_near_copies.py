"""Near copies against brute force over all pairs."""

import random

import numpy as np
import pytest

from sievelake.llm import near_copies as m
from tests.llm import cases


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The ids that stay when texts within the radius link at a similarity of 0.8 (wordless ones always)."""
    rows = sorted(rows)
    sets = [grams(t) for _, t in rows]
    fps = [m.word_fingerprint((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not any_ or (5 * both >= 4 * any_ and (fps[i] ^ fps[j]).bit_count() <= m.RADIUS):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return sorted(rows[k][0] for k in {find(k) for k in range(len(rows))})


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"w{rng.randrange(5000)}"
        out.append(" ".join(own))
    return out


def test_variants_give_their_owner_back():
    fps = np.array([0, 2**64 - 1, 0x0123456789ABCDEF], np.uint64)
    keys, codes = m.variants(fps)
    assert len(keys) == 3 * 198
    assert (m.owners(keys, codes).reshape(6, 3, 33) == fps[None, :, None]).all()


def test_all_within_the_radius_meet():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, m.RADIUS + 1)))
        runs = [set((m.variants(np.array([x], np.uint64))[0] >> np.uint64(6)).tolist()) for x in (a, b)]
        assert runs[0] & runs[1]


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_runs_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(m, "TILE_CELLS", cells)
    rng = random.Random(2)
    near = [sum(1 << k for k in rng.sample(range(16), rng.randrange(6))) for _ in range(40)]
    runs = [sorted(set(near)), [1, 2], [7], [1 << 60, 3, 2**50 - 1]]
    keys = np.concatenate([np.full(len(x), k << 6, np.uint64) for k, x in enumerate(runs)])
    fps = np.concatenate([np.array(x, np.uint64) for x in runs])
    got = {}
    for a, b, bits in zip(*(x.tolist() for x in m.nearest(keys, fps)), strict=True):
        assert (a ^ b).bit_count() == bits
        got.setdefault((a, bits), 0)
        got[a, bits] += 1
    want = {}
    for run in runs:
        for a in run:
            least = min(((a ^ b).bit_count() for b in run if b != a), default=99)
            if least <= m.RADIUS:
                want[a, least] = want.get((a, least), 0) + 1
    assert got == want
    few = np.bincount(keys.astype(np.int64) >> 6)[keys.astype(np.int64) >> 6] <= m.SMALL_RUN
    listed = sorted((min(a, b), max(a, b), n) for a, b, n in zip(*(x.tolist() for x in m.close(keys[few], fps[few])), strict=True))
    assert listed == sorted((a, b, (a ^ b).bit_count()) for run in runs if len(run) <= m.SMALL_RUN for a in run for b in run if a < b and (a ^ b).bit_count() <= m.RADIUS)
    labels = [rng.choice([b"x", b"y", b"z"]) for _ in fps]
    pairs = sorted(tuple(sorted(((a, x), (b, y)))) for part in m.apart(keys, fps, labels) for a, x, b, y in zip(part[0].tolist(), part[1], part[2].tolist(), part[3], strict=True))
    named = [(int(k), int(f), x) for k, f, x in zip(keys, fps, labels, strict=True)]
    wanted = sorted(
        tuple(sorted(((a, x), (b, y))))
        for i, (k, a, x) in enumerate(named)
        for kk, b, y in named[:i]
        if k == kk and x != y and (a ^ b).bit_count() <= m.RADIUS
    )
    assert pairs == wanted and pairs


def test_groups_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = [t for n, words, edits in ((40, 200, 4), (30, 90, 2), (25, 400, 12), (3, 8, 1)) for t in family(rng, n, words, edits)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(40)] + texts[:10]
    base = texts[0].split()
    texts += [" ".join(rng.sample(base, len(base))) for _ in range(5)]  # the same words, other shingles
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = cases.docs(spark, rows)
    for limit, small in ((1 << 20, 16), (0, 1)):
        monkeypatch.setattr(m, "SMALL_RUN", small)
        kept = m.keep_one(docs, broadcast_bytes=limit)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    assert len(brute_kept(rows)) < len(set(texts)) - 30


def test_long_families_meet_in_the_second_turn(spark):
    # Chains whose nearest fingerprints leave components apart, all joined in the end.
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(150):
        words = list(words)
        for _ in range(2):
            words[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    assert sorted(r.doc_id for r in m.keep_one(cases.docs(spark, rows)).collect()) == brute_kept(rows)


def test_odd_rows(spark):
    assert m.keep_one(cases.empty(spark)).collect() == []
    long = "a b c d e f " * 200_000
    rows = [(4, None), (None, ""), (3, " \n"), (9, "One two"), (8, "one TWO"), (8, "one two"), (None, "x y z v w u"), (2, long), (5, long + "a")]
    docs = spark.createDataFrame([(i, t, "own", 7, b"s") for i, t in rows], "doc_id long, text string, fp string, Row_No int, sig binary")
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp, r.Row_No) for r in kept.collect()) == [(False, 2, "own", 7), (False, 3, "own", 7), (False, 8, "own", 7), (True, 0, "own", 7)]


def test_like_texts_that_do_not_link_are_not_listed_pair_by_pair(spark, monkeypatch):
    # Each text has edits of its own, so fingerprints are close and similarities of any two below 0.8.
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(300):
        own = list(base)
        for at in range(rng.randrange(12), 150, 24):
            own[at] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    seen = []
    verified = m.verified
    monkeypatch.setattr(m, "verified", lambda near, *rest: seen.append(near.count()) or verified(near, *rest))
    assert sorted(r.doc_id for r in m.keep_one(cases.docs(spark, rows)).collect()) == brute_kept(rows)
    assert len(brute_kept(rows)) > 250
    assert sum(seen) < 10 * len(rows)
