"""SimHash components against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from sievelake.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = [None, "", " \n", "one", "One two", "a b c", "A b c d É e" * 7, "x y z " * 4000]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_variants_give_their_owner_back():
    fps = np.array([0, 2**64 - 1, 0x0123456789ABCDEF], np.uint64)
    keys, codes = simhash.variants(fps)
    assert len(keys) == 3 * 196
    back = simhash.owners(keys, codes).reshape(4, 3, 49)
    assert (back == fps[None, :, None]).all()


@pytest.mark.parametrize("limit", [2048, 1])
def test_forest_connects_what_is_linked(monkeypatch, limit):
    monkeypatch.setattr(simhash, "LONG_RUN", limit)
    rng = random.Random(1)
    for block in range(4):
        for _ in range(12):
            base = rng.getrandbits(64)
            closed = [b for b in range(64) if b // 16 != block]
            members = set()
            for _ in range(rng.randrange(2, 40)):
                x = base
                if rng.random() < 0.7:
                    x ^= 1 << rng.choice(closed)
                for b in rng.sample(range(16), rng.randrange(0, 5)):
                    x ^= 1 << (block * 16 + b)
                members.add(x)
            members = np.array(sorted(members), np.uint64)
            want = brute_components([int(x) for x in members])
            place = {int(x): i for i, x in enumerate(members)}
            label = list(range(len(members)))
            for a, b in simhash.forest(members, block):
                assert (a ^ b).bit_count() <= 3
                i, j = label[place[a]], label[place[b]]
                label = [min(i, j) if x in (i, j) else x for x in label]
            assert label == want


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)) for _ in range(12)]
    texts = [None, "", " ", "a", "A", "a b", *base]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    rows = [(i * 3 + 1, t, None, None, None, "clash") for i, t in enumerate(texts)] + [(1, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    want = sorted((rows[i][0], fps[i], min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[i])) for i in range(len(rows)))
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_components(docs).collect())
    assert got == want
    assert len(set(roots)) < len(rows) - 20
    for limit in (1 << 20, 0):
        kept = simhash.keep_one(docs, broadcast_bytes=limit)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_chance_pairs_of_random_fingerprints(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for n in (1, 2, 3, 4):
            x = f
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            fps.append(x)
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.near_links(df)).collect()}
    roots = brute_components([f % 2**64 for f in fps])
    groups = {}
    for f, r in zip(fps, roots, strict=True):
        groups.setdefault(r, []).append(f)
    assert got == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}


def test_empty_and_null_ids(spark):
    assert simhash.near_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, "a b c", None, None, None, None), (4, "a b c", None, None, None, None)], SCHEMA)
    assert {r.component_id for r in simhash.near_components(docs).collect()} == {4}
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [4]
