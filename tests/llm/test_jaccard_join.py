"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest

from sievelake.llm import jaccard_join as j
from tests.llm import cases


def brute_set(text, width=3):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < width:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, num=90, den=100):
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(k)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    return sorted((doc, len(sets[i]), min(d for d in least[find(i)])) for i, (doc, _) in enumerate(rows))


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edited(rng, words, n):
    own = list(words)
    for _ in range(n):
        own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
    return " ".join(own)


@pytest.mark.parametrize("tile", [1024, 3])
def test_against_brute_force(spark, tile):
    rng = random.Random(tile)
    rows = [(k, t) for k, t in enumerate([None, "", " \n\t", "one", "One", "two words", "two  WORDS", "a b c", "a b c d", "É é É é", "é é é é"])]
    for size, copies, edits in ((60, 25, 2), (200, 30, 8), (400, 12, 6), (35, 20, 1), (90, 15, 5)):
        base = [f"w{rng.randrange(300)}" for _ in range(size)]
        rows += [(1000 + len(rows) + k, edited(rng, base, rng.randint(0, edits))) for k in range(copies)]
    # A common passage before different ends: near 0.9 on both sides of it.
    passage = [f"p{k}" for k in range(100)]
    rows += [(5000 + k, " ".join(passage + [f"q{k}-{i}" for i in range(rng.randint(2, 9))])) for k in range(40)]
    rows += [(7000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for k in range(40)]
    rng.shuffle(rows)
    got = j.jaccard_components(cases.docs(spark, rows).repartition(6), tile=tile, broadcast_bytes=-1 if tile == 3 else 1 << 20)
    assert rows_of(got) == brute(rows)


@pytest.mark.parametrize("num, den", [(80, 100), (1, 2)])
def test_other_thresholds(spark, num, den):
    rng = random.Random(num)
    base = [f"w{k}" for k in range(40)]
    rows = [(k, edited(rng, base, rng.randint(0, 6))) for k in range(60)]
    assert rows_of(j.jaccard_components(cases.docs(spark, rows), num, den)) == brute(rows, num, den)


def test_the_exact_edge(spark):
    # 18 of 20 n-grams in common is 0.9, 17 of 19 is less.
    edge = [" ".join(f"a{k}" for k in range(n)) for n in (20, 22)]
    below = [" ".join(f"b{k}" for k in range(n)) for n in (19, 21)]
    rows = list(enumerate(edge + below))
    assert rows_of(j.jaccard_components(cases.docs(spark, rows))) == [(0, 18, 0), (1, 20, 0), (2, 17, 2), (3, 19, 3)]


def test_links_that_the_first_turn_does_not_see(spark, monkeypatch):
    """Without strides beyond the next member, the second turn has to find the rest."""
    monkeypatch.setattr(j, "STRIDES", (1,))
    rng = random.Random(8)
    base = [f"w{k}" for k in range(70)]
    rows = [(k, edited(rng, base, rng.choice([1, 6]))) for k in range(70)]
    assert rows_of(j.jaccard_components(cases.docs(spark, rows), tile=8)) == brute(rows)


def test_sets_and_filters():
    for t in [None, "", "one", "One two", "a b c", "A b c d É e" * 7, "x y z " * 4000]:
        assert len(j.ngram_set(None if t is None else t.encode())) == len(brute_set(t))
    many = " ".join(f"w{k}" for k in range(3 * j.PIECE_WORDS // 2))
    assert len(j.ngram_set(many.encode())) == 3 * j.PIECE_WORDS // 2 - 2
    for n in range(1, 60):
        for m in range(1, 60):
            assert j.need(n, m) == next(c for c in range(200) if 100 * c >= 90 * (n + m - c))
        assert j.prefix_length(n) == n - min(j.need(n, m) for m in range(1, 100) if j.need(n, m) <= min(n, m)) + 1


def test_counters_grade_rare_before_common(spark):
    common = " ".join(f"c{k}" for k in range(30))
    docs = cases.docs(spark, [(k, f"{common} r{k} s{k} t{k}") for k in range(400)]).select("doc_id", "text").repartition(7)
    grades = j.rarity(j.set_keys(docs))
    place = lambda t: (j.ngram_set(t.encode()) >> np.uint64(64 - j.SKETCH_BITS)).astype(np.int64)
    assert (grades[place(common)] > 127).all() and grades[place("r5 s5 t5")].max() < 5


def test_repeats_null_ids_and_empty(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "A b c"), (None, "x y z"), (None, None), (7, None), (8, "")]
    got = j.jaccard_components(cases.docs(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == [(5, 1, 5), (5, 1, 5), (7, 0, 7), (8, 0, 8), (None, 0, None), (None, 1, None), (None, 1, 5)]
    assert j.jaccard_components(cases.empty(spark)).collect() == []
