"""The source audit against plain counting in whole numbers."""

import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from sievelake.llm import source_audit as s

SCHEMA = "doc_id long, text string, lang string, source string, part string, item string, value string, rank string, shard string"
UPPER = {c: c + 32 for c in range(65, 91)}


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, *["clash"] * 5) for k, (t, lang, source) in enumerate(rows)], SCHEMA)


def brute(rows, min_docs, top):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        counts[lang, None].update(words)
        found[lang].update(set(words))
    out = []

    def p_of(lang, source):
        kept = [w for w, n in found[lang].items() if n >= min_docs]
        n = sum(counts[lang, source][w] for w in kept)
        return {w: 1 + 1_000_000_000 * (counts[lang, source][w] + 1) // (n + len(kept)) for w in kept}

    def f(p, q):
        return (p - q) * (p - q) // q

    for lang, source in groups:
        mine, all_of = p_of(lang, source), p_of(lang, None)
        pairs = [(-sum(f(p, q[w]) for w, p in mine.items()), other.encode()) for other, q in ((o, p_of(lang, o)) for g, o in groups if g == lang and o != source)]
        terms = [(-f(p, all_of[w]), w.encode()) for w, p in mine.items() if counts[lang, source][w] and p > all_of[w]]
        for part, values, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(sorted(values)[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("blocks, shard_counts, top", [(1, 10**6, 200), (3, 40, 4), (5, 7, 1), (15, 100, 3)])
def test_against_brute_force(spark, blocks, shard_counts, top):
    rng = random.Random(blocks)
    words = [*"abcdefghij", "É", "É́t", "naïve", "日本", "Z9z", "x1y2"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", "é", None, "S1", ""])) for _ in range(120)]
    rows += [("hot a a a", "en", "s1")] * 60 + [(None, "en", "no text"), ("12 -- 3", "fr", "f1"), ("once only", "fr", "f2"), ("", None, None), ("lone", "xx", "alone")]
    got = s.audit_sources(table(spark, rows).repartition(5), 3, top, blocks, shard_counts)
    assert rows_of(got) == brute(rows, 3, top)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(s, "PIECE", 7)
    text = "Aé bb, ccc" * 30 + "x" * 40 + "é" * 20
    words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UPPER))
    assert [w.decode() for part in s.terms_of(text.encode()) for w in part] == words


def test_dictionaries_are_passed_on_when_full(spark, monkeypatch):
    rows = [(f"w{k % 7} w{k % 3} common", "en", f"s{k % 4}") for k in range(60)]
    docs = table(spark, [(t.translate({48 + d: 97 + d for d in range(10)}), *g) for t, *g in rows])
    whole = sorted(map(tuple, s.count_terms(docs).collect()), key=str)
    monkeypatch.setattr(s, "HELD_BYTES", 2500)
    assert sorted(map(tuple, s.count_terms(docs).collect()), key=str) == whole


def test_shares_are_exact_for_huge_counts():
    for count, total, n in product([0, 5, 10**15 - 1], [10**15, 9 * 10**15], [1, 10**6]):
        assert s.shares(np.array([count]), total, n).tolist() == [1 + 10**9 * (count + 1) // (total + n)]
    assert s.shares(np.array([7]), 7, 1).tolist() == [10**9 + 1]


def test_vectors_come_back():
    for places, counts in ([], []), ([0], [255]), ([3, 4, 400, 70_000], [1, 256, 1, 2**40]):
        a, b = s.unpack(s.pack(np.array(places, np.int64), np.array(counts, np.int64)))
        assert a.tolist() == places and b.tolist() == counts


def test_each_two_blocks_meet_once():
    for blocks in (1, 3, 5, 15):
        met = [(i, (i + r) % blocks) for r in range((blocks - 1) // 2 + 1) for i in range(blocks)]
        assert len({frozenset(m) for m in met}) == len(met) == blocks * (blocks + 1) // 2


def test_no_kept_terms_and_empty(spark):
    got = rows_of(s.audit_sources(table(spark, [("a", "en", "x"), ("b", "en", "y"), ("c", "en", None)])))
    assert got == [("en", "", "pair", "x", 0, 1), ("en", "", "pair", "y", 0, 2), ("en", "x", "pair", "", 0, 1), ("en", "x", "pair", "y", 0, 2), ("en", "y", "pair", "", 0, 1), ("en", "y", "pair", "x", 0, 2)]
    assert s.audit_sources(table(spark, [])).collect() == []
