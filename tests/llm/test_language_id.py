"""Language labels: forward-backward against enumeration, gradients' effect, held-out accuracy, odd rows."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from sievelake.llm import language_id as g
from tests.llm import cases

SF = "/root/testdata/sf0.01"
WORDS = {"aa": ["kato", "mika", "tokai", "naka"], "bb": ["schli", "strun", "gerst", "plock"], "cc": ["ñué", "éllo", "añi", "oué"]}


def texts(n=90, seed=2):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s"]) for _ in range(30)), lang) for k in range(n) for lang in [sorted(WORDS)[k % 3]]]


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([1, 4, 2, 5])
    scores, trans, start = rng.normal(size=(12, k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k)
    marginal, expected, total = g.forward_backward(scores, lengths, trans, start)
    want_m, want_e = np.zeros((12, k)), np.zeros((k, k))
    at = 0
    for c, n in enumerate(lengths):
        weights = {}
        for path in itertools.product(range(k), repeat=int(n)):
            s = start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
            weights[path] = np.exp(s)
        z = sum(weights.values())
        assert np.isclose(total[c], np.log(z))
        for path, w in weights.items():
            for i, y in enumerate(path):
                want_m[at + i, y] += w / z
            for a, b in itertools.pairwise(path):
                want_e[a, b] += w / z
        at += n
    assert np.allclose(marginal, want_m) and np.allclose(expected, want_e)


def test_code_switched_words():
    chain = g.train([(t.encode(), lang) for t, lang in texts()])
    text = "kato tokai mika schli gerst plocks oué éllo añi naka kato"
    assert [y for _, y, _ in g.label_words(chain, text)] == ["aa"] * 3 + ["bb"] * 3 + ["cc"] * 3 + ["aa"] * 2


def test_odd_rows_and_buffers(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)] + [(None, "x", "aa"), (999, None, "aa"), (1000, "kato", None)], "doc_id long, text string, lang string")
    chain = g.fit_languages(docs)
    odd = [(1, None), (2, ""), (3, "123 .."), (4, "—…"), (5, "É"), (6, "kato " * 30_000), (None, "schli"), (8, "schli gerst"), (8, "schli gerst")]
    table = cases.docs(spark, odd)
    got = sorted((r._id or 0, r.lang_pred, round(r.score, 6)) for r in g.identify(table, chain).collect())
    assert len(got) == 9 and all(0 <= s <= 1 for *_, s in got)
    by = {k: p for k, p, _ in got}
    assert [by[k] for k in (1, 2, 3, 4)] == ["und"] * 4 and by[5] != "und" and by[6] == "aa" and by[8] == by[0] == "bb"
    monkeypatch.setattr(g, "BUFFER_WORDS", 10)
    monkeypatch.setattr(g, "CACHE_WORDS", 2)
    many = [(k, t.encode()) for k, (t, _) in enumerate(rows)]
    small = {k: m.sum(axis=0) for k, m in g._labelled(chain, many)}
    monkeypatch.setattr(g, "BUFFER_WORDS", 10**6)
    whole = {k: m.sum(axis=0) for k, m in g._labelled(chain, many)}
    assert all(np.allclose(small[k], whole[k], atol=1e-3) for k in whole)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    chain = g.fit_languages(none)
    assert chain is None
    assert [(r.lang_pred, r.score) for r in g.identify(cases.docs(spark, [(1, "abc")]), chain).collect()] == [("und", 0.0)]
    assert g.identify(cases.empty(spark), chain).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_on_tables(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = g.op10_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_many_languages_are_sampled_in_two_passes(spark):
    rows = [(k, "kato " * 3, f"l{k % 40:02}") for k in range(4000)] + [(5000 + k, "gerst " * 3, "hot") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    read = []
    train = lambda texts: read.append(texts)
    g.train, kept = train, g.train
    try:
        g.fit_languages(docs, sample_docs=10)
        g.fit_languages(docs, sample_docs=10, sample_total=82)
        g.fit_languages(docs, sample_docs=10, sample_bytes=41 * 60)
    finally:
        g.train = kept
    for texts, each in zip(read, (10, 2, 3), strict=True):
        assert {lang: sum(y == lang for _, y in texts) for _, lang in texts} == {lang: each + (each == 3) * (lang != "hot") for lang in {r[2] for r in rows}}


def test_sampled_texts_are_read_whole(spark):
    docs = spark.createDataFrame([(k, "kato " * 9000 + "schli " * (k % 2), "aa") for k in range(20)], "doc_id long, text string, lang string")
    read = []
    g.train, kept = (lambda texts: read.extend(texts)), g.train
    try:
        g.fit_languages(docs)
    finally:
        g.train = kept
    assert sorted(len(t) for t, _ in read) == sorted(len(r.text) for r in docs.collect())
