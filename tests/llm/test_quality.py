"""Quality: held-out accuracy, the fold rule, and odd rows."""

import os
import random
import zlib

import pytest

from sievelake.llm import common
from sievelake.llm import quality as q
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["ba", "lo", "miru", "tesa", "von", "kel", "the", "of"]
    good = lambda: " ".join(rng.choices(words, k=60)).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(words, k=60))
    return [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = cases.docs(spark, [(k, t) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = q.fit_quality(docs, q.open_labels(labels))
    got = {r.doc_id: (r.score, r.predicted) for r in q.score_quality(docs, model).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(held) > 50 and sum(got[k][1] == y for k, y in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in got.values())


def test_held_out_labels_are_not_read(spark):
    rows = corpus(120)
    docs = cases.docs(spark, [(k, t) for k, t, _ in rows])
    fold = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    true = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    false = spark.createDataFrame([(k, 1 - y if fold(k) else y) for k, _, y in rows], "doc_id long, quality int")
    models = [q.fit_quality(docs, q.open_labels(x)) for x in (true, false)]
    assert models[0].good == models[1].good and models[0].bad == models[1].bad and models[0].weights == models[1].weights


def test_odd_rows_and_filter(spark):
    rows = corpus()
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    docs = cases.docs(spark, [(k, t) for k, t, _ in rows])
    model = q.fit_quality(docs, labels)
    odd = cases.docs(spark, [(1, None), (2, ""), (3, "x"), (None, "ba lo"), (5, "KEL!! " * 60_000), (5, "KEL!! " * 60_000)])
    got = q.score_quality(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score and by[5].predicted == 0
    kept = q.keep_good(odd, model)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()}
    assert q.score_quality(cases.empty(spark), model).collect() == []


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = cases.docs(spark, [(1, "a")])
    assert [r.score for r in q.score_quality(docs, q.fit_quality(docs, none)).collect()] == [0.5]
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [round(r.score, 9) for r in q.score_quality(docs, q.fit_quality(docs, ones)).collect()] == [round(2 / 3, 9)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_on_tables(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = q.op7_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_sample_is_bounded_in_rows_and_bytes_and_read_whole(spark, monkeypatch):
    docs = cases.docs(spark, [(k, f"{'abc ' * 9000}{k}") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    read = []
    monkeypatch.setattr(q, "fit_texts", lambda good, bad, rate: read.append((good, bad)))
    q.fit_quality(docs, labels)
    q.fit_quality(docs, labels, sample_rows=5)
    q.fit_quality(docs, labels, sample_bytes=3 * 36_010)
    assert [(len(g), len(b)) for g, b in read] == [(20, 20), (5, 5), (3, 3)]
    assert all(len(t) > 36_000 for g, b in read for t in [*g, *b])


def test_a_large_text_keeps_no_others_out(spark):
    """The first by hash may be of any size; each group has a row at least."""
    rows = [("a", 0, "x" * 900), *[("a", k, "y" * 40) for k in range(1, 30)], ("b", 0, "z" * 5000), ("c", 0, ""), ("d", 0, "v" * 800), ("d", 1, "w" * 50), ("d", 2, "u" * 30)]
    df = spark.createDataFrame(rows, "g string, k long, t string")
    drawn = {}
    for r in common.first_rows(df, "g", ["k"], "t", 10, 1000).collect():
        drawn.setdefault(r.g, set()).add(r.k)
    assert drawn == {"a": set(range(1, 11)), "b": {0}, "d": {0, 1, 2}}
