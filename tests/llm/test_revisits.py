"""Revisits against a scan of all earlier responses."""

import random

import pytest
from pyspark.sql import functions as F

from sievelake.llm import revisits as r

SCHEMA = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, payload_digest string, canonical string, chunk int"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://Example.com", "example.com"),
        ("https://www.Example.com:443/a/?utm_source=x&b=2&a=1#top", "example.com/a?a=1&b=2"),
        ("HTTP://user@ex.org:8080/A//", "ex.org:8080/A"),
        ("http://ex.org/?ref=1", "ex.org"),
        ("http://ex.org/x?", "ex.org/x"),
        ("ftp://ex.org/x", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(r.canonical_url(F.col("u")).alias("c")).first().c == want


def brute(rows):
    out = []
    strip = lambda e: (e or "").strip().removeprefix("W/") or None
    for k, url, ts, status, etag, mod, headers, *_ in rows:
        if status != 304:
            continue
        own = {a.strip().lower(): b for a, b in (headers or {}).items()}
        if url is None or ts is None:
            out.append((k, None, "invalid", tuple(sorted(own.items()))))
            continue
        past = [x for x in rows if x[3] == 200 and x[1] is not None and x[2] is not None and x[1].lower() == url.lower() and x[2] < ts]
        if not past:
            out.append((k, None, "orphan", tuple(sorted(own.items()))))
            continue
        to = max(past, key=lambda x: (x[2], x[0]))
        if strip(etag) and strip(to[4]):
            said = "resolved" if strip(etag) == strip(to[4]) else "mismatch"
        elif mod and to[5]:
            said = "resolved" if mod == to[5] else "mismatch"
        else:
            said = "unverified"
        if said == "resolved":
            stored = {a.strip().lower(): b for a, b in (to[6] or {}).items()}
            own = stored | {a: b for a, b in own.items() if a not in r.KEEP_STORED}
        out.append((k, to[0], said, tuple(sorted(own.items()))))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunks", [1, 3, 1024])
def test_against_brute_force(spark, chunks):
    rng = random.Random(chunks)
    rows = []
    for k in range(160):
        url = rng.choice(["http://a.org/x"] * 6 + ["http://b.org/", None])
        headers = rng.choice([None, {}, {"Age": str(k), "ETag": "q"}, {"age": "1", "Content-Type": "t", "X": str(k)}])
        rows.append((k, url, rng.choice([None, *range(40), *range(40), -(2**63), 2**63 - 1]), rng.choice([200, 304, 304, 404]), rng.choice([None, "e1", "W/e1", "e2", " "]), rng.choice([None, "d1", "d2"]), headers, f"p{k}", "clash", 0))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(x.record_id, x.refers_to, x.outcome, tuple(sorted(x.headers.items()))) for x in r.resolve_revisits(df, chunks).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_payload_and_empty(spark):
    rows = [(1, "http://a.org/x", 1, 200, "e", None, None, "p1", None, None), (2, "https://A.org/x/", 5, 304, "W/e", None, {"A": "1", "a": "2"}, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = r.resolve_revisits(df)
    one = found.first()
    assert (one.outcome, one.refers_to, one.payload_digest) == ("resolved", 1, "p1") and one.headers["a"] in ("1", "2")
    body = r.attach_payload(found, df.select("record_id", F.lit("<html>").alias("html")))
    assert [(x.record_id, x.html) for x in body.collect()] == [(2, "<html>")]
    assert r.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
