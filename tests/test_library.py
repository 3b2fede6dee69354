"""Vectors of the scalar functions, and the operators on small libraries."""

import io
import itertools
import json
import os
import random
import re
import time
import zipfile
import zlib
from datetime import datetime
from math import log

import pytest
from pyspark.sql import functions as F

from sievelake import schema
from sievelake.functions import names, scores, text
from sievelake.operators import all_pairs, identity, library, review, scoring, set_pairs, shingles, similar_names, tier1
from sievelake.plans import queries
from sievelake.sources import extract, objects, session
from sievelake.sources import library as source
from sievelake.sources import stage
from sievelake.sources.tables import Change, Conflict, Tables
from sievelake.streaming.ingest import EVENTS, UPLOADS, LibraryState


def values(spark, rows, ddl, *columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_sha256(spark):
    got = values(spark, [("abc",)], "t string", F.sha2("t", 256))
    assert got == [("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",)]


def test_shingle_hash():
    assert text.shingle_hash("Hello   World a B c") == text.shingle_hash("hello world a b c")
    assert text.shingle_hash("a b c d e") == -2151162946836183668
    assert text.shingle_hash("hello wörld") == -24157707937361841
    h = 0xCBF29CE484222325
    for b in b"x y z":
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert text.shingle_hash("x y z") % 2**64 == h


def test_shingles():
    hashes, offsets = text.shingle_text("a b c d e f")
    assert offsets.tolist() == [0, 2] and hashes.tolist() == [text.shingle_hash("a b c d e"), text.shingle_hash("b c d e f")]
    assert [len(text.shingle_text(t)[0]) for t in ("", None, "a b c d", "  ")] == [0] * 4
    body = "The  general\ttheory of\nrelativity and more"
    _, offsets = text.shingle_text(body)
    assert body[offsets[1] :].startswith("general")
    assert text.shingle_text("a\xa0b　c d e")[1].tolist() == [0]
    assert len(text.shingle_text("a\x85b c d e")[0]) == 0


def test_filename_similarity(spark):
    rows = [("Report", "report"), ("kitten", "sitting"), ("", ""), ("", "abc")]
    got = values(spark, rows, "a string, b string", names.filename_similarity(F.col("a"), F.col("b")))
    assert got == [(1.0,), (1 - 3 / 7,), (1.0,), (0.0,)]


def test_names(spark):
    rows = [(n,) for n in ("Report Final.PDF", "archive.tar.gz", "noext", "/tmp/dir/notes.md", ".bashrc", "file.", "a\\b.c")]
    got = values(spark, rows, "n string", names.extension_of(F.col("n")), names.stem_of(F.col("n")))
    assert got == [("pdf", "Report Final"), ("gz", "archive.tar"), ("", "noext"), ("md", "notes"), ("bashrc", ".bashrc"), ("", "file"), ("c", "b")]
    renamed = values(spark, [(" a.b.C ",), (".x",), ("  ",), ("plain",)], "n string", names.rename_parts(F.col("n")))
    assert [r[0] and tuple(r[0]) for r in renamed] == [("a.b.C", "a.b", "c"), (".x", "", "x"), None, ("plain", "plain", "")]
    kinds = values(spark, [(e,) for e in ("DOCX", "pptx", "xlsx", "Pdf", "md", "csv", "png")], "e string", names.format_of(F.col("e")))
    assert [k[0] for k in kinds] == ["docx", "pptx", "xlsx", "pdf", "plain", "plain", "unsupported"]


def test_floors(spark):
    rows = [("docx", None), ("pdf", 3), ("pdf", None), ("pptx", 4), ("pptx", 0), ("xlsx", 10), ("plain", None), ("unsupported", None)]
    n = F.col("n")
    got = values(spark, rows, "f string, n int", scores.expected_chars(F.col("f"), n, n, n))
    assert [g[0] for g in got] == [1500, 4500, 1500, 600, 150, 40, 0, 0]
    got = values(spark, [(300, 1500), (299, 1500), (0, 0)], "a int, e int", scores.passes_floor(F.col("a"), F.col("e")))
    assert [g[0] for g in got] == [True, False, True]


def test_classification(spark):
    rows = [(0.8, False, 0.5), (0.0, False, 1.0), (0.4, False, 0.9), (None, False, 0.79), (None, False, 0.8), (0.9, True, 0.5), (None, False, 0.42)]
    c, p, f = F.col("c"), F.col("p"), F.col("f")
    got = values(spark, rows, "c double, p boolean, f double", scores.flagged(c, f), scores.confidence(c, p), scores.composite(c, f))
    assert [g[0] for g in got] == [True, False, True, False, True, True, False]
    assert [g[1] for g in got] == ["high", "high", "high", "metadata-only", "metadata-only", "provisional", "metadata-only"]
    assert got[0][2] == pytest.approx(0.71) and got[2][2] == 0.55 and got[6][2] == 0.42


def test_sizes_and_display(spark):
    low, high = scores.size_band(F.col("n"))
    got = values(spark, [(1,), (100,), (708,), (1000,), (1200,)], "n long", scores.size_bucket(F.col("n")), low, high)
    assert [g[0] for g in got] == [0, 25, 35, 37, 38]
    assert not got[0][1] <= 1 <= got[0][2] and not got[1][1] <= 137 <= got[1][2] and got[2][1] <= 501 <= got[2][2]
    shown = values(spark, [(float(n),) for n in (0, 999, 1024, 1536, 5 << 20, -1, float("nan"), 2.0**60)], "n double", scores.format_bytes(F.col("n")))
    assert [s[0] for s in shown] == ["0 B", "999 B", "1.0 KB", "1.5 KB", "5.0 MB", "0 B", "0 B", "1048576.0 TB"]
    shown = values(spark, [(0.556,), (0.0,), (None,), (float("nan"),), (0.125,)], "x double", scores.format_percent(F.col("x")))
    assert [s[0] for s in shown] == ["56%", "0%", "—", "—", "13%"]
    shown = values(spark, [("2026-03-04T05:06:07Z",), ("nonsense",), (None,)], "t string", scores.format_date(F.col("t")))
    assert shown == [("Mar 4, 2026, 05:06 AM",), ("—",), ("—",)]
    long = "x" * 300
    shown = values(spark, [(long, 150), (long, 0), ("a  b\nc ", 2)], "t string, o int", text.excerpt(F.col("t"), F.col("o")))
    assert shown[0][0].startswith("…") and shown[0][0].endswith("…") and not shown[1][0].startswith("…") and shown[2] == ("a b c",)


def test_clean_text(spark):
    rows = [("a &lt;b&gt; &amp;lt; &#65;&#8364;",), ("x  \r\ny\t\n\n\n\nz \r",), ("﻿\xa0 trimmed　",), (None,)]
    got = values(spark, rows, "t string", text.clean_text(F.col("t")))
    assert got == [("a <b> &lt; A€",), ("x\ny\n\nz",), ("trimmed",), (None,)]


def test_word_diff(spark):
    got = values(spark, [("the quick brown fox", "the quick red fox"), (None, "a")], "a string, b string", text.word_diff("a", "b"))
    ops = [(d.op, d.value) for d in got[0][0]]
    assert ("removed", "brown") in ops and ("added", "red") in ops and any(o == "equal" and "quick" in v for o, v in ops)
    assert [(d.op, d.value) for d in got[1][0]] == [("added", "a")]


def longest_common(x, y):
    best = [0] * (len(y) + 1)
    for s in x:
        last = best[:]
        for j, t in enumerate(y):
            best[j + 1] = last[j] + 1 if s == t else max(last[j + 1], best[j])
    return best[-1]


@pytest.mark.parametrize("held", [1 << 27, 40])
def test_word_diff_is_shortest(monkeypatch, held):
    monkeypatch.setattr(text, "HELD_BITS", held)
    rng = random.Random(1)
    for _ in range(400):
        a, b = (" ".join(rng.choices("abc", k=rng.randrange(16))) for _ in "ab")
        d = text.diff_words(a, b)
        assert "".join(v for o, v in d if o != "added") == a and "".join(v for o, v in d if o != "removed") == b
        x, y = (text._TOKEN.findall(t) for t in (a, b))
        assert sum(len(text._TOKEN.findall(v)) for o, v in d if o == "equal") == longest_common(x, y)


def test_word_diff_ignores_white_space():
    assert text.diff_words("one two\nthree", "one  two three") == [("equal", "one  two three")]
    assert text.diff_words("a (b) c", "a (x) c") == [("equal", "a ("), ("removed", "b"), ("added", "x"), ("equal", ") c")]
    assert text.diff_words("", None) == [] and text.diff_words("a", "") == [("removed", "a")]


def test_word_diff_of_long_texts():
    rng = random.Random(2)
    a = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    b = [w if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for w in a]
    began = time.perf_counter()
    d = text.diff_words(" ".join(a), " ".join(b))
    assert time.perf_counter() - began < 5
    assert "".join(v for o, v in d if o != "added").split() == a and "".join(v for o, v in d if o != "removed").split() == b


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def pdf(lines):
    body = zlib.compress(b"BT " + b" ".join(b"(" + x.encode() + b") Tj" for x in lines) + b" ET")
    return b"%PDF-1.4\n1 0 obj<</Type /Pages>>endobj\n2 0 obj<</Type /Page>>endobj\n3 0 obj<</Filter /FlateDecode>>\nstream\n" + body + b"\nendstream\n%%EOF"


def test_extraction(spark):
    para = "<w:p><w:r><w:t>Hello &amp;amp; </w:t></w:r><w:r><w:t xml:space='preserve'>all</w:t></w:r></w:p>"
    slides = [("ppt/slides/slide10.xml", "<a:t>ten</a:t>"), ("ppt/slides/slide2.xml", "<a:t>two</a:t><a:t>more</a:t>"), ("ppt/slides/slide3.xml", "<p/>")]
    sheet = '<c r="A1" t="s"><v>0</v></c><c r="B1"><is><t>in</t></is></c><c r="C1"><v>  </v></c><c r="D1"><v>4.5</v></c>'
    rows = [
        ("docx", archive([("word/document.xml", para + "<w:p></w:p>" + para * 40)])),
        ("pptx", archive(slides)),
        ("xlsx", archive([("xl/sharedStrings.xml", "<t>shared</t><t> </t>"), ("xl/worksheets/sheet1.xml", sheet)])),
        ("pdf", pdf(["Page (one".replace("(", "\\("), "x" * 400])),
        ("txt", "﻿a\r\nb  \n\n\n\n&lt;c&gt;".encode()),
        ("md", b""),
        ("csv", b"a,b\xff"),
        ("png", b"\x89PNG"),
        ("docx", b"not a zip"),
        ("docx", archive([("other.xml", "")])),
        ("txt", b"bad &#99999999; reference"),
    ]
    df = spark.createDataFrame([(k, e, c) for k, (e, c) in enumerate(rows)], "k int, extension string, content binary")
    got = {r.k: r for r in extract.extract(df).collect()}
    assert got[0].extracted_text.startswith("Hello & all\nHello & all") and got[0].expected_min_chars == 1500 and got[0].page_count is None
    assert (got[1].page_count, got[1].expected_min_chars, got[1].extraction_ok, got[1].actual_chars) == (3, 450, False, len("two more\n\nten"))
    assert got[2].extracted_text == "shared\t0\tin\t4.5" and got[2].expected_min_chars == 12
    assert got[3].extracted_text == "Page (one" + "x" * 400 and got[3].page_count == 1 and got[3].extraction_ok
    assert (got[4].extracted_text, got[4].extraction_reason) == ("a\nb\n\n<c>", "plain-text read directly")
    assert (got[5].extraction_ok, got[5].extraction_reason) == (False, "empty plain-text file")
    assert got[6].extracted_text == "a,b�"
    assert (got[7].extraction_reason, got[7].expected_min_chars, got[7].extracted_text) == ("unsupported format: .png", 0, None)
    assert got[8].extraction_reason.startswith("extraction error: ") and got[8].actual_chars == 0
    assert got[9].extraction_reason == "docx text layer below confidence floor"
    assert got[10].extraction_reason.startswith("extraction error: ") and not got[10].extraction_ok


def test_deflated_streams_that_end_in_a_carriage_return():
    body = next(b for k in range(10_000) if (b := zlib.compress(f"BT ({k}) Tj ET".encode())).endswith(b"\r"))
    text = zlib.decompress(body)[4:-7].decode()
    for end in (b"\n", b"\r\n"):
        content = b"%PDF-1.4\n1 0 obj<</Type /Page>>\nstream\n" + body + end + b"endstream\n%%EOF"
        assert extract.pdf_text(content) == (text, 1)
    plain = b"%PDF-1.4\n1 0 obj<</Type /Page>>\nstream\r\nBT (as it is) Tj ET\r\nendstream\n%%EOF"
    assert extract.pdf_text(plain) == ("as it is", 1)


def test_uploads_from_files(spark, tmp_path):
    for name, body in (("Report.TXT", b"abc"), ("empty.md", b""), ("noext", b"abc")):
        (tmp_path / name).write_bytes(body)
    rows = {r.filename: r for r in source.read_uploads(spark, str(tmp_path), "u1").collect()}
    assert set(rows) == {"Report.TXT", "noext"} and rows["noext"].extension == "" and rows["Report.TXT"].extension == "txt"
    assert rows["Report.TXT"].sha256_hash == rows["noext"].sha256_hash and rows["noext"].size_bytes == 3
    up = spark.createDataFrame([("u1", "h1", 3, b"abc"), ("u1", "h1", 3, b"abc"), ("u2", "h1", 3, b"abc")], "user_id string, sha256_hash string, size_bytes long, content binary")
    stored = spark.createDataFrame([("u2", "h1")], "user_id string, sha256_hash string")
    assert [r.storage_path for r in source.new_blobs(up, stored).collect()] == ["u1/h1"]
    source.write_blobs(up, str(tmp_path / "blobs"))
    more = up.union(spark.createDataFrame([("", "h2", 1, b"x")], up.schema))
    for _ in range(2):  # what is there already stays, once
        source.write_blobs(more, str(tmp_path / "blobs"))
    got = source.read_blobs(spark, str(tmp_path / "blobs")).collect()
    assert sorted((b.user_id, b.sha256_hash, bytes(b.content)) for b in got) == [("", "h2", b"x"), ("u1", "h1", b"abc"), ("u2", "h1", b"abc")]
    assert [(r.path.rsplit("/", 1)[1], r.reason, r.status) for r in source.refused_files(spark, str(tmp_path), "u1").collect()] == [("empty.md", "empty file", 400)]


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", "en"), (3, "a b c d e f", None), (None, "text", "en"), (5, "a b c d e f", "en"), (6, "a b c d e f", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    for name in ("tier1_flags", "running_counts", "file_list"):
        assert {r.file_id for r in getattr(queries, name)(spark, sf).collect()} == {3, 5, 6}, name
    refused = {(r.user_id, r.file_id, r.reason) for r in queries.refused_uploads(spark, sf).collect()}
    assert refused == {("en", 1, "empty file"), ("en", 2, "empty file"), ("en", None, "no id")}
    assert {(r.file_id, r.deduplicated) for r in queries.tier1_flags(spark, sf).collect()} == {(3, False), (5, False), (6, True)}


def test_stems_of_documents_without_a_name(spark, tmp_path):
    rows = [("en", 1, "One. Two\nthree"), ("en", 2, "\nno first line"), ("zh", 3, "文字。\nmore"), ("en", 4, "...")]
    spark.createDataFrame(rows, "lang string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.file_id: (r.extension, r.stem) for r in queries.ext_stem(spark, str(tmp_path)).collect()}
    assert got == {1: ("md", "One Two"), 2: ("csv", ""), 3: ("docx", ""), 4: ("pptx", "")}


def test_staging(spark, tmp_path):
    made = stage.staged(spark.range(3), "numbers")
    path = made.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and stage.clear_staged(spark) >= 1 and not os.path.exists(path)

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        stage.shared_dir(Far)


def library_rows(n=45, seed=3):
    rng = random.Random(seed)
    base = [[rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) for _ in range(30)] for _ in range(6)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["one", "two", "three"])
        body = " ".join(w[: rng.choice([30, 30, 12, 3])])
        ext = rng.choice(["txt", "txt", "md", "png"])
        stem = rng.choice(["Quarterly Report", "quarterly reports", "notes", "Notes 2"])
        rows.append((rng.choice(["u1", "u1", "u2"]), k, body, stem, ext))
    rows += [(u, n + k, body, stem, ext) for k, (u, _, body, stem, ext) in enumerate(rows[:4])]
    return rows


def replay(rows, ceiling=2000, gone=None, renames=()):
    """Score uploads one at a time, as they come; ``gone``: when files go; ``renames``: (when, file, stem, extension)."""
    stored, texts, sets, out = {}, {}, {}, {}
    gone = gone or {}
    for u, k, body, stem, ext in rows:
        mine = [r for r in rows if r[0] == u and r[1] < k and gone.get(r[1], k) >= k]
        called = {file: new for at, file, *new in sorted(renames) if at < k}
        mine = [(*r[:3], *called.get(r[1], r[3:])) for r in mine]
        count = len(mine) + 1
        if any(r[2] == body for r in mine):
            stored[k] = False
            continue
        ok = ext != "png" and len(body) > 0
        stored[k] = ok
        if ok:
            w = body.split()
            texts[k] = {" ".join(w[i : i + 5]).lower() for i in range(len(w) - 4)}
            if texts[k]:
                sets.setdefault(u, {})[k] = texts[k]
        known = {i: s for i, s in sets.get(u, {}).items() if gone.get(i, k) >= k}
        n = len(known)
        df = {}
        for s in known.values():
            for h in s:
                df[h] = df.get(h, 0) + 1
        size = len(body.encode())
        b = int(log(max(size, 1)) / log(1.2) // 1)
        low, high = -int(-(1.2 ** (b - 1)) // 1), int(1.2 ** (b + 2) // 1) - 1
        for _, i, other, stem_i, ext_i in mine:
            if count > ceiling and not (ext_i == ext and low <= len(other.encode()) <= high):
                continue
            x, y = stem_i.lower(), stem.lower()
            name = 1.0 if x == y else 1 - lev(x, y) / max(len(x), len(y))
            if stored[i] and ok:
                both, union = texts[i] & texts[k], texts[i] | texts[k]
                if n < 10:
                    c, kind = (len(both) / len(union) if union else 0.0), "provisional"
                else:
                    weight = lambda s: sum(log(n / max(df.get(h, 1), 1)) for h in s)  # noqa: B023, E731
                    c, kind = (weight(both) / weight(union) if weight(union) else 0.0), "high"
                total = 0.7 * c + 0.3 * name
                if total >= 0.55:
                    out[i, k] = (round(c, 7), round(total, 7), kind)
            elif name >= 0.8:
                out[i, k] = (None, round(name, 7), "metadata-only")
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def uploaded(spark, rows):
    import hashlib

    made = [(u, k, k, f"{stem}.{ext}", stem, ext, len(body.encode()), hashlib.sha256(body.encode()).hexdigest(), ext != "png" and bool(body), body) for u, k, body, stem, ext in rows]
    return spark.createDataFrame(made, UPLOADS)


def shown(pairs):
    r = lambda x: None if x is None else round(x, 7)
    return {(p.file_a_id, p.file_b_id): (r(p.content_score), r(p.composite_score), p.confidence) for p in pairs.collect()}


@pytest.mark.parametrize("ceiling", [2000, 12])
def test_scores_on_arrival_match_a_replay(spark, ceiling):
    rows = library_rows()
    up = uploaded(spark, rows)
    files = tier1.with_tier1(up).withColumn("extraction_ok", ~F.col("deduplicated") & F.col("extraction_ok"))
    usable = files.where("extraction_ok").select("user_id", "file_id", "upload_seq", "extracted_text")
    found = scoring.content_scores(shingles.file_shingles(usable))
    want = replay(rows, ceiling)
    assert len(want) > 10 and len({v[2] for v in want.values()}) > 1
    assert shown(scoring.flagged_pairs(files.drop("extracted_text"), found, ceiling)) == want
    ranked = shingles.ranked_postings(shingles.file_shingles(usable))
    likely = scoring.likely_scores(files.drop("extracted_text"), ranked, scoring.file_sets(ranked), ceiling)
    assert shown(scoring.flagged_pairs(files.drop("extracted_text"), likely, ceiling)) == want


@pytest.mark.parametrize("ceiling, span", [(2000, None), (12, None), (2000, 8), (12, 8)])
def test_scores_with_deletes_match_a_replay(spark, monkeypatch, ceiling, span):
    """Frequencies, counts, Tier 1 and pairs are those of the files that are there; ``span``: ranges this short."""
    if span:
        monkeypatch.setattr(shingles, "RANK_FILES", span)
        monkeypatch.setattr(tier1, "LIFE_RANGE", span)
    rows = library_rows(60, 11)
    rng = random.Random(12)
    gone = {r[1]: r[1] + rng.choice([0, 1, 5, 20, 90]) + 0.5 for r in rows if rng.random() < 0.5}
    when = spark.createDataFrame([(k, int(2 * g)) for k, g in gone.items()], "file_id long, gone_seq long")
    up = uploaded(spark, rows).withColumn("upload_seq", F.col("file_id") * 2).join(when, "file_id", "left")
    flagged = tier1.with_living_tier1(up)
    want_flags = {k: any(r[0] == u and r[1] < k and r[2] == body and gone.get(r[1], k) >= k for r in rows) for u, k, body, _, _ in rows}
    assert {r.file_id: r.deduplicated for r in flagged.collect()} == want_flags
    files = flagged.withColumn("extraction_ok", ~F.col("deduplicated") & F.col("extraction_ok"))
    counts = {r.file_id: r.n_files for r in tier1.running_file_count(files).collect()}
    assert counts == {k: sum(r[0] == u and r[1] <= k and gone.get(r[1], k) >= k for r in rows) for u, k, *_ in rows}
    usable = files.where("extraction_ok").select("user_id", "file_id", "upload_seq", "extracted_text")
    ranked = shingles.living_postings(shingles.file_shingles(usable), files)
    found = scoring.likely_scores(files.drop("extracted_text"), ranked, scoring.file_sets(ranked), ceiling)
    want = replay(rows, ceiling, gone)
    assert want != replay(rows, ceiling) and len(want) > 10
    assert shown(scoring.flagged_pairs(files.drop("extracted_text"), found, ceiling)) == want


@pytest.mark.parametrize("sizes", [(4, 8, 3, 5), (2048, 1 << 16, 2048, 1 << 21)])
def test_all_pairs_are_scored_without_a_shuffle_of_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "SPAN", "CHUNK", "MET"), sizes, strict=True):
        monkeypatch.setattr(all_pairs, name, size)
    rows = library_rows(60, 11)
    files = tier1.with_tier1(uploaded(spark, rows)).withColumn("extraction_ok", ~F.col("deduplicated") & F.col("extraction_ok"))
    usable = files.where("extraction_ok").select("user_id", "file_id", "upload_seq", "extracted_text")
    made = shingles.file_shingles(usable)
    sets = {}
    for r in sorted(made.collect(), key=lambda r: r.file_id):
        sets.setdefault(r.user_id, {}).setdefault(r.file_id, set()).add(r.shingle_hash)
    arrival, plain, now = {}, {}, {}

    def score(a, b, held):
        df = lambda h: sum(h in s for s in held.values())
        weight = lambda hs: sum(log(len(held) / df(h)) for h in hs)
        jaccard, union = len(held[a] & held[b]) / len(held[a] | held[b]), weight(held[a] | held[b])
        return (round(jaccard if len(held) < 10 else 0.0 if abs(union) < 1e-9 else weight(held[a] & held[b]) / union, 9), len(held) < 10)

    for held in sets.values():
        for b in held:
            upto = {k: s for k, s in held.items() if k <= b}
            for a in upto:
                if a < b and held[a] & held[b]:
                    arrival[a, b], now[a, b] = (len(held[a] & held[b]), *score(a, b, upto)), score(a, b, held)
                    plain[a, b] = round(len(held[a] & held[b]) / len(held[a] | held[b]), 9)
    assert len(arrival) > 40 and {v[2] for v in arrival.values()} == {True, False}
    found = scoring.content_scores(made)
    assert "a_id" not in "".join(line for line in found._jdf.queryExecution().toString().splitlines() if "Exchange" in line)
    assert {(r.a_id, r.b_id): (r.shared, round(r.content_score, 9), r.provisional) for r in found.collect()} == arrival
    assert {(r.a_id, r.b_id): round(r.score, 9) for r in scoring.plain_jaccard(made).collect()} == plain
    assert {(r.a_id, r.b_id): (round(r.score, 9), r.provisional) for r in scoring.snapshot_scores(made).collect()} == now
    ranked = shingles.ranked_postings(made)
    near = lambda df: sorted((r.a_id, r.b_id, *[round(r[c], 9) for c in ("content_score", "filename_score", "composite_score")], r.confidence, r.flagged) for r in df.collect())
    got = near(scoring.compared_pairs(files, ranked, scoring.file_sets(ranked), 12))
    assert got == near(scoring.content_pairs(files, found, 12)) and 0 < len(got) < len(arrival)


@pytest.mark.parametrize("least", [0.0, 0.2, 0.5, 0.9])
def test_likely_pairs_lose_nothing(spark, monkeypatch, least):
    monkeypatch.setattr(shingles, "RANK_FILES", 7)  # ranks and counts over several ranges
    rows = library_rows(60, 11)
    usable = uploaded(spark, rows).where("extraction_ok").select("user_id", "file_id", "upload_seq", "extracted_text")
    made = shingles.file_shingles(usable)
    ranked = shingles.ranked_postings(made)
    want = {(r.a_id, r.b_id): round(r.content_score, 9) for r in scoring.content_scores(made).collect() if r.content_score >= least}
    near = scoring.likely_pairs(ranked, scoring.file_sets(ranked), least)
    got = {(r.a_id, r.b_id): round(r.content_score, 9) for r in scoring.exact_scores(near, ranked, scoring.file_sets(ranked), least).collect()}
    assert {k: v for k, v in want.items() if v > 0} == {k: v for k, v in got.items() if v > 0} and len(want) > 4
    assert near.count() <= scoring.content_scores(made).count()


def test_shared_postings_leave_out_what_meets_nobody(spark, monkeypatch):
    monkeypatch.setattr(text, "HELD_TEXT", 64)
    rows = library_rows(60, 11)
    usable = uploaded(spark, rows).where("extraction_ok").select("user_id", "file_id", "upload_seq", "extracted_text")
    made = shingles.file_shingles(usable)
    one = usable.orderBy("file_id").limit(1).withColumn("extracted_text", F.concat("extracted_text", F.lit(" and five more words here")))
    assert shingles.one_row_each(shingles.file_hashes(usable.union(one))).count() == shingles.file_hashes(usable).count()
    hashes = shingles.one_row_each(shingles.file_hashes(usable))
    every = shingles.ranked_postings(made)
    often = {(r.user_id, r.shingle_hash) for r in every.where("rank = 2").collect()}
    ranked = shingles.shared_postings(hashes)
    want = sorted((r.user_id, r.shingle_hash, r.file_id, r.upload_seq, r.rank) for r in every.collect() if (r.user_id, r.shingle_hash) in often)
    assert sorted(tuple(r) for r in ranked.collect()) == want and 0 < len(want) < every.count()
    sizes = hashes.select("user_id", "file_id", "upload_seq", F.size("hashes").cast("long").alias("n"))
    near = lambda df: sorted((r.file_id, r.n, r.n_shingled, round(r.own_logs, 9)) for r in df.collect())
    sets = scoring.sets_with(sizes, ranked)
    assert near(sets) == near(scoring.file_sets(every))
    found = lambda df: sorted((r.a_id, r.b_id, round(r.content_score, 9)) for r in df.collect())
    old, new = scoring.likely_pairs(every, scoring.file_sets(every)), scoring.likely_pairs(ranked, sets)
    got = found(scoring.exact_scores(new, ranked, sets, sizes=sets))
    assert got == found(scoring.exact_scores(old, every, scoring.file_sets(every))) and got
    counted = lambda df: sorted(tuple(r) for r in df.collect())
    assert counted(shingles.hash_frequency(hashes)) == counted(shingles.doc_frequency(made))
    frequency = {(r.user_id, r.shingle_hash): r.doc_count for r in shingles.doc_frequency(made).collect()}
    sums = {}
    for r in every.collect():
        n, total = sums.get((r.user_id, r.file_id), (0, 0))
        sums[r.user_id, r.file_id] = (n + 1, total + frequency[r.user_id, r.shingle_hash])
    assert {(r.user_id, r.file_id): (r.n, r.total) for r in shingles.frequency_sums(hashes).collect()} == sums


def test_texts_are_shingled_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text, "HELD_TEXT", 10)
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 4, "b" * 5, "c" * 2, None, "d" * 50, "", "e"]})
    assert [b.column("t").to_pylist() for b in text._by_bytes(iter([batch]), "t")] == [["aaaa", "bbbbb"], ["cc", None], ["d" * 50], ["", "e"]]


def test_texts_step_together(monkeypatch):
    odd = ["", None, " ", "a b c d", "a b c d e", "ΑΣ Σ ΟΔΟΣ\ufeffΣΑ x y İ I ẞ", "a\x1cb c d e f g h\x1f i", "\u3000a b c d e f g "]
    odd += ["x " * 30, "q" * 40000 + " a b c d e f", "a\x85b c d e f g", " ".join("ab" * 9)]
    steps = []
    real = text.fnv1a
    monkeypatch.setattr(text, "fnv1a", lambda *a: steps.append(1) or real(*a))
    got = text.shingle_sets(odd)
    assert len(steps) == 1
    assert [h.tolist() for h in got] == [sorted({*text.shingle_text(t)[0].tolist()}) for t in odd]
    assert text.shingle_sets([]) == [] and [len(h) for h in text.shingle_sets(["", None])] == [0, 0]


def test_postings_are_ordered_by_hash_first(spark):
    # Tenants are few: ordered by them first, every two rows that meet in a sort are compared to the end.
    hashes = spark.createDataFrame([("u", 1, 1, [5, 7]), ("u", 2, 2, [7])], "user_id string, file_id long, upload_seq long, hashes array<long>")
    plan = shingles.shared_postings(hashes)._jdf.queryExecution().executedPlan().toString()
    sorts = re.findall(r"Sort \[(\w+)#\d+L? ASC", plan)
    assert sorts and {*sorts} == {"shingle_hash"}
    assert sorted(tuple(r) for r in shingles.shared_postings(hashes).collect()) == [("u", 7, 1, 1, 1), ("u", 7, 2, 2, 2)]


def test_a_batch_takes_only_postings_that_meet(spark):
    schema = "user_id string, shingle_hash long, file_id long, upload_seq long"
    old = spark.createDataFrame([("u", 1, 1, 1), ("u", 2, 1, 1), ("u", 2, 2, 2), ("v", 3, 3, 3)], schema)
    own = spark.createDataFrame([("u", 1, 4, 4), ("u", 3, 4, 4), ("u", 5, 4, 4), ("u", 5, 5, 5)], schema)
    got = sorted((r.user_id, r.shingle_hash, r.file_id, r.newer) for r in shingles.met_postings(old, own).collect())
    assert got == [("u", 1, 1, False), ("u", 1, 4, True), ("u", 5, 4, True), ("u", 5, 5, True)]
    assert shingles.met_postings(old.limit(0), own.where("shingle_hash = 3")).isEmpty()


def test_capped_candidates_make_no_pair_beyond_the_cap(spark, tmp_path):
    rows = [("u", k, k, "s", "txt", 1000 + k % 3, False, True) for k in range(400)]
    files = spark.createDataFrame(rows, "user_id string, file_id long, upload_seq long, filename_stem string, extension string, size_bytes long, deduplicated boolean, extraction_ok boolean")
    for ceiling in (10, 500):
        found = scoring.capped_candidates(stage.staged(files, "capped"), 4, ceiling)
        got = {(r.a_id, r.b_id) for r in found.collect()}
        assert got == {(a, b) for b in range(400) for a in range(min(4, b))}
        assert len(got) >= max(_joined_rows(found)) - 10 * 400


def _joined_rows(df):
    """Rows that each join of a plan that was run gives."""
    out, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if "AdaptiveSparkPlan" in name:
            todo.append(plan.executedPlan())
        if "QueryStage" in name:
            todo.append(plan.plan())
        if "Join" in name:
            out.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out


def test_ranks_over_ranges(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(rng.choice("uv"), k, k * 3, h, 0) for k in range(60) for h in rng.sample(range(6), 3)]
    made = spark.createDataFrame(rows, "user_id string, file_id long, upload_seq long, shingle_hash long, start_offset int")
    one = {tuple(r) for r in shingles.ranked_postings(made).collect()}
    monkeypatch.setattr(shingles, "RANK_FILES", 10)
    ranked = shingles.ranked_postings(made)
    assert {tuple(r) for r in ranked.collect()} == one
    asked = [(u, h, s) for u in "uvw" for h in range(7) for s in (0, 9, 10, 11, 95, 500)]
    df = shingles.counted_until(ranked, spark.createDataFrame(asked, "user_id string, shingle_hash long, upload_seq long"))
    want = {(u, h, s): sum(r[0] == u and r[3] == h and r[2] <= s for r in rows) for u, h, s in asked}
    assert {(r.user_id, r.shingle_hash, r.upload_seq): r.df for r in df.collect()} == want


def test_name_pairs_against_brute_force(spark):
    rng = random.Random(14)
    base = ["quarterly report north", "minutes of the meeting", "été à la plage", "a", ""]
    stems = []
    for _ in range(70):
        stem = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(stem) + 1)
            stem[at : at + rng.randrange(2)] = rng.choice(["", "x", "Y", "é"])
        stems.append("".join(stem))
    rows = [("u", k, k, s, "md", 10, False, k % 3 > 0) for k, s in enumerate(stems)]
    files = spark.createDataFrame(rows, "user_id string, file_id long, upload_seq long, filename_stem string, extension string, size_bytes long, deduplicated boolean, extraction_ok boolean")
    score = lambda x, y: 1.0 if x == y else 1 - lev(x, y) / max(len(x), len(y))
    want = {(i, j): round(score(stems[i].lower(), stems[j].lower()), 9) for j in range(70) for i in range(j) if not (rows[i][7] and rows[j][7])}
    for ceiling in (2000, 10):
        got = {(r.a_id, r.b_id): round(r.filename_score, 9) for r in scoring.name_pairs(files, ceiling).collect()}
        assert got == {k: v for k, v in want.items() if v >= 0.8}


@pytest.mark.parametrize("ceiling", [2000, 12])
def test_stream_matches_a_replay(spark, tmp_path, ceiling):
    rows = library_rows(36, 5)
    state = LibraryState(spark, str(tmp_path / "state"), ceiling)
    at = [0, 9, 10, 27, len(rows)]
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        state.ingest(uploaded(spark, rows[a:b]), k)
    state.ingest(uploaded(spark, rows[27:]), 3)  # a batch that is run again changes nothing
    assert shown(state.pairs()) == replay(rows, ceiling)


def test_compacted_stream(spark, tmp_path):
    rows = library_rows(30, 6)
    state = LibraryState(spark, str(tmp_path / "state"))
    for k, (a, b) in enumerate([(0, 10), (10, 20), (20, len(rows))]):
        if k == 2:
            state.compact(2)
            assert all(len(parts) == 1 for parts in state.tables.latest().parts.values())
        state.ingest(uploaded(spark, rows[a:b]), k)
    assert shown(state.pairs()) == replay(rows)


def events_of(spark, rows, gone, renames, others):
    made = uploaded(spark, rows).withColumn("upload_seq", F.col("file_id") * 2).withColumn("kind", F.lit("upload"))
    user = {r[1]: r[0] for r in rows}
    changes = [("delete", user[k], k, int(2 * at), None, None) for k, at in gone.items()]
    changes += [("rename", user[k], k, int(2 * at), f"{stem}.{ext}", None) for at, k, stem, ext in renames] + others
    more = spark.createDataFrame(changes, "kind string, user_id string, file_id long, upload_seq long, new_name string, other_id long")
    return spark.createDataFrame([], EVENTS).unionByName(made, allowMissingColumns=True).unionByName(more, allowMissingColumns=True)


def test_a_batch_without_uploads_scores_nothing(spark, tmp_path):
    rows = library_rows(12, 6)
    state = LibraryState(spark, str(tmp_path / "state"))
    state.ingest(uploaded(spark, rows), 0)
    before = shown(state.pairs())
    user, file = rows[0][:2]
    state.apply(events_of(spark, rows, {file: 1000.0}, [], []).where("kind = 'delete'"), 1)
    parts = state.tables.latest().parts
    assert {t for t, own in parts.items() if any(p["batch"] == 1 for p in own)} == {"gone", "renames", "kept", "refused"}
    assert state.files().where(f"user_id = '{user}' AND file_id = {file}").isEmpty()
    assert len(shown(state.pairs())) <= len(before)


@pytest.mark.parametrize("ceiling", [2000, 12])
def test_stream_of_events_matches_a_replay(spark, tmp_path, ceiling):
    rows = library_rows(40, 21)
    rng = random.Random(22)
    n, user = len(rows), {r[1]: r[0] for r in rows}
    gone = {r[1]: r[1] + rng.choice([0, 2, 9, 30]) + 0.5 for r in rows if rng.random() < 0.4}
    renames = sorted((k + rng.choice([0, 3, 11]) + 0.5, k, rng.choice(["quarterly report", "notes", "Minutes"]), rng.choice(["txt", "md"])) for k in rng.sample(range(n), 15))
    renames = [r for r in renames if gone.get(r[1], r[0] + 1) > r[0]]
    want = replay(rows, ceiling, gone, renames)
    assert want != replay(rows, ceiling, gone)
    left = {p: v for p, v in want.items() if not set(p) & set(gone)}
    pair = min(left)
    twice = next(iter(gone))
    others = [("keep", user[pair[0]], pair[1], 2 * n + 200, None, pair[0]), ("delete", "u9", 3, 2 * n + 201, None, None), ("rename", user[twice], twice, 2 * n + 203, "x.txt", None), ("rename", user[pair[0]], pair[0], 2 * n + 205, "  ", None)]
    events = events_of(spark, rows, gone, renames, others)
    state = LibraryState(spark, str(tmp_path / "state"), ceiling)
    cuts = [0, 17, 18, 50, 10**6]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        state.apply(events.where((F.col("upload_seq") >= a) & (F.col("upload_seq") < b)), batch)
        if batch == 2:
            state.compact(2)
            state.apply(events.where((F.col("upload_seq") >= a) & (F.col("upload_seq") < b)), batch)  # once more
    assert shown(state.pairs()) == left
    assert {(p.file_a_id, p.file_b_id) for p in state.pairs().where("status = 'kept'").collect()} == {pair}
    assert sorted((r.kind, r.user_id, r.file_id) for r in state.refused().collect()) == sorted([("delete", "u9", 3), ("rename", user[twice], twice)])
    there = {r[1] for r in rows} - set(gone)
    called = {file: f"{stem}.{ext}" for _, file, stem, ext in renames}
    assert {r.file_id: r.filename for r in state.files().collect()} == {k: called.get(k, f"{stem}.{ext}") for _, k, _, stem, ext in rows if k in there}
    bodies = [(r[0], r[2]) for r in rows if r[1] in there]
    assert sorted(r.ref_count for r in state.references().collect()) == sorted(bodies.count(b) for b in set(bodies))
    freed = {(u, int(2 * gone[k])) for u, k, body, *_ in rows if k in gone and not any(r[0] == u and r[2] == body and r[1] != k and r[1] < gone[k] and gone.get(r[1], 10**6) > gone[k] for r in rows)}
    assert {(r.user_id, r.freed_seq) for r in state.freed().collect()} == freed


def test_faults_leave_the_last_version(spark, tmp_path, monkeypatch):
    """A compaction or a batch that stops anywhere before its commit changes nothing."""
    rows = library_rows(24, 6)
    state = LibraryState(spark, str(tmp_path / "state"))
    for k in (0, 1):
        state.ingest(uploaded(spark, rows[k * 8 : k * 8 + 8]), k)
    before, want = state.tables.latest(), shown(state.pairs())
    write, calls = Tables.write, []

    def failing(self, df, table, **marks):
        calls.append(table)
        if len(calls) == 3:
            raise OSError("lost")
        return write(self, df, table, **marks)

    monkeypatch.setattr(Tables, "write", failing)
    for work in (lambda: state.compact(2), lambda: state.ingest(uploaded(spark, rows[16:]), 2)):
        calls.clear()
        with pytest.raises(OSError):
            work()
        assert state.tables.latest() == before and shown(state.pairs()) == want
    monkeypatch.undo()
    state.compact(2)
    state.tables.vacuum()
    assert shown(state.pairs()) == want
    state.ingest(uploaded(spark, rows[16:]), 2)
    assert shown(state.pairs()) == replay(rows)


def test_tables(spark, tmp_path):
    """Two writers of one key leave one row, readers keep their version, and a merge rewrites touched buckets only."""
    schema, keys = "k long, v string", ["k"]
    one, two = Tables(spark, str(tmp_path / "t")), Tables(spark, str(tmp_path / "t"))
    rows = lambda *ks, v: spark.createDataFrame([(k, v) for k in ks], schema)
    held = lambda t, *s: sorted(map(tuple, t.read("blobs", schema, *s).collect()))
    assert held(one) == []
    first = one.latest()
    late = two.latest()
    one.insert_absent("blobs", schema, keys, rows(1, 2, 2, v="first"))
    with pytest.raises(Conflict):
        two.commit(late, Change({"blobs": two.write_buckets(rows(2, v="lost"), "blobs", keys)}))
    real, raced = Tables.commit, []

    def race(self, snapshot, change):  # another writer comes in between, once
        if not raced:
            raced.append(1)
            one.insert_absent("blobs", schema, keys, rows(3, v="winner"))
        return real(self, snapshot, change)

    two.commit = race.__get__(two)
    two.insert_absent("blobs", schema, keys, rows(2, 3, 4, v="second"))
    assert held(one) == [(1, "first"), (2, "first"), (3, "winner"), (4, "second")]
    assert held(one, first) == []
    before = {p["path"] for p in one.latest().parts["blobs"]}
    one.merge("blobs", schema, keys, rows(4, v="new"))
    after = {p["path"]: p["bucket"] for p in one.latest().parts["blobs"]}
    assert len(set(after) - before) == 1 and held(one)[3] == (4, "new")
    one.remove("blobs", schema, keys, rows(1, 4, v=""))
    assert held(one) == [(2, "first"), (3, "winner")]
    # A fault between two tables: neither is seen.
    version = one.latest()
    one.write_buckets(rows(9, v="x"), "blobs", keys)
    one.write(rows(9, v="x"), "other")
    assert one.latest() == version and held(one) == [(2, "first"), (3, "winner")]
    assert one.vacuum() >= 2 and held(one) == [(2, "first"), (3, "winner")]


def test_sessions(spark, tmp_path):
    """A session sees and writes its caller's rows only, and the comparison reaches the scan."""
    store = Tables(spark, str(tmp_path / "t"))
    lib = session.StoredLibrary(store)
    blobs = spark.createDataFrame([(1, "u1", "dead", "u1/dead", 5, 2), (2, "u2", "dead", "u2/dead", 5, 1)], lib.BLOBS)
    store.merge("physical_blobs", lib.BLOBS, ["user_id", "sha256_hash"], blobs)
    files = spark.createDataFrame([(10, "u1", 1), (11, "u1", 1), (12, "u2", 2)], lib.FILES)
    store.merge("logical_files", lib.FILES, ["user_id", "file_id"], files)
    objects = spark.createDataFrame([("files", "u1/dead"), ("other", "u1/x"), ("files", "u2/dead")], "bucket_id string, name string")

    def opened():
        frequency = store.read("shingle_doc_frequency", lib.FREQUENCY)
        session.open_library(spark, {"physical_blobs": store.read("physical_blobs", lib.BLOBS), "shingle_doc_frequency": frequency, "storage_objects": objects})

    opened()
    assert spark.sql("SELECT * FROM physical_blobs").count() == 0  # no caller
    session.set_caller(spark, "u1")
    seen = spark.sql("SELECT * FROM physical_blobs")
    assert [r.id for r in seen.collect()] == [1]
    assert "EqualTo(user_id,u1)" in seen._jdf.queryExecution().executedPlan().toString()
    assert [r.name for r in spark.sql("SELECT name FROM storage_objects").collect()] == ["u1/dead"]
    assert session.checked_rows(blobs.where("user_id = 'u1'")).count() == 1
    assert session.checked_objects(objects.where("name = 'u1/dead'")).count() == 1
    for bad in (session.checked_rows(blobs), session.checked_objects(objects)):
        with pytest.raises(Exception, match="row-level security"):
            bad.collect()
    assert lib.increment_blob_ref(1) == 3 and lib.increment_blob_ref(2) is None and lib.increment_blob_ref(9) is None
    hashes = lambda *h: spark.createDataFrame([(x,) for x in h], "shingle_hash long")
    lib.bump_shingle_doc_frequency(hashes(111, 222, 222))
    lib.bump_shingle_doc_frequency(hashes(111))
    opened()
    assert spark.sql("SELECT * FROM get_doc_frequencies(array(111L, 222L, 3L))").count() == 0  # opened anew, no caller
    session.set_caller(spark, "u1")
    assert sorted(map(tuple, spark.sql("SELECT * FROM get_doc_frequencies(array(111L, 222L, 3L))").collect())) == [(111, 2), (222, 1)]
    with pytest.raises(LookupError, match="not owned"):
        lib.delete_logical_file(12)
    assert lib.delete_logical_file(10) == {"deleted": True, "blob_deleted": False, "storage_path": None}
    assert lib.delete_logical_file(11)["blob_deleted"] is False  # the reference that was added is still there
    with pytest.raises(LookupError):
        lib.delete_logical_file(11)
    session.set_caller(spark, "u2")
    assert lib.delete_logical_file(12) == {"deleted": True, "blob_deleted": True, "storage_path": "u2/dead"}
    assert sorted((r.id, r.ref_count) for r in store.read("physical_blobs", lib.BLOBS).collect()) == [(1, 1)]
    session.set_caller(spark, None)


def test_objects(spark, tmp_path):
    """Objects stay as they were put, a second attempt changes nothing, and what cannot be removed is a warning."""
    rows = [("u1", "aa", b"one"), ("u1", "bb", b"two"), ("u2", "aa", b"other")]
    up = spark.createDataFrame(rows, "user_id string, sha256_hash string, content binary")
    root = str(tmp_path / "store")
    told = lambda df: {r.storage_path: r.outcome for r in df.collect()}
    assert set(told(objects.put_objects(up, root)).values()) == {"stored"}
    assert set(told(objects.put_objects(up.withColumn("content", F.lit("new").cast("binary")), root)).values()) == {"already exists"}
    assert (tmp_path / "store" / "u1" / "aa").read_bytes() == b"one"
    (tmp_path / "file").write_text("no folder")
    failed = objects.put_objects(up, str(tmp_path / "file")).collect()
    assert {r.outcome for r in failed} == {"failed"} and all(r.storage_warning for r in failed)
    (tmp_path / "store" / "u3" / "folder" / "inner").mkdir(parents=True)
    gone = spark.createDataFrame([("u1/aa",), ("u1/missing",), ("u3/folder",), (None,)], "storage_path string")
    removals = objects.remove_objects(gone, root)
    assert {r.storage_path: r.removed for r in removals.collect()} == {"u1/aa": True, "u1/missing": True, "u3/folder": False}
    assert not (tmp_path / "store" / "u1" / "aa").exists() and (tmp_path / "store" / "u3" / "folder").exists()
    results = spark.createDataFrame([(1, True, True, "u1/aa"), (2, True, True, "u3/folder"), (3, True, False, None)], "file_id long, deleted boolean, blob_deleted boolean, storage_path string")
    shown = {r.file_id: json.loads(r.result) for r in objects.with_storage_warnings(results, removals).collect()}
    assert "storage_warning" not in shown[1] and shown[2]["storage_warning"] and shown[3] == {"deleted": True, "blob_deleted": False, "storage_path": None}


def test_numbers_and_files_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k * 7 % 50, k) for k in range(50)], "x long, y long")
    got = {r.x: r.n for r in identity.numbered(rows, ["x", "y"], "n", 5).collect()}
    assert got == {x: x + 5 for x in range(50)}
    assert identity.numbered(rows.where("false"), ["x"]).count() == 0
    state = LibraryState(spark, str(tmp_path / "state"))
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    for batch, files in enumerate([{"b.txt": text, "a.txt": text, "c.png": "x"}, {"Report.txt": text + " one", "empty.txt": ""}]):
        folder = tmp_path / f"in{batch}"
        folder.mkdir()
        for name, body in files.items():
            (folder / name).write_text(body)
            os.utime(folder / name, (10**9 + batch, 10**9 + batch))
        read = spark.read.format("binaryFile").load(str(folder))
        for _ in range(batch + 1):  # the second batch is run twice
            state.ingest_files(read, "u", batch)
    assert sorted((r.upload_seq, r.filename, r.deduplicated) for r in state.files().collect()) == [(0, "a.txt", False), (1, "b.txt", True), (2, "c.png", False), (3, "Report.txt", False)]
    assert [(p.file_a_id, p.file_b_id, p.confidence) for p in state.pairs().collect()] == [(0, 3, "provisional")]


def test_rarest_disjoint_grams():
    rng = random.Random(9)
    for _ in range(200):
        q, picks = rng.choice([(1, 1), (2, 3), (3, 2), (3, 4), (0, 1)])
        counts = [rng.randrange(5) for _ in range(picks * q + rng.randrange(6) - q + 1)]
        got = similar_names.rarest(counts, q, picks)
        ways = [c for c in itertools.combinations(range(len(counts)), picks) if all(b - a >= q for a, b in zip(c, c[1:], strict=False))]
        assert tuple(got) in ways and sum(counts[p] for p in got) == min(sum(counts[p] for p in c) for c in ways)


def test_names_of_one_bucket(spark):
    """Many names of one scheme in one block: few are met, none is lost."""
    rng = random.Random(5)
    stem = lambda: "scan of the " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=24))
    stems = [stem() for _ in range(3000)]
    for k in range(0, 3000, 100):
        stems[k] = stems[k + 1][:20] + "x" + stems[k + 1][21:]
    rows = [("u", k, k, s, "md", 10, False, False) for k, s in enumerate(stems)]
    files = spark.createDataFrame(rows, "user_id string, file_id long, upload_seq long, filename_stem string, extension string, size_bytes long, deduplicated boolean, extraction_ok boolean")
    newer = scoring.newer_files(files, 10)
    met = similar_names.candidates(files, newer, 0.8)
    assert met.count() < 20_000  # of 4.5 million
    assert {(r.a_id, r.b_id) for r in scoring.name_pairs(files, 10).collect()} == {(k, k + 1) for k in range(0, 3000, 100)}


def test_files_of_one_name_are_met_once(spark):
    """Names of many files make no candidates of their own, and all their pairs are found."""
    rows = [("u", k, k, "scan of the month" if k % 3 else "scan of a month", "md", 10, False, k % 5 == 0) for k in range(90)]
    files = spark.createDataFrame(rows, "user_id string, file_id long, upload_seq long, filename_stem string, extension string, size_bytes long, deduplicated boolean, extraction_ok boolean")
    assert similar_names.candidates(files, scoring.newer_files(files, 10), 0.8).count() <= 6  # of 2 names, each usable and not
    want = {(i, j) for j in range(90) for i in range(j) if i % 5 or j % 5}
    found = [(r.a_id, r.b_id) for r in scoring.name_pairs(files, 10).collect()]
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("tile", [4, 1 << 20])
def test_pairs_in_tiles(spark, monkeypatch, tile):
    """A set goes to a tile once, whatever number of pairs needs it, and small tiles lose nothing."""
    monkeypatch.setattr(set_pairs, "TILE", tile)
    rng = random.Random(3)
    held = {k: sorted(rng.sample(range(30), rng.randrange(1, 12))) for k in range(20)}
    ranked = spark.createDataFrame([("u", h, k, h % 7 + k % 3 + 1) for k, own in held.items() for h in own], "user_id string, shingle_hash long, file_id long, rank int")
    pairs = spark.createDataFrame([("u", i, j) for j in range(20) for i in range(j)], "user_id string, a_id long, b_id long")
    sets = stage.staged(set_pairs.sets_of(ranked, pairs.select("user_id", F.explode(F.array("a_id", "b_id")).alias("file_id")).distinct()), "sets")
    got = {(r.a_id, r.b_id): (r.shared, round(r.shared_logs, 9), r.a_n, sorted(r.rest)) for r in set_pairs.compared(pairs, sets).collect()}
    want = {}
    for j in range(20):
        for i in range(j):
            if both := set(held[i]) & set(held[j]):
                want[i, j] = (len(both), round(sum(log(h % 7 + j % 3 + 1) for h in both), 9), len(held[i]), sorted(set(held[i]) - both))
    assert got == want and len(want) > 50
    dealt = set_pairs.tiled(pairs, sets)
    assert dealt.count() == 190
    parts = dealt.select(*set_pairs.KEY, F.explode(F.array("a_id", "b_id")).alias("f")).distinct().count()
    assert parts == 20 if tile > 4 else 20 < parts <= 380


def test_sizes_beside_postings(spark):
    rows = library_rows(40, 5)
    usable = uploaded(spark, rows).where("extraction_ok").select("user_id", "file_id", "upload_seq", "extracted_text")
    hashes = shingles.file_hashes(usable)
    both = shingles.shared_postings(hashes, sizes=True)
    assert sorted(map(tuple, both.where("user_id IS NOT NULL").collect())) == sorted(map(tuple, shingles.shared_postings(hashes).collect()))
    sizes = {r.file_id: r.shingle_hash for r in both.where("user_id IS NULL").collect()}
    assert sizes == {r.file_id: len(r.hashes) for r in hashes.collect()} and sizes


def test_capped_candidates(spark):
    rows = [("u", k, k, "s", "md", 10 + k % 3, k % 5 == 4, True) for k in range(30)]
    files = spark.createDataFrame(rows, "user_id string, file_id long, upload_seq long, filename_stem string, extension string, size_bytes long, deduplicated boolean, extraction_ok boolean")
    for ceiling in (2000, 8):
        every = {}
        for r in scoring.all_candidates(files, ceiling).collect():
            every.setdefault(r.b_id, []).append(r.a_id)
        capped = {}
        for r in scoring.capped_candidates(files, 4, ceiling).collect():
            capped.setdefault(r.b_id, []).append(r.a_id)
        assert {b: sorted(a) for b, a in capped.items()} == {b: sorted(a)[:4] for b, a in every.items()}


def test_structured_stream(spark, tmp_path):
    rows = library_rows(12, 7)
    for k in range(2):
        uploaded(spark, rows[k * 8 : k * 8 + 8]).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    state = LibraryState(spark, str(tmp_path / "state"))
    query = state.follow(stream, str(tmp_path / "check"))
    assert query.awaitTermination(120)
    assert shown(state.pairs()) == replay(rows)


def test_lifecycle(spark):
    up = spark.createDataFrame(
        [("u1", 1, 1, "h", "Report Final.docx", 10), ("u1", 2, 2, "h", "Report-Final copy.docx", 10), ("u2", 3, 3, "h", "x.md", 10)],
        "user_id string, file_id long, upload_seq long, sha256_hash string, filename string, size_bytes long",
    )
    blobs = tier1.blobs(up)
    assert {(b.user_id, b.ref_count) for b in blobs.collect()} == {("u1", 2), ("u2", 1)}
    assert [(r.file_id, r.deduplicated) for r in tier1.with_tier1(up).orderBy("file_id").collect()] == [(1, False), (2, True), (3, False)]
    one = spark.createDataFrame([("u1", 1)], "user_id string, file_id long")
    left, kept, freed = library.delete_files(up, blobs, one)
    assert left.count() == 2 and {(b.user_id, b.ref_count) for b in kept.collect()} == {("u1", 1), ("u2", 1)} and freed.count() == 0
    _, kept, freed = library.delete_files(left, kept, spark.createDataFrame([("u1", 2)], "user_id string, file_id long"))
    assert [b.storage_path for b in freed.collect()] == ["u1/h"] and [b.user_id for b in kept.collect()] == ["u2"]
    other = spark.createDataFrame([("u2", 1), ("u1", 99)], "user_id string, file_id long")
    assert library.foreign_deletes(up, other).count() == 2 and library.delete_files(up, blobs, other)[0].count() == 3
    with pytest.raises(Exception, match="logical file not found or not owned by caller"):
        library.owned(up, other).collect()
    assert library.owned(up, one).collect() == one.collect()
    both = spark.createDataFrame([("u1", 2, 1), ("u1", 1, 2), ("u2", 3, 3), ("u2", 1, 4)], "user_id string, file_id long, delete_seq long")
    told = {(r.file_id, r.blob_deleted, r.storage_path) for r in library.delete_results(up, blobs, both).collect()}
    assert told == {(2, False, None), (1, True, "u1/h"), (3, True, "u2/h")}  # the last of two references frees the blob, once
    first = library.delete_results(up, blobs, both.drop("delete_seq").limit(1)).first()
    assert first.result == '{"deleted":true,"blob_deleted":false,"storage_path":null}'
    assert library.scoped(up, "u2").count() == 1 and library.write_violations(up, "u1").count() == 1
    objects = spark.createDataFrame([("files", "u1/a"), ("files", "u2/a"), ("else", "u1/b")], "bucket_id string, name string")
    assert library.scoped_objects(objects, "u1").count() == 1
    hits = spark.createDataFrame([("u1", "h"), ("u1", "h")], "user_id string, sha256_hash string")
    assert {(b.user_id, b.ref_count) for b in tier1.increment_refs(blobs, hits).collect()} == {("u1", 4), ("u2", 1)}
    named = library.rename_files(up.withColumn("filename_stem", F.lit("s")).withColumn("extension", F.lit("e")), spark.createDataFrame([("u1", 1, "a.B"), ("u1", 2, " ")], "user_id string, file_id long, new_name string"))
    assert {(r.file_id, r.filename, r.filename_stem, r.extension) for r in named.where("user_id = 'u1'").collect()} == {(1, "a.B", "a", "b"), (2, "Report-Final copy.docx", "s", "e")}


def test_frequencies(spark):
    ddl = "user_id string, file_id long, upload_seq long, shingle_hash long, start_offset int"
    one = spark.createDataFrame([("u1", 1, 1, 111, 0), ("u1", 1, 1, 111, 9), ("u1", 1, 1, 222, 4)], ddl)
    two = spark.createDataFrame([("u1", 2, 2, 111, 0)], ddl)
    df = shingles.bump_frequency(shingles.doc_frequency(one), two)
    assert {(r.shingle_hash, r.doc_count) for r in df.collect()} == {(111, 2), (222, 1)}
    assert {(r.shingle_hash, r.doc_count) for r in shingles.drop_frequency(df, one).collect()} == {(111, 1)}
    wanted = spark.createDataFrame([("u2", 111), ("u1", 222)], "user_id string, shingle_hash long")
    assert shingles.frequencies_of(df, wanted).count() == 1
    assert shingles.shingled_file_count(one.union(two)).first().n_files == 2


def test_pairs(spark):
    ddl = "user_id string, file_a_id long, file_b_id long, content_score double, filename_score double, composite_score double, confidence string, status string"
    rows = [("u", 1, 2, 0.9, 0.5, 0.78, "high", "pending"), ("u", 1, 3, None, 0.8, 0.8, "metadata-only", "pending")]
    pairs = spark.createDataFrame(rows, ddl)
    files = spark.createDataFrame([("u", 1, "a.txt"), ("u", 2, "b.txt")], "user_id string, file_id long, filename string")
    queue = review.review_queue(pairs, files).collect()
    assert [(q.filename_a, q.filename_b, q.percent) for q in queue] == [("a.txt", "(deleted)", "80%"), ("a.txt", "b.txt", "78%")]
    assert {(r.file_id, r.pending) for r in review.pending_counts(pairs).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert review.pairs_for_file(pairs, 3).count() == 1 and review.pairs_for_file(pairs).count() == 2
    kept = review.keep_pairs(pairs, pairs.where("file_b_id = 2"))
    assert {(r.file_b_id, r.status) for r in kept.collect()} == {(2, "kept"), (3, "pending")}
    assert {(r.file_b_id, r.status) for r in review.upsert_pairs(kept, pairs.where("file_b_id = 2")).collect()} == {(2, "pending"), (3, "pending")}
    bad = spark.createDataFrame([("u", 1, 1, None, 0.1, 0.1, "high", "pending"), ("u", 1, 2, None, 0.1, 0.1, "sure", "open"), ("u", 1, 2, None, 0.1, 0.1, "high", "open")], ddl)
    assert {r.violation for r in schema.pair_violations(bad).collect()} == {"self", "confidence", "status", "repeated"}
    assert schema.pair_violations(pairs).count() == 0
    stats = library.library_stats(spark.createDataFrame([("u", 5), ("u", 5)], "user_id string, size_bytes long"), spark.createDataFrame([("u", 5)], "user_id string, size_bytes long"), pairs).first()
    assert (stats.n_files, stats.n_blobs, stats.ratio, stats.saved, stats.pending) == (2, 1, 2.0, 5, 2)


def test_plain_and_snapshot_scores(spark):
    rows = [("u", k, k, f"{body}") for k, body in enumerate(["a b c d e f g", "a b c d e f x", "q r s t u v w"])]
    made = shingles.file_shingles(spark.createDataFrame(rows, "user_id string, file_id long, upload_seq long, extracted_text string"))
    plain = scoring.plain_jaccard(made).collect()
    assert [(p.a_id, p.b_id, p.score) for p in plain] == [(0, 1, 2 / 4)]
    assert [(p.score, p.provisional) for p in scoring.snapshot_scores(made).collect()] == [(2 / 4, True)]


def test_log_and_buckets(spark):
    up = spark.createDataFrame([("u", 1, "a.txt", False, True, None), ("u", 2, "b.png", False, False, "unsupported format: .png"), ("u", 3, "c.txt", True, False, None)], "user_id string, file_id long, filename string, deduplicated boolean, extraction_ok boolean, extraction_reason string")
    counts = spark.createDataFrame([("u", 1, 2), ("v", 2, 9)], "user_id string, file_id long, n_pairs long")
    got = {r.file_id: r.message for r in source.upload_log(up, counts).collect()}
    assert got[1] == "a.txt: stored — text extracted; 2 possible duplicate(s)." and "metadata-only (unsupported format: .png); 0" in got[2] and "Tier 1" in got[3]
    buckets = spark.createDataFrame([("files", True)], "id string, public boolean")
    wanted = spark.createDataFrame([("files", False), ("new", False)], "id string, public boolean")
    assert {(r.id, r.public) for r in source.register_buckets(buckets, wanted).collect()} == {("files", True), ("new", False)}
    assert datetime(2026, 1, 1)  # tests run in UTC sessions


def test_hashes_and_frequencies_of_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    hashes, freq = set(), {}
    for r in queries.Library(spark, sf).texts.collect():
        placed = [(m.start(), m[0]) for m in re.finditer(r"[^\s﻿]+", r.extracted_text)]
        for k in range(len(placed) - 4):
            h = text.shingle_hash(" ".join(w for _, w in placed[k : k + 5]))
            hashes.add((r.file_id, placed[k][0], h))
            freq.setdefault((r.user_id, h), set()).add(r.file_id)
    got = [tuple(r) for r in queries.shingle_hashes(spark, sf).collect()]
    assert len(got) == len(hashes) and set(got) == hashes
    total = {}
    for (user, _), files in freq.items():
        for f in files:
            n, t = total.get((user, f), (0, 0))
            total[user, f] = n + 1, t + len(files)
    assert {(r.user_id, r.file_id): (r.n, r.total) for r in queries.rpc_doc_frequencies(spark, sf).collect()} == total
