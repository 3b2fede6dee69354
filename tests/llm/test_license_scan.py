"""License scans against comparing every block with every template."""

import math
import random
import re

from sievelake.llm import license_scan as s
from tests.llm import cases


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_windows(text, threshold=s.THRESHOLD):
    """The best share of each label over all windows of twice the template's words."""
    w, best = split(text), {}
    for body, label in s.TEMPLATES:
        t, n = set(body.split()), s.WINDOW * len(body.split())
        share = max((len(t & set(w[i : i + n])) for i in range(len(w)) if w[i] in t), default=0)
        if share >= math.ceil(threshold * len(t) - 1e-9):
            best[label] = max(best.get(label, 0), share / len(t))
    return best


def brute(text, threshold=s.THRESHOLD):
    w = split(text)
    at, base = [], set()
    for phrase, label in s.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                base.add(label)
    found = brute_windows(text, threshold)
    best = max([1.0 if base else 0.0, *found.values()])
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), best


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocab = sorted({w for t, _ in s.TEMPLATES for w in t.split()})
    texts = [None, "", "CC\nBY cc by", "all rights reserved all rights reserved", "All, rights... RESERVED", "general public license", "by cc"]
    for body, _ in s.TEMPLATES:
        for drop in (0, 1, 2, 4):
            w = body.split()
            for _ in range(drop):
                w[rng.randrange(len(w))] = rng.choice(["foo", "bar", rng.choice(vocab)])
            rng.shuffle(w)
            texts.append("intro\n" + " ".join(w).title() + "\nend " + "word " * rng.randrange(5))
    texts += [" ".join(rng.choices(vocab, k=60)) for _ in range(20)] + ["the " * 50_000 + "all rights reserved"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, None)]
    got = s.scan_licenses(cases.docs(spark, rows)).collect()
    key = lambda r: (r[0], str(r))
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=key)
    assert found == sorted(((k, *brute(t)) for k, t in rows), key=key)
    assert {m.label for r in got for m in r.matches} >= {"mit", "bsd", "cc0"}


def test_wrapped_notices_and_scattered_words(spark):
    rng = random.Random(9)
    vocab = sorted({w for t, _ in s.TEMPLATES for w in t.split()})
    wrapped = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided", "bsd"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "mpl-2.0"),
    ]
    texts = [t for t, _ in wrapped] + [" ".join(b.replace(" ", rng.choice("\n "), 3) for b, _ in s.TEMPLATES)]
    texts += [" ".join(w + " filler" * 70 for w in b.split()) for b, _ in s.TEMPLATES] + [None, ""]
    texts += [" ".join(rng.choices(vocab, k=300)) for _ in range(20)]
    texts += ["\n".join(rng.sample(b.split(), len(b.split()))) + " x" * 50 + f" {b}" for b, _ in s.TEMPLATES]
    got = {r.doc_id: r for r in s.scan_licenses(cases.docs(spark, list(enumerate(texts))), phrases=(("no such phrase", "none"),)).collect()}
    for k, (_, label) in enumerate(wrapped):
        assert got[k].labels == label and got[k].score == 1.0
    for k, text in enumerate(texts):
        best = brute_windows(text)
        assert got[k].labels == ",".join(sorted(best)) and got[k].score == max(best.values(), default=0.0), text
        assert all(m.end_word <= got[k].n_words for m in got[k].matches)
    assert all(got[k].labels == "" for k in range(4, 4 + len(s.TEMPLATES)))


def test_filters_lose_nothing():
    rng = random.Random(10)
    for _ in range(200):
        vocab = [f"t{i}" for i in range(rng.randrange(2, 25))]
        templates = [(" ".join(rng.choices(vocab, k=rng.randrange(1, 12))), f"l{i}") for i in range(4)]
        frequency = {w.encode(): rng.randrange(5) for w in vocab}
        index = s.TemplateIndex(templates, frequency, rng.choice([0.5, 0.7, 0.9, 1.0]))
        words = rng.choices([*vocab, "zz", "yy"], k=rng.randrange(80))
        got, whole = {}, dict(index.matches([w.encode() for w in words]))
        for k, a, b, share in index.windows([w.encode() for w in words]):
            got[k] = max(got.get(k, 0), share)
            own = set(templates[k][0].split())
            assert share == len(own & set(words[a:b])) / len(own) and b - a <= index.reach[k]
        for k, (body, _) in enumerate(templates):
            own = set(body.split())
            n = s.WINDOW * len(body.split())
            most = max((len(own & set(words[i : i + n])) for i in range(len(words))), default=0)
            assert got.get(k) == (most / len(own) if most >= index.need[k] else None)
            all_in = len(own & set(words))
            assert whole.get(k) == (all_in / len(own) if all_in >= index.need[k] else None)


def test_full_notices_wrapped_at_any_width(spark):
    rng = random.Random(11)
    texts = []
    for body, _ in s.TEMPLATES[10:]:
        words = body.split()
        for i in range(0, len(words), rng.randrange(4, 12)):
            words[i] = "\n * " + words[i].upper()
        texts.append("Some code\n" + " ".join(words) + ".\nmore code " * 20)
    got = {r.doc_id: set(r.labels.split(",")) for r in s.scan_licenses(cases.docs(spark, list(enumerate(texts)))).collect()}
    assert all(label in got[k] for k, (_, label) in enumerate(s.TEMPLATES[10:]))


def test_empty(spark):
    assert s.scan_licenses(cases.empty(spark)).collect() == []
