"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

The patterns give the base spans. The method then takes every maximal run of ``[A-Za-z0-9+/_=-]``, cuts it
at each ``=`` that is not final padding, and tests each piece of at least ``MIN_TOKEN`` characters that some
alphabet holds, and such parts of it between ``-`` and ``_``, between ``/`` and ``+``, and between any of
these; of passing pieces that overlap the longest is reported. For a piece it infers the encoding (digits,
hex, upper or lower case, base32, base36, letters, base62 or base64) and tests its symbols against uniform
randomness: chi-squared over the alphabet, and over its kinds of symbols (vowels and other letters of either
case, digits, marks); runs about the middle (Wald-Wolfowitz); and lag-1 serial correlation. The piece's
p-value is the smallest of these, times their number.

What looks random may still be ordinary, and short pieces or narrow alphabets tell least. So each piece has
``DECOYS`` decoys of its own: the words and numbers that stand near it in its document, written in its
encoding and cut to its length (names, paths, dates, codes). Pieces and decoys are counted by encoding,
length class and p. At a cut, the share of decoys that pass estimates how many of the pieces would pass if
all were ordinary, and the lowest cut is taken whose estimated false-discovery rate is at most ``FDR``. As
every piece brings its decoys, one rule holds for a table with one piece and for one with billions; a
group in which no cut meets the rate reports nothing. Distinct pieces are counted, so copies of one
document weigh nothing. The counts over all documents are all that is gathered; they are at most one row
for each alphabet, class and bin.

One narrow pass reads the texts; its findings are staged, and the cuts are applied to them.

Defined results: a null text counts as empty; no span gives zero counts and empty lists; repeated
documents are each scanned; equal pieces have equal p, and a cut takes all of a bin or none; columns other
than the text pass through, but those named like a result are replaced; an empty table gives an empty result.
Runs of any length are tested whole, with memory of a few times the run; a long run of base64 takes some 20 seconds a
megabyte, as each of its parts between marks is a piece with decoys of its own.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, binaries, staged, table

# The base patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LONG_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
ORDINARY = re.compile(rb"[A-Za-z]{2,15}|[0-9]{1,6}")
VALUES = re.compile(rb"[^=]+(?:=+\Z)?")
PARTS = tuple(re.compile(p) for p in (rb".+", rb"[^-_]+", rb"[^/+]+", rb"[^-_/+]+"))
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20
FDR = 0.05
DECOYS = 60
#: Bytes on either side of a piece that its decoys take their words from.
NEAR = 2048
#: Beyond this a piece and its decoys are tested one after another, and by sums over pieces of ``PIECE``.
LONG_PIECE = 1 << 15
PIECE = 1 << 18
#: Decoys of one piece begin at most this far apart, so that long ones overlap and take little more than one.
DECOY_STEP = 1 << 13
CLASSES = 6
BINS = 40
LOW = BINS - 1 - 24  # p of 1e-3: what uniform tokens fall below once in a thousand
#: Stands in where a document has next to no words of its own.
PLAIN = b"the version of this file and its name were changed in the last update for all users of the system data report".split()
GROUP_BYTES = 4 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGITS, _UPPER, _SMALL = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + b"abcdef",
    "HEX": _DIGITS + b"ABCDEF",
    "UPPER": _UPPER,
    "lower": _SMALL,
    "base32": _UPPER + b"234567",
    "base36": _DIGITS + _SMALL,
    "BASE36": _DIGITS + _UPPER,
    "letters": _UPPER + _SMALL,
    "base62": _DIGITS + _UPPER + _SMALL,
    "base64": _UPPER + _SMALL + _DIGITS + b"+/",
    "base64url": _UPPER + _SMALL + _DIGITS + b"-_",
}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
_NAMES = list(ALPHABETS)
_INDEX, _KINDS_OF = {}, {}
for _name, _own in ALPHABETS.items():
    _INDEX[_name] = np.full(256, -1, np.int16)
    _INDEX[_name][list(_own)] = np.arange(len(_own))
    #: Vowels and other letters of either case, digits, and marks, numbered as far as the alphabet has them.
    _KINDS_OF[_name] = np.unique([next((i for i, s in enumerate((b"AEIOU", b"aeiou", _UPPER, _SMALL, _DIGITS)) if c in s), 5) for c in _own], return_inverse=True)[1]


def encoding_of(token: bytes) -> str | None:
    """The narrowest alphabet that holds all of the token."""
    have = set(token)
    return next((name for name, a in _SETS.items() if have <= a), None)


def _tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z.tolist()])


def _uniformity(seen: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
    """For each row of counts of n symbols, the upper-tail p of chi-squared against the symbols' shares, by the
    Wilson-Hilferty cube root with the statistic's exact variance for few symbols."""
    k = len(share)
    statistic = (seen.astype(float) ** 2 / share).sum(axis=1) / n - n
    mean, var = k - 1, 2 * (k - 1) + ((1 / share).sum() - k * k - 2 * k + 2) / n
    df, scale = 2 * mean * mean / var, var / (2 * mean)
    return _tail(((np.maximum(statistic, 0) / scale / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def uniformity(symbols: np.ndarray, share: np.ndarray) -> np.ndarray:
    """`_uniformity` of rows of symbols."""
    return _uniformity(_counted(symbols, len(share)), symbols.shape[1], share)


def _counted(symbols: np.ndarray, k: int) -> np.ndarray:
    m = len(symbols)
    return np.bincount((symbols + np.arange(m)[:, None] * k).ravel(), minlength=m * k).reshape(m, k)


def _runs(a: np.ndarray, changes: np.ndarray, n: int) -> np.ndarray:
    """For each row of n symbols, a of them above the middle, the two-sided p of its number of runs."""
    count = 1 + changes
    mean = 2 * a * (n - a) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z = np.maximum(0.0, abs(count - mean) - 0.5) / np.sqrt(np.where(var > 0, var, 1.0))
    return np.where((a == 0) | (a == n), 2 * 0.5 ** min(n, 1000), np.where(var > 0, 2 * _tail(z), 1.0))


def runs(symbols: np.ndarray, k: int) -> np.ndarray:
    """For each row, the two-sided p of the number of runs above and below the middle of the alphabet."""
    high = symbols >= k / 2
    return _runs(high.sum(axis=1), (high[:, 1:] != high[:, :-1]).sum(axis=1), symbols.shape[1])


def _serial(power: np.ndarray, product: np.ndarray, n: int) -> np.ndarray:
    off = abs(product / np.where(power > 0, power, 1.0) + 1 / n)
    return np.where(power > 0, 2 * _tail(off * math.sqrt(n)), 0.0)


def serial_correlation(symbols: np.ndarray, k: int) -> np.ndarray:
    """For each row, the two-sided p of the lag-1 correlation of neighbouring symbols."""
    x = symbols - (k - 1) / 2
    return _serial((x * x).sum(axis=1), (x[:, 1:] * x[:, :-1]).sum(axis=1), symbols.shape[1])


def battery(symbols: np.ndarray, name: str) -> np.ndarray:
    """The p-value of each row of symbols of an alphabet against uniform randomness."""
    k, kinds = len(ALPHABETS[name]), _KINDS_OF[name]
    p = [uniformity(symbols, np.full(k, 1 / k)), runs(symbols, k), serial_correlation(symbols, k)]
    if kinds.max():
        p.append(uniformity(kinds[symbols], np.bincount(kinds) / k))
    return np.minimum(1.0, len(p) * np.min(p, axis=0))


def long_battery(token: memoryview, name: str) -> float:
    """`battery` of one long token: all tests go by sums, added up over pieces of ``PIECE`` symbols."""
    k, kinds, n = len(ALPHABETS[name]), _KINDS_OF[name], len(token)
    seen, high, changes, power, product = np.zeros(k, np.int64), 0, 0, 0.0, 0.0
    for at in range(0, n, PIECE):
        # One symbol more, as neighbours are of both pieces.
        own = _INDEX[name][np.frombuffer(token[at : at + PIECE + 1], np.uint8)]
        first = own[:PIECE]
        seen += np.bincount(first, minlength=k)
        above = own >= k / 2
        high += int(above[:PIECE].sum())
        changes += int((above[1:] != above[:-1]).sum())
        x = own - (k - 1) / 2
        power += float((x[:PIECE] ** 2).sum())
        product += float((x[1:] * x[:-1]).sum())
    row = lambda v: np.array([v])
    p = [_uniformity(seen[None], n, np.full(k, 1 / k)), _runs(row(high), row(changes), n), _serial(row(power), row(product), n)]
    if kinds.max():
        p.append(_uniformity(np.bincount(kinds, weights=seen)[None], n, np.bincount(kinds) / k))
    return float(min(1.0, len(p) * np.min(p)))


def _symbols(tokens: list[bytes], name: str) -> np.ndarray:
    return _INDEX[name][np.frombuffer(b"".join(tokens), np.uint8)].reshape(len(tokens), -1).astype(np.int64)


def randomness(token: bytes) -> float:
    """The battery's p-value of a token in its own encoding; 0 if it has none."""
    body = token.rstrip(b"=")
    name = encoding_of(body)
    if name is None or len(body) < 2:
        return 0.0
    return float(battery(_symbols([body], name), name)[0])


def ordinary(near: bytes, name: str, n: int, count: int, seed: int) -> list:
    """``count`` strings of n symbols that write the words and numbers of a text in an encoding.

    Long ones are views of one string. Words keep their order and each string begins elsewhere among them. Between them stand separators, if the
    encoding has any, and numbers: the text's own, years, days and round ones, by a generator of the given seed.
    """
    rng = random.Random(seed)
    found = ORDINARY.findall(LONG_RUN.sub(b" ", near))
    words = [w for w in found if not w.isdigit()]
    if len(words) < 8:
        words += PLAIN
    numbers = [w for w in found if w.isdigit()]
    numbers += [b"%d" % rng.randrange(1990, 2036) for _ in range(4)] + [b"%02d" % rng.randrange(1, 32) for _ in range(8)] + [b"%d" % (rng.randrange(1, 10) * 10 ** rng.randrange(1, 4)) for _ in range(2)]
    number = lambda: rng.choice(numbers)
    if name == "decimal":
        part = lambda w: number()
    elif name in ("hex", "HEX"):
        # Fields of a fixed width, as in dumps, tables and colours.
        width, digits = rng.choice((2, 4, 8)), b"%x" if name == "hex" else b"%X"
        part = lambda w: (digits % int(number())).zfill(width)
    elif name in ("lower", "UPPER", "letters"):
        part = lambda w: w
    elif name in ("base36", "BASE36", "base62", "base32"):
        part = lambda w: w + number() if rng.random() < 0.4 else w
    else:
        marks = (b"-", b"_") if name == "base64url" else (b"/", b"+")
        part = lambda w: (rng.choice((w, w, number(), w + number()))) + rng.choice((marks[0], marks[0], marks[1]))
    if name in ("HEX", "UPPER", "BASE36", "base32"):
        case = bytes.upper
    elif name in ("letters", "base62"):
        case = bytes.capitalize
    elif name in ("base64", "base64url"):
        case = rng.choice((bytes.lower, bytes.lower, bytes.capitalize, bytes.upper))
    else:
        case = bytes.lower
    at, whole = rng.randrange(len(words)), bytearray()
    have, step = _SETS[name], min(n // 4, DECOY_STEP) + 1
    while len(whole) < count * step + n:
        one = part(case(words[at % len(words)]))
        if name == "base32":
            one = bytes(c for c in one if c in have)
        whole += one
        at += 1
    seen = memoryview(bytes(whole)) if n > LONG_PIECE else bytes(whole)
    return [seen[i : i + n] for i in range(0, count * step, step)]


def judged(token: bytes, near: bytes) -> tuple[float, int, list[int]]:
    """A piece's p, its group by encoding and length, and the bins of those of its decoys that reach ``LOW``."""
    body = token.rstrip(b"=")
    name = encoding_of(body)
    tried = [body, *ordinary(near, name, len(body), DECOYS, key_of(token))]
    p = np.array([long_battery(memoryview(t), name) for t in tried]) if len(body) > LONG_PIECE else battery(_symbols(tried, name), name)
    group = _NAMES.index(name) * CLASSES + length_class(len(token))
    return float(p[0]), group, sorted(b for b in map(bin_of, p[1:].tolist()) if b >= LOW)


def pieces(token: bytes) -> list[tuple[int, int]]:
    """The parts of a run that are tested each on its own, in order."""
    found = set()
    for whole in VALUES.finditer(token):
        for cut in PARTS:
            found.update((whole.start() + m.start(), whole.start() + m.end()) for m in cut.finditer(whole[0]) if m.end() - m.start() >= MIN_TOKEN)
    return [(a, b) for a, b in sorted(found) if encoding_of(token[a:b].rstrip(b"="))]


def length_class(n: int) -> int:
    return min(CLASSES - 1, int(2 * math.log2(n / MIN_TOKEN)))


def key_of(token: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(token, digest_size=7).digest(), "big") >> 1


def bin_of(p: float) -> int:
    """Ascending in p: the last bin holds the most random-looking."""
    return max(0, BINS - 1 + math.ceil(8 * math.log10(max(p, 1e-12))))


def _at(text: bytes, words, pattern) -> list:
    """Leftmost non-overlapping matches of a pattern that begins with one of the words."""
    found, end = [], -1
    starts = set()
    for w in words:
        at = text.find(w)
        while at >= 0:
            starts.add(at)
            at = text.find(w, at + 1)
    for s in sorted(starts):
        if s >= end and (m := pattern(s)):
            found.append(m)
            end = m.end()
    return found


def scan_text(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], list[tuple]]]:
    """For each text: base spans (kind, start, end), and tested pieces (start, end, p, group, bin, key, decoys).
    Keys are hashes that tell distinct pieces, decoys the bins of those that may pass.

    Texts are scanned as one block joined by line feeds, which no pattern or piece can hold.
    """
    block = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - [len(t) + 1 for t in texts]
    out: list[tuple[list, list]] = [([], []) for _ in texts]

    def put(which: int, start: int, item) -> None:
        k = int(np.searchsorted(ends, start, side="right"))
        out[k][which].append(item(int(begins[k])))

    for m in _at(block.translate(_LOWER), KEYWORDS, lambda s: ASSIGN.match(block, s)):
        if len(m[2]) >= 8:
            put(0, m.start(), lambda z, m=m: (0, m.start() - z, m.end() - z))
    for m in _at(block, (b"AKIA",), lambda s: ACCESS.match(block, s)):
        if len(m[0]) >= 16:
            put(0, m.start(), lambda z, m=m: (1, m.start() - z, m.end() - z))
    inside = _TOKEN[np.frombuffer(block, np.uint8)].view(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), inside, np.zeros(1, np.int8)))))
    for s, e in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= MIN_TOKEN].tolist():
        token = block[s:e]
        for m in HEX.finditer(token):
            if len(m[0]) >= 32:
                put(0, s, lambda z, a=s + m.start(), b=s + m.end(): (2, a - z, b - z))
        if cut := pieces(token):
            k = int(np.searchsorted(ends, s, side="right"))
            near = block[max(int(begins[k]), s - NEAR) : s] + b" " + block[e : min(int(ends[k]) - 1, e + NEAR)]
            for i, j in cut:
                p, group, decoys = judged(token[i:j], near)
                put(1, s, lambda z, a=s + i, b=s + j, p=p, g=group, k=key_of(token[i:j]), d=decoys: (a - z, b - z, p, g, bin_of(p), k, d))
    return out


_FIELDS = [("kind", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("p", T.DoubleType()), ("group", T.IntegerType()), ("bin", T.IntegerType()), ("key", T.LongType()), ("decoys", T.ArrayType(T.IntegerType()))]
SPAN = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64()), ("group", pa.int32()), ("bin", pa.int32()), ("key", pa.int64()), ("decoys", pa.list_(pa.int32()))]))


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _spans (code points; kind 3: tested pieces with their p)."""

    def run(column: pa.Array):
        texts = [raw or b"" for raw in binaries(column)]
        spans, k = [], 0
        while k < len(texts):
            size, n = 0, k
            while n < len(texts) and (n == k or size + len(texts[n]) <= GROUP_BYTES):
                size += len(texts[n])
                n += 1
            for raw, (base, tokens) in zip(texts[k:n], scan_text(texts[k:n]), strict=True):
                rows = [(*b, *[None] * 5) for b in base] + [(3, *t) for t in tokens]
                point = {}
                at = chars = 0
                for o in sorted({o for r in rows for o in r[1:3]}):
                    chars += len(raw[at:o].decode())
                    point[o], at = chars, o
                spans.append([{"kind": kind, "start": point[s], "end": point[e], **dict(zip(SPAN.names[3:], rest, strict=True))} for kind, s, e, *rest in rows])
            k = n
        return [pa.array(spans, _SPAN)]

    return add_columns(docs, [("_spans", T.ArrayType(SPAN))], run, text_col)


def cuts(targets: dict[tuple[int, int], int], decoys: dict[tuple[int, int], int], rate: float, each: int = DECOYS) -> dict[int, int]:
    """For each group, the lowest bin from ``LOW`` whose estimated false-discovery rate is at most ``rate``;
    ``BINS`` if there is none. Both tables count by (group, bin); every target has ``each`` decoys.

    If all targets of a group were ordinary, (decoys that pass + 1) / each of them would pass.
    """
    out = {}
    for group in {g for g, _ in targets}:
        t = np.cumsum([targets.get((group, b), 0) for b in range(BINS)][::-1])[::-1]
        d = np.cumsum([decoys.get((group, b), 0) for b in range(BINS)][::-1])[::-1]
        ok = [b for b in range(LOW, BINS) if t[b] and (d[b] + 1) / each <= rate * t[b]]
        out[group] = ok[0] if ok else BINS
    return out


def longest(passed: list[dict]) -> list[dict]:
    """Of pieces that overlap, the longest."""
    out: list[dict] = []
    for s in sorted(passed, key=lambda s: (s["start"] - s["end"], s["start"])):
        at = bisect.bisect(out, s["start"], key=lambda o: o["start"])
        if (at == 0 or out[at - 1]["end"] <= s["start"]) and (at == len(out) or s["end"] <= out[at]["start"]):
            out.insert(at, s)
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text", rate: float = FDR) -> DataFrame:
    """``docs`` without its text, with n_assign, n_access, n_hex, base_sha256, spans and found (an
    array of kind, start, end, p)."""
    found = staged(find_spans(docs, text_col).drop(text_col), "spans")
    tested = found.select(F.inline(F.filter("_spans", lambda s: s.kind == 3)))
    # One row for each distinct piece; of its copies' decoys those with the smallest hash.
    distinct = tested.groupBy("key", "group").agg(F.first("bin").alias("bin"), F.min_by("decoys", F.xxhash64("decoys")).alias("decoys"))
    at = distinct.select("group", F.lit(True).alias("own"), "bin")
    at = at.union(distinct.select("group", F.lit(False), F.explode("decoys")))
    counted = at.groupBy("group", "own", "bin").count().collect()  # two rows for each alphabet, class and bin at most
    targets, decoys = ({(r.group, r.bin): r["count"] for r in counted if r.own == own} for own in (True, False))
    least = cuts(targets, decoys, rate)
    listed = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *SPAN.fields[1:4]]))

    def run(spans: pa.Array):
        rows = []
        for own in spans.to_pylist():
            passed = [s for s in own if s["kind"] == 3 and s["bin"] >= least[s["group"]]]
            own = [s for s in own if s["kind"] < 3] + longest(passed)
            own.sort(key=lambda s: (s["start"], s["kind"], s["end"]))
            n = [sum(s["kind"] == k for s in own) for k in range(3)]
            text = [f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in own]
            base = ",".join(t for t, s in zip(text, own, strict=True) if s["kind"] < 3)
            rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(text), [{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "p": s["p"]} for s in own]))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))]
        return [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]

    new = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("found", listed)]
    return add_columns(found, new, run, "_spans").drop("_spans")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")
