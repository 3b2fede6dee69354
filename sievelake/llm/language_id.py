"""Language identification with a linear-chain conditional random field over words.

Every word of a text is labelled with a language by forward-backward, so code-switched text gets a label
for each word; a text's language is the one with the most expected words. Emissions sum learned weights of
character n-grams, prefixes, suffixes and a lexicon entry of the word; transitions between neighbouring
words are learned too. Training maximises the conditional likelihood by stochastic gradient (Adam) on a
bounded sample: of each language at most ``sample_docs`` labelled texts, those with the smallest hash of
their id, of all at most ``sample_total``, and no more of them than hold ``sample_bytes``; they are read
whole. Two passes draw it, however many languages there are: one counts them, one keeps the rows under a
hash that leaves about twice what is wanted of each. Passages of different texts are chained, so that the
transitions see language switches.

Inference is one narrow pass. Texts are gathered until they hold ``BUFFER_WORDS`` words, and all of them
step through forward-backward together, so one very long text costs steps but little memory.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is all when nothing
could be learnt; ties go to the first language in order; repeated documents are alike; of the input's
columns only the id is returned, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, binaries, first_rows, table, words_of
from .quality import fold

SAMPLE_DOCS = 300
SAMPLE_TOTAL = 3000
SAMPLE_BYTES = 64 << 20
LEXICON = 5000
BUFFER_WORDS = 1_500_000
CACHE_WORDS = 200_000
NONE = "und"
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes | None) -> bool:
    return bool(raw) and (bool(_LETTER.search(raw)) or (not raw.isascii() and any(c.isalpha() for c in raw.decode())))


def features(w: bytes) -> list[bytes]:
    """Lexicon entry, prefixes, suffixes and inner n-grams of a word, told apart by a leading mark."""
    n = len(w)
    out = [b"=" + w]
    for k in (1, 2, 3):
        if k <= n:
            out += (b"<" + w[:k], b">" + w[-k:])
    out += [w[i : i + 2] for i in range(n - 1)]
    out += [w[i : i + 3] for i in range(n - 2)]
    return out


@dataclass
class Chain:
    """Languages, feature weights (rows of ``weights``; row 0 is the bias), transitions and start."""

    languages: list[str]
    index: dict[bytes, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def rows_of(self, w: bytes) -> list[int]:
        get = self.index.get
        return [0, *(i for f in features(w) if (i := get(f)))]

    def emissions(self, words: list[bytes]) -> np.ndarray:
        rows = [self.rows_of(w) for w in words]
        sizes = np.array([len(r) for r in rows])
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.weights[flat], np.concatenate(([0], sizes.cumsum()[:-1])), axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each word, expected transitions, and each chain's log-likelihood normaliser.

    ``scores``: emission scores of all words, chain after chain; no chain is empty.
    """
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    longest = lengths[order]
    n_steps = int(longest[0])
    active = np.searchsorted(-longest, -np.arange(n_steps), side="left")  # chains longer than t
    top = scores.max(axis=1, keepdims=True)
    emit = np.exp(scores - top)
    step = np.exp(transitions)
    alpha = np.empty_like(emit)
    norm = np.empty(len(emit), emit.dtype)
    a = None
    for t in range(n_steps):
        at = begins[: active[t]] + t
        a = emit[at] * (np.exp(start) if a is None else a[: active[t]] @ step)
        z = a.sum(axis=1)
        a /= z[:, None]
        alpha[at], norm[at] = a, z
    marginal = alpha.copy()
    expected = np.zeros_like(step)
    b = np.ones((0, len(start)), emit.dtype)
    for t in range(n_steps - 1, 0, -1):
        n = active[t]
        at = begins[:n] + t
        if len(b) < n:
            b = np.concatenate((b, np.ones((n - len(b), b.shape[1]), b.dtype)))
        marginal[at] = alpha[at] * b
        right = emit[at] * b / norm[at][:, None]
        expected += (alpha[at - 1].T @ right) * step
        b = right @ step.T
    if n_steps > 1:
        marginal[begins[: active[1]]] *= b
    marginal /= marginal.sum(axis=1, keepdims=True)
    ends = np.cumsum(lengths)
    total = np.add.reduceat(np.log(norm) + top[:, 0], ends - lengths)
    return marginal, expected, total


def train(texts: list[tuple[bytes, str]], epochs: int = 8, seed: int = 7) -> Chain | None:
    """Fit a chain on labelled texts; None if there is no word to learn from."""
    languages = sorted({lang for raw, lang in texts if has_letter(raw)})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    parts = []
    for raw, lang in texts:
        numbers = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(raw)], np.int64)
        at = 0
        while at < len(numbers):
            n = int(rng.integers(6, 25))
            parts.append((numbers[at : at + n], languages.index(lang)))
            at += n
    rng.shuffle(parts)
    listed = list(vocab)
    seen: Counter[bytes] = Counter()
    for numbers, _ in parts:
        for i in set(numbers.tolist()):
            seen.update(features(listed[i]))
    often = np.bincount(np.concatenate([numbers for numbers, _ in parts]), minlength=len(listed))
    lexicon = {b"=" + listed[i] for i in np.argsort(-often, kind="stable")[:LEXICON]}
    kept = [f for f, n in seen.items() if n > 1 and (f[:1] != b"=" or f in lexicon)]
    k = len(languages)
    chain = Chain(languages, {f: i + 1 for i, f in enumerate(kept)}, np.zeros((len(kept) + 1, k)), np.zeros((k, k)), np.zeros(k))
    params = [chain.weights, chain.transitions, chain.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = [chain.rows_of(w) for w in listed]
    edges = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    rows_flat = np.fromiter((i for r in rows for i in r), np.int64, int(edges[-1]))
    chains = [parts[i : i + 2] for i in range(0, len(parts), 2)]
    size, step = 128, 0
    for epoch in range(epochs):
        for at in range(0, len(chains), size):
            batch = chains[at : at + size]
            # Scores and gradients are taken once for each distinct word of the batch.
            words, which = np.unique(np.concatenate([p[0] for c in batch for p in c]), return_inverse=True)
            gold = np.repeat([p[1] for c in batch for p in c], [len(p[0]) for c in batch for p in c])
            lengths = np.array([sum(len(p[0]) for p in c) for c in batch])
            sizes = edges[words + 1] - edges[words]
            heads = np.cumsum(sizes) - sizes
            flat = rows_flat[np.repeat(edges[words] - heads, sizes) + np.arange(sizes.sum())]
            scores = np.add.reduceat(chain.weights[flat], heads, axis=0)[which]
            marginal, expected, _ = forward_backward(scores, lengths, chain.transitions, chain.start)
            truth = np.eye(k)[gold]
            begins = np.cumsum(lengths) - lengths
            inner = np.ones(len(gold), bool)
            inner[begins] = False
            pairs = np.zeros((k, k))
            np.add.at(pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            miss = truth - marginal
            own = np.stack([np.bincount(which, miss[:, c], len(words)) for c in range(k)], 1)
            gain = np.stack([np.bincount(flat, np.repeat(own[:, c], sizes), len(chain.weights)) for c in range(k)], 1)
            grads = [gain / size, (pairs - expected) / size, miss[begins].sum(axis=0) / size]
            step += 1
            rate = 0.05 * (1 - epoch / epochs)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g - 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    chain.weights = chain.weights.astype(np.float32)
    return chain


def fit_languages(
    docs: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    sample_total: int = SAMPLE_TOTAL,
    sample_bytes: int = SAMPLE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Chain | None:
    """Train on a bounded sample of the labelled rows given; hold rows out by leaving them out of ``docs``."""
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where("_lang IS NOT NULL AND _id IS NOT NULL")
    counts = {r._lang: r["count"] for r in known.groupBy("_lang").count().collect()}  # a row per language
    if not counts:
        return None
    each = max(1, min(sample_docs, sample_total // len(counts)))
    # Under this hash stand about twice as many rows as are wanted, or all.
    under = [(lang, min(int((2 * each + 50) / n * 2**64), 2**64 - 1) - 2**63) for lang, n in counts.items()]
    limits = docs.sparkSession.createDataFrame(under, T.StructType([known.schema["_lang"], T.StructField("_under", T.LongType())]))
    if sum(len(str(lang)) + 16 for lang in counts) <= BROADCAST_BYTES:
        limits = F.broadcast(limits)
    near = known.join(limits, "_lang").where(F.xxhash64("_id") <= F.col("_under"))
    rows = first_rows(near, "_lang", [F.xxhash64("_id"), F.col("_id")], "_text", each, sample_bytes // len(counts))
    rows = rows.select("_id", "_lang", "_text").orderBy(F.xxhash64("_id"), "_lang", "_text").collect()
    return train([(r._text.encode(), r._lang) for r in rows])


class Labeller:
    """Gathers texts into word numbers and runs forward-backward over many at once."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.cache: dict[bytes, int] = {}
        self.table = np.zeros((0, len(chain.languages)), np.float32)

    def number(self, words: list[bytes]) -> np.ndarray:
        """Rows of ``table`` with the emission scores of the words; the table is kept to a bound."""
        cache = self.cache
        got = np.fromiter(map(cache.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            cache.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate((self.table, self.chain.emissions(new).astype(np.float32)))
            got[missing] = np.fromiter((cache[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return got

    def scores(self, words: list[bytes]) -> np.ndarray:
        numbers = self.number(words)
        scores = self.table[numbers]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.table = self.table[:0]
        return scores


def _labelled(chain: Chain, texts):
    """(text's number, words, marginals) of every text with words, several together."""
    labeller = Labeller(chain)
    held: list[tuple[int, list[bytes] | None, int]] = []
    words: list[bytes] = []
    blocks: list[np.ndarray] = []
    total = 0

    def flush():
        lengths = np.array([n for _, _, n in held])
        marginal, _, _ = forward_backward(np.concatenate(blocks), lengths, chain.transitions.astype(np.float32), chain.start.astype(np.float32))
        ends = np.cumsum(lengths)
        for (k, _, n), end in zip(held, ends, strict=True):
            yield k, marginal[end - n : end]

    for k, raw in texts:
        own = words_of(raw)
        if not own:
            continue
        held.append((k, None, len(own)))
        words += own
        total += len(own)
        if len(words) > 20_000:
            blocks.append(labeller.scores(words))
            words = []
        if total >= BUFFER_WORDS:
            if words:
                blocks.append(labeller.scores(words))
            yield from flush()
            held, words, blocks, total = [], [], [], 0
    if held:
        if words:
            blocks.append(labeller.scores(words))
        yield from flush()


def identify(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``; score is the share of expected words."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the sample it was trained on
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        ids: list[pa.Array] = []
        said: list[tuple[str, float]] = []
        size = 0

        def out():
            flat = pa.chunked_array(ids).combine_chunks()
            return pa.RecordBatch.from_arrays([flat, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=["_id", "lang_pred", "score"])

        def settle(texts):
            for k, marginal in _labelled(model, texts) if model else ():
                mass = marginal.sum(axis=0, dtype=float)
                best = int(mass.argmax())
                said[k] = (model.languages[best], float(min(1.0, mass[best] / mass.sum())))

        texts: list[tuple[int, bytes]] = []
        for batch in batches:
            ids.append(batch.column(0))
            for raw in binaries(batch.column(1)):
                said.append((NONE, 0.0))
                if has_letter(raw):
                    texts.append((len(said) - 1, raw))
                    size += len(raw)
            if size >= 12 << 20:
                settle(texts)
                yield out()
                ids, said, texts, size = [], [], [], 0
        if said:
            settle(texts)
            yield out()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def label_words(chain: Chain, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of every word of one text."""
    raw = text.encode()
    return [
        (w.decode(), chain.languages[int(m.argmax())], float(m.max()))
        for _, marginal in _labelled(chain, [(0, raw)])
        for w, m in zip(words_of(raw), marginal, strict=True)
    ]


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    chain = fit_languages(docs.where(fold(F.col("doc_id"), 4) != 2))
    held = F.coalesce(fold(F.col("_id"), 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs, chain).select(F.col("_id").alias("doc_id"), held, "lang_pred", "score")
