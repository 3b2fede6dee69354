"""Quality classifier by compression.

A zstandard dictionary is trained on good and one on bad labelled text. A document is cut into pieces
of ``PIECE`` bytes (whole text, so that late parts see the dictionary as early ones do) and every piece
is compressed with either dictionary. The difference of the summed sizes, normalised by the smaller
sum, becomes a probability through logistic calibration on labelled rows that the dictionaries have not
seen, weighted back to the labels' own rate. The calibration also takes the smaller sum per byte: text
that repeats itself shrinks to nothing with either dictionary, and only that shows it.

The fit reads at most ``sample_rows`` labelled rows of each class, those with the smallest hash of their
id, and no more of them than hold ``sample_bytes``; their texts are read whole. So the model and what is sent
to the driver are bounded at any input size. Scoring is one narrow pass over all rows and whole texts.

Defined results: a null or empty text scores at the calibrated intercept; repeated labels of an id are
averaged; with no labels of one class the score is the smoothed base rate; repeated documents score
alike; a score of exactly 0.5 is predicted 1; input columns that clash with the result's names are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, binaries, first_rows, set_aside, table

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 64 << 20
DICT_BYTES = 96 << 10
PIECE = 2048
LEVEL = 3
RESULT = ("score", "predicted")


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(data)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def features(self, raw: bytes | None) -> tuple[float, float]:
        """(size by the bad dictionary - size by the good one) / the smaller, and the smaller's log per
        byte; zeros for no text."""
        if not raw or not self.good:
            return 0.0, 0.0
        if "_pair" not in self.__dict__:
            self._pair = _compressor(self.good), _compressor(self.bad)
        good, bad = self._pair
        cut = pieces(raw)
        g = sum(len(good.compress(p)) for p in cut)
        b = sum(len(bad.compress(p)) for p in cut)
        return (b - g) / min(b, g), math.log(min(b, g) / len(raw))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.array([(1.0, *self.features(raw)) for raw in texts], float).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression of y on the columns of x by Newton steps, slightly ridged."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.concatenate((np.ones((len(x), 1)), x / scale), 1)
    beta, ridge = np.zeros(design.shape[1]), np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in beta / np.concatenate(([1.0], scale)))


def fit_texts(good: list[bytes], bad: list[bytes], good_rate: float) -> CompressionModel:
    """Dictionaries from the even rows, calibration on the odd ones."""
    none = CompressionModel(b"", b"", (math.log(good_rate / (1 - good_rate)), 0.0, 0.0))
    good, bad = [t for t in good if t], [t for t in bad if t]
    if min(len(good), len(bad)) < 4:
        return none
    books = []
    for texts in (good[::2], bad[::2]):
        samples = [p for t in texts for p in pieces(t)]
        size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
        try:
            books.append(zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes())
        except zstandard.ZstdError:  # too little text to train on
            books.append(b"".join(samples)[-DICT_BYTES:])
    model = CompressionModel(*books, (0.0, 1.0, 0.0))
    x = np.array([model.features(t) for t in [*good[1::2], *bad[1::2]]])
    n_good, n_bad = len(good[1::2]), len(bad[1::2])
    y = np.concatenate((np.ones(n_good), np.zeros(n_bad)))
    weight = np.where(y == 1, good_rate * (n_good + n_bad) / n_good, (1 - good_rate) * (n_good + n_bad) / n_bad)
    model.weights = calibrate(x, y, weight)
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> CompressionModel:
    """Fit on a bounded sample of the labelled rows given; hold rows out by leaving them out of ``labels``."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).alias("good"))
    counts = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    rate = (counts.get(True, 0) + 1) / (sum(counts.values()) + 2)
    taken = [known.where(F.col("good") == kind).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows) for kind in (True, False)]
    picked = F.broadcast(taken[0].union(taken[1]))  # 2 * sample_rows ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(picked, "_id")
    order = [F.xxhash64("_id"), F.col("_id")]
    rows = first_rows(rows, "good", order, "text", 2 * sample_rows, sample_bytes).orderBy("good", "_n").collect()
    texts = {kind: [r.text.encode() for r in rows if r.good == kind] for kind in (True, False)}
    return fit_texts(texts[True], texts[False], rate)


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (higher: better) and predicted (1 if score >= 0.5)."""

    def run(texts: pa.Array):
        score = model.score(binaries(texts))
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]

    return add_columns(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())], run, text_col)


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns as they are."""
    safe, back = set_aside(docs, RESULT)
    return score_quality(safe, model, text_col).where("predicted = 1").select(*back)


def fold(column, n: int):
    return F.crc32(column.cast("string").cast("binary")) % n


def open_labels(labels: DataFrame) -> DataFrame:
    """Rows of ``labels`` that may be learnt from."""
    return labels.where(fold(F.col("doc_id"), 3) != 1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, open_labels(table(spark, sf_dir, "labels").select("doc_id", "quality")))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select("doc_id", held, "score", "predicted")
