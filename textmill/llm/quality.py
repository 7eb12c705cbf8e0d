"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Its score is a sigmoid of  w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2),  linear in the number
of features. It is fitted on the driver on a bounded sample (see labelled.py); the model is WORD_DIM + BINS rows of
1 + RANK numbers, whatever the corpus. Every whole text is scored in one scan without a shuffle.

Defined cases: null text counts as empty and is scored; a null n_chars has a bin of its own; without any learning rows,
or with one class only, every text scores that class's share (0.5 if there are none); an empty table: an empty result;
repeated rows: repeated results; further columns are ignored. Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled

WORD_DIM, RANK, THRESHOLD = 2048, 8, 0.3
STEPS, RATE, DECAY = 150, 0.05, 2e-4

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_LETTER = _UPPER | _LOWER | _HIGH

#: Edges of the bins of each structure statistic; each bin is a feature.
_SHARE = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.6, 0.9)
EDGES = {
    "words": tuple(2.0**k for k in range(2, 15)),
    "word_bytes": (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10),
    "upper": _SHARE,
    "punctuation": _SHARE,
    "digits": _SHARE,
    "odd_words": _SHARE,
    "distinct_words": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "top_word": _SHARE,
    "distinct_lines": (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.99),
    "line_words": (2, 4, 8, 16, 32, 64, 128),
    "repeats": (0.001, 0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "n_chars": tuple(2.0**k for k in range(5, 18)),
}
BINS = sum(len(e) + 2 for e in EDGES.values())


def statistics(text: bytes, words: list[bytes], counts: Counter, n_chars: float | None) -> dict[str, float]:
    n, size = len(words), max(len(text), 1)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = int(by_byte[_LETTER].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = sum(k for w, k in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:)" or not w[:1].isalnum() and w[0] < 128)
    return {
        "words": n,
        "word_bytes": sum(map(len, words)) / max(n, 1),
        "upper": by_byte[_UPPER].sum() / max(letters, 1),
        "punctuation": by_byte[~(_LETTER | _DIGIT | _SPACE)].sum() / size,
        "digits": by_byte[_DIGIT].sum() / size,
        "odd_words": odd / max(n, 1),
        "distinct_words": len(counts) / max(n, 1),
        "top_word": max(counts.values(), default=0) / max(n, 1),
        "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "line_words": n / max(len(lines), 1),
        "repeats": sum(map(bytes.__eq__, words, words[1:])) / max(n, 1),
        "n_chars": -1.0 if n_chars is None or n_chars != n_chars else float(n_chars),
    }


def features(text: bytes | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words by hash (square roots of counts, unit length), then a bin per statistic."""
    text = text or b""
    words = text.split()
    counts = Counter(words)
    x = np.zeros(WORD_DIM, np.float32)
    if counts:
        at = np.fromiter((zlib.crc32(w.lower()) % WORD_DIM for w in counts), np.int64, len(counts))
        np.add.at(x, at, np.fromiter(counts.values(), np.float32, len(counts)))
        x = np.sqrt(x)
        x /= np.linalg.norm(x)
    ids, base = [], WORD_DIM
    stats = statistics(text, words, counts, n_chars)
    for name, edges in EDGES.items():
        v = stats[name]
        ids.append(base + (len(edges) + 1 if v < 0 else int(np.searchsorted(edges, v, side="right"))))
        base += len(edges) + 2
    hit = np.flatnonzero(x)
    return np.concatenate([hit, ids]).astype(np.int32), np.concatenate([x[hit], np.full(len(ids), 0.5, np.float32)])


class Model:
    def __init__(self, bias: float, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.bias, self.w, self.v = bias, w, v

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        if self.w is None:
            return float(labelled.sigmoid(self.bias))
        vx = self.v[ids] * x[:, None]
        pairs = 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())
        return float(labelled.sigmoid(self.bias + float(self.w[ids] @ x) + pairs))


def fit(ids: list[np.ndarray], xs: list[np.ndarray], y: np.ndarray, share: float, steps: int = STEPS, seed: int = 7) -> Model:
    """Full-batch Adam on the logistic loss, the classes weighing alike; the bias is then set to their shares."""
    if not len(y) or y.min() == y.max():
        return Model(float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))))
    rng = np.random.default_rng(seed)
    big = np.zeros((len(y), WORD_DIM + BINS), np.float32)
    for row, i, x in zip(big, ids, xs, strict=True):
        row[i] = x
    squares = big * big
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)
    b, w, v = np.zeros(1, np.float32), np.zeros(big.shape[1], np.float32), rng.normal(0, 0.05, (big.shape[1], RANK)).astype(np.float32)

    def gradients():
        xv = big @ v
        z = b + big @ w + 0.5 * ((xv**2).sum(1) - squares @ (v**2).sum(1))
        e = ((labelled.sigmoid(z) - y) * weight).astype(np.float32)
        gv = big.T @ (e[:, None] * xv) - v * (squares.T @ e)[:, None]
        return e.sum(keepdims=True), big.T @ e + DECAY * w, gv + DECAY * v

    labelled.adam([b, w, v], gradients, steps, RATE)
    return Model(float(b[0]) + labelled.prior_shift(np.array([0, 1]), share), w, v)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS) -> Model:
    rows, share = labelled.sample(docs, labels, "quality", per_class, ("text", "n_chars"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            f = [features(t, n) for t, n in zip(b["text"], b["n_chars"], strict=True)]
            yield pd.DataFrame({"y": b["y"], "ids": [i.tobytes() for i, _ in f], "x": [x.tobytes() for _, x in f]})

    cast = rows.select("y", F.col("text").cast("binary").alias("text"), F.col("n_chars").cast("double").alias("n_chars"))
    got = cast.mapInPandas(run, "y int, ids binary, x binary").toPandas()  # 2 * per_class rows of WORD_DIM + BINS features at most
    got = got.sort_values(["y", "ids", "x"])
    ids, xs = [np.frombuffer(i, np.int32) for i in got["ids"]], [np.frombuffer(x, np.float32) for x in got["x"]]
    return fit(ids, xs, got["y"].to_numpy(np.float32), share)


def scorer(model: Model) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def score(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series([model.score(*features(t, n)) for t, n in zip(texts, n_chars, strict=True)], dtype="float64")

    return lambda text, n_chars: score(text.cast("binary"), n_chars.cast("double"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """docs: doc_id, text, n_chars; labels: doc_id, quality. doc_id, held_out, score, predicted."""
    score = scorer(learn(docs, labels, per_class))
    out = docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), F.col("n_chars")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
