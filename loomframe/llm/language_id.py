"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the code points of the lower-cased whole text, n-grams of one to
`ORDER` of them hashed into `BUCKETS`, (1 + log count) times inverse document
frequency, unit length. Document frequencies cover every learning document;
the classifier is fitted by follow-the-regularised-leader with an elastic-net
penalty on at most `sample` labelled rows (a documented bound: they alone reach
the driver, as sparse vectors), a fifth of which only calibrate a temperature.
Prediction is one pass over all documents without a shuffle.

Defined results: null text, or text without a letter, is `und` with score 0; so
is everything where nothing can be learned (no labelled row). Null labels are
never learned from. Of equally probable languages the first in order is taken. Repeated rows get equal results. Very long texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, ORDER = 1 << 15, 3
LETTER = regex.compile(r"\p{L}")
SMOOTH = 0.01
#: Odd multipliers that spread n-grams over the buckets.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def ngram_buckets(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out, h = [], np.zeros(len(points) + 1, np.uint64)
    for n in range(ORDER):
        if len(points) <= n:
            break
        h = h[: len(points) - n] * STEP + points[n:]
        out.append(((h ^ (h >> np.uint64(29))) * SPREAD) >> np.uint64(64 - 15))
        h = np.append(h, np.uint64(0))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(ngram_buckets(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    #: Mean difference of score and share told right on the calibration rows, by tenths of the score.
    calibration_error: float = 0.0

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class FTRL:
    """FTRL-proximal with per-coordinate rates and L1 and L2 penalties; the last row is the bias, without L1."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        at, v = np.append(at, BUCKETS), np.append(v, 1.0)
        w = self.weights(at)
        error = softmax(v @ w)
        error[label] -= 1
        g = v[:, None] * error
        squares = g * g
        sigma = (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += squares


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and of each bucket those that have it; every task sends one row a bucket at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS, bool)
        for pdf in batches:
            for text in pdf["text"]:
                at = ngram_buckets(text)
                seen[at] = True
                total[:-1] += seen
                seen[at] = False
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return int(df[-1]), df[:-1]


def fit(labelled: DataFrame, sample: int = 3000, epochs: int = 3, seed: int = 7) -> Model:
    """A model from (text, lang) rows, neither of them null. `sample` bounds the rows the classifier sees."""
    total, df = document_frequencies(labelled.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    if not total:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), idf, 1.0)
    scale = 1 << 30
    share = min(1.0, 1.5 * sample / total + 50 / total)
    key = F.pmod(F.xxhash64("text", "lang"), F.lit(scale))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [vector(t, idf) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "lang": pdf["lang"], "at": [a.astype(np.uint16).tobytes() for a, _ in found], "v": [v.tobytes() for _, v in found]})

    picked = labelled.select("text", "lang", key.alias("key")).filter(F.col("key") < int(share * scale))
    rows = picked.mapInPandas(vectors, "key long, lang string, at binary, v binary").orderBy("key", "lang").limit(sample).collect()
    langs = sorted({r.lang for r in rows})
    data = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["v"], np.float32), langs.index(r.lang)) for r in rows]
    if not data:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), idf, 1.0)
    held = [x for i, x in enumerate(data) if i % 5 == 4] or data
    taught = [x for i, x in enumerate(data) if i % 5 != 4]
    learner, order = FTRL(len(langs)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(taught)):
            learner.learn(*taught[i])
    w = learner.weights(slice(None))
    model = Model(langs, w[:-1].astype(np.float32), w[-1].astype(np.float32), idf, 1.0)
    logits, labels = np.array([model.logits(at, v) for at, v, _ in held]), np.array([k for _, _, k in held])
    model.temperature = calibrated(logits, labels)
    model.calibration_error = expected_error(softmax(logits / model.temperature), labels)
    return model


def calibrated(logits: np.ndarray, labels: np.ndarray, smooth: float = SMOOTH) -> float:
    """The temperature of least cross-entropy with smoothed labels; the grid grows until the least is inside it."""
    classes = logits.shape[1]
    if classes < 2:
        return 1.0
    want = np.full(logits.shape, smooth / classes)
    want[np.arange(len(labels)), labels] += 1 - smooth

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float(-(want * (x - np.log(np.exp(x).sum(1, keepdims=True)))).sum(1).mean())

    low, high = 0.05, 5.0
    while True:
        grid = np.geomspace(low, high, 80)
        k = int(np.argmin([loss(t) for t in grid]))
        if 0 < k < len(grid) - 1 or not 1e-4 < grid[k] < 1e4:
            return float(grid[k])
        low, high = (low / 10, high) if k == 0 else (low, high * 10)


def expected_error(p: np.ndarray, labels: np.ndarray) -> float:
    score, right = p.max(1), p.argmax(1) == labels
    bins = np.minimum((score * 10).astype(int), 9)
    return float(sum(abs((score - right)[bins == b].sum()) for b in range(10)) / len(labels))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (in place of columns of those names)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times languages, whatever the input's size

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    got = docs.select(*own, predict(F.col(text_col)).alias("_language"))
    return got.select(*own, F.col("_language.lang_pred").alias("lang_pred"), F.col("_language.score").alias("score"))
