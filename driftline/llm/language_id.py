"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed into BUCKETS. Document frequencies come
from all training documents (each task returns one count for each bucket it saw, Spark sums them). The model is
trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on at most
PER_LANGUAGE documents of each language (SAMPLE of all), the ones with the smallest hash of their id, of which the driver
gets n-gram counts alone; a temperature fitted on a
fifth of them that training leaves out calibrates the probabilities. Every whole text is scored.

Defined results: a null text, or one without a letter, is `und` with score 0. Repeated rows each get a row.
Rows without an id are scored, and count as training rows of remainder null, that is, never. Without any
training row every text is `und`. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import hashed_below, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The bounds of the training sample: rows of a language, and of all; every language has its share of the second.
PER_LANGUAGE, SAMPLE = 1000, 20_000
#: Characters handled at once; longer texts are scored piece by piece.
PIECE = 1 << 20
EPOCHS = 3
UNKNOWN = "und"


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with a space at both ends."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each n-gram of points."""
    h = points[: len(points) - n + 1].astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(n)
    for i in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[i : len(points) - n + 1 + i]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def pieces(text: str) -> Iterator[np.ndarray]:
    """Code points in pieces that overlap so that each n-gram of the highest order lies in one of them."""
    points = codes(text)
    for i in range(0, max(1, len(points) - max(ORDERS) + 1), PIECE):
        yield points[i : i + PIECE + max(ORDERS) - 1]


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of one text's n-grams."""
    total = np.zeros(BUCKETS, np.int64)
    for p in pieces(text):
        for n in ORDERS:
            total += np.bincount(grams(p, n), minlength=BUCKETS)
    at = np.nonzero(total)[0]
    return at, total[at]


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """For each bucket the number of texts that hold it; the last entry is the number of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b["text"]:
                seen = np.zeros(BUCKETS, bool)
                for p in pieces(text):
                    for order in ORDERS:
                        seen[grams(p, order)] = True
                df += seen
                n += 1
        at = np.nonzero(df)[0]
        yield pd.DataFrame({"bucket": np.append(at, BUCKETS), "n": np.append(df[at], n)})

    rows = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1)
    out[rows["bucket"].to_numpy(dtype=int)] = rows["n"].to_numpy()
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for a multinomial logistic model; one weight row for each feature."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search of its logarithm."""
    loss = lambda t: -np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class LanguageModel:
    """languages, a table of IDF-weighted weights by bucket, and the temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, heat: float):
        self.languages, self.weights, self.bias, self.heat = languages, weights, bias, heat

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for p in pieces(text):
            for order in ORDERS:
                h = grams(p, order)
                total += self.weights.take(h, axis=0).sum(axis=0, dtype=np.float64)
                n += len(h)
        p = softmax((FEATURE_SCALE * total / max(n, 1) + self.bias) / self.heat)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


#: Term frequencies of some thousands of n-grams are small; this brings the features near one.
FEATURE_SCALE = 30.0


#: Counts of so many languages are sent to every task.
SENT_LANGUAGES = 100_000


def sample(training: DataFrame) -> DataFrame:
    """doc_id, text and lang of at most PER_LANGUAGE rows of each language, SAMPLE of all."""
    counts = training.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    # unasked, the planner deals all texts by language for this join, and most of them to one task
    counts = F.broadcast(counts) if languages <= SENT_LANGUAGES else counts
    # twice the wanted rows of a language and some more pass, however many tasks there are, before the least hashes are ranked
    near = training.join(counts, "lang").filter(hashed_below(F.lit(2.0 * each + 50) / F.col("n")))
    spread = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return near.withColumn("r", spread).filter(F.col("r") <= each).select("doc_id", "text", "lang")


def counted(rows: DataFrame) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """doc_id, lang, buckets and counts of each row with a letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[np.array([any(map(str.isalpha, t)) for t in b["text"]], bool)]
            found = [term_counts(t) for t in b["text"]]
            yield b[["doc_id", "lang"]].assign(at=[x.astype(np.uint16).tobytes() for x, _ in found], n=[n.astype(np.uint32).tobytes() for _, n in found])

    for r in rows.mapInPandas(run, "doc_id long, lang string, at binary, n binary").toLocalIterator():
        yield r[0], r[1], np.frombuffer(r[2], np.uint16).astype(np.int64), np.frombuffer(r[3], np.uint32)


def train(training: DataFrame, seed: int = 7) -> LanguageModel:
    """training: doc_id, text, lang, none of them null."""
    df = document_frequencies(training)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    found, labels, held = [], [], []
    for doc_id, lang, at, n in sorted(counted(sample(training)), key=lambda x: x[:2]):
        found.append((at, FEATURE_SCALE * n / n.sum() * idf[at]))
        labels.append(lang)
        held.append(doc_id % 5 == 4)
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    y, held = np.array([languages.index(x) for x in labels]), np.array(held)
    if held.all():
        held[:] = False
    model, bias = Ftrl(BUCKETS + 1, len(languages)), BUCKETS
    whole = [(np.append(at, bias), np.append(x, 1.0)) for at, x in found]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.nonzero(~held)[0]):
            model.learn(*whole[i], y[i])
    w = model.weights()
    check = np.nonzero(held)[0] if held.any() else np.arange(len(y))
    z = np.array([x @ w[at] for at, x in (whole[i] for i in check)])
    return LanguageModel(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], temperature(z, y[check]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [held.value.score(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = docs.filter((remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    out = predict(docs, train(learnable))
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
