"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Features are words and word beginnings of PREFIXES characters, each at several counts (LEVELS). The classifier
is logistic; its vocabulary is the features whose document frequency differs most between confirmed toxic
documents and all training documents, counted over every one of them. The weights minimise the non-negative risk estimator
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))
over confirmed toxic documents and unlabelled ones; when the second part falls below zero, its gradient is
reversed. The class prior is the toxic share of all labelled training rows. The fit uses at most POSITIVES
confirmed and UNLABELLED documents of any kind, those with the smallest hash of their id, of which the driver gets the
vocabulary's places alone; scores cover all rows.

Defined results: a null or empty text has no words and gets the score of the bias. Without a confirmed toxic
training document every score is 0. A text longer than a strip is counted alone. Repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import smallest_hashes, table

VOCABULARY = 1200
POSITIVES = 2500
UNLABELLED = 6000
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 4, 8)
#: Features that fewer confirmed toxic documents hold, as number or share, are not candidates for the vocabulary. The share
#: bounds the candidates by the features a document has, whatever the number of documents.
LEAST, LEAST_SHARE = 4, 0.002
#: Counts a task holds before it hands them on.
HELD = 300_000
#: Characters of text whose words are counted together.
STRIP = 1 << 22
#: Labels are sent to every task up to so many rows (16 bytes each); beyond, the join shuffles.
SENT_LABELS = 500_000
WORD = re.compile(r"[^\W\d_]+")


def stems(word: str) -> list[str]:
    """The word itself and its beginnings, which end in a mark."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


class StemCounts:
    """How often each stem occurs in each text, for many texts at once: rows of text, stem (its number) and n.

    among: the numbers of the stems that count; None numbers all stems as they come, in names."""

    def __init__(self, among: dict[str, int] | None):
        self.names: dict[str, int] = {} if among is None else among
        self.every = among is None
        self.known: dict[str, list[int]] = {}

    def of_word(self, word: str) -> list[int]:
        own = self.known.get(word)
        if own is None:
            found = stems(word)
            own = [self.names.setdefault(s, len(self.names)) for s in found] if self.every else [self.names[s] for s in found if s in self.names]
            self.known[word] = own
        return own

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, n = [], []
        for text in texts:
            own = WORD.findall(text.lower()) if text else []
            flat += own
            n.append(len(own))
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > HELD:
            self.known.clear()
        pair, times = np.unique(np.repeat(np.arange(len(texts)), n) * max(len(words), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text, word = np.divmod(pair, max(len(words), 1))
        lists = [self.of_word(w) for w in words]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        every, first = np.fromiter(itertools.chain.from_iterable(lists), np.int64, size.sum()), np.cumsum(size) - size
        own = size[word]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[word], own)
        key, row = np.unique(np.repeat(text, own) * max(len(self.names), 1) + every[at], return_inverse=True)
        counts = np.bincount(row, np.repeat(times, own), len(key)).astype(np.int64)
        return *np.divmod(key, max(len(self.names), 1)), counts


def strips(texts: list[str | None]) -> Iterator[slice]:
    """Slices of about STRIP characters; a longer text is alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t or "") > STRIP:
            yield slice(a, i)
            a, size = i, 0
        size += len(t or "")
    if len(texts) > a:
        yield slice(a, len(texts))


def numbered(vocabulary: Iterable[tuple[str, int]]) -> dict[str, int]:
    return {s: i for i, s in enumerate(sorted({s for s, _ in vocabulary}))}


class ToxicityModel:
    """weights of the vocabulary's (stem, level) features; a stem that occurs n times has those of all levels up to n."""

    def __init__(self, vocabulary: dict[tuple[str, int], int], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        self.among = numbered(vocabulary)
        self.sums = np.zeros((len(self.among), len(LEVELS) + 1))
        for (stem, level), i in vocabulary.items():
            self.sums[self.among[stem], LEVELS.index(level) + 1] = weights[i]
        self.sums = self.sums.cumsum(axis=1)

    def scores(self, texts: list[str | None], counts: StemCounts) -> np.ndarray:
        """One score for each text; counts: of this model's stems."""
        if self.bias == -np.inf:
            return np.zeros(len(texts))
        text, stem, n = counts(texts)
        z = self.bias + np.bincount(text, self.sums[stem, np.searchsorted(LEVELS, n, "right")], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def document_frequencies(texts: DataFrame, among: frozenset | None = None) -> DataFrame:
    """stem, level and n: how many texts hold each feature (of the stems in among). Tasks count, Spark sums."""
    held = texts.sparkSession.sparkContext.broadcast(among)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = lambda: StemCounts(None if held.value is None else {s: i for i, s in enumerate(sorted(held.value))})
        counts, found = start(), np.zeros((0, len(LEVELS)), np.int64)

        def rows() -> pd.DataFrame:
            i, j = np.nonzero(found)
            names = np.array([*counts.names, ""], object)
            return pd.DataFrame({"stem": names[i], "level": np.array(LEVELS, np.int32)[j], "n": found[i, j]})

        for b in batches:
            own = list(b["text"])
            for s in strips(own):
                _, stem, n = counts(own[s])
                new = np.stack([np.bincount(stem[n >= level], minlength=len(counts.names)) for level in LEVELS], axis=1)
                new[: len(found)] += found
                found = new
                if held.value is None and len(found) > HELD:
                    yield rows()
                    counts, found = start(), found[:0]
        yield rows()

    return texts.select("text").mapInPandas(count, "stem string, level int, n long").groupBy("stem", "level").agg(F.sum("n").alias("n"))


def choose_vocabulary(training: DataFrame, n_pos: int, n_all: int) -> dict[tuple[str, int], int]:
    """The features whose document frequency differs most between confirmed rows and all rows."""
    often = document_frequencies(training.filter(F.col("toxic") == 1)).filter(F.col("n") >= max(LEAST, LEAST_SHARE * n_pos))
    pos = {(r["stem"], r["level"]): r["n"] for r in often.collect()}
    every = {(r["stem"], r["level"]): r["n"] for r in document_frequencies(training, frozenset(s for s, _ in pos)).collect()}

    def gain(f: tuple[str, int]) -> float:
        p, q = (pos[f] + 0.5) / (n_pos + 1), (every.get(f, 0) + 0.5) / (n_all + 1)
        return abs(p**0.5 - q**0.5) * (p + q) ** 0.5

    return {f: i for i, f in enumerate(sorted(pos, key=lambda f: (-gain(f), f))[:VOCABULARY])}


def feature_places(docs: DataFrame, vocabulary: dict[tuple[str, int], int]) -> np.ndarray:
    """One row of marks for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = StemCounts(numbered(held.value))
        place = np.full((len(counts.names), len(LEVELS)), -1)
        for (stem, level), i in held.value.items():
            place[counts.names[stem], LEVELS.index(level)] = i
        for b in batches:
            own = list(b["text"])
            for s in strips(own):
                text, stem, n = counts(own[s])
                at = np.where(n[:, None] >= np.array(LEVELS), place[stem], -1)
                lists = np.split(at, np.searchsorted(text, np.arange(1, len(own[s]))))
                yield pd.DataFrame({"at": [x[x >= 0].astype(np.uint16).tobytes() for x in lists]})

    rows = [np.frombuffer(r[0], np.uint16) for r in docs.select("text").mapInPandas(places, "at binary").toLocalIterator()]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, at in enumerate(rows):
        x[i, at] = 1
    return x


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 300, l2: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; p, u: feature rows of positives and unlabelled."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))
    w = np.zeros(p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        g = prior * (p.T @ (sigmoid(zp) - 1)) / len(p) + of_negative if negative >= 0 else -of_negative
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w[:-1], float(w[-1])


def train(training: DataFrame) -> ToxicityModel:
    """training: doc_id, text, toxic (1: confirmed, else unlabelled), labelled (whether the row has a label)."""
    n_pos, n_labelled, n_all = training.agg(F.sum("toxic"), F.sum(F.col("labelled").cast("long")), F.count("*")).first()
    if not n_pos:
        return ToxicityModel({}, np.zeros(0, np.float32), -np.inf)

    vocabulary = choose_vocabulary(training, n_pos, n_all)
    positive = feature_places(smallest_hashes(training.filter(F.col("toxic") == 1), POSITIVES, n_pos), vocabulary)
    unlabelled = feature_places(smallest_hashes(training, UNLABELLED, n_all), vocabulary)
    prior = min(max(n_pos / max(n_labelled, n_pos), 1e-3), 0.5)
    return ToxicityModel(vocabulary, *fit_nnpu(positive, unlabelled, prior))


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted of each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = StemCounts(held.value.among)
        for b in batches:
            own = list(b["text"])
            scores = np.concatenate([np.zeros(0), *(held.value.scores(own[s], counts) for s in strips(own))])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "predicted": (scores >= 0.5).astype("int32")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    marks = labels.filter((fold != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("mark"))
    marks = F.broadcast(marks) if marks.count() <= SENT_LABELS else marks
    training = (
        docs.filter(fold != 0)
        .select("doc_id", "text")
        .join(marks, "doc_id", "left")
        .select("doc_id", "text", F.coalesce(F.col("mark"), F.lit(0)).cast("long").alias("toxic"), F.col("mark").isNotNull().alias("labelled"))
    )
    return predict(docs, train(training)).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
