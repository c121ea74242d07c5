"""Periodic runs of words: a harmonic grid of LCE queries on suffix arrays.

A stretch of period p and at least 3 p words holds three neighbouring multiples of p, so for each period p and each j the
pair jp, (j+1)p is asked how far the texts from there agree forwards and backwards (their longest common
extensions), which gives the whole run at once. Pairs whose first words differ, or differ a period later, have no such run and are
settled by that comparison; for the others the extension is a range minimum over the common prefixes of
neighbours in a suffix array, forwards in that of the words and backwards in that of the reversed words. All texts of a
strip share their arrays: a position's rank begins with its document, so that no match crosses documents.

Runs of multiples of a period have the same ends; the least period is kept. Work is n ln n words a text, memory is bounded
by a strip of texts (or one text, if longer) and by GRID pairs at once. Nothing is shuffled.

Defined results: a null or empty text, or one of white space, has no words, no runs, and digests of the empty string. A row without
an id is never rewritten. Repeated rows each get a row; an empty table gives no rows; other columns are not looked at. Of runs with
equal exponents the one of least start, then of least period, is reported.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import table, texts

#: The shortest run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of text and pairs of the grid handled at once.
STRIP, GRID = 1 << 22, 1 << 20

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def byte_strips(texts_: pa.Array) -> Iterator[slice]:
    """Slices of texts of about STRIP bytes; a longer text is alone."""
    total = np.cumsum(pc.binary_length(texts_).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts_) else np.zeros(0, np.int64)
    a = 0
    while a < len(texts_):
        before = total[a - 1] if a else 0
        b = max(int(np.searchsorted(total, before + STRIP, "right")), a + 1)
        yield slice(a, b)
        a = b


def split_words(texts_: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in turn, and where each text's words begin (one more than texts)."""
    trimmed = pc.ascii_trim_whitespace(texts_)
    lists = pc.ascii_split_whitespace(trimmed)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) > 0
    words = lists.flatten()
    if not some.all():
        words = words.filter(pa.array(np.repeat(some, n)))
        n = np.where(some, n, 0)
    return words, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def rewritten(ids: list[int | None], begin: np.ndarray) -> np.ndarray:
    """Which word stands at each place: in a tenth of the documents a stretch is repeated from some word on."""
    source = np.arange(begin[-1])
    for i, doc_id in enumerate(ids):
        n = int(begin[i + 1] - begin[i])
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[begin[i] + a : begin[i + 1]] = begin[i] + a + np.arange(n - a) % p
    return source


class Extensions:
    """Longest common extensions to the right of positions of one document, for many documents at once.

    codes: a number for each word; ends: for each position the end of its document."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        n = len(codes)
        key = doc * (int(codes.max()) + 1) + codes
        order = np.argsort(key, kind="stable")
        first = np.ones(n, bool)
        first[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, split, step = [rank.copy()], np.where(first, 0, -1), 1
        while True:
            # places of equal ranks are told apart by the rank a step further; those told apart keep their place
            slots = np.nonzero(~(first & np.append(first[1:], True)))[0]
            if not len(slots):
                break
            at = order[slots]
            beyond = at + step
            after = np.where(beyond < ends[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
            key = rank[at] * (n + 1) + after
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[slots] = at
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            fresh = slots[new & ~first[slots]]
            split[fresh] = len(levels)
            first[fresh] = True
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            levels.append(rank.copy())
            step *= 2
        self.rank = rank
        self.minima = self.range_minima(self.common(order, levels, split, ends), ends)

    @staticmethod
    def common(order: np.ndarray, levels: list[np.ndarray], split: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with the one before it in order. Those told apart at level k share at least half of 2^k."""
        lcp = np.zeros(len(order), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            at = np.nonzero(split > k)[0]
            a, b = order[at - 1], order[at]
            x, y = a + lcp[at], b + lcp[at]
            inside = (x < ends[a]) & (y < ends[b])
            last = len(order) - 1
            equal = inside & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])
            lcp[at[equal]] += 1 << k
        return lcp

    @staticmethod
    def range_minima(lcp: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Minima over 2^k neighbours, up to the longest document."""
        longest = int(np.bincount(ends).max())
        table = [lcp.astype(np.int32)]
        while 2 << (len(table) - 1) <= longest:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For positions a <> b of the same document: how many words from there on are equal."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.minima[k][low[own]], self.minima[k][high[own] - (1 << int(k))])
        return out


def grid(codes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p): pairs i, i + p of the grid whose words are equal, and equal again at i + 2 p."""
    n = np.diff(begin)
    periods = np.where(n >= LEAST_WORDS, n // LEAST_PERIODS, 0)
    doc = np.repeat(np.arange(len(n)), periods)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (n[doc] - 1) // p - 1
    total = np.cumsum(count)
    a = 0
    while a < len(p):
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + GRID, "right")), a + 1)
        c = count[a:b]
        step = np.repeat(p[a:b], c)
        j = np.arange(len(step)) - np.repeat(np.cumsum(c) - c, c)
        i = np.repeat(begin[doc[a:b]], c) + j * step
        equal = codes[i] == codes[i + step]
        i, step = i[equal], step[equal]
        equal = codes[i + step] == codes[i + 2 * step]
        yield i[equal], step[equal]
        a = b


def runs_of(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of start, end, period: all runs of all texts, by start, then period."""
    asked = list(grid(codes, begin))
    i, p = (np.concatenate(x) for x in zip(*asked)) if asked else (np.zeros(0, np.int64),) * 2
    if not len(i):
        return np.zeros((0, 3), np.int64)
    # only texts with a pair to ask get suffix arrays; they are laid one behind the other
    owner = np.searchsorted(begin, i, "right") - 1
    used = np.unique(owner)
    n = np.diff(begin)[used]
    own_begin = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(begin[used] - own_begin[:-1], n) + np.arange(own_begin[-1])
    shift = own_begin[np.searchsorted(used, owner)] - begin[owner]
    own, doc, ends = codes[place], np.repeat(np.arange(len(used)), n), np.repeat(own_begin[1:], n)
    forward = Extensions(own, doc, ends)
    size = len(own)
    backward = Extensions(own[::-1], doc[::-1].max() - doc[::-1], size - np.repeat(own_begin[:-1], n)[::-1])
    found = []
    for a in range(0, len(i), GRID):
        x, q, off = i[a : a + GRID] + shift[a : a + GRID], p[a : a + GRID], shift[a : a + GRID]
        ahead = forward(x, x + q)
        behind = np.zeros(len(x), np.int64)
        inner = x > own_begin[doc[x]]
        behind[inner] = backward(size - x[inner], size - x[inner] - q[inner])
        start, end = x - behind, x + q + ahead
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        rows = np.stack([start[long] - off[long], end[long] - off[long], q[long]], axis=1)
        found.append(np.unique(rows, axis=0))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), bool)
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """start, length, period of the run with the greatest exact exponent."""
    length = runs[:, 1] - runs[:, 0]
    near = length / runs[:, 2]
    top = np.nonzero(near >= near.max() * (1 - 1e-12))[0]
    best = min(top, key=lambda k: (-Fraction(int(length[k]), int(runs[k, 2])), runs[k, 0], runs[k, 2]))
    return int(runs[best, 0]), int(length[best]), int(runs[best, 2])


def judged(ids: list[int | None], texts_: pa.Array) -> dict[str, list]:
    """The result columns of a strip of texts."""
    words, begin = split_words(texts_)
    source = rewritten(ids, begin)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[source]
    runs = runs_of(codes, begin)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    left = words.take(pa.array(source[kept]))
    offsets = np.concatenate([[0], np.cumsum(kept)])[begin]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left), " ").cast(pa.binary())
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    bounds = np.searchsorted(runs[:, 0], begin)
    for k, doc_id in enumerate(ids):
        own = runs[bounds[k] : bounds[k + 1]] - np.array([begin[k], begin[k], 0])
        start, length, period = strongest(own) if len(own) else (None, None, None)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in own.tolist())
        row = (doc_id, len(own), start, length, period, 1000 * length // period if len(own) else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed[k].as_buffer()).hexdigest())
        for values, v in zip(out.values(), row):
            values.append(v)
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (x.split() for x in SCHEMA.split(", "))])
        for b in batches:
            for s in byte_strips(b.column("text")):
                own = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_pydict(judged(own.column("doc_id").to_pylist(), own.column("text")), schema=kinds)

    return texts(docs).mapInArrow(run, SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
