"""Packing by best-fit decreasing.

A document's ids (with an end id) are cut into full windows and a rest. Pieces are dealt by hash into shards of
about SHARD pieces, each packed on its own: in decreasing length, a piece goes to the open window with the least
remaining capacity that holds it, found by a segment tree over remaining capacities, or opens a new one. Shards
are bounded, so that no task grows with the input; what is lost is at most one nearly empty window a shard.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each. An empty table gives
no rows. A sequence is filled without gaps from offset 0; padding behind it is not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import fresh, stored, table, texts
from driftline.llm.token_ids import WordEncoder, encoder

WINDOW = 4096
SHARD = 50_000
#: Characters encoded at once: what a worker holds for them is some 15 times as much.
STRIP = 1 << 21
END = 2


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities holds the number of windows below."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.tree, self.windows = [0] * (2 * self.half), [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, window: int) -> None:
        self.windows[remaining].append(window)
        self.change(remaining, 1)

    def change(self, remaining: int, by: int) -> None:
        i, tree = remaining + self.half, self.tree
        while i:
            tree[i] += by
            i >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least size that a window has, or -1."""
        i, tree = size + self.half, self.tree
        if tree[i]:
            return size
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.half:
                    i *= 2
                    i += not tree[i]
                return i - self.half
            i >>= 1
        return -1

    def take(self, remaining: int) -> int:
        self.change(remaining, -1)
        return self.windows[remaining].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece; lengths from 1 to capacity."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, n = OpenWindows(capacity), 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        left = opened.tightest(size)
        if left < 0:
            left, at, n = capacity, n, n + 1
        else:
            at = opened.take(left)
        window[i], offset[i] = at, capacity - left
        if left > size:
            opened.add(left - size, at)
    return window, offset


def pack(pieces: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """pieces (doc_id, start, length and any others; stored, as they are read twice) with sequence_id and offset."""
    shards = max(1, -(-pieces.count() // shard))
    columns = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pieces.dtypes), "sequence_id long", "offset long"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "length"], na_position="first", kind="stable")
        at, offset = best_fit_decreasing(rows["length"].to_numpy(dtype=np.int64), window)
        return rows.assign(sequence_id=(int(key[0]) << 40) + at, offset=offset)[columns]

    # a row's number salts the hash: repeated rows and rows without an id are dealt evenly too
    shard = fresh(pieces, "shard")
    dealt = F.pmod(F.xxhash64("doc_id", "start", "length", F.monotonically_increasing_id()), F.lit(shards))
    return pieces.withColumn(shard, dealt).groupBy(shard).applyInPandas(run, schema)


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens (and ids) of each piece of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        try:
            yield from of_texts(encode, batches)
        finally:
            encode.forget()  # the worker lives on, for tasks of other stages too

    def of_texts(encode: WordEncoder, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"], encode.each(list(b["text"]), STRIP)):
                ids = np.append(ids, np.uint16(end)).astype("<u4")
                for a in range(0, len(ids), window):
                    own = ids[a : a + window]
                    rows.append((doc_id, a, len(own), zlib.crc32(own.tobytes()), len(ids), *([own.astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return texts(docs).mapInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(stored(token_pieces(docs, path or tokenizer_file(), with_ids=with_ids), "pieces"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
