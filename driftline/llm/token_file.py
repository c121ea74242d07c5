"""Token-id files with an adaptive context-mixing range coder.

A chunk holds the ids of whole documents in turn, cut into blocks of BLOCK ids. Each block starts from the same
empty model and carries its number of ids, of bytes, and a CRC-32, so that it can be read, or found damaged, alone.
The blocks of a chunk are coded together, one numpy lane each.

The next id's distribution is a mixture  l2 [id = guess2] + l1 [id = guess1] + l0 P0(id).  guess2 and guess1 are the
ids last seen after the hashed last two ids and last id, with the number of times they have held since (3 at most);
P0 is the frequency of id classes (single ids below SINGLE, WIDTH ids beyond) among the ids that neither guess gave,
renewed every RENEW ids; it starts from a prior that falls with the id, as merges are numbered by frequency. The
weights l are the rates of the three outcomes under the state of both guesses. The model learns ROUND ids of every block at
once: the coder, which knows them, prepares a round with a few passes lane by lane, whose tables stay in the cache, and only
the range coder itself goes id by id. It has 64 bits, with carries into 32-bit words, and takes the mixture's choice and
then P0's interval: both together take at most 32 bits, so that one word at most moves after each id.

Chunks are rows of a Parquet dataset: part, chunk, doc_ids, doc_sizes and blocks, ordered by doc_id over parts.

Defined results: a null or empty text is the end id alone. Rows without an id come first. Rows that repeat an id are
ordered by a hash of their text, then their text, so that starts do not change between runs. An empty table gives no rows;
other columns are not looked at. A document is never split between chunks, so that one of n ids takes about 40 n bytes of
a task's memory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import table, texts, without_shuffle_files
from driftline.llm.packing import tokenizer_file
from driftline.llm.token_ids import encoder
from driftline.storage import shared_folder

BLOCK = 2048
#: Ids after which a chunk ends at the next document.
CHUNK = 1 << 23
SINGLE, WIDTH_BITS = 256, 8
WIDTH = 1 << WIDTH_BITS
CLASSES = SINGLE + ((1 << 16) - SINGLE) // WIDTH
#: Ids after which the model learns what it has coded, and P0 is renewed; lanes that learn together.
ROUND, RENEW, GROUP = 128, 512, 256
HASH_BITS = 10
MIX_BITS, FREQUENCY_BITS = 12, 12
SLOT_BITS = FREQUENCY_BITS + WIDTH_BITS
#: How many ids the prior of P0 counts for.
PRIOR = 200
END = 1
MAGIC = b"DLT3"

U = np.uint64
WORD, SHORT = U(32), U(1 << 32)
#: Classes are the ids themselves below SINGLE, then runs of WIDTH ids; SINGLE is a multiple of WIDTH.
CLASS_SHIFT = SINGLE - SINGLE // WIDTH
FIRST_OF = np.concatenate([np.arange(SINGLE), SINGLE + WIDTH * np.arange(CLASSES - SINGLE)]).astype(np.int32)
FALLING = np.log1p(np.where(np.arange(CLASSES) < SINGLE, 1, WIDTH) / (FIRST_OF + 512.0))
FALLING = (FALLING / FALLING.sum()).astype(np.float32)
#: States of the guesses: whether they are the same id, and confidence of both (4 times 4).
STATES = 32
CHOICES = 1 << MIX_BITS
#: A share of P0 is kept as start << SIZE_AT | size.
SIZE_AT, SIZE_MASK = FREQUENCY_BITS + 1, (2 << FREQUENCY_BITS) - 1


def fresh_outcomes() -> np.ndarray:
    """What the outcomes (guess2, guess1, neither) of each state count at the start of a block."""
    state = np.arange(STATES)
    return np.stack([1 + 2 * (state >> 2 & 3), 1 + (state & 3), np.full(STATES, 4)], axis=1)


class Lanes:
    """The model of n blocks. It learns ROUND ids of every block at once; in between it is only read."""

    def __init__(self, n: int, with_slots: bool):
        self.n, self.with_slots = n, with_slots
        lane = np.arange(n)
        self.row1, self.row2 = lane << HASH_BITS, lane << HASH_BITS + 1
        self.guess1, self.guess2 = np.zeros(n << HASH_BITS, np.int32), np.zeros(n << HASH_BITS + 1, np.int32)
        self.state_row, self.class_row, self.slot_row = lane * (4 * STATES), lane * CLASSES, lane << FREQUENCY_BITS
        self.outcomes = np.zeros((n, STATES, 4), np.int32)
        self.outcomes[:, :, :3] = fresh_outcomes()
        self.edges = np.zeros((n, STATES, 4), np.uint16)
        self.edges[:, :, 3] = CHOICES
        self.flat_edges = self.edges.reshape(-1)
        self.count = np.zeros((n, CLASSES), np.int32)
        self.spans = np.zeros(n * CLASSES, np.int32)
        self.slots = np.zeros((n, 1 << FREQUENCY_BITS) if with_slots else (0, 0), np.uint16)
        self.flat_slots = self.slots.reshape(-1)
        # the last id and the one before it, of each lane
        self.last = np.zeros((n, 2), np.int32)

    def groups(self) -> Iterator[slice]:
        return (slice(a, min(a + GROUP, self.n)) for a in range(0, self.n, GROUP))

    def renew(self, own: slice, seen: int) -> None:
        """Renews the tables that are due after seen ids."""
        c = self.outcomes[own]
        scale = np.float32(CHOICES - 3) / c.sum(axis=2, dtype=np.int32).astype(np.float32)
        first = 1 + (c[:, :, 0] * scale).astype(np.int32)
        self.edges[own, :, 1] = first
        self.edges[own, :, 2] = first + 1 + (c[:, :, 1] * scale).astype(np.int32)
        if seen % RENEW == 0:
            count = self.count[own]
            share = np.float32((1 << FREQUENCY_BITS) - CLASSES - 1) / (count.sum(axis=1, keepdims=True, dtype=np.int32) + PRIOR).astype(np.float32)
            f = ((count + FALLING * np.float32(PRIOR)) * share).astype(np.int32)
            f += 1
            f[:, CLASSES - 1] += (1 << FREQUENCY_BITS) - f.sum(axis=1, dtype=np.int32)
            start = np.cumsum(f, axis=1, dtype=np.int32)
            start -= f
            self.spans.reshape(self.n, CLASSES)[own] = start << SIZE_AT | f
            if self.with_slots:
                self.slots[own] = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint16), len(f)), f.reshape(-1)).reshape(len(f), -1)

    def guess(self, last: np.ndarray, before: np.ndarray, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Places of the guesses, the guesses (4 times the id, and confidence), and where the edges of their state are."""
        row1, row2, state_row = rows
        one = last * 40503
        at1 = row1 + (one >> 3 & (1 << HASH_BITS) - 1)
        one += before * 30011
        at2 = row2 + (one >> 3 & (2 << HASH_BITS) - 1)
        packed1, packed2 = self.guess1.take(at1), self.guess2.take(at2)
        state = (packed2 & 3) << 4
        state += (packed1 & 3) << 2
        state += ((packed1 ^ packed2) < 4).view(np.int8) * np.int8(64)
        return at1, at2, packed1, packed2, state_row + state

    def rows(self) -> tuple[np.ndarray, ...]:
        return self.row1, self.row2, self.state_row

    def learn(self, own: slice, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Learns a round of the lanes of own; returns where its outcomes and classes are, whether no guess held, and single ids."""
        known = np.concatenate([self.last[own], ids], axis=1)
        self.last[own] = known[:, -2:]
        at1, at2, packed1, packed2, state = self.guess(known[:, 1:-1], known[:, :-2], tuple(x[own, None] for x in self.rows()))
        packed = ids << 2
        hit1, hit2 = (packed1 ^ packed) < 4, (packed2 ^ packed) < 4
        outcome = (np.int8(2) - hit1.view(np.int8)) * (~hit2).view(np.int8)
        missed = outcome == 2
        for table, at, old, hit in ((self.guess1, at1, packed1, hit1), (self.guess2, at2, packed2, hit2)):
            sure = old & 3
            sure += sure < 3
            sure *= hit
            sure += packed
            table[at] = sure  # of equal places the last one stays
        outcome_at = state + outcome
        single = ids < SINGLE
        class_at = self.class_row[own, None] + np.where(single, ids, (ids >> WIDTH_BITS) + CLASS_SHIFT)
        low, n = own.start, len(ids)
        self.outcomes[own] += np.bincount((outcome_at - low * 4 * STATES).reshape(-1), minlength=n * 4 * STATES).reshape(n, STATES, 4)
        self.count[own] += np.bincount((class_at - low * CLASSES)[missed], minlength=n * CLASSES).reshape(n, CLASSES)
        return outcome_at, class_at, missed, single


def encode_blocks(ids: np.ndarray) -> bytes:
    """All ids in blocks, each with its header."""
    n, steps = max(1, -(-len(ids) // BLOCK)), min(BLOCK, len(ids))
    rows = np.zeros((n, BLOCK), np.int32)
    rows.reshape(-1)[: len(ids)] = ids
    model = Lanes(n, False)
    low, width = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
    out, used = np.zeros(n * (steps + 4), np.uint32), np.arange(n) * (steps + 4)
    begin = used.copy()
    for t in range(0, steps, ROUND):
        k = min(ROUND, steps - t)
        edge, choice, start, size = (np.zeros((k, n), d) for d in (np.uint16, np.uint16, np.uint32, np.uint32))
        for own in model.groups():
            model.renew(own, t)
            mine = rows[own, t : t + k]
            outcome_at, class_at, missed, single = model.learn(own, mine)
            e = model.flat_edges.take(outcome_at)
            edge[:, own], choice[:, own] = e.T, (model.flat_edges.take(outcome_at + 1) - e).T
            span = model.spans.take(class_at)
            f, a = span & SIZE_MASK, span >> SIZE_AT << WIDTH_BITS
            a += (mine & WIDTH - 1) * ~single * f
            # where a guess holds, P0's interval is the whole one
            start[:, own] = (a * missed).T
            size[:, own] = np.where(missed, f << single.view(np.int8) * np.int32(WIDTH_BITS), 1 << SLOT_BITS).T
        for i in range(k):
            width >>= U(MIX_BITS)
            add = width * edge[i]
            width *= choice[i]
            width >>= U(SLOT_BITS)
            add += width * start[i]
            width *= size[i]
            low += add
            carried = np.nonzero(low < add)[0]
            if carried.size:
                carried = used.take(carried) - 1
                while carried.size:
                    out[carried] += 1
                    carried = carried[out[carried] == 0] - 1
            full = width < SHORT
            out[used] = low >> WORD
            used += full
            shift = full.astype(U) << U(5)
            low <<= shift
            width <<= shift
    for _ in range(2):
        out[used] = low >> WORD
        low <<= WORD
        used += 1
    parts = []
    for i, (a, b) in enumerate(zip(begin.tolist(), used.tolist())):
        own, body = ids[i * BLOCK : (i + 1) * BLOCK].astype("<u2").tobytes(), out[a:b].astype("<u4").tobytes()
        parts += [MAGIC, np.array([len(own) // 2, len(body), zlib.crc32(own), zlib.crc32(body)], "<u4").tobytes(), body]
    return b"".join(parts)


def opened(data: bytes) -> tuple[list[np.ndarray], list[int], list[int]]:
    """The words, number of ids and their checksum of each block; raises ValueError where a block is damaged."""
    bodies, sizes, sums, at = [], [], [], 0
    while at < len(data):
        size, length, crc, body_crc = np.frombuffer(data, "<u4", 4, at + 4).tolist()
        body = data[at + 20 : at + 20 + length]
        if data[at : at + 4] != MAGIC or zlib.crc32(body) != body_crc:
            raise ValueError(f"damaged block at byte {at}")
        bodies.append(np.frombuffer(body, "<u4"))
        sizes.append(size)
        sums.append(crc)
        at += 20 + length
    return bodies, sizes, sums


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of all blocks that were coded together; raises ValueError where a checksum does not hold."""
    bodies, sizes, sums = opened(data)
    n, steps = len(bodies), max(sizes, default=0)
    if not n:
        return np.zeros(0, np.uint16)
    cap = max(map(len, bodies)) + 3  # a lane that is through reads on, without use
    words = np.zeros((n, cap), np.uint32)
    for i, b in enumerate(bodies):
        words[i, : len(b)] = b
    words, used = words.reshape(-1), np.arange(n) * cap + 2
    code = words[used - 2].astype(U) << WORD | words[used - 1].astype(U)
    model, width = Lanes(n, True), np.full(n, (1 << 64) - 1, U)
    out = np.zeros((max(steps, 1), n), np.uint16)
    last, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(steps):
        if t % ROUND == 0:
            for own in model.groups():
                if t:
                    model.learn(own, np.ascontiguousarray(out[t - ROUND : t, own].T).astype(np.int32))
                model.renew(own, t)
        _, _, packed1, packed2, state = model.guess(last, before, model.rows())
        width >>= U(MIX_BITS)
        slot = code // width
        outcome_at = state + 1
        missed = slot >= model.flat_edges.take(outcome_at + 1)
        outcome_at -= slot < model.flat_edges.take(outcome_at)
        outcome_at += missed
        edge = model.flat_edges.take(outcome_at)
        code -= width * edge
        width *= model.flat_edges.take(outcome_at + 1) - edge
        width >>= U(SLOT_BITS)
        mine = np.where(outcome_at == state, packed2, packed1) >> 2
        # where a guess holds, the slot may be past P0's last one; it is not used
        slot = np.minimum(code // width, U((1 << SLOT_BITS) - 1)).astype(np.int64)
        found = model.flat_slots.take(model.slot_row + (slot >> WIDTH_BITS)).astype(np.int32)
        span = model.spans.take(model.class_row + found)
        f, a = span & SIZE_MASK, span >> SIZE_AT << WIDTH_BITS
        single = found < SINGLE
        inside = ((slot - a).astype(np.float32) / f).astype(np.int32)
        inside *= ~single
        np.copyto(mine, FIRST_OF.take(found) + inside, where=missed)
        a += inside * f
        a *= missed
        code -= width * a.astype(U)
        width *= np.where(missed, f << single.view(np.int8) * np.int32(WIDTH_BITS), 1 << SLOT_BITS).astype(U)
        short = width < SHORT
        shift = short.astype(U) << U(5)
        code <<= shift
        code |= words.take(used) * short
        used += short
        width <<= shift
        out[t] = mine
        before, last = last, mine.astype(np.int64)
    found = [own[:size].astype("<u2") for own, size in zip(np.ascontiguousarray(out.T), sizes)]
    for own, crc in zip(found, sums):
        if zlib.crc32(own.tobytes()) != crc:
            raise ValueError("a block's ids do not match its checksum")
    return np.concatenate(found)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Encodes every text, adds the end id, and writes the chunks in ascending doc_id order."""
    path, spark = path or tokenizer_file(), docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        own, ids, part, chunk = [], [], None, 0

        def row() -> pd.DataFrame:
            data = encode_blocks(np.concatenate(ids))
            return pd.DataFrame({"part": [part], "chunk": [chunk], "doc_ids": [own], "doc_sizes": [[len(x) for x in ids]], "blocks": [data]})

        n = 0
        for b in batches:
            part = int(b["part"].iloc[0]) if len(b) else part
            for doc_id, found in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), encode.each(list(b["text"]))):
                own.append(None if doc_id is None else int(doc_id))
                ids.append(np.append(found, np.uint16(end)))
                n += len(found) + 1
                if n >= CHUNK:
                    yield row()
                    own, ids, n, chunk = [], [], 0, chunk + 1
        if own:
            yield row()

    keyed = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    rows = ordered.mapInPandas(run, "part int, chunk int, doc_ids array<long>, doc_sizes array<long>, blocks binary")
    with without_shuffle_files(spark):
        rows.write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ids) of each document in the files."""
    files = spark.read.parquet(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, chunk, doc_ids, sizes, data in b[["part", "chunk", "doc_ids", "doc_sizes", "blocks"]].itertuples(index=False):
                ids = decode_blocks(data)
                at = np.concatenate([[0], np.cumsum(sizes)])
                own = [ids[x:y].astype("<u4") for x, y in zip(at, at[1:])]
                out = {"part": part, "chunk": chunk, "doc_id": pd.array(doc_ids, "Int64"), "inside": at[:-1], "n_tokens": np.asarray(sizes), "ids_crc32": [zlib.crc32(x.tobytes()) for x in own]}
                yield pd.DataFrame(out | ({"ids": [x.astype(np.int32) for x in own]} if with_ids else {}))

    schema = "part int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = files.mapInPandas(run, schema)
    size = F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    chunks = files.select("part", "chunk", size.alias("n"))
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")
    starts = chunks.select("part", "chunk", within.alias("before_chunk")).join(before, "part")
    start = (F.col("before_part") + F.col("before_chunk") + F.col("inside")).alias("start")
    return docs.join(starts, ["part", "chunk"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder)


QUERIES = {"op7_token_file": op7_token_file}
