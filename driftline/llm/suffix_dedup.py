"""Removal of repeated byte strings by distributed, sparse prefix doubling.

A position's rank is the 64-bit name of the string that starts there. Names are doubled inside each task: from
1 byte to 2, 4, 8, 16 and then HALF bytes, as name(i, 2k) = name(i, k) * B^k + name(i + k, k). Ranking every
position by Spark would shuffle many times the input, so that only anchors are ranked there: in each
window of WINDOW bytes the ANCHOR-byte string with the least mixed name (the leftmost on ties). Equal windows have
their anchor at the same place, so that no repeat is lost. Windows that share an anchor make one segment.

Round 1: Spark sorts (anchor rank, segment rank, document); anchors of one document are unique and drop out. A
segment that an earlier document holds too is removed whole. Where one anchor has several segments,
round 2 ranks each window of the earliest holders at offset HALF: Spark ranks the pairs (name(s), name(s + HALF)),
which is the threshold, and a window is removed where an earlier document has the pair.
Within a task, segments that an earlier document of the same strip of text holds are decided before any shuffle, so
that a frequent passage costs one row for each strip, not for each document.
Both rounds go over the texts PARTS times and rank one part of the names each time, so that the shuffle files of one
part are gone before the next is dealt out.

Names are 64-bit, pairs 96-bit fingerprints (of the second name 32 bits go into the pair). Defined results: a null or empty text has no bytes and the SHA-256
of nothing. Rows without an id neither remove nor lose anything. Rows that repeat a doc_id neither
remove bytes of each other; where their texts differ, rows get numbers of their own, by which positions are told apart. An
empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import fresh, stored, table, texts

WINDOW = 50
HALF = WINDOW // 2
#: Length of an anchor: shorter ones are rarer (two of WINDOW - ANCHOR + 2 positions) but less often unique.
ANCHOR = 20
#: Bytes whose names are computed at once, and bytes whose segments are compared within a task.
CHUNK, STRIP = 1 << 18, 1 << 23
#: Parts of the names that are ranked one after the other.
PARTS = 2
BASE = np.uint64(0x9E3779B97F4A7C15)
LETTER = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def names(data: np.ndarray, length: int = HALF) -> np.ndarray:
    """The name of the bytes of a length at each position, by doubling."""
    size, name = 1, LETTER[data]
    parts, left = [], length
    while left:
        if left & size:
            parts.append((size, name))
            left -= size
        if left:
            name = name[:-size] * power(size) + name[size:]
            size *= 2
    n, at, out = max(0, len(data) - length + 1), 0, np.uint64(0)
    for size, name in reversed(parts):
        at += size
        out = out + name[at - size : at - size + n] * power(length - at)
    return out


def in_part(name: np.ndarray, part: int, parts: int) -> np.ndarray:
    return (name >> np.uint64(40)) % np.uint64(parts) == part


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """first window, windows, anchor's place, anchor rank and segment rank of each segment.

    data: bytes of several texts; ends: where they end. No window crosses an end."""
    none = np.zeros(0, np.int64)
    n = len(data) - WINDOW + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    name, short = names(data), names(data, ANCHOR)
    low = (mixed(short) & ~np.uint64(0xFFFFFF)) | np.arange(len(short), dtype=np.uint64)
    width, step = WINDOW - ANCHOR + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:n], low[width - step : width - step + n])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = np.ones(n + 1, bool)
    for shift in range(1, WINDOW):
        at = ends - shift
        whole[at[(at >= 0) & (at < n)]] = False
    whole[n] = False
    new = whole[:n] & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[: n - 1]])
    start = np.nonzero(new)[0]
    stop = np.nonzero(whole[:n] & (np.concatenate([new[1:], [True]]) | ~whole[1:]))[0]
    p, count = anchor[start], stop - start + 1
    # a segment has up to 2 * WINDOW - ANCHOR bytes: four names of HALF bytes leave none out
    between, last = name[start + HALF + np.minimum(count - 1, HALF)], name[stop + HALF]
    segment = mixed(mixed(mixed(mixed(name[start]) + name[start + HALF]) + between) + last) + (count.astype(np.uint64) << np.uint64(32)) + (p - start).astype(np.uint64)
    return start, count, p, mixed(short[p] + BASE), mixed(segment)


def pieces(begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, from, to): runs of whole texts of about CHUNK bytes, and parts of long ones."""
    i, n = 0, len(begin) - 1
    while i < n:
        if begin[i + 1] - begin[i] > 2 * CHUNK:
            for a in range(int(begin[i]), int(begin[i + 1]) - WINDOW + 1, CHUNK):
                yield i, i, a, min(a + CHUNK + WINDOW - 1, int(begin[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + CHUNK, "right")) - 1)
        while j > i + 1 and begin[j] - begin[j - 1] > 2 * CHUNK:
            j -= 1
        yield i, j - 1, int(begin[i]), int(begin[j])
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and where each text begins (one more at the end)."""
    column = column.cast(pa.large_string())
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, begin


def strips(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(begin) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + STRIP, "right")) - 1)
        yield i, j
        i = j


#: place: first window (24 bits and more), number of windows (7 bits), settled (1 bit), as one number for a smaller shuffle.
ROW = pa.schema([("rank", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
#: The number of a row, where doc_id does not tell rows apart.
NUMBER = pa.field("row", pa.int64())


def anchor_rows(batches: Iterator[pa.RecordBatch], part: int, of: int) -> Iterator[pa.RecordBatch]:
    """A row for each segment of one part of the anchor ranks; settled: an earlier document of the same strip holds it, and its rank is of no more use."""
    for batch in batches:
        data, begin = text_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        numbers = batch.column("row").to_numpy() if "row" in batch.schema.names else None
        for a, b in strips(begin):
            parts = []
            for i, j, lo, hi in pieces(begin[a : b + 1]):
                start, count, _, rank, segment = segments(data[lo:hi], begin[a + i + 1 : a + j + 2] - lo)
                own = in_part(rank, part, of)
                start, count, rank, segment = start[own], count[own], rank[own], segment[own]
                text = a + np.searchsorted(begin[a : b + 1], start + lo, "right") - 1
                parts.append((rank, segment, ids[text], start + lo - begin[text], count, text))
            rank, segment, doc, first, count, text = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((doc, segment, rank))
            rank, segment, doc, first, count, text = (x[order] for x in (rank, segment, doc, first, count, text))
            new = np.ones(len(rank), bool)
            new[1:] = (rank[1:] != rank[:-1]) | (segment[1:] != segment[:-1])
            settled = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            rank = np.where(settled, mixed(segment + doc.astype(np.uint64) * BASE + first.astype(np.uint64)), rank)
            back = np.argsort(order, kind="stable")
            columns = [rank.view(np.int64), segment.view(np.int64), doc, first.astype(np.int64) << 8 | count << 1 | settled]
            columns += [] if numbers is None else [numbers[text]]
            yield pa.RecordBatch.from_arrays([pa.array(x[back]) for x in columns], schema=ROW if numbers is None else ROW.append(NUMBER))


PAIR = pa.schema([("left", pa.int64()), ("right", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int32())])


def pair_rows(batches: Iterator[pa.RecordBatch], part: int, of: int) -> Iterator[pa.RecordBatch]:
    """The rank pair of each window of the open segments of each text, of one part of the left names."""
    for batch in batches:
        numbered = "row" in batch.schema.names
        out: list[list] = [[], [], [], [], []]
        for i, (text, doc, first, count) in enumerate(zip(*(batch.column(c) for c in ("text", "doc_id", "firsts", "counts")))):
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            first, count = first.values.to_numpy().astype(np.int64), count.values.to_numpy().astype(np.int64)
            at = np.unique(np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum()))
            row = batch.column("row")[i].as_py() if numbered else 0
            for lo in range(0, len(data), CHUNK):
                own = at[(at >= lo) & (at < lo + CHUNK)]
                if len(own):
                    name = names(data[lo : lo + CHUNK + WINDOW])
                    own = own[in_part(name[own - lo], part, of)]
                    for column, x in zip(out, (name[own - lo], (mixed(name[own - lo + HALF]) >> np.uint64(32)).astype(np.uint32), np.full(len(own), doc.as_py()), own, np.full(len(own), row))):
                        column.append(x)
        if out[0]:
            left, right, doc, first, row = (np.concatenate(x) for x in out)
            columns = [left.view(np.int64), right.view(np.int32), doc, first.astype(np.int32), *([row] if numbered else [])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=PAIR.append(NUMBER) if numbered else PAIR)


def repeats(docs: DataFrame) -> DataFrame:
    """Bytes to remove, as intervals first, last that may overlap, of each row. docs: doc_id and text, none null, and `row`
    where doc_id alone does not tell rows apart; so do the intervals."""
    key, more = ("row", ", row long") if "row" in docs.columns else ("doc_id", "")
    judged = [stored(judged_segments(docs, key, more, part, PARTS), "segments") for part in range(PARTS)]
    judged = reduce(DataFrame.unionByName, judged)
    whole = judged.filter("repeated").select(key, "first", (F.col("first") + F.col("windows") + F.lit(WINDOW - 1)).alias("last"))
    still = judged.filter("not repeated").groupBy(key).agg(F.collect_list("first").alias("firsts"), F.collect_list("windows").alias("counts"))
    opened = docs.join(still.hint("shuffle_hash"), key).select("text", *dict.fromkeys(["doc_id", key]), "firsts", "counts")
    return reduce(DataFrame.unionByName, [whole, *(stored(repeated_windows(opened, key, more, part, PARTS), "windows") for part in range(PARTS))])


def judged_segments(docs: DataFrame, key: str, more: str, part: int, parts: int) -> DataFrame:
    """Round 1 on one part of the anchor ranks: the segments that are repeated as a whole, and those whose windows have to be ranked."""
    by_rank, by_segment = Window.partitionBy("rank"), Window.partitionBy("rank", "segment")
    return (
        docs.mapInArrow(lambda batches: anchor_rows(batches, part, parts), "rank long, segment long, doc_id long, place long" + more)
        .repartition("rank")
        .sortWithinPartitions("rank", "segment", "doc_id")
        .withColumn("several", F.min("doc_id").over(by_rank) != F.max("doc_id").over(by_rank))
        .withColumn("mixed", F.min("segment").over(by_rank) != F.max("segment").over(by_rank))
        .withColumn("owner", F.min("doc_id").over(by_segment))
        .withColumn("settled", F.col("place").bitwiseAND(1) == 1)
        .filter("settled or several and (doc_id > owner or mixed)")
        .withColumn("first", F.shiftright("place", 8).cast("int"))
        .withColumn("windows", F.shiftright("place", 1).bitwiseAND(127).cast("int"))
        .select(key, "first", "windows", (F.col("settled") | (F.col("doc_id") > F.col("owner"))).alias("repeated"))
    )


def repeated_windows(opened: DataFrame, key: str, more: str, part: int, parts: int) -> DataFrame:
    """Round 2 on one part of the windows' left names: the windows that an earlier document holds too."""
    pairs = opened.mapInArrow(lambda batches: pair_rows(batches, part, parts), "left long, right int, doc_id long, first int" + more)
    earliest = F.min("doc_id").over(Window.partitionBy("left", "right"))
    return pairs.withColumn("owner", earliest).filter("doc_id > owner").select(key, "first", (F.col("first") + WINDOW).alias("last"))


def cut(text: str, firsts, lasts) -> tuple[bytes, int, int]:
    """The bytes of text outside the intervals, how many are inside, and in how many runs."""
    data = text.encode()
    if firsts is None or not len(firsts):
        return data, 0, 0
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, np.asarray(firsts), 1)
    np.add.at(step, np.asarray(lasts), -1)
    gone = np.cumsum(step)[:-1] > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def with_repeats(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, the begins and ends of the intervals to remove (null: none), and their names."""
    plain = texts(docs).filter(F.col("doc_id").isNotNull())
    key, firsts, lasts = (fresh(docs, c) for c in ("repeats_key", "firsts", "lasts"))
    h = F.xxhash64("text")
    if plain.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").limit(1).count():
        docs = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")  # a number once written stays
        own = F.coalesce(F.col("text"), F.lit(""))
        plain = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("text"), F.col(key).alias("row"))
    else:
        docs = docs.withColumn(key, F.col("doc_id").cast("long"))
    found = repeats(plain)
    by = "row" if "row" in plain.columns else "doc_id"
    gathered = found.groupBy(F.col(by).alias(key)).agg(F.collect_list("first").alias(firsts), F.collect_list("last").alias(lasts))
    return docs.join(gathered.hint("shuffle_hash"), key, "left"), firsts, lasts


def removal_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""

    def run(batches):
        for b in batches:
            rows = [cut(t, f, z) for t, f, z in zip(b["text"], b["firsts"], b["lasts"])]
            b = b[["doc_id"]].assign(n_bytes=[len(t.encode()) for t in b["text"]], n_removed=[r[1] for r in rows], n_spans=[r[2] for r in rows])
            yield b.assign(kept_sha256=[hashlib.sha256(r[0]).hexdigest() for r in rows])

    joined = with_repeats(texts(docs))[0].select("doc_id", "text", "firsts", "lasts")
    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes; a character that loses some of its bytes goes. Same columns, same rows."""

    @F.pandas_udf("string")
    def kept(text, firsts, lasts):
        return text.combine(firsts, lambda t, f: (t, f)).combine(lasts, lambda x, z: None if x[0] is None else cut(x[0], x[1], z)[0].decode("utf-8", "ignore"))

    held, firsts, lasts = with_repeats(docs)
    whole = F.col(firsts).isNull()
    changed = held.withColumn("text", F.when(whole, F.col("text")).otherwise(kept("text", firsts, lasts)))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return changed.select(*docs.columns)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_table(table(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
