"""Near-duplicate components by SimHash fingerprints, linked through pigeonring filtering.

A fingerprint has a bit where more than half of the text's shingle hashes have it. Its 64 bits are SEGMENTS segments in a
ring. If two fingerprints differ in at most BUDGET bits, then from some segment on every chain of l segments round the
ring holds at most floor(l * BUDGET / SEGMENTS) of the differences: none in two segments, one in five, two in seven. So
the pair agrees in the chain's first two segments and in two of the next three, which makes 24 joining keys of 32 bits
(8 starts, 3 segments to leave out). Pairs that share a key are held against the budgets of the longer
chains, and what is left against the whole Hamming distance.

Equal fingerprints are one row before anything is joined, so groups of copies cost nothing. Within a key sorted rows are
compared in numpy, and only the links that join components leave a task, fewer than it has rows; no pair is emitted for
the sake of its group. A key of more than CELL fingerprints is split by one more segment (one of the other four must be
equal), and what is still too large into blocks, of which each two meet in a task of their own. Components come from label
propagation with pointer jumping.

Defined results: a text without words (null ones too) has fingerprint zero, linked like any other; fewer words than
SHINGLE are one shingle. Rows without an id get a fingerprint and the least id of their component, null if it has none.
Repeated rows each get a row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftline.llm.common import stored, table, texts
from driftline.llm.minhash_dedup import components
from driftline.llm.periodic_runs import byte_strips, split_words

SHINGLE, SEED = 3, 42
BUDGET, SEGMENTS, BITS = 3, 8, 8
#: Fingerprints of one key that a task compares; keys that may be broadcast.
CELL, BROADCAST = 8192, 100_000
#: Prints of most rows whose components are sent to every task (24 bytes each).
HOTTEST = 10_000
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def chain(start: int, length: int) -> int:
    """The bits of length segments from start on, round the ring."""
    return sum(((1 << BITS) - 1) << BITS * ((start + k) % SEGMENTS) for k in range(length))


#: What a chain of l segments may differ in, for l = 0 to SEGMENTS.
ALLOWED = [length * BUDGET // SEGMENTS for length in range(SEGMENTS + 1)]
EXACT = max(length for length in range(SEGMENTS + 1) if ALLOWED[length] == 0)
ONE = max(length for length in range(SEGMENTS + 1) if ALLOWED[length] == 1)
#: (start, bits that must be equal) of each joining key, then of each split of a key by a further segment.
KEYS = [(i, chain(i, ONE) & ~chain(i + j, 1)) for i in range(SEGMENTS) for j in range(EXACT, ONE)]
SPLITS = [(i, mask | chain(k, 1)) for i, mask in KEYS for k in range(SEGMENTS) if not mask & chain(k, 1)]
PER_KEY = len(SPLITS) // len(KEYS)


def fingerprints(texts_: pa.Array) -> np.ndarray:
    """One unsigned 64-bit number for each text."""
    words, begin = split_words(pc.ascii_lower(texts_))
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    spaced = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), words), " ").cast(pa.binary())
    out = np.zeros(len(texts_), np.uint64)
    for i in range(len(texts_)):
        own = size[begin[i] : begin[i + 1]]
        if not len(own):
            continue
        text, ends = spaced[i].as_py(), np.cumsum(own + 1) - 1
        a, b = (ends - own)[: max(len(own) - SHINGLE + 1, 1)], ends[min(SHINGLE, len(own)) - 1 :]
        hashes = np.fromiter((xxh64_intdigest(text[x:y], SEED) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
        held = np.zeros(64, np.int64)
        for k in range(0, len(hashes), COUNTED):
            bits = np.unpackbits(hashes[k : k + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            held += bits.sum(axis=0, dtype=np.uint32)
        out[i] = np.packbits(2 * held > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in byte_strips(b.column("text")):
                own = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(fingerprints(own.column("text")).view(np.int64))], ["doc_id", "print"])

    return texts(docs).mapInArrow(run, "doc_id long, print long")


def keyed(prints: DataFrame) -> DataFrame:
    """key (its number), value (the bits it takes) and print, one row for each joining key."""
    keys = [F.struct(F.lit(k).alias("key"), F.col("print").bitwiseAND(F.lit(as_long(mask))).alias("value")) for k, (_, mask) in enumerate(KEYS)]
    return prints.select("print", F.explode(F.array(*keys)).alias("x")).select("x.key", "x.value", "print")


def split_further(rows: DataFrame) -> DataFrame:
    """Each row under the splits of its key."""
    masks = F.array(*[F.lit(as_long(mask)) for _, mask in SPLITS])
    number = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PER_KEY - 1)), lambda k: F.col("key") * PER_KEY + k))
    rows = rows.select(number.alias("split"), "print")
    return rows.select((F.col("split") + len(KEYS)).alias("key"), F.col("print").bitwiseAND(F.element_at(masks, F.col("split") + 1)).alias("value"), "print")


def as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def crowded(rows: DataFrame) -> DataFrame:
    """key, value and n of what more than CELL rows share."""
    return stored(rows.groupBy("key", "value").agg(F.count("*").alias("n")).filter(F.col("n") > CELL), "crowded")


def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that fit a cell, and those of the others with their n (None where there are none)."""
    few = crowded(rows)
    count = few.count()
    if not count:
        return rows, None
    side = F.broadcast(few) if count <= BROADCAST else few
    return rows.join(side.drop("n"), ["key", "value"], "left_anti"), rows.join(side, ["key", "value"])


def cells(prints: DataFrame) -> DataFrame:
    """key, value, low, high, block, print: rows that are compared with those of equal key, value, low and high."""
    whole = [F.lit(0).cast("long").alias(c) for c in ("low", "high", "block")]
    fit, crowd = by_size(keyed(prints))
    out = fit.select("key", "value", *whole, "print")
    if crowd is None:
        return out
    fit, crowd = by_size(split_further(crowd))
    out = out.union(fit.select("key", "value", *whole, "print"))
    if crowd is None:
        return out
    blocks = crowd.withColumn("blocks", F.ceil(2 * F.col("n") / CELL)).withColumn("block", F.pmod(F.xxhash64("print"), "blocks"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return out.union(blocks.select("key", "value", F.least("block", "other"), F.greatest("block", "other"), "block", "print"))


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b; root[i] is the least member of i's."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root[:] = root[root]


def joining(group: np.ndarray, block: np.ndarray, across: np.ndarray, start: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Rows a, b: for each print that is linked within its group, another one of its component.

    group: ascending numbers; block, across: whether only pairs of two blocks count; start: of the key's chain."""
    budgets = [(length, np.array([chain(i, length) for i in range(SEGMENTS)], np.uint64)) for length in range(ONE + 1, SEGMENTS)]
    root, at, d = np.arange(len(group)), np.arange(len(group)), 0
    while True:
        d += 1
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        own = at[~across[at] | (block[at] != block[at + d])]
        differ = prints[own] ^ prints[own + d]
        for length, masks in budgets:
            near = np.bitwise_count(differ & masks[start[own]]) <= ALLOWED[length]
            own, differ = own[near], differ[near]
        own = own[np.bitwise_count(differ) <= BUDGET]
        if len(own):
            merged(root, own, own + d)
    linked = np.nonzero(root != np.arange(len(root)))[0]
    return np.stack([prints[linked], prints[root[linked]]], axis=1)


def links(prints: DataFrame) -> DataFrame:
    """a, b: enough linked fingerprints to join every component of the distinct ones in prints."""
    starts = np.array([i for i, _ in KEYS + SPLITS])
    parts = ["key", "value", "low", "high"]

    def judge(rows: pa.Table) -> pa.RecordBatch:
        key, value, low, high, block = (rows.column(c).to_numpy() for c in [*parts, "block"])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        found = joining(np.cumsum(new), block, low != high, starts[key], rows.column("print").to_numpy().view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            here = np.stack([b.column(c).to_numpy() for c in parts], axis=1)
            other = np.nonzero((here != here[-1]).any(axis=1))[0]
            cut = int(other[-1]) + 1 if len(other) else 0
            # the batch's last group may go on in the next one
            if held and (cut or any(held[-1].column(c)[-1].as_py() != here[-1, k] for k, c in enumerate(parts))):
                yield judge(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield judge(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield judge(pa.Table.from_batches(held))

    rows = cells(prints).repartition(*parts).sortWithinPartitions(*parts)
    return rows.mapInArrow(run, "a long, b long").distinct()


def with_component(own: DataFrame, named: DataFrame) -> DataFrame:
    """own's rows with the component_id of their print. named: print, component_id and n, the rows that hold the print.

    The HOTTEST prints are sent to every task and their rows stay where they are; no other print has more than a
    HOTTEST-th of all rows, and those are shuffled."""
    hot = F.broadcast(stored(named.filter("n > 1").orderBy(F.desc("n"), "print").limit(HOTTEST), "hot"))
    rest = own.join(hot.select("print"), "print", "left_anti").join(named, "print")
    return own.join(hot, "print").unionByName(rest).drop("n")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each row of docs."""
    own = stored(signed(docs), "prints")
    distinct = stored(own.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = stored(links(distinct.select("print")), "links")
    classes = stored(components(found), "classes")
    several = classes.join(distinct, classes["node"] == distinct["print"])
    least = several.groupBy("class_id").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "class_id").select(F.col("node").alias("print"), "component_id")
    named = distinct.join(named, "print", "left").select("print", "n", F.coalesce("component_id", "least").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return with_component(own, named).select("doc_id", hexed, "component_id")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op13_simhash_dedup": op13_simhash_dedup}
