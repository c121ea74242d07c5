"""Near-duplicate classes by DartMinHash signatures, bands and exact verification.

Elements are SHINGLE-word shingles, each weighing as often as its text holds it. On the plane of weight and rank, an
element of weight w owns a region w wide, and darts fall on it as a Poisson process that the element's hash alone
determines; each dart has a coordinate of the signature. All darts with a rank below a text's bound, about K (ln K + 2) of
them whatever its length, are thrown, and the earliest of each coordinate is kept; two texts agree in a coordinate with
the probability of their weighted Jaccard similarity (the sum of the smaller weights over that of the greater). Coordinates
without a dart double the bound. BANDS bands of ROWS coordinates are joining keys: a pair of similarity 0.8 shares one with
probability 1 - (1 - 0.8^4)^20, 0.99997.

Exact copies are one representative each, under a number of its own. No bucket's pairs are spelled out. First its members
are compared with its HUBS most popular members (those whose buckets are largest, which is where the original of a group of
edited copies stands): each text with its best hub, then the pairs not yet in one class. Buckets that
still hold several classes are then searched whole: hashed into blocks of about CELL members, one cell for each two
blocks, whose signatures are compared as matrices within a task. Members with a likely partner of another class bring
their shingles to the cell, which verifies such pairs and returns the links that join classes, fewer than it has
members. So every pair that shares a band is in one class or has been compared. Verification is exact, on
the weighted shingles. Classes are connected components, found by label propagation with pointer jumping.

Defined results: texts of fewer than SHINGLE words are one shingle; texts without words (null ones too) are alone in
their class. Every row gets a row; rows without an id have no class. Rows that repeat a doc_id are judged by their own text
each. keep_first keeps one row of each class, one of least doc_id, and all rows without an id or words. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import discard, fresh, stored, table, texts

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Hubs of a bucket, and members of a block where a bucket is searched whole.
HUBS, CELL = 3, 512
#: Share of equal coordinates below which a pair is not verified; 0.8 lies four deviations above.
LIKELY = 0.6
#: Characters of texts handled at once.
STRIP = 1 << 21
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingles(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in turn, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(texts_, pa.string())))
    words = lists.flatten().dictionary_encode()
    own = np.fromiter(map(word_hash, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    h = own[words.indices.to_numpy()]
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    n = np.where([not t.strip(" \t\n\r\v\f") for t in texts_], 0, n) if len(texts_) else n
    if len(h) != n.sum():
        h = h[np.repeat(n > 0, pc.list_value_length(lists).to_numpy())]
    begin = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    at = np.repeat(begin[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    end = np.repeat(begin[1:], count)
    out = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        out = mixed(out + GOLD) + np.where(at + j < end, h[np.minimum(at + j, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else out
    return mixed(out), count


def unit_columns(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The region of a set's element that occurs w times is w unit columns; each occurrence gets the hash of its own."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    again = np.zeros(len(e), bool)
    again[1:] = (e[1:] == e[:-1]) & (o[1:] == o[:-1])
    if not again.any():
        return elements
    at = np.arange(len(e))
    column = at - np.maximum.accumulate(np.where(again, 0, at))
    out = elements.copy()
    out[order[again]] = mixed(e[again] + column[again].astype(np.uint64) * GOLD)
    return out


def signatures(elements: np.ndarray, counts: np.ndarray, k: int = K) -> np.ndarray:
    """One row of k dart hashes for each set; unit columns of all sets in turn, counts how many each has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, minlength=len(counts))
    out = np.zeros((len(counts), k), np.uint64)
    todo = total > 0
    bound = k * (np.log(k) + 2) / np.maximum(total, 1)
    while todo.any():
        own = todo[owner]
        e, o = elements[own], owner[own]
        limit, rank, best = bound[o], np.zeros(len(e)), np.full(len(counts) * k, np.inf)
        darts = []
        i = 0
        while len(e):
            i += 1
            h = mixed(e + np.uint64(i * int(GOLD) & (1 << 64) - 1))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            alive = rank < limit
            e, o, limit, rank, h = e[alive], o[alive], limit[alive], rank[alive], mixed(h[alive] + np.uint64(1))
            cell = o * k + (h % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            darts.append((cell, rank, h))
        cell, rank, h = (np.concatenate(x) for x in zip(*darts))
        first = rank == best[cell]
        full = np.isfinite(best.reshape(-1, k)).all(axis=1) & todo
        flat = out.reshape(-1)
        flat[cell[first]] = h[first]
        todo = todo & ~full
        bound = bound * 2
    return out


def strips(values: pd.Series) -> Iterator[slice]:
    a = n = 0
    for i, v in enumerate(values):
        if i > a and n + len(v) > STRIP:
            yield slice(a, i)
            a, n = i, 0
        n += len(v)
    if len(values) > a:
        yield slice(a, len(values))


def weighted_shingles(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The unit columns of each text's shingles, and how many it has."""
    h, n = shingles(texts_)
    return unit_columns(h, n), n


def copy_key():
    """16 bytes that are equal for equal texts."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, copy, bands (one key each) and short (one byte a coordinate)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in strips(b["text"]):
                own = list(b["text"].iloc[s])
                sig = signatures(*weighted_shingles(own))
                keys = np.zeros((len(own), BANDS), np.uint64)
                for j in range(ROWS):
                    keys = mixed(keys + GOLD) + sig[:, j::ROWS]
                keys = mixed(keys + np.arange(BANDS, dtype=np.uint64))
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[s].to_numpy(),
                        "copy": b["copy"].iloc[s].to_numpy(),
                        "bands": [r if sig[i].any() else None for i, r in enumerate(keys.view(np.int64))],
                        "short": [r.tobytes() for r in (sig >> np.uint64(56)).astype(np.uint8)],
                    }
                )

    return docs.select("doc_id", "text", copy_key().alias("copy")).mapInPandas(run, "doc_id long, copy binary, bands array<long>, short binary")


def bucket_rows(representatives: DataFrame) -> DataFrame:
    """bucket, node, popularity, of buckets with several members."""
    rows = representatives.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    several = stored(rows.join(sizes, "bucket"), "buckets")
    popular = several.groupBy("node").agg(F.sum("n").alias("popularity"))
    return stored(several.join(popular, "node").select("bucket", "node", "popularity"), "members")


def hub_pairs(members: DataFrame) -> DataFrame:
    """a, b, member, hub_popularity: each member with the hubs of its buckets."""
    order = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("popularity"), "node"))
    hubs = members.withColumn("place", order).filter(F.col("place") <= HUBS)
    hubs = hubs.select("bucket", F.col("node").alias("hub"), F.col("popularity").alias("hub_popularity"))
    both = members.join(hubs, "bucket").filter("node <> hub")
    pairs = both.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return pairs.agg(F.max(F.struct("hub_popularity", F.col("node").alias("member"))).alias("x")).select("a", "b", F.col("x.member").alias("member"), F.col("x.hub_popularity").alias("hub_popularity"))


def likely(pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in a share of LIKELY coordinates."""
    one = representatives.select(F.col("node").alias("a"), F.col("short").alias("short_a"))
    two = representatives.select(F.col("node").alias("b"), F.col("short").alias("short_b"))

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        m, n = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, K) for z in (x, y))
        return pd.Series((m == n).mean(axis=1))

    return pairs.join(one, "a").join(two, "b").filter(agreement("short_a", "short_b") >= LIKELY).drop("short_a", "short_b")


def alike(p: bytes, q: bytes) -> bool:
    """Whether two sorted sets of 32-bit hashes have the similarity."""
    p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
    small, large = min(len(p), len(q)), max(len(p), len(q))
    common = len(np.intersect1d(p, q, assume_unique=True)) if small >= SIMILARITY * large else 0
    return common >= SIMILARITY * (small + large - common) and common > 0


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs whose shingle sets have the similarity. sets: node, own (sorted hashes)."""
    one = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    two = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b"))

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([alike(p, q) for p, q in zip(x, y)], dtype=bool)

    return pairs.select("a", "b").join(one, "a").join(two, "b").filter(similar("own_a", "own_b")).select("a", "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and own, the sorted distinct 32-bit hashes of the weighted shingles, of the wanted representatives.

    docs: doc_id and text; wanted: node, doc_id and copy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in strips(b["text"]):
                h, n = weighted_shingles(list(b["text"].iloc[s]))
                parts = np.split((h >> np.uint64(32)).astype(np.uint32), np.cumsum(n)[:-1])
                yield pd.DataFrame({"node": b["node"].iloc[s].to_numpy(), "own": [np.unique(p).tobytes() for p in parts]})

    chosen = docs.withColumn("copy", copy_key()).join(wanted.hint("shuffle_hash"), ["doc_id", "copy"]).select("node", "text")
    return chosen.mapInPandas(run, "node long, own binary").dropDuplicates(["node"])


def components(edges: DataFrame) -> DataFrame:
    """node and class_id, the least node of its component, for each end of an edge (a, b)."""
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")), "edges")
    labels = kept = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, "x").select("x", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("x").alias("low"), F.col("label").alias("lower"))
        after = stored(lower.join(jump, "low", "left").select("x", "label", F.least("low", F.coalesce("lower", "low")).alias("new")), "labels")
        changed = after.filter("new <> label").limit(1).count()
        discard(kept)
        kept, labels = after, after.select("x", F.col("new").alias("label"))
        if not changed:
            discard(both)
            return labels.select(F.col("x").alias("node"), F.col("label").alias("class_id"))


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes."""
    for end in ("a", "b"):
        own = classes.select(F.col("node").alias(end), F.col("class_id").alias(f"class_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"class_{end}", F.coalesce(f"class_{end}", end))
    return pairs.filter("class_a <> class_b").drop("class_a", "class_b")


def likely_apart(cell: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Places of a cell's rows, each with the places behind it of likely partners in another class.

    In a cell of two blocks only pairs across them count; those within one have a cell of their own."""
    own, block = cell["class_id"].to_numpy(), cell["block"].to_numpy()
    if (own == own[0]).all():
        return
    short = np.frombuffer(b"".join(cell["short"]), np.uint8).reshape(-1, K)
    across = cell["low"].iat[0] != cell["high"].iat[0]
    for i in range(len(own) - 1):
        equal = np.count_nonzero(short[i + 1 :] == short[i], axis=1)
        at = (equal >= LIKELY * K) & (own[i + 1 :] != own[i])
        at = np.nonzero(at & (block[i + 1 :] != block[i]) if across else at)[0]
        if at.size:
            yield i, at + i + 1


def with_partners(cell: pd.DataFrame) -> pd.DataFrame:
    """The rows that have a likely partner."""
    found = np.zeros(len(cell), bool)
    for i, at in likely_apart(cell):
        found[i] = found[at] = True
    return cell[found]


def joining_links(cell: pd.DataFrame) -> pd.DataFrame:
    """a, b: verified pairs, each of which joins two classes that those before it left apart."""
    own, ids, sets = cell["class_id"].to_numpy().copy(), cell["node"].to_numpy(), cell["own"].to_numpy()
    links = []
    for i, at in likely_apart(cell):
        for j in at:
            if own[i] != own[j] and alike(sets[i], sets[j]):
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                own[own == own[j]] = own[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def by_cell(rows: DataFrame, judge, schema: str) -> DataFrame:
    """judge's rows for each cell; cells are small and many, so that a task goes through its sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            key = b[["bucket", "low", "high"]].to_numpy()
            starts = [0, *(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1), len(b)]
            if held and (held[0][["bucket", "low", "high"]].iloc[0].to_numpy() != key[0]).any():
                yield judge(pd.concat(held, ignore_index=True))
                held = []
            for x, y in zip(starts, starts[1:]):
                held.append(b.iloc[x:y])
                if y < len(b):
                    yield judge(pd.concat(held, ignore_index=True))
                    held = []
        if held:
            yield judge(pd.concat(held, ignore_index=True))

    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node").mapInPandas(run, schema)


def links_within(members: DataFrame, classes: DataFrame, representatives: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the links that are missing between classes, of the buckets that hold members of several.

    Buckets of HUBS + 1 members are left out: one of each pair is a hub."""
    own = members.select("bucket", "node").join(classes, "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))
    several = own.groupBy("bucket").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count("*").alias("n")).filter(F.col("n") > HUBS + 1).filter("lo <> hi")
    blocks = several.select("bucket", F.ceil(F.col("n") / CELL).alias("blocks"))
    rows = own.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.join(representatives.select("node", "short"), "node")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "class_id", "short")
    schema = "bucket long, low long, high long, block long, node long, class_id long, short binary"
    found = stored(by_cell(rows, with_partners, schema), "partners")
    new = found.select("node").distinct().join(sets, "node", "left_anti").join(representatives.select("node", "doc_id", "copy"), "node")
    if new.limit(1).count():
        sets = sets.union(stored(shingle_sets(known, new), "sets"))
    return stored(by_cell(found.join(sets, "node"), joining_links, "a long, b long").distinct(), "links")


def classified(known: DataFrame) -> DataFrame:
    """doc_id, copy, representative, class_id and group (the class's number; null without words) of each row of known (doc_id, text; no null)."""
    signed = stored(sign(known), "signatures")
    # a number once written stays; it is a representative's node, as an id may stand for several texts
    least = signed.filter(F.col("bands").isNotNull()).groupBy("copy").agg(F.min(F.struct("doc_id", "bands", "short")).alias("x")).select("copy", "x.*")
    representatives = stored(least.withColumn("node", F.monotonically_increasing_id()), "representatives")
    members = bucket_rows(representatives)

    candidates = stored(likely(hub_pairs(members), representatives), "candidates")
    ends = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    sets = stored(shingle_sets(known, ends.join(representatives.select("node", "doc_id", "copy"), "node")), "sets")
    best = candidates.groupBy("member").agg(F.max(F.struct("hub_popularity", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    edges = stored(verified(best, sets), "links")
    classes = components(edges)
    edges = edges.union(stored(verified(apart(candidates, classes), sets), "links"))
    classes = components(edges)
    further = links_within(members, classes, representatives, known, sets)
    if further.limit(1).count():
        classes = components(edges.union(further))

    # nodes are numbers without order; a class is named by its least doc_id, which classes may share where ids are repeated
    named = classes.join(representatives.select("node", "doc_id"), "node")
    least_ids = named.groupBy("class_id").agg(F.min("doc_id").alias("least_id"))
    named = named.join(least_ids, "class_id").select("node", "class_id", "least_id")
    own = representatives.select("copy", "node", F.col("doc_id").alias("representative")).join(named, "node", "left")
    own = own.select("copy", "representative", F.coalesce("least_id", "representative").alias("class_id"), F.coalesce("class_id", "node").alias("group"))
    alone = F.col("doc_id")
    return signed.select("doc_id", "copy").join(own, "copy", "left").select(
        "doc_id", "copy", "group", F.coalesce("representative", alone).alias("representative"), F.coalesce("class_id", alone).alias("class_id")
    )


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, representative (least id of its exact copies) and class_id (least id of its class) for each row."""
    plain, none = texts(docs), F.lit(None).cast("long")
    known = classified(plain.filter(F.col("doc_id").isNotNull())).select("doc_id", "representative", "class_id")
    return known.union(plain.filter(F.col("doc_id").isNull()).select("doc_id", none, none))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, with its least doc_id, and all rows without an id or words; the columns of docs.

    Of several rows with that id and the same text any one stays."""
    judged = classified(texts(docs).filter(F.col("doc_id").isNotNull())).filter(F.col("group").isNotNull())
    rows = judged.groupBy("group", "doc_id", "copy").agg(F.count("*").alias("n"))
    rows = stored(rows, "rows")
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "copy")).alias("first"))
    told = rows.join(first, "group").withColumn("is_first", F.struct("doc_id", "copy") == F.col("first"))
    told = stored(told.filter("n > 1 or not is_first").select("doc_id", "copy", "is_first"), "gone")
    key, copy = fresh(docs, "class_key"), fresh(docs, "copy_key")
    gone = told.select(F.col("doc_id").alias(key), F.col("copy").alias(copy), "is_first")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumn(copy, F.unhex(F.md5(text.cast("binary")))).withColumn(key, F.col("doc_id").cast("long"))
    once = own.join(gone.drop("is_first"), [key, copy], "left_anti").select(*docs.columns)
    repeated = gone.filter("is_first").drop("is_first")
    if not repeated.limit(1).count():
        return once
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    return once.unionByName(own.join(repeated, [key, copy]).groupBy(key, copy).agg(row).select("row.*"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
