"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are dealt into blocks, and each (query block, candidate part) cell is one bounded
task that multiplies two matrices. Histogram passes count, for each query, how many scores fall into each of
BINS bins between two edges; the bin that holds the k-th best score becomes the next pass's range, until few
scores lie above its lower edge or the bin is one score wide. A last pass keeps the scores from that edge
upwards, and ranks them by score, ties to the smaller id.

Rows count, not ids: each gets a number of its own when the vectors are written to the shared folder.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without an id; vectors of different length are never compared; rows that repeat an id are queries and candidates each;
fewer than k candidates are all returned; an empty table gives no rows. Scores are exact over the whole range of a long,
whatever the size of the components; a sum beyond it counts as the end of the range that it lies behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import stored, table

BINS = 256
QUERY_BLOCK = 2048
CANDIDATE_PART = 8192
#: Queries multiplied at once within a cell.
STRIP = 128
SCALE = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Whole numbers up to here are exact as double, sums and products included.
EXACT = 2.0**53
#: Larger components are taken apart into digits of so many bits, up to DIGITS of them.
BITS, DIGITS = 16, 4
#: An edge is a long, but what it is moved by may not be.
EDGE = "decimal(20,0)"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id and v, the floor of SCALE times each component, a whole number as double."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    most = float(np.finfo(np.float64).max)
    # beyond the range of a double the largest one stands for the product; the score is at its limit then
    whole = F.transform("x", lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * SCALE).cast("double")).otherwise(F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite)
    return stored(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v")), "vectors")


def digits(v: np.ndarray) -> list[np.ndarray]:
    """The signed digits of whole numbers below 2^(BITS * DIGITS) in size, least first."""
    size, sign = np.abs(v).astype(np.uint64), np.sign(v)
    return [sign * ((size >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1)).astype(np.float64) for k in range(DIGITS)]


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a and b as Python numbers: digits are multiplied as matrices, which is exact, and added up."""
    total = np.zeros((len(a), len(b)), object)
    for i, x in enumerate(digits(a)):
        if x.any():
            for j, y in enumerate(digits(b)):
                if y.any():
                    total += (x @ y.T).astype(np.int64).astype(object) << BITS * (i + j)
    return total


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a and b as longs. Those that a double may round are added as whole numbers."""
    top_a, top_b = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
    wide = top_a[:, None] * top_b[None, :] * a.shape[1]
    if wide.max() < EXACT:
        return (a @ b.T).astype(np.int64)
    out = np.zeros(wide.shape, np.int64)
    plain = wide < EXACT
    out[plain] = (a @ b.T)[plain]
    within = 2.0 ** (BITS * DIGITS - 1)
    i, j = np.nonzero(~plain.all(axis=1) & (top_a < within))[0], np.nonzero(~plain.all(axis=0) & (top_b < within))[0]
    if len(i) and len(j):
        out[np.ix_(i, j)] = np.clip(summed(a[i], b[j]), LEAST, MOST).astype(np.int64)
    # beyond the digits, as where the other side is zero, pair by pair
    for i, j in zip(*np.nonzero(~plain & ((top_a >= within)[:, None] | (top_b >= within)[None, :]))):
        out[i, j] = max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(a[i], b[j]))))
    return out


def strips(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of q, their scores against c, and which candidates are the query's own row."""
    a, b = np.stack(q["query"].to_numpy()), np.stack(c["v"].to_numpy())
    rows, own = c["row"].to_numpy(), q["query_row"].to_numpy()
    for i in range(0, len(a), STRIP):
        part = slice(i, i + STRIP)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = exact_scores(a[part], b)
        yield part, scores, own[part, None] == rows[None, :]


def counted(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """For each query, the counts of its scores by bin; BINS counts those above the range."""
    out = []
    if len(q) and len(c):
        lo, width, ids = q["lo"].to_numpy(), q["width"].to_numpy(), q["query_row"].to_numpy()
        for rows, scores, own in strips(q, c):
            low = lo[rows, None]
            # the distance from the lower edge may be beyond a long, but not beyond 64 bits
            up = np.maximum(scores, low).view(np.uint64) - low.view(np.uint64)
            bins = np.where(own | (scores < low), -1, np.minimum(up // width[rows, None].view(np.uint64), np.uint64(BINS)).astype(np.int64))
            n = len(bins)
            counts = np.bincount((np.arange(n)[:, None] * (BINS + 2) + bins + 1).ravel(), minlength=n * (BINS + 2)).reshape(n, BINS + 2)[:, 1:]
            i, j = np.nonzero(counts)
            out.append(pd.DataFrame({"row": ids[rows][i], "bin": j, "n": counts[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"row": [], "bin": [], "n": []}).astype("int64")


def chosen(k: int):
    def best(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The cell's k best from each query's lower edge upwards; what is behind them can't be among the k best."""
        out = [np.zeros((4, 0), np.int64)]
        if len(q) and len(c):
            lo, row, ids, vec = (x.to_numpy() for x in (q["lo"], q["query_row"], q["query_id"], c["vec_id"]))
            for rows, scores, own in strips(q, c):
                i, j = np.nonzero(~own & (scores >= lo[rows, None]))
                order = np.lexsort((vec[j], -scores[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                out.append(np.stack([row[rows][i], ids[rows][i], vec[j], scores[i, j]]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["query_row", "query_id", "vec_id", "score"])

    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of vectors for each row of queries (both: row, vec_id, v)."""
    spark = vectors.sparkSession
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n_q, norm_q = queries.agg(F.count("*"), F.max(F.sqrt(size))).first()
    n_c, norm_c = vectors.agg(F.count("*"), F.max(F.sqrt(size))).first()
    if not n_q or not n_c:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, parts = -(-n_q // QUERY_BLOCK), -(-n_c // CANDIDATE_PART)
    most = norm_q * norm_c * (1 + 1e-9)
    bound = int(most) + 1 if most < 2.0**62 else 1 << 63
    part, block = F.pmod(F.xxhash64("row"), F.lit(parts)), F.pmod(F.xxhash64("row"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = vectors.select("row", "vec_id", "v", F.size("v").alias("dim"), every(blocks).alias("block"), part.cast("long").alias("part"))
    width = 2 * bound // BINS + 1
    ranges = queries.select("row", F.lit(-bound).cast("long").alias("lo"), F.lit(width).cast("long").alias("width"))

    def cells(ranges: DataFrame):
        q = queries.join(ranges, "row").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("query"), "lo", "width", F.size("v").alias("dim"), block.cast("long").alias("block"), every(parts).alias("part"))
        return q.groupBy("dim", "block", "part").cogroup(candidates.groupBy("dim", "block", "part"))

    down = Window.partitionBy("row").orderBy(F.desc("bin"))
    while width > 1:
        bins = cells(ranges).applyInPandas(counted, "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        reached = bins.withColumn("above", F.sum("n").over(down)).filter(F.col("above") >= k)
        edge = reached.groupBy("row").agg(F.max("bin").alias("bin"), F.min("above").alias("above"))
        wide = F.col("width")
        found = ranges.join(edge, "row", "left").select(
            "row",
            (F.col("lo").cast(EDGE) + wide.cast(EDGE) * F.coalesce("bin", F.lit(0)).cast("decimal(18,0)")).cast("decimal(38,0)").cast("long").alias("lo"),
            F.when(F.col("bin").isNull() | (F.col("bin") == BINS), 1).otherwise(F.ceil(wide / BINS)).cast("long").alias("width"),
            F.coalesce("above", F.lit(0)).cast("long").alias("above"),
        )
        found = stored(found, "ranges")
        width, most = found.agg(F.max("width"), F.max("above")).first()
        ranges = found.drop("above")
        if most <= 4 * k:
            break
    rows = cells(ranges).applyInPandas(chosen(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


QUERIES = {"op8_topk_search": op8_topk_search}
ORACLE = {
    "op8_topk_search": """with n as (select row_number() over () r, * from embeddings),
v as (select r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from n
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r q, q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score
    from v q join v c on q.vec_id % 100 = 0 and q.r <> c.r and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by q order by score desc, vec_id)::integer rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""
}
