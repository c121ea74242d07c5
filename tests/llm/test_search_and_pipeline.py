import numpy as np
import pytest

from driftline.llm import packing, topk_search


def brute(rows, k):
    own = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for n, (i, q) in enumerate(own):
        if i % 20 == 0:
            scores = sorted((-clip(sum(a * b for a, b in zip(q, c))), j) for m, (j, c) in enumerate(own) if m != n and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("k", [3, 10])
def test_top_k(spark, k, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_PART", 40)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist()) for i in range(160)]
    rows += [(200 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None] + [0.0] * 4), (303, [float("nan")] * 6), (None, [1.0] * 6), (320, [1.0, 2.0]), (20, rows[20][1]), (340, [0.0] * 6)]
    rows += [(1, [9.0] * 6), (1, [8.0] * 6), (360, [1e30] * 6), (361, [-1e30] * 6), (362, [3e6, 1e12, 0.5, 1.0, 2.0, -7e11]), (380, [2e9] * 6)]
    df = spark.createDataFrame([(i, v, 1, 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    vectors = topk_search.whole_vectors(df)
    got = topk_search.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, k)
    none = topk_search.whole_vectors(df.limit(0))
    assert topk_search.top_k(none, none, k).count() == 0


def test_top_k_over_the_whole_range_of_a_long(spark):
    """Scores of 2^62 and more, either sign, are told apart; what no long holds counts as its end."""
    rows = [(0, 3.0e6), (1, 1.9e6), (2, 1.8e6), (3, 1.7e6), (4, -1.9e6), (5, 2.9e6), (6, 2.93e6), (7, 1e300), (8, -1e300), (9, 0.0), (20, -2.5e6), (40, 2.0**-10), (60, 0.0)]
    df = spark.createDataFrame([(i, [v]) for i, v in rows], "vec_id long, embedding array<double>")
    vectors = topk_search.whole_vectors(df)
    got = sorted(tuple(x) for x in topk_search.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 4).collect())
    whole = {i: int(np.floor(1024 * v)) if abs(v) < 1e200 else int(1024 * v) for i, v in rows}
    want = []
    for q in (0, 20, 40, 60):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, whole[q] * whole[i])), i) for i in whole if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert [x for x in got if x[0] == 0][3][3] == 5976883200000000000


def test_digits_multiply_exactly():
    r = np.random.default_rng(3)
    a, b = (np.floor(r.normal(size=(n, 40)) * 10.0 ** r.integers(0, 18, (n, 40))) for n in (6, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert topk_search.summed(a, b).tolist() == want
    clipped = [[max(-(1 << 63), min((1 << 63) - 1, v)) for v in row] for row in want]
    assert topk_search.exact_scores(a, b).tolist() == clipped


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    kept = {r["doc_id"] for r in docs.collect()}
    assert 1 in kept and not kept & {2, 3, 4, 5, 6, 7, 8, 11}
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == kept
    assert set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert out.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.WINDOW}").count() == 0


def test_pipeline_on_nothing(spark, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
