import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import lsq
from driftline.operators import alignment, network, seismic, trajectory
from driftline.operators.selection import KEY

S = "NetworkCode string, StationCode string"


def series(seed=1, years=4, jump=2012.0, relaxation=0.5):
    r = np.random.default_rng(seed)
    t = 2010 + np.arange(int(years * 365)) / 365.25
    t = np.delete(t, np.arange(500, 590))
    after = t > jump
    decay = np.where(after, np.log10(1 + np.maximum(t - jump, 0) / relaxation), 0)
    neu = np.column_stack([v * (t - t[0]) + s * np.sin(2 * np.pi * t) + j * after + d * decay for v, s, j, d in [(0.012, 0.002, 0.05, 0.03), (-0.02, 0.001, -0.1, -0.06), (0.001, 0.005, 0.01, 0.0)]])
    neu += r.normal(0, 0.002, neu.shape)
    neu[::100] += 0.05
    return t, neu


@pytest.fixture(scope="module")
def observed(spark):
    rows = []
    for k, seed in (("one", 1), ("two", 2)):
        t, neu = series(seed)
        rows += [("n", k, float(a), int(55000 + i), *map(float, b)) for i, (a, b) in enumerate(zip(t, neu))]
    rows += [("n", "few", 2010.0 + i / 365, 55000 + i, 0.0, 0.0, 0.0) for i in range(2)]
    return spark.createDataFrame(rows, f"{S}, t double, mjd int, n double, e double, u double")


@pytest.fixture(scope="module")
def jumps(spark):
    return spark.createDataFrame([("n", k, "both", 2012.0, 0.5) for k in ("one", "two")], f"{S}, kind string, at double, relaxation double")


@pytest.fixture(scope="module")
def terms(observed, jumps):
    return trajectory.fit_trajectories(observed, jumps).cache()


def test_parameters_are_recovered(terms):
    v = {r["StationCode"]: r for r in trajectory.velocity(terms).collect()}
    assert set(v) == {"one", "two"}
    for r in v.values():
        assert (r["v_n"], r["v_e"], r["v_u"]) == pytest.approx((0.012, -0.02, 0.001), abs=1e-3)
    step = terms.filter("term = 'step' and StationCode = 'one'").first()["params"]
    decay = terms.filter("term = 'decay' and StationCode = 'one'").first()["params"]
    assert step == pytest.approx([0.05, -0.1, 0.01], abs=3e-3) and decay == pytest.approx([0.03, -0.06, 0], abs=5e-3)
    amp = trajectory.seasonal(terms).filter("StationCode = 'one' and period_days = 365.25").first()
    assert (amp["amp_n"], amp["amp_u"]) == pytest.approx((0.002, 0.005), abs=6e-4)


def test_evaluation_and_outliers(spark, observed, terms):
    r = trajectory.residuals(observed, terms)
    t, _ = series(1)
    bad = {round(x["t"], 6) for x in r.filter("outlier and StationCode = 'one'").collect()}
    assert {round(x, 6) for x in t[::100]} <= bad and len(bad) < 0.1 * len(t)
    dates = spark.createDataFrame([("n", "one", 2015.5), ("n", "one", float(t[0])), ("n", "one", float(t[1])), ("n", "few", 2015.5)], f"{S}, t double")
    p = {(x["StationCode"], round(x["t"], 3)): x for x in trajectory.position(observed, terms, dates).collect()}
    assert p["one", 2015.5]["source"] == "modelled" and p["few", 2015.5]["source"] == "mean"
    assert p["one", round(t[0], 3)]["source"] == "filtered" and p["one", round(t[1], 3)]["source"] == "observed"
    assert p["one", 2015.5]["sigma_u"] >= 0.15


def test_refit_only_what_changed(spark, observed, terms):
    saved = terms.withColumn("hash", F.lit(1).cast("long"))
    hashes = spark.createDataFrame([("n", "one", 1), ("n", "two", 2)], f"{S}, hash long")
    out = trajectory.refit_changed(observed, saved, hashes)
    assert {(r["StationCode"], r["hash"]) for r in out.collect()} == {("one", 1), ("two", 2)}


def test_selection_of_stations(observed, terms, jumps):
    assert trajectory.interseismic(terms, observed, jumps).count() == 0
    assert trajectory.interseismic(terms, observed, jumps.limit(0)).count() == 2
    assert trajectory.postseismic(observed, jumps).count() == 2


def test_repeatability_and_detection(spark, observed):
    w = {(r["StationCode"], r["component"]): r["wrms"] for r in trajectory.repeatability(observed.filter("StationCode <> 'few'")).collect()}
    assert w["one", "n"] == pytest.approx(0.002 * 2**0.5, rel=0.25)
    r = np.random.default_rng(3)
    rows = [("n", "j", 2010 + i / 365.25, i, 0.0, float((i > 200) * 0.05 + r.normal(0, 0.0005)), 0.0) for i in range(400)]
    found = trajectory.detected_jumps(spark.createDataFrame(rows, observed.schema)).collect()
    assert [round(f["at"], 2) for f in found] == [round(2010 + 200.5 / 365.25, 2)]
    s = trajectory.entropy_sigma(observed.filter("StationCode = 'one'").select(*KEY, "t", *[F.col(c).alias(f"r_{c}") for c in "neu"])).collect()
    assert all(x["sigma"] > 0 for x in s)


def test_short_series_have_no_model(spark):
    df = spark.createDataFrame([("n", "a", 2010.0, 1, 0.0, 0.0, 0.0), ("n", "a", 2010.1, 2, 0.0, 0.0, 0.0)], f"{S}, t double, mjd int, n double, e double, u double")
    assert trajectory.fit_trajectories(df).count() == 0


def globe(n, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    return 6371e3 * x / np.linalg.norm(x, axis=1)[:, None]


def test_alignment_recovers_known_vectors(spark):
    x = globe(30)
    truth = {1: np.array([3.0, -2, 5, 0.01, 0.02, -0.03]), 2: np.array([-8.0, 1, 0, 0.1, 0, 0.05])}
    rows, target = [], []
    for d, c in truth.items():
        shift = (alignment.design(*x.T) @ c).reshape(3, -1).T
        own = x - shift
        own[3] += 0.5  # a blundered station
        rows += [("n", f"s{i:02d}", 2020, d, *map(float, p)) for i, p in enumerate(own)]
        target += [("n", f"s{i:02d}", 2020, d, *map(float, p)) for i, p in enumerate(x)]
    schema = f"{S}, Year int, DOY int, X double, Y double, Z double"
    days, to = spark.createDataFrame(rows, schema), spark.createDataFrame(target, schema)
    h = alignment.helmert(days, to)
    for r in h.collect():
        assert [r[p] for p in alignment.PARAMETERS[:6]] == pytest.approx(truth[r["DOY"]], abs=1e-2) and r["n_down"] >= 1
    moved = {(r["StationCode"], r["DOY"]): (r["X"], r["Y"], r["Z"]) for r in alignment.transformed(days, h).collect()}
    assert moved["s05", 2] == pytest.approx(tuple(x[5]), abs=1e-2)
    chain = {(r["StationCode"], r["DOY"]): (r["X"], r["Y"], r["Z"]) for r in alignment.chain(days).collect()}
    assert np.linalg.norm(np.subtract(chain["s05", 1], chain["s05", 2])) < 0.02
    back, redo = alignment.build_stack(days, days.filter("DOY = 1"))
    assert {r["DOY"] for r in back.collect()} == {1} and {r["DOY"] for r in redo.collect()} == {2}
    assert alignment.align_stack(days, passes=1).count() == 60


def test_common_mode_and_pole(spark):
    x = globe(40, 2)
    p = np.array([1.0, 2, -3, 0.01, -0.02, 0.03, 4.0])
    d = (alignment.design(*x.T, scale=True) @ p).reshape(3, -1).T
    df = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(x, d)], "auto_x double, auto_y double, auto_z double, dx double, dy double, dz double")
    got = alignment.common_mode(df, ["dx", "dy", "dz"])
    assert got.coefficients == pytest.approx(p, abs=1e-3)
    assert all(abs(v) < 1e-6 for r in alignment.remove_mode(df, ["dx", "dy", "dz"], got).select("dx", "dy", "dz").collect() for v in r)
    w = np.array([-1.2e-9, 0.5e-9, 2.1e-9])
    v = np.cross(w, x)
    df = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(x, v)], "auto_x double, auto_y double, auto_z double, vx double, vy double, vz double")
    pole = alignment.euler_pole(df, radius=None)
    assert (pole["wx"], pole["wy"], pole["wz"]) == pytest.approx(tuple(w), rel=1e-6) and pole["rate"] == pytest.approx(np.degrees(np.linalg.norm(w)) * 1e6)
    day = df.select(F.lit("n").alias("NetworkCode"), F.lit("s").alias("StationCode"), F.lit(2021).alias("Year"), F.lit(0).alias("DOY"), (F.col("auto_x") + F.col("vx")).alias("X"), (F.col("auto_y") + F.col("vy")).alias("Y"), (F.col("auto_z") + F.col("vz")).alias("Z"))
    fixed = np.array(sorted((r["X"], r["Y"], r["Z"]) for r in alignment.plate_fixed(day, pole, 2020.0).collect()))
    assert np.abs(fixed - np.array(sorted(map(tuple, x)))).max() < 1e-6


def test_events_reach(spark):
    st = spark.createDataFrame([("n", f"s{i}", 0.0, float(lon)) for i, lon in enumerate((0.45, 2.7, 13.5, 54.0))], f"{S}, lat double, lon double")
    ev = spark.createDataFrame([("q", 0.0, 0.0, 8.8, 20.0)], "id string, lat double, lon double, mag double, depth double")
    got = {r["StationCode"]: (r["score"] > 0, r["after_score"] > 0) for r in seismic.affected(st, ev).collect()}
    assert got["s0"] == (True, True) and got["s1"] == (True, True) and "s3" not in got
    assert seismic.new_events(ev, ev.union(ev.withColumn("id", F.lit("r")))).count() == 1


def blobs(n):
    r = np.random.RandomState(0)
    return np.vstack([c + r.randn(n, 2) * s for c, s in [((-5, -2), 0.8), ((4, -1), 0.1), ((1, -2), 0.2), ((-2, 3), 0.3), ((3, -2), 1.6), ((5, 6), 2)]])


@pytest.mark.parametrize("qmax,n", [(5, 10), (7, 10), (10, 50), (15, 50), (10, 250), (30, 250)])
def test_clusters_keep_their_ceiling(qmax, n):
    assert np.bincount(network.bisecting(blobs(n), qmax)).max() <= qmax


@pytest.mark.parametrize("qmax,overlap,nmax", [(5, 5, 2), (10, 2, 5), (10, 5, 2), (15, 2, 5), (20, 1, 10), (17, 10, 1)])
def test_overlap_is_bounded(qmax, overlap, nmax):
    x = blobs(20)
    labels = network.bisecting(x, qmax)
    members = network.overlapping(labels, x, "dynamic", overlap, nmax)
    original = np.bincount(labels)
    assert ((members.sum(axis=1) - original) <= overlap * nmax).all()
    assert members[network.prune(members)].any(axis=0).all()


def test_agglomerative_and_ties():
    x = globe(120, 5)
    labels = network.agglomerative(x, 15, 4, 8e6)
    assert np.bincount(labels).max() <= 19
    m = network.tie_points(labels, x, 2, 2e7)
    assert (m.sum(axis=1) > np.bincount(labels)).all()
    assert network.backbone(x, 45).sum() == 45


def test_daily_clusters_and_plans(spark):
    x = globe(70, 6)
    rows = [("n", f"s{i:02d}", 2020, 1, *map(float, p)) for i, p in enumerate(x)] + [("n", f"s{i:02d}", 2020, 2, *map(float, p)) for i, p in enumerate(x[:20])]
    active = spark.createDataFrame(rows, f"{S}, Year int, DOY int, auto_x double, auto_y double, auto_z double")
    m = network.clusters(active).cache()
    assert m.filter("DOY = 2").select("cluster").distinct().count() == 1
    home = m.filter("DOY = 1 and not is_tie").groupBy(*KEY).count()
    assert home.count() == 70 and m.filter("DOY = 1 and is_tie").count() > 0
    assert network.cluster_times(m).filter("DOY = 2").first()["minutes"] == pytest.approx(6.04370855910554 - 0.102313555237178 * 20 + 0.0206316702864554 * 400)
    c = network.snapped_centroids(m, active.filter("DOY = 1"))
    assert c.count() == m.select("DOY", "cluster").distinct().count()
    plan = network.plan_sessions(active.filter("StationCode <> 's05'").union(spark.createDataFrame([("n", "new", 2020, 2, *map(float, x[0]))], active.schema)), m, m.select("Year", "DOY", "cluster").distinct())
    assert {r["StationCode"] for r in plan["added"].collect()} == {"new"} and plan["fresh"].count() == 0 and plan["invalid"].count() >= 1
    assert network.place_added(plan["added"], c).count() == 1


def test_polygon_area(spark):
    tri = spark.createDataFrame([("t", 1, 0.0, 0.0), ("t", 2, 0.0, 90.0), ("t", 3, 90.0, 0.0)], "k string, o int, lat double, lon double")
    box = spark.createDataFrame([("b", i, float(a), float(o)) for i, (a, o) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)])], tri.schema)
    got = {r["k"]: r["area"] for r in network.polygon_area(tri.union(box), ["k"], "o").collect()}
    assert got["b"] == pytest.approx(np.radians(1) ** 2, rel=1e-3) and got["t"] == pytest.approx(np.pi / 2, rel=1e-3)


def test_no_task_holds_a_day(spark, monkeypatch):
    """What is gathered for a day are factors of pieces, however many stations it has."""
    from pyspark.sql.group import GroupedData

    plain, gathered = GroupedData.applyInPandas, []
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda g, f, schema: gathered.append(g._df.count()) or plain(g, f, schema))
    x = globe(400, 9)
    c = np.array([3.0, -2, 5, 0.01, 0.02, -0.03])
    noise = np.random.default_rng(2).normal(0, 1e-3, x.shape)
    own = x - (alignment.design(*x.T) @ c).reshape(3, -1).T + noise
    schema = f"{S}, Year int, DOY int, X double, Y double, Z double"
    days, to = (spark.createDataFrame([("n", f"s{i:03d}", 2020, 1, *map(float, p)) for i, p in enumerate(v)], schema) for v in (own, x))
    (got,) = alignment.helmert(days, to).collect()
    assert max(gathered, default=0) < 100
    f = lsq.robust_fit(alignment.design(*own.T), (x - own).T.ravel())
    assert [got[p] for p in alignment.PARAMETERS[:6]] == pytest.approx(f.coefficients, rel=1e-6, abs=1e-9) and got["passes"] == f.passes
    assert got["iqr"] == pytest.approx(np.subtract(*np.percentile(f.residuals, [75, 25])), rel=1e-9) and got["n_down"] == (~f.used).sum()


@pytest.mark.parametrize("around", [0.001, 0.0])
def test_quartiles_are_exact(spark, monkeypatch, around):
    """Also where the first guess misses a rank."""
    monkeypatch.setattr(alignment, "AROUND", around)
    r = np.random.default_rng(8)
    days = {1: [2.5], 2: [1.0, 4.0], 3: [0.0] * 50, 4: r.normal(size=3001), 5: np.round(r.normal(size=400), 1), 6: [*r.normal(0, 1e-6, 900), *r.normal(0, 1e6, 100)]}
    rows = spark.createDataFrame([(2020, d, float(v)) for d, own in days.items() for v in own], "Year int, DOY int, v double")
    got = {x["DOY"]: x["iqr"] for x in alignment.quartile_range(rows).collect()}
    assert got == pytest.approx({d: np.subtract(*np.percentile(own, [75, 25])) for d, own in days.items()}, rel=1e-12)


def test_many_stations_are_fitted_as_each_alone(spark, monkeypatch):
    """Stations of all lengths, with and without jumps, in calls that hold several and cut none."""
    monkeypatch.setattr(trajectory, "FITTED_ROWS", 50)
    r = np.random.default_rng(4)
    rows, jumps = [], [("n0", "s03", "step", 2011.2, 0.0), ("n0", "s09", "both", 2012.0, 0.5), ("n0", "s99", "step", 2011.2, 0.0)]
    for k, n in enumerate([1, 2, 3, 40, 12, 12, 90, 5, 12, 70, 12, 200]):
        t = np.sort(r.choice(np.arange(300), n, replace=False)) * (0.013 if k % 3 else 0.07) + 2010
        neu = r.normal(0, 0.003, (n, 3)) + np.outer(t - 2010, [0.01, 0.02, -0.01]) + (r.random((n, 3)) < 0.05) * 0.2
        rows += [("n0", f"s{k:02d}", float(a), *map(float, p)) for a, p in zip(t, neu if k != 4 else neu * 0)]
    r.shuffle(rows)
    rows = [(str(a), str(b), *map(float, v)) for a, b, *v in rows]
    series = spark.createDataFrame(rows, f"{S}, t double, n double, e double, u double").repartition(3)
    steps = spark.createDataFrame(jumps, f"{S}, kind string, at double, relaxation double")
    for own in (None, steps):
        assert "FlatMap" not in trajectory.fit_trajectories(series, own)._jdf.queryExecution().executedPlan().toString()
        got = {(x["StationCode"], x["term"], x["at"], None if x["term"] == "wrms" else x["value"]): x for x in trajectory.fit_trajectories(series, own).collect()}
        n = 0
        for code in sorted({x[1] for x in rows}):
            v = np.array(sorted(x[2:] for x in rows if x[1] == code))
            found = trajectory.fit_series(v[:, 0], v[:, 1:], [j[2:] for j in jumps if own and j[1] == code])
            if found is None:
                continue
            for j, (term, at, value, _) in enumerate(found[0]):
                x, n = got[code, term, at, value], n + 1
                assert x["params"] == pytest.approx([f.coefficients[j] for f in found[1]], rel=1e-6, abs=1e-9) and x["sigmas"] == pytest.approx([f.sigma[j] for f in found[1]], rel=1e-6, abs=1e-9)
            x, n = got[code, "wrms", 0.0, None], n + 1
            assert x["value"] == len(v) and x["params"] == pytest.approx([f.wrms for f in found[1]], rel=1e-6, abs=1e-12) and x["sigmas"] == [f.used.sum() for f in found[1]]
        assert n == len(got)
