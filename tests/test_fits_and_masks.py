"""Robust fits by sums, alignment on trajectories, dislocation columns, masks and outlines, against plain recomputations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import geodesy, lsq
from driftline.functions.dislocation import with_dislocation
from driftline.operators import alignment, masks, robust, trajectory
from driftline.operators.selection import KEY
from driftline.plans import catalogue, fit_catalogue

SF = "/root/testdata/sf0.001"
S = "NetworkCode string, StationCode string"


def okada_surface(x: np.ndarray, y: np.ndarray, depth: float, length: float, width: float, dip: float, strike_slip: float, dip_slip: float, alpha: float = 0.5):
    """Surface displacement (x along strike, y, up) of a rectangular fault in a half-space, Okada (1985).

    x, y are measured from the fault's centre; depth is that of its centre; dip in degrees; alpha = mu / (lambda + mu)."""
    sd, cd = np.sin(np.radians(dip)), np.cos(np.radians(dip))
    if abs(cd) < 1e-9:
        cd = 0.0
    bottom = depth + width / 2 * sd
    x, y = x + length / 2, y + width / 2 * cd
    p, q = y * cd + bottom * sd, y * sd - bottom * cd
    total = [np.zeros_like(x, dtype=float) for _ in range(3)]
    for xi, eta, sign in ((x, p, 1), (x, p - width, -1), (x - length, p, -1), (x - length, p - width, 1)):
        r = np.sqrt(xi**2 + eta**2 + q**2)
        yt, dt = eta * cd + q * sd, eta * sd - q * cd
        xx = np.sqrt(xi**2 + q**2)
        r_eta, r_xi = np.maximum(r + eta, 1e-12), np.maximum(r + xi, 1e-12)
        theta = np.where(np.abs(q) < 1e-9, 0.0, np.arctan(xi * eta / np.where(np.abs(q) < 1e-9, 1.0, q * r)))
        if cd:
            i5 = alpha * 2 / cd * np.arctan((eta * (xx + q * cd) + xx * (r + xx) * sd) / np.where(np.abs(xi) < 1e-9, np.inf, xi * (r + xx) * cd))
            i4 = alpha / cd * (np.log(r + dt) - sd * np.log(r_eta))
            i3 = alpha * (yt / (cd * (r + dt)) - np.log(r_eta)) + sd / cd * i4
            i1 = -alpha * xi / (cd * (r + dt)) - sd / cd * i5
        else:
            i1 = -alpha / 2 * xi * q / (r + dt) ** 2
            i3 = alpha / 2 * (eta / (r + dt) + yt * q / (r + dt) ** 2 - np.log(r_eta))
            i4 = -alpha * q / (r + dt)
            i5 = -alpha * xi * sd / (r + dt)
        i2 = -alpha * np.log(r_eta) - i3
        strike = (xi * q / (r * r_eta) + theta + i1 * sd, yt * q / (r * r_eta) + q * cd / r_eta + i2 * sd, dt * q / (r * r_eta) + q * sd / r_eta + i4 * sd)
        along = (q / r - i3 * sd * cd, yt * q / (r * r_xi) + cd * theta - i1 * sd * cd, dt * q / (r * r_xi) + sd * theta - i5 * sd * cd)
        for k in range(3):
            total[k] += sign * (-strike_slip / (2 * np.pi) * strike[k] - dip_slip / (2 * np.pi) * along[k])
    return total


def test_published_displacements(spark):
    """Case 2 of Okada (1985): x=2, y=3, depth 4, dip 70, length 3, width 2, origin at the lower edge's start."""
    d = np.radians(70)
    one = spark.createDataFrame([(2 - 1.5, float(3 - np.cos(d)), float(4 - np.sin(d)))], "x double, y double, c double")
    fault = (F.col("x"), F.col("y"), F.col("c"), F.lit(3.0), F.lit(2.0), F.lit(70.0))
    for slips, want, within in (((1.0, 0.0), [-8.689e-3, -4.298e-3, -2.747e-3], 2e-6), ((0.0, 1.0), [-4.682e-3, -3.527e-2, -3.564e-2], 1e-5)):
        (row,) = with_dislocation(one, ("a", "b", "c3"), *fault, *map(F.lit, slips)).collect()
        assert [row["a"], row["b"], row["c3"]] == pytest.approx(want, abs=within)


def test_dislocation_columns_equal_the_plain_formula(spark):
    r = np.random.default_rng(3)
    rows = [tuple(map(float, (r.uniform(-5e4, 5e4), r.uniform(-5e4, 5e4), r.uniform(9e3, 3e4), r.uniform(1e3, 4e4), r.uniform(1e3, 1e4), dip, r.normal(), r.normal()))) for dip in (90.0, 0.0, 12.0, 45.0, 89.0, 60.0) for _ in range(20)]
    names = ["x", "y", "c", "l", "w", "dip", "ss", "ds"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    out = with_dislocation(df, ("u1", "u2", "u3"), *[F.col(n) for n in names]).collect()
    for g in out:
        want = okada_surface(np.array([g["x"]]), np.array([g["y"]]), *[g[n] for n in names[2:]])
        assert [g["u1"], g["u2"], g["u3"]] == pytest.approx([float(w[0]) for w in want], rel=1e-9, abs=1e-12)


def plain_displacements(e, n, mag, depth_m, planes):
    """The displacement by each plane that is given, arrays of north, east, up."""
    size = {k: 10.0 ** (c + m * mag) * u for k, (c, m, u) in geodesy.FAULT.items()}
    out = []
    for strike, dip, rake in planes:
        if not np.isfinite([strike, dip, rake]).all():
            continue
        depth_m = max(depth_m, size["down_dip_m"] / 2 * np.sin(np.radians(dip)) + 500)
        s, k = np.radians(strike), np.radians(rake)
        u = okada_surface(e * np.sin(s) + n * np.cos(s), n * np.sin(s) - e * np.cos(s), depth_m, size["along_strike_m"], size["down_dip_m"], dip, size["mean_slip_m"] * np.cos(k), size["mean_slip_m"] * np.sin(k))
        out.append((u[0] * np.cos(s) + u[1] * np.sin(s), u[0] * np.sin(s) - u[1] * np.cos(s), u[2]))
    return out


NAN = float("nan")
QUAKES = [
    ("a", 10.0, 20.0, 7.6, 12.0, 30.0, 40.0, 90.0, 200.0, 55.0, 80.0), ("b", -35.0, 179.8, 8.2, 30.0, 120.0, 90.0, 10.0, NAN, NAN, NAN),
    ("c", 60.0, -70.0, 6.8, 8.0, NAN, NAN, NAN, NAN, NAN, NAN), ("d", 0.0, 0.0, 6.1, 600.0, 10.0, 20.0, 30.0, NAN, NAN, NAN),
]
SCHEMA = "id string, lat double, lon double, mag double, depth double, strike1 double, dip1 double, rake1 double, strike2 double, dip2 double, rake2 double"


def plain_mask(q, density):
    """Cells by direct evaluation, and the metres of the grid for a km of the map."""
    half = np.ceil(10 ** (-3.22 + 0.69 * q[3]) * 1000) * 25
    line = np.arange(density) * (2 * half / (density - 1)) - half
    e, n = np.meshgrid(line, line, indexing="ij")
    reach = 10 ** (geodesy.SCORE_A * q[3] + geodesy.SCORE_B)
    away = np.hypot(e, n)
    planes = [q[5:8], q[8:11]]
    if not np.isfinite(planes).all(axis=1).any():
        return away < reach * 1000, away < reach * 1500, 1000.0, 1000.0, half
    hit = []
    for depth in (0.0, q[4] * 1000):
        hit.append(np.any([np.sqrt(sum(c * c for c in u)) >= 1e-3 for u in plain_displacements(e, n, q[3], depth, planes)], axis=0))
    far = max(away[h].max() if h.any() else 0 for h in hit)
    return hit[1], hit[1], far / reach, far / reach / 1.5, half


def test_masks_and_stations_in_them(spark):
    density = 41
    events = spark.createDataFrame(QUAKES, SCHEMA)
    cells, frames = masks.level2_masks(events, density)
    found = {(r["id"], r["i"], r["j"]): (r["during"], r["after"]) for r in cells.collect()}
    scale = {r["id"]: r for r in frames.collect()}
    plain = {q[0]: plain_mask(q, density) for q in QUAKES}
    for k, (during, after, m0, m1, half) in plain.items():
        want = {(k, int(i), int(j)): (bool(during[i, j]), bool(after[i, j])) for i, j in zip(*np.nonzero(during | after))}
        assert {c: v for c, v in found.items() if c[0] == k} == want
        if want:
            assert (scale[k]["during_m"], scale[k]["after_m"], scale[k]["half_m"]) == pytest.approx((m0, m1, half))
    assert sum(len(v[0].nonzero()[0]) > 30 for v in plain.values()) >= 2

    r = np.random.default_rng(1)
    places = [("n", f"s{i}", float(np.clip(q[1] + r.normal() * s, -89, 89)), float(q[2] + r.normal() * s)) for i, (q, s) in enumerate((q, s) for q in QUAKES for s in (0.2, 1, 3, 6) for _ in range(25))]
    got = {(x["StationCode"], x["id"]): x["kind"] for x in masks.masked_pairs(spark.createDataFrame(places, f"{S}, lat double, lon double"), events, density).collect()}
    want = {}
    for _, code, lat, lon in places:
        for q in QUAKES:
            during, after, m0, m1, half = plain[q[0]]
            p, p0, d = np.radians(lat), np.radians(q[1]), np.radians(lon - q[2])
            c = np.arccos(np.clip(np.sin(p0) * np.sin(p) + np.cos(p0) * np.cos(p) * np.cos(d), -1, 1))
            k = c / np.sin(c) * 6371
            x, y = k * np.cos(p) * np.sin(d), k * (np.cos(p0) * np.sin(p) - np.sin(p0) * np.cos(p) * np.cos(d))
            score = geodesy.SCORE_A * q[3] - np.log10(6371 * c) + geodesy.SCORE_B + np.log10(1.5)
            cell = lambda v, m: int(np.clip(np.floor((v * m + half) / (2 * half / (density - 1)) + 0.5), 0, density - 1))
            if score > 0 and during[cell(x, m0), cell(y, m0)]:
                want[code, q[0]] = "both"
            elif score > 0 and after[cell(x, m1), cell(y, m1)]:
                want[code, q[0]] = "decay"
    assert got == want and set(want.values()) == {"both", "decay"}


def test_displacement_by_the_larger_plane(spark):
    df = spark.createDataFrame([(*q, x, y) for q in QUAKES for x, y in ((50.0, 20.0), (-3.0, 7.0), (2000.0, 1.0))], f"{SCHEMA}, x_km double, y_km double")
    for g in masks.displacements(df).collect():
        own = plain_displacements(np.array([g["x_km"] * 1000]), np.array([g["y_km"] * 1000]), g["mag"], g["depth"] * 1000, [g[5:8], g[8:11]])
        best = max(own, key=lambda u: sum(float(c[0]) ** 2 for c in u), default=np.zeros((3, 1)))
        assert [g["d_n"], g["d_e"], g["d_u"]] == pytest.approx([float(c[0]) for c in best], rel=1e-9, abs=1e-12)
        assert g["level2"] == (np.sqrt(sum(float(c[0]) ** 2 for c in best)) >= 1e-3)


def test_outlines_are_closed_rings(spark):
    r = np.random.default_rng(8)
    ring = {(i, j) for i in range(6) for j in range(6)} - {(2, 2), (2, 3), (4, 4)}
    snake = {(i, 20) for i in range(300)} | {(299, j) for j in range(20, 60)}
    cells = [("ring", *c) for c in ring] + [("one", 7, -3)] + [("snake", *c) for c in snake] + [("dots", int(i), int(j)) for i, j in {tuple(x) for x in r.integers(0, 25, (300, 2))}]
    df = spark.createDataFrame(cells, "k string, i int, j int")
    found = masks.outlines(df, ["k"])
    rings = {}
    for x in sorted(found.collect(), key=lambda x: x["at"]):
        rings.setdefault((x["k"], x["ring"]), []).append((x["i"], x["j"], x["at"]))
    areas = {(x["k"], x["ring"]): x["area"] for x in masks.ring_areas(found, ["k"]).collect()}
    assert set(areas) == set(rings)
    for k, points in rings.items():
        assert [p[2] for p in points] == list(range(len(points)))
        turns = list(zip(points, points[1:] + points[:1]))
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in turns)
        assert areas[k] == pytest.approx(sum(a[0] * b[1] - b[0] * a[1] for a, b in turns) / 2)
    signs = lambda name: sorted(np.sign(a) for (k, _), a in areas.items() if k == name)
    assert signs("ring") == [-1, -1, 1] and signs("one") == [1] and signs("snake") == [1]
    assert {a for (k, _), a in areas.items() if k == "one"} == {0.5}
    # within a cell's width of the outline the area is that of the cells
    for name, own in (("ring", ring), ("snake", snake)):
        total, edge = sum(a for (k, _), a in areas.items() if k == name), sum(len(p) for (k, _), p in rings.items() if k == name)
        assert abs(total - len(own)) < edge


def test_outlines_of_nothing(spark):
    assert masks.outlines(spark.createDataFrame([], "k string, i int, j int"), ["k"]).count() == 0


def test_mask_polygons_as_kml(spark):
    events = spark.createDataFrame(QUAKES, SCHEMA)
    cells, frames = masks.level2_masks(events, 41)
    found = masks.mask_polygons(cells, frames, events).collect()
    assert {r["id"] for r in found} >= {"a", "b"}
    for r in found:
        points = np.array([[float(v) for v in p.split(",")] for p in r["polygon"].split("<coordinates>")[1].split("</coordinates>")[0].split(" ")])
        assert (points[0] == points[-1]).all() and r["area"] > 0.0025
        q = next(q for q in QUAKES if q[0] == r["id"])
        assert np.abs(points - [q[2], q[1]]).max() < 40
    lines = [r["value"] for r in masks.mask_placemarks(masks.mask_polygons(cells, frames, events), F.col("id")).collect()]
    assert len(lines) == len(found) and all(x.startswith("<Placemark><name>") and x.endswith("</Polygon></Placemark>") for x in lines)
    assert catalogue.QUERIES["mask_outlines"](spark, SF).count() > 10


def globe(n, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    return 6371e3 * x / np.linalg.norm(x, axis=1)[:, None]


def test_sums_give_what_a_plain_robust_fit_gives(spark):
    r = np.random.default_rng(5)
    t = r.uniform(0, 10, 500)
    y = 3 + 2 * t - 0.5 * np.sin(t) + r.normal(0, 0.02, 500)
    y[::25] += r.normal(0, 3, 20)
    rows = [(float(a), float(b)) for a, b in zip(t, y)] + [(1.0, None), (None, 2.0)]
    df = spark.createDataFrame(rows, "t double, y double")
    fit = robust.fitted(df, [([F.lit(1.0), F.col("t"), F.sin("t")], F.col("y"))])
    plain = lsq.robust_fit(np.column_stack([np.ones(500), t, np.sin(t)]), y)
    assert fit.coefficients == pytest.approx(plain.coefficients, abs=1e-9) and fit.sigma == pytest.approx(plain.wrms, rel=1e-9)
    assert np.sqrt(np.diag(fit.covariance)) == pytest.approx(plain.sigma, rel=1e-8) and (fit.passes, fit.observations) == (plain.passes, 500)
    assert fit.coefficients == pytest.approx([3, 2, -0.5], abs=0.01)
    few = robust.fitted(df.filter("y is not null and t is not null").limit(3), [([F.lit(1.0), F.col("t"), F.sin("t")], F.col("y"))])
    assert few.observations == 3 and np.isfinite(few.coefficients).all()
    none = robust.fitted(df.limit(0), [([F.lit(1.0), F.col("t")], F.col("y"))])
    assert none.observations == 0 and (none.coefficients == 0).all()


def test_robust_fit_down_weighs_as_the_rule_says():
    r = np.random.default_rng(9)
    a = np.column_stack([np.ones(80), np.linspace(-1, 1, 80)])
    y = a @ [1.0, -2.0] + r.normal(0, 0.1, 80)
    y[7] += 4
    sigma, w, c = 1.0, np.ones(80), None
    for _ in range(11):
        c = np.linalg.solve((a.T * w**2) @ a, (a.T * w**2) @ y)
        before, sigma = sigma, np.sqrt(np.sum((w * (y - a @ c)) ** 2) / 78)
        if lsq.chi2_quantile(0.025, 78) <= 78 * (sigma / before) ** 2 <= lsq.chi2_quantile(0.975, 78):
            break
        s = np.abs(y - a @ c) / sigma
        w = np.where(s > 2.5, np.maximum(10 ** (2.5 - s), np.finfo(float).eps), 1)
    f = lsq.robust_fit(a, y)
    assert f.coefficients == pytest.approx(c) and f.wrms == pytest.approx(sigma) and not f.used[7]
    exact = lsq.robust_fit(a[:2], y[:2])
    assert exact.coefficients == pytest.approx(np.linalg.solve(a[:2], y[:2])) and exact.used.all()


def moving(n, w, wrong, seed=4):
    x, r = globe(n, seed), np.random.default_rng(seed + 100)
    v = np.cross(w, x) + r.normal(0, 1e-3, x.shape)
    v[wrong] += 1.0
    return x, v


def test_one_wrong_station_leaves_the_pole(spark):
    w = np.array([-1.2e-9, 0.5e-9, 2.1e-9])
    x, v = moving(60, w, [17])
    df = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(x, v)], "auto_x double, auto_y double, auto_z double, vx double, vy double, vz double")
    pole = alignment.euler_pole(df, radius=None)
    true = (np.degrees(np.arctan2(w[2], np.hypot(w[0], w[1]))), np.degrees(np.arctan2(w[1], w[0])), np.degrees(np.linalg.norm(w)) * 1e6)
    for k, value in zip(("lat", "lon", "rate"), true):
        assert abs(pole[k] - value) < 4 * pole[f"s_{k}"] and pole[f"s_{k}"] < 2
    assert pole["rms"] < 2e-3


def test_vertical_stations_fix_the_drift_of_the_frame(spark):
    w, drift = np.array([1e-9, 2e-9, -1.5e-9]), np.array([0.004, -0.006, 0.01])
    x, v = moving(80, w, [3], seed=6)
    up = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(x, v + drift)], "auto_x double, auto_y double, auto_z double, vx double, vy double, vz double")
    vertical = spark.createDataFrame([(*map(float, a), float(u @ drift)) for a, u in zip(x[:40], up)], "auto_x double, auto_y double, auto_z double, v_u double")
    pole = alignment.euler_pole(df, vertical, radius=None)
    assert (pole["tx"], pole["ty"], pole["tz"]) == pytest.approx(tuple(drift), abs=1e-3)
    assert (pole["wx"], pole["wy"], pole["wz"]) == pytest.approx(tuple(w), abs=2e-10)


def test_common_modes_of_periods_leave_outliers_aside(spark):
    x, r = globe(50, 3), np.random.default_rng(2)
    modes = {(365.25, "sin"): [1.0, 2, -3, 0.01, -0.02, 0.03, 4.0], (365.25, "cos"): [0.5, 0, 1, -0.01, 0.02, 0.0, -2.0]}
    rows = []
    for (period, phase), p in modes.items():
        d = (alignment.design(*x.T, scale=True) @ np.array(p)).reshape(3, -1).T + r.normal(0, 1e-4, x.shape)
        d[5] += 0.7
        rows += [("n", f"s{i:02d}", *map(float, a), period, phase, *map(float, b)) for i, (a, b) in enumerate(zip(x, d))]
    terms = spark.createDataFrame(rows, f"{S}, auto_x double, auto_y double, auto_z double, period double, phase string, x double, y double, z double")
    found = alignment.periodic_modes(terms)
    for k, p in modes.items():
        assert found[k].coefficients == pytest.approx(p, abs=0.05)
    own = terms.filter("phase = 'sin'")
    assert [r["StationCode"] for r in alignment.mode_outliers(own, ["x", "y", "z"], found[365.25, "sin"]).collect() if r["down_x"] and r["down_y"] and r["down_z"]] == ["s05"]
    # a day's positions lose just what the modes explain there
    day = spark.createDataFrame([("n", f"s{i:02d}", 2020, 100, *map(float, a)) for i, a in enumerate(x)], f"{S}, Year int, DOY int, X double, Y double, Z double")
    left = np.array([[g["X"], g["Y"], g["Z"]] for g in sorted(alignment.without_periodic_modes(day, found).collect(), key=lambda g: g["StationCode"])])
    angle = 2 * np.pi * (2020 + 100 / 366.0)
    want = x - sum(wave * (alignment.design(*x.T, scale=True) @ found[k].coefficients).reshape(3, -1).T for k, wave in (((365.25, "sin"), np.sin(angle)), ((365.25, "cos"), np.cos(angle))))
    assert np.abs(left - want).max() < 1e-6


def network(spark):
    days = fit_catalogue.network_days(spark, SF).toPandas()
    return {d: g.set_index(KEY)[["X", "Y", "Z"]] for d, g in days.groupby("DOY")}


def plain_helmert(own, target):
    both = own.join(target, rsuffix="t", how="inner").sort_index()
    x, t = both[["X", "Y", "Z"]].to_numpy(), both[["Xt", "Yt", "Zt"]].to_numpy()
    return lsq.robust_fit(alignment.design(*x.T), (t - x).T.ravel())


def turned(p, c):
    x, y, z = p.T
    return p + (alignment.design(x, y, z) @ c).reshape(3, -1).T


def test_days_fitted_and_chained(spark):
    days = network(spark)
    import pandas as pd

    every = pd.concat(days.values())
    mean = every.groupby(level=[0, 1]).mean()
    got = {r["DOY"]: r for r in catalogue.QUERIES["days_fitted"](spark, SF).collect()}
    for d, own in days.items():
        f = plain_helmert(own, mean)
        assert [got[d][p] for p in alignment.PARAMETERS[:6]] == pytest.approx(f.coefficients, rel=1e-6, abs=1e-6)
        assert got[d]["n_down"] == int((~f.used).sum()) and got[d]["wrms"] == pytest.approx(f.wrms, rel=1e-6)
    # one day after the other, each to the one before as it has been moved
    done, order = {}, sorted(days)
    for k, d in enumerate(order):
        own = days[d].copy()
        if k:
            steps = [plain_helmert(days[order[j]], days[order[j - 1]]).coefficients for j in range(1, k + 1)]
            p = own.to_numpy()
            for c in reversed(steps):
                p = turned(p, c)
            own[["X", "Y", "Z"]] = p
        done[d] = own
    for r in catalogue.QUERIES["days_chained"](spark, SF).collect():
        want = done[r["DOY"]].loc[(r["NetworkCode"], r["StationCode"])]
        assert (r["X"], r["Y"], r["Z"]) == pytest.approx(tuple(want), abs=1e-5)


def test_stack_is_aligned_to_trajectories(spark):
    """What all stations of a day have in common goes; a station's own step stays, as its trajectory has it."""
    raw, done = (network(spark) if k == 0 else {d: g.set_index(KEY)[["X", "Y", "Z"]] for d, g in catalogue.QUERIES["stack_aligned"](spark, SF).toPandas().groupby("DOY")} for k in (0, 1))
    assert {d: len(g) for d, g in raw.items()} == {d: len(g) for d, g in done.items()}

    def spread(days):
        """What is left of the stations' series after a straight line each."""
        import pandas as pd

        every = pd.concat({d: g for d, g in days.items()}, names=["DOY"]).reset_index()
        left = []
        for _, g in every.groupby(KEY):
            a = np.column_stack([np.ones(len(g)), g["DOY"]])
            if len(g) > 4:
                left.append((g[["X", "Y", "Z"]].to_numpy() - a @ np.linalg.lstsq(a, g[["X", "Y", "Z"]].to_numpy(), rcond=None)[0]).ravel())
        return np.median(np.abs(np.concatenate(left)))

    assert spread(done) < 0.6 * spread(raw)


def test_targets_follow_steps(spark):
    r = np.random.default_rng(7)
    x = globe(12, 5)
    rows = [("n", f"s{i:02d}", 2010 + d // 12, 1 + d % 12 * 30, *map(float, p + (np.array([0.3, 0, 0]) if i == 4 and d >= 20 else 0) + r.normal(0, 1e-3, 3))) for d in range(40) for i, p in enumerate(x)]
    days = spark.createDataFrame(rows, f"{S}, Year int, DOY int, X double, Y double, Z double")
    jumps = spark.createDataFrame([("n", "s04", "step", 2011 + 225 / 365.0, 0.0)], f"{S}, kind string, at double, relaxation double")
    at = {(g["StationCode"], g["Year"], g["DOY"]): (g["X"], g["Y"], g["Z"]) for g in alignment.trajectory_targets(days, jumps).collect()}
    assert len(at) == 480
    for d in range(40):
        want = x[4] + (np.array([0.3, 0, 0]) if d >= 20 else 0)
        assert np.abs(np.array(at["s04", 2010 + d // 12, 1 + d % 12 * 30]) - want).max() < 5e-3


def test_trajectories_of_series_query(spark):
    got = catalogue.QUERIES["trajectories_of_series"](spark, SF).collect()
    assert got and {r["component"] for r in got} == {0, 1, 2}
    assert trajectory.fit_trajectories(spark.createDataFrame([], f"{S}, t double, n double, e double, u double")).count() == 0
