"""Stacks of daily networks and their alignment (N1 to N7) and plate motion.

A day's network is a group of rows (station key, Year, DOY, X, Y, Z); Helmert parameters of a day come from the
triangular factors of pieces of its stations with their targets, and are applied as columns. Common modes and spaces are one robust
least-squares problem with few unknowns: Spark sums the normal equations of each pass, the driver solves a 7 x 7 system."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions import geodesy
from driftline.functions.lsq import LIMIT, PASSES, down_weight, settled, triangle
from driftline.operators.archive import numbered
from driftline.operators.robust import Equation, Solution, fitted, residual
from driftline.operators.selection import KEY
from driftline.storage import written

DAY = ["Year", "DOY"]
#: Rotations are in units of 1e-9 rad.
UNIT = 1e-9
PARAMETERS = ("rx", "ry", "rz", "tx", "ty", "tz", "scale")


def design(x: np.ndarray, y: np.ndarray, z: np.ndarray, scale: bool = False) -> np.ndarray:
    """The x, then y, then z rows of the linearised Helmert transformation."""
    o, i = np.zeros(len(x)), np.ones(len(x))
    rows = [[o, -z * UNIT, y * UNIT, i, o, o], [z * UNIT, o, -x * UNIT, o, i, o], [-y * UNIT, x * UNIT, o, o, o, i]]
    blocks = [np.column_stack([*r, *([c * UNIT] if scale else [])]) for r, c in zip(rows, (x, y, z))]
    return np.concatenate(blocks)


FITTED = "Year int, DOY int, " + ", ".join(f"{p} double" for p in PARAMETERS) + ", wrms double, n_stations int, passes int"
#: How far around the quartiles, in shares of a day, residuals are ranked, and the accuracy of the quartiles' first guess.
AROUND, ACCURACY = 0.001, 10_000


def with_targets(days: DataFrame, target: DataFrame) -> DataFrame:
    """Positions of days with their targets (toX, toY, toZ), written once, the days of a file one after the other."""
    both = days.join(target.select(*KEY, *DAY, *[F.col(c).alias(f"to{c}") for c in "XYZ"]), [*KEY, *DAY])
    numbers = [F.col(p + c).cast("double").alias(p + c) for p in ("", "to") for c in "XYZ"]
    return written(both.select(*[F.col(c).cast("int").alias(c) for c in DAY], *numbers).sortWithinPartitions(*DAY), "targets")


def day_fits(both: DataFrame, scale: bool = False) -> DataFrame:
    """The robust transformation of each day of with_targets(), wrms, stations and passes; days of under three stations give no row.

    Nobody holds a day: a pass makes the triangular factor of the weighted equations of each batch of rows, factors of one day
    are put together by factoring them again, and the driver has one solution a day for the next pass's weights."""
    spark = both.sparkSession
    k = 7 if scale else 6
    state: dict[tuple[int, int], tuple] = {}

    def factors(known: dict):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own: dict = {}
            for b in batches:
                keys = b[DAY].to_numpy()
                cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(b)]
                x, to = b[list("XYZ")].to_numpy(), b[["toX", "toY", "toZ"]].to_numpy()
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi or known.get(day := (int(keys[lo, 0]), int(keys[lo, 1])), (None,))[-1]:
                        continue
                    a, l = design(*x[lo:hi].T, scale), (to - x)[lo:hi].T.ravel()  # noqa: E741
                    w = down_weight(l - a @ known[day][0], known[day][1], LIMIT) if day in known else np.ones(len(l))
                    before, n = own.get(day, (np.zeros((0, k + 1)), 0))
                    own[day] = np.linalg.qr(np.concatenate([before, triangle(a, l, w)]), mode="r"), n + hi - lo
            yield pd.DataFrame([(*day, r.ravel(), n) for day, (r, n) in own.items()], columns=[*DAY, "r", "n"])

        return run

    def solution(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        r = np.linalg.qr(np.concatenate([x.reshape(-1, k + 1) for x in rows["r"]]), mode="r")
        dof = 3 * n - k
        c = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]
        sigma = float(np.linalg.norm(r[:, -1] - r[:, :-1] @ c)) / dof**0.5 if dof > 0 else 1.0
        return pd.DataFrame([(*map(int, keys), c, sigma, n)], columns=[*DAY, "c", "sigma", "n"])

    for turn in range(1, PASSES + 1):
        parts = both.mapInPandas(factors({day: (s[0], s[1], s[-1]) for day, s in state.items()}), "Year int, DOY int, r array<double>, n long")
        found = parts.groupBy(*DAY).applyInPandas(solution, "Year int, DOY int, c array<double>, sigma double, n long").filter("n >= 3").collect()
        for f in found:
            day, dof = (f["Year"], f["DOY"]), 3 * f["n"] - k
            before = state[day][1] if day in state else 1.0
            state[day] = (np.array(f["c"]), f["sigma"], f["n"], turn, dof <= 0 or f["sigma"] < 1e-14 or settled([before, f["sigma"]], dof))
        if all(s[-1] for s in state.values()):
            break
    rows = [(*day, *map(float, c), *([] if scale else [0.0]), float(sigma), int(n), turns) for day, (c, sigma, n, turns, _) in state.items()]
    return spark.createDataFrame(rows, FITTED)


def helmert(days: DataFrame, target: DataFrame, scale: bool = False) -> DataFrame:
    """Each day's transformation to the target positions (same keys, X, Y, Z), robust, with the components it weighed down and
    the range between the quartiles of all residuals; days of under three common stations give no row."""
    both = with_targets(days, target)
    fits = day_fits(both, scale)
    x, y, z = (F.col(c) for c in "XYZ")
    terms = {"X": [y * F.col("rz") - z * F.col("ry"), F.col("tx"), x * F.col("scale")], "Y": [z * F.col("rx") - x * F.col("rz"), F.col("ty"), y * F.col("scale")], "Z": [x * F.col("ry") - y * F.col("rx"), F.col("tz"), z * F.col("scale")]}
    left = [F.col(f"to{c}") - F.col(c) - (turn * UNIT + shift + grown * UNIT) for c, (turn, shift, grown) in terms.items()]
    # a day without redundancy, or without residuals, has nothing weighed down
    down = (F.abs("v") > LIMIT * F.col("wrms")) & (3 * F.col("n_stations") > (7 if scale else 6)) & (F.col("wrms") >= 1e-14)
    v = both.join(F.broadcast(fits), DAY).select(*DAY, "wrms", "n_stations", F.explode(F.array(*left)).alias("v"))
    beyond = v.groupBy(*DAY).agg(F.sum(down.cast("int")).cast("int").alias("n_down"))
    out = fits.join(beyond, DAY).join(quartile_range(v.select(*DAY, "v")), DAY)
    return out.select(*DAY, *PARAMETERS, "wrms", "n_stations", "n_down", "iqr", "passes")


def quartile_range(values: DataFrame) -> DataFrame:
    """The exact range between the quartiles (linear between ranks) of v on each day.

    A first guess of what stands around each quartile, with known error, leaves few values to be ranked; what is below is counted."""
    shares = (0.25, 0.75)
    cuts = [s + d for s in shares for d in (-AROUND, AROUND)]
    guess = written(values.groupBy(*DAY).agg(F.percentile_approx("v", cuts, ACCURACY).alias("g"), F.count("v").alias("n")), "quartiles")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.floor((F.col("n") - 1) * s).alias("rank"), ((F.col("n") - 1) * s).alias("place"), F.get("g", F.lit(2 * i)).alias("lo"), F.get("g", F.lit(2 * i + 1)).alias("hi")) for i, s in enumerate(shares)]))
    sides = guess.select(*DAY, "n", sides.alias("s")).select(*DAY, "n", "s.*")
    near = values.join(F.broadcast(sides), DAY)
    count = lambda c: F.sum(c.cast("long"))
    counts = written(near.groupBy(*DAY, "side", "n", "rank", "place", "lo", "hi").agg(count(F.col("v") < F.col("lo")).alias("below"), count(F.col("v") <= F.col("hi")).alias("upto")), "quartiles")
    # where the guess does not hold both ranks, every value is ranked
    missed = (F.col("below") > F.col("rank")) | (F.col("upto") < F.least(F.col("rank") + 2, "n"))
    counts = counts.withColumns({"lo": F.when(missed, float("-inf")).otherwise(F.col("lo")), "hi": F.when(missed, float("inf")).otherwise(F.col("hi")), "below": F.when(missed, 0).otherwise(F.col("below"))})
    few = values.join(F.broadcast(counts), DAY).filter("v between lo and hi").groupBy(*DAY, "side", "n", "rank", "place", "below", "v").agg(F.count("*").alias("m"))
    ranked = few.withColumn("last", F.col("below") + F.sum("m").over(Window.partitionBy(*DAY, "side").orderBy("v")))
    at = lambda r: F.min(F.when(F.col("last") > r, F.col("v")))
    found = ranked.groupBy(*DAY, "side", "rank", "place").agg(at(F.col("rank")).alias("a"), at(F.least(F.col("rank") + 1, F.col("n") - 1)).alias("b"))
    quartile = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("rank"))
    return found.groupBy(*DAY).agg((F.max(F.when(F.col("side") == 1, quartile)) - F.max(F.when(F.col("side") == 0, quartile))).alias("iqr"))


def transformed(days: DataFrame, parameters: DataFrame) -> DataFrame:
    """The days with their transformation applied, as columns; days without one are left out."""
    p = parameters.select(*DAY, *PARAMETERS)
    j = days.join(F.broadcast(p), DAY)
    x, y, z = F.col("X"), F.col("Y"), F.col("Z")
    k = 1 + F.col("scale") * UNIT
    moved = {
        "X": x * k + (F.col("rz") * y - F.col("ry") * z) * UNIT + F.col("tx"),
        "Y": y * k + (F.col("rx") * z - F.col("rz") * x) * UNIT + F.col("ty"),
        "Z": z * k + (F.col("ry") * x - F.col("rx") * y) * UNIT + F.col("tz"),
    }
    return j.withColumns(moved).select(*days.columns)


def mean_positions(days: DataFrame) -> DataFrame:
    """The mean position of each station over the days."""
    return days.groupBy(*KEY).agg(*[F.avg(c).alias(c) for c in "XYZ"])


def build_stack(solutions: DataFrame, stack: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of days that the stack holds whole, and rows of days to be aligned anew."""
    keys = [*KEY, *DAY]
    missing = solutions.select(*keys).subtract(stack.select(*keys)).union(stack.select(*keys).subtract(solutions.select(*keys)))
    days = missing.select(*DAY).distinct()
    return stack.join(days, DAY, "left_anti"), solutions.join(days, DAY, "left_semi")


def trend_targets(days: DataFrame) -> DataFrame:
    """Targets of a pass: each station's linear motion through its positions, evaluated on its days (aggregates only)."""
    t = F.col("Year") + F.col("DOY") / 366.0
    d = days.withColumn("t", t)
    fits = d.groupBy(*KEY).agg(F.count("*").alias("n"), *[F.regr_slope(c, "t").alias(f"s{c}") for c in "XYZ"], *[F.regr_intercept(c, "t").alias(f"i{c}") for c in "XYZ"], *[F.avg(c).alias(f"m{c}") for c in "XYZ"])
    j = d.join(fits, KEY)
    at = {c: F.coalesce(F.col(f"i{c}") + F.col(f"s{c}") * F.col("t"), F.col(f"m{c}")) for c in "XYZ"}
    return j.withColumns(at).select(*days.columns)


def trajectory_targets(days: DataFrame, jumps: DataFrame | None = None) -> DataFrame:
    """Targets of a pass: each station's trajectory (trend, seasonal terms, steps and decays of jumps), robustly fitted to its
    days and evaluated on them. Stations too short for a model are no targets."""
    from driftline.functions.calendar import fractional_year
    from driftline.operators import trajectory

    ref = mean_positions(days).select(*KEY, *[F.col(c).alias(f"m{c}") for c in "XYZ"])
    ref = ref.withColumn("g", geodesy.geodetic(*[F.col(f"m{c}") for c in "XYZ"]))
    place = days.join(ref, KEY).withColumn("t", fractional_year(F.col("Year"), F.col("DOY")))
    neu = geodesy.to_neu(*[F.col(c) - F.col(f"m{c}") for c in "XYZ"], F.col("g.lat"), F.col("g.lon"))
    series = place.withColumn("neu", neu).select(*KEY, "t", "neu.n", "neu.e", "neu.u")
    model = trajectory.evaluate(trajectory.fit_trajectories(series, jumps), series.select(*KEY, "t").distinct())
    back = geodesy.from_neu(*[F.col(c) for c in "neu"], F.col("g.lat"), F.col("g.lon"))
    at = place.select(*KEY, *DAY, "t", "g", *[f"m{c}" for c in "XYZ"]).join(model, [*KEY, "t"]).withColumn("back", back)
    return at.select(*KEY, *DAY, *[(F.col(f"m{c}") + F.col(f"back.d{c.lower()}")).alias(c) for c in "XYZ"])


def align_stack(days: DataFrame, passes: int = 4, targets=trajectory_targets, cut=None) -> DataFrame:
    """Days aligned to the stations' trajectories, some passes. A pass reads its input several times, so each one is
    written out: to the shared folder, or by cut(df) where that is given."""
    for _ in range(passes):
        days = transformed(days, day_fits(with_targets(days, targets(days))))
        days = cut(days) if cut else written(days, "aligned")
    return days


NORMAL = 7


def helmert_equations(observed: list[str], scale: bool = True) -> list[Equation]:
    """N6 as columns: the three rows of a station (auto_x, auto_y, auto_z) for three observed differences."""
    x, y, z = F.col("auto_x") * UNIT, F.col("auto_y") * UNIT, F.col("auto_z") * UNIT
    o, i = F.lit(0.0), F.lit(1.0)
    rows = [[o, -z, y, i, o, o, x], [z, o, -x, o, i, o, y], [-y, x, o, o, o, i, z]]
    return [(terms if scale else terms[:-1], F.col(c)) for terms, c in zip(rows, observed)]


def common_mode(stations: DataFrame, observed: list[str], scale: bool = True) -> Solution:
    """The Helmert parameters that best explain one difference of all stations, such as a periodic or velocity
    term, or its difference from a constraint; robust, by sums over the stations."""
    return fitted(stations, helmert_equations(observed, scale))


def mode_outliers(stations: DataFrame, observed: list[str], mode: Solution) -> DataFrame:
    """Stations with a component that the fit has weighed down, and which: one boolean column each."""
    scale = len(mode.coefficients) == NORMAL
    flags = {f"down_{c}": F.abs(residual(e, mode.coefficients)) > LIMIT * mode.sigma for c, e in zip(observed, helmert_equations(observed, scale))}
    return stations.withColumns(flags).filter(" or ".join(flags))


def periodic_modes(terms: DataFrame, scale: bool = True) -> dict[tuple[float, str], Solution]:
    """The common mode of each period and phase (sin, cos). terms: auto_x, auto_y, auto_z, period, phase, x, y, z (metres).

    There are as many modes as periods in use, two for each of a few; each is a handful of sums."""
    found = {}
    for r in sorted(terms.select("period", "phase").distinct().collect()):
        own = terms.filter((F.col("period") == r["period"]) & (F.col("phase") == r["phase"]))
        found[r["period"], r["phase"]] = common_mode(own, ["x", "y", "z"], scale)
    return found


def without_periodic_modes(days: DataFrame, modes: dict[tuple[float, str], Solution]) -> DataFrame:
    """Positions (X, Y, Z) of days less what the modes explain there on that date."""
    angle = {period: 2 * np.pi * (F.col("Year") + F.col("DOY") / 366.0) * 365.25 / period for period, _ in modes}
    x, y, z = F.col("X") * UNIT, F.col("Y") * UNIT, F.col("Z") * UNIT
    less = {c: F.lit(0.0) for c in "XYZ"}
    for (period, phase), mode in modes.items():
        p = [float(v) for v in mode.coefficients] + [0.0] * (NORMAL - len(mode.coefficients))
        wave = F.sin(angle[period]) if phase == "sin" else F.cos(angle[period])
        own = {"X": -z * p[1] + y * p[2] + p[3] + x * p[6], "Y": z * p[0] - x * p[2] + p[4] + y * p[6], "Z": -y * p[0] + x * p[1] + p[5] + z * p[6]}
        less = {c: less[c] + wave * own[c] for c in "XYZ"}
    return days.withColumns({c: F.col(c) - less[c] for c in "XYZ"})


def remove_mode(rows: DataFrame, values: list[str], mode: Solution) -> DataFrame:
    """Values less what the mode explains, as columns."""
    p = [float(v) for v in mode.coefficients] + [0.0] * (NORMAL - len(mode.coefficients))
    x, y, z = F.col("auto_x") * UNIT, F.col("auto_y") * UNIT, F.col("auto_z") * UNIT
    explained = [
        -z * p[1] + y * p[2] + p[3] + x * p[6],
        z * p[0] - x * p[2] + p[4] + y * p[6],
        -y * p[0] + x * p[1] + p[5] + z * p[6],
    ]
    return rows.withColumns({v: F.col(v) - e for v, e in zip(values, explained)})


def periodic_constraints(fits: DataFrame) -> DataFrame:
    """Mean of repeated fits of each station, period and component."""
    return fits.groupBy(*KEY, "period", "component").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


#: Days of a stretch of a chain, whose running product is one task's work.
STRETCH = 1000


def chain(days: DataFrame) -> DataFrame:
    """Each day aligned to the already aligned day before.

    Transformations compose: neighbouring days are fitted in parallel, and only their running product is sequential. Tasks
    make it within stretches of STRETCH days; the driver multiplies one product a stretch, for what lies before each.
    A day that shares no station with the one before takes that one's transformation."""
    spark = days.sparkSession
    order = numbered(days.select(*DAY).distinct(), DAY, "driftline_k")
    d = days.join(order, DAY)
    before = d.select(*KEY, (F.col("driftline_k") + 1).alias("driftline_k"), *[F.col(c).alias(f"t{c}") for c in "XYZ"])
    target = d.join(before, [*KEY, "driftline_k"]).select(*KEY, *DAY, *[F.col(f"t{c}").alias(c) for c in "XYZ"])
    stretch = F.floor((F.col("driftline_k") - 1) / STRETCH).alias("driftline_stretch")
    steps = order.join(day_fits(with_targets(days, target)), DAY, "left").select(*DAY, "driftline_k", stretch, *PARAMETERS[:6])

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("driftline_k")
        turn, shift, own = np.eye(3), np.zeros(3), []
        for rx, ry, rz, *move in rows[list(PARAMETERS[:6])].fillna(0.0).to_numpy(dtype=float):
            step = np.eye(3) + UNIT * np.array([[0, rz, -ry], [-rz, 0, rx], [ry, -rx, 0]])
            turn, shift = turn @ step, turn @ np.array(move) + shift
            own.append([*turn.ravel(), *shift])
        return rows[[*DAY, "driftline_k", "driftline_stretch"]].assign(driftline_own=own)

    within = steps.groupBy("driftline_stretch").applyInPandas(products, "Year int, DOY int, driftline_k long, driftline_stretch long, driftline_own array<double>")
    within = written(within, "chain")
    ends = within.groupBy("driftline_stretch").agg(F.max_by("driftline_own", "driftline_k").alias("p")).orderBy("driftline_stretch").collect()
    turn, shift, earlier = np.eye(3), np.zeros(3), []
    for r in ends:
        earlier.append((r["driftline_stretch"], [*turn.ravel().tolist(), *shift.tolist()]))
        p = np.array(r["p"])
        turn, shift = turn @ p[:9].reshape(3, 3), turn @ p[9:] + shift
    first = spark.createDataFrame(earlier, "driftline_stretch long, driftline_earlier array<double>")
    j = days.join(within.join(first, "driftline_stretch"), DAY)
    return affine(affine(j, "driftline_own"), "driftline_earlier").select(*days.columns)


def affine(rows: DataFrame, p: str) -> DataFrame:
    """X, Y, Z turned and shifted by an array of nine factors, row by row, and three shifts."""
    at = lambda i: F.get(p, F.lit(i))
    return rows.withColumns({c: sum(at(3 * i + k) * F.col(x) for k, x in enumerate("XYZ")) + at(9 + i) for i, c in enumerate("XYZ")})


def save_stack(rows: DataFrame, path: str, name: str) -> None:
    """K2: replaces the stack of this name, and no other."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.withColumn("name", F.lit(name)).write.mode("overwrite").partitionBy("name").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def euler_pole(stations: DataFrame, vertical: DataFrame | None = None, radius: float | None = geodesy.SEMI_MAJOR) -> dict[str, float]:
    """The rotation (rad/yr) that best explains the horizontal velocities vx, vy, vz at auto_x, auto_y, auto_z, with its pole,
    rate (degrees per million years), their deviations, and what an observation of full weight deviates by. Robust.

    vertical: stations with v_u, their vertical velocity less the wanted one; then a drift tx, ty, tz of the frame is
    fitted with the rotation, to both the horizontal velocities and these. radius: of the sphere (None: each station's own)."""
    x, y, z = (F.col(f"auto_{c}") for c in "xyz")
    flat = F.sqrt(x * x + y * y)
    size = F.sqrt(x * x + y * y + z * z)
    sl, cl, so, co = z / size, flat / size, y / flat, x / flat
    own = (size if radius is None else F.lit(radius)) * UNIT
    vx, vy, vz = F.col("vx"), F.col("vy"), F.col("vz")
    none = F.lit(None).cast("double")
    across = {"north": -sl * co * vx - sl * so * vy + cl * vz, "east": -so * vx + co * vy, "up": none}
    place = [sl.alias("sl"), cl.alias("cl"), so.alias("so"), co.alias("co"), own.alias("own")]
    rows = stations.select(*place, *[v.alias(k) for k, v in across.items()])
    if vertical is not None:
        rows = rows.unionByName(vertical.select(*place, none.alias("north"), none.alias("east"), F.col("v_u").cast("double").alias("up")))
    sl, cl, so, co, own = (F.col(c) for c in ("sl", "cl", "so", "co", "own"))
    o = F.lit(0.0)
    north, east, up = [own * so, -own * co, o], [-own * sl * co, -own * sl * so, own * cl], [o, o, o]
    drift = ([-sl * co, -sl * so, cl], [-so, co, o], [cl * co, cl * so, sl])
    terms = [a + b if vertical is not None else a for a, b in zip((north, east, up), drift)]
    fit = fitted(rows, [(t, F.col(c)) for t, c in zip(terms, across)])
    w, cov = fit.coefficients[:3] * UNIT, fit.covariance[:3, :3] * UNIT**2
    length, level = float(np.linalg.norm(w)), float(np.hypot(w[0], w[1]))
    jac = np.array([[-w[0] * w[2] / (level * length**2), -w[1] * w[2] / (level * length**2), level / length**2], [-w[1] / level**2, w[0] / level**2, 0.0], w / length])
    deviation = np.degrees(np.sqrt(np.abs(np.diag(jac @ cov @ jac.T))))
    shift = fit.coefficients[3:] if vertical is not None else np.zeros(3)
    return {
        "wx": w[0], "wy": w[1], "wz": w[2], "lat": np.degrees(np.arctan2(w[2], level)), "lon": np.degrees(np.arctan2(w[1], w[0])), "rate": np.degrees(length) * 1e6,
        "rms": fit.sigma, "s_lat": deviation[0], "s_lon": deviation[1], "s_rate": deviation[2] * 1e6, "n": stations.count(), "passes": fit.passes,
        "tx": shift[0], "ty": shift[1], "tz": shift[2],
    }


def plate_candidates(table: DataFrame, affected: DataFrame, lat: tuple[float, float], lon: tuple[float, float], years: float = 2.5) -> DataFrame:
    """Stations of a box with a long record that no event has moved."""
    from driftline.operators.selection import in_box

    return in_box(table, lat, lon, years).join(affected.select(*KEY).distinct(), KEY, "left_anti")


def plate_fixed(days: DataFrame, pole: dict[str, float], t_ref: float) -> DataFrame:
    """Positions less the plate's motion since t_ref."""
    t = F.col("Year") + F.col("DOY") / 366.0 - t_ref
    x, y, z = F.col("X"), F.col("Y"), F.col("Z")
    w = [F.lit(float(pole[k])) for k in ("wx", "wy", "wz")]
    return days.withColumns({"X": x - (w[1] * z - w[2] * y) * t, "Y": y - (w[2] * x - w[0] * z) * t, "Z": z - (w[0] * y - w[1] * x) * t})
