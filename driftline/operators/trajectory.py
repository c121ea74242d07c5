"""Trajectory models of station series.

A series is a DataFrame of one row a day: the station key, `t` (fractional year), `mjd` and n, e, u in metres. Series
are loaded and filtered with joins; each station's fit is one group of a grouped map, whose size is bounded by
the days a station can have. Results are rows of parameters, so that evaluation and selection are columns again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import geodesy
from driftline.functions.lsq import density_clusters, robust_fit, robust_fits
from driftline.operators import selection, windows
from driftline.operators.selection import KEY

COMPONENTS = ("n", "e", "u")
PERIODS_DAYS = (365.25, 182.625)
DAYS_IN_YEAR = 365.25
#: Decays of larger amplitude (m) are taken out and the model fitted again.
LARGEST_DECAY = 4.0
CONDITION = 1e10
#: Automatic steps need data all round the year: the largest wrapped gap, in years.
LARGEST_GAP = 0.2465

TERMS = "NetworkCode string, StationCode string, term string, at double, value double, params array<double>, sigmas array<double>"


def load(solutions: DataFrame, stations: DataFrame, excluded: DataFrame | None = None, mjd: str = "mjd", t: str = "FYear") -> DataFrame:
    """The series of each station as n, e, u against its reference place; excluded days and blunders are out."""
    good = selection.near_station(solutions, stations, excluded).filter(~F.col("blunder"))
    ref = stations.select(*KEY, "lat", "lon", "auto_x", "auto_y", "auto_z")
    j = good.join(ref, KEY)
    neu = geodesy.to_neu(F.col("X") - F.col("auto_x"), F.col("Y") - F.col("auto_y"), F.col("Z") - F.col("auto_z"), F.col("lat"), F.col("lon"))
    return j.withColumn("r", neu).select(*KEY, F.col(t).alias("t"), F.col(mjd).alias("mjd"), "r.n", "r.e", "r.u")


def blunders(solutions: DataFrame, stations: DataFrame) -> DataFrame:
    """The solutions that load leaves out for their distance."""
    return selection.near_station(solutions, stations).filter("blunder")


def linear_trend(series: DataFrame, keys: list[str], t: str, v: str, digits: int = 6) -> DataFrame:
    """Slope and intercept of each series of three points and more, by built-in aggregates."""
    out = series.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"))
    return out.filter("n > 2 and slope is not null").withColumns({c: F.round(c, digits) for c in ("slope", "intercept")})


def outliers_one_pass(series: DataFrame, keys: list[str], t: str, v: str, limit: float = 2.5) -> DataFrame:
    """Residual, sigma and `outlier` (beyond limit sigmas) after one unweighted pass."""
    fit = series.groupBy(*keys).agg(F.count("*").alias("n_points"), F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept")).filter("n_points > 2")
    r = series.join(fit, keys).withColumn("residual", F.col(v) - F.col("intercept") - F.col("slope") * F.col(t))
    s = r.groupBy(*keys).agg(F.sqrt(F.sum(F.col("residual") ** 2) / (F.first("n_points") - 2)).alias("sigma"))
    return r.join(s, keys).withColumn("outlier", F.abs("residual") > limit * F.col("sigma"))


def robust_trend(series: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """E3 with E12: robust slope and intercept, wrms and the number of points within the limit."""
    schema = ", ".join([*(f"{c} {k}" for c, k in series.select(*keys).dtypes), "slope double, intercept double, wrms double, n_used long"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[t].to_numpy(dtype=float), rows[v].to_numpy(dtype=float)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        out = rows.iloc[:1][keys].copy()
        if len(np.unique(x)) < 3:
            return out.assign(slope=np.nan, intercept=np.nan, wrms=np.nan, n_used=0)
        f = robust_fit(np.column_stack([np.ones(len(x)), x]), y)
        return out.assign(slope=f.coefficients[1], intercept=f.coefficients[0], wrms=f.wrms, n_used=int(f.used.sum()))

    return series.groupBy(*keys).applyInPandas(fit, schema)


def periods_allowed(t: np.ndarray, periods=PERIODS_DAYS) -> list[float]:
    """The periods that the largest wrapped gap in the data leaves resolvable: a quarter of each at most."""
    part = np.unique(np.round(t - np.floor(t), 6))
    if len(part) < 2:
        return []
    gap = max(np.diff(part).max(), 1 - part[-1] + part[0])
    return [p for p in periods if gap <= p / DAYS_IN_YEAR / 4]


def columns(t: np.ndarray, t_ref: float, degree: int, periods, jumps) -> list[tuple[str, float, float, np.ndarray]]:
    """(term, place, value, column) of the design: polynomial, periodic, step and decay terms.

    jumps: (kind, time, relaxation years); kind step, decay, or both."""
    out = [("poly", t_ref, float(p), (t - t_ref) ** p) for p in range(degree)]
    for p in periods:
        phase = 2 * np.pi * t * DAYS_IN_YEAR / p
        out += [("sin", p, 0.0, np.sin(phase)), ("cos", p, 0.0, np.cos(phase))]
    for kind, at, relaxation in jumps:
        after = t > at
        if kind in ("step", "both"):
            out.append(("step", at, 0.0, after.astype(float)))
        if kind in ("decay", "both"):
            out.append(("decay", at, relaxation, np.where(after, np.log10(1 + np.maximum(t - at, 0) / relaxation), 0.0)))
    return out


def resolvable(t: np.ndarray, t_ref: float, degree: int, periods, jumps) -> list:
    """Jumps that have data on both sides, are apart from the one before, and keep the design's condition."""
    kept: list = []
    for jump in sorted(jumps, key=lambda j: j[1]):
        kind, at, _ = jump
        before, after = (t <= at).sum(), (t > at).sum()
        if not after or (not before and kind == "step"):
            continue
        if kept and ((t > kept[-1][1]) & (t <= at)).sum() < 2:
            if kind == "both" or kept[-1][0] == "step":
                kept[-1] = jump
            continue
        a = np.column_stack([c[3] for c in columns(t, t_ref, degree, periods, [*kept, jump])])
        if np.linalg.cond(a) < CONDITION:
            kept.append(jump)
    return kept


def fit_series(t: np.ndarray, neu: np.ndarray, jumps=(), degree: int = 2, periods=None, t_ref: float | None = None, velocity=None):
    """The design's terms, their three fits, and the time they refer to; None for series too short.

    Decays beyond LARGEST_DECAY are taken out and all fitted again, up to ten times. velocity: E21, removed before."""
    t_ref = float(t[0] if t_ref is None else t_ref)
    neu = neu if velocity is None else neu - np.outer(t - t_ref, velocity)
    periods = periods_allowed(t) if periods is None else list(periods)
    jumps = resolvable(t, t_ref, degree, periods, jumps)
    for _ in range(10):
        terms = columns(t, t_ref, degree, periods, jumps)
        if len(t) <= len(terms):
            if jumps:
                jumps = []
                continue
            if periods:
                periods = []
                continue
            return None
        fits = [robust_fit(np.column_stack([c[3] for c in terms]), neu[:, i]) for i in range(3)]
        large = {(k, at, r) for j, (k, at, r, _) in enumerate(terms) if k == "decay" and max(abs(f.coefficients[j]) for f in fits) > LARGEST_DECAY}
        if not large:
            return terms, fits, t_ref
        jumps = [("step", at, 0.0) if kind == "both" and ("decay", at, r) in large else (kind, at, r) for kind, at, r in jumps if not (kind == "decay" and ("decay", at, r) in large)]
    return terms, fits, t_ref


#: Days of stations that are fitted at once; a station is never cut.
FITTED_ROWS = 1 << 16


def model_terms(stations: list[tuple[np.ndarray, np.ndarray, list]], degree: int) -> list[tuple[int, list, np.ndarray]]:
    """Of each station (t, neu, jumps) that has a model: its place in the list, the terms (term, at, value), and by component their
    parameters and sigmas with wrms and points used at the end. Stations without jumps whose designs have one shape are solved together."""
    out, shapes, designs = [], {}, {}
    for i, (t, neu, jumps) in enumerate(stations):
        if jumps:
            result = fit_series(t, neu, jumps, degree)
            if result is not None:
                terms, fits, _ = result
                values = [[[f.coefficients[j] for f in fits], [f.sigma[j] for f in fits]] for j in range(len(terms))]
                out.append((i, [x[:3] for x in terms], np.array([*values, [[f.wrms for f in fits], [float(f.used.sum()) for f in fits]]])))
            continue
        same = t.tobytes()
        if same not in designs:
            found = periods_allowed(t)
            choices = [columns(t, float(t[0]), degree, p, ()) for p in ([found, []] if found else [[]])]
            terms = next((c for c in choices if len(t) > len(c)), None)
            designs[same] = terms and ([c[:3] for c in terms], np.column_stack([c[3] for c in terms]))
        if designs[same]:
            terms, a = designs[same]
            shapes.setdefault(a.shape, []).append((i, terms, a, neu))
    for own in shapes.values():
        a = np.repeat(np.stack([x[2] for x in own]), 3, axis=0)
        f = robust_fits(a, np.stack([x[3] for x in own]).transpose(0, 2, 1).reshape(len(a), -1))
        # station, term, parameter or sigma, component
        values = np.stack([f.coefficients, f.sigma], axis=2).reshape(len(own), 3, -1, 2).transpose(0, 2, 3, 1)
        last = np.stack([f.wrms, f.used.astype(float)], axis=1).reshape(len(own), 1, 3, 2).transpose(0, 1, 3, 2)
        out += zip([x[0] for x in own], [x[1] for x in own], np.concatenate([values, last], axis=1))
    return out


def fit_trajectories(series: DataFrame, jumps: DataFrame | None = None, degree: int = 2) -> DataFrame:
    """One row for each term of each station's model, with the parameters and sigmas of n, e and u.

    jumps: station key, kind, at (fractional year), relaxation. Stations too short for a model give no rows (E17).
    A task has its stations one after the other and fits many at once, so that no station is a call of its own."""
    rows = series.select(*KEY, *[F.col(c).cast("double").alias(c) for c in ("t", *COMPONENTS)])
    if jumps is None:
        rows = rows.withColumn("jumps", F.lit(None).cast("array<struct<kind:string,at:double,relaxation:double>>"))
    else:
        own = jumps.groupBy(*[F.col(c).alias(f"driftline_{c}") for c in KEY]).agg(F.collect_list(F.struct("kind", F.col("at").cast("double").alias("at"), F.col("relaxation").cast("double").alias("relaxation"))).alias("jumps"))
        same = [F.col(c).eqNullSafe(F.col(f"driftline_{c}")) for c in KEY]
        rows = rows.join(own, same[0] & same[1], "left").select(*rows.columns, "jumps")

    def fitted(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t = table["t"].to_numpy()
        neu = np.column_stack([table[c].to_numpy() for c in COMPONENTS])
        ends = [*starts[1:], len(t)]
        given = table["jumps"].take(pa.array(starts)).to_pylist()
        found = model_terms([(t[a:b], neu[a:b], [(j["kind"], j["at"], j["relaxation"]) for j in own or ()]) for a, b, own in zip(starts, ends, given)], degree)
        names = [x for _, terms, _ in found for x in (*terms, ("wrms", 0.0, None))]
        place = np.repeat([starts[i] for i, _, _ in found], [len(terms) + 1 for _, terms, _ in found]).astype(np.int64)
        length = np.repeat([float(ends[i] - starts[i]) for i, _, _ in found], [len(terms) + 1 for _, terms, _ in found])
        numbers = np.concatenate([v for _, _, v in found]) if found else np.zeros((0, 2, 3))
        at = pa.array(np.arange(len(names) + 1, dtype=np.int32) * 3)
        value = [n if v is None else float(v) for (_, _, v), n in zip(names, length)]
        keys = [table[c].combine_chunks().take(pa.array(place)) for c in KEY]
        lists = [pa.ListArray.from_arrays(at, pa.array(numbers[:, k].ravel())) for k in range(2)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([n[0] for n in names], pa.string()), pa.array([float(n[1]) for n in names], pa.float64()), pa.array(value, pa.float64()), *lists], names=[*KEY, "term", "at", "value", "params", "sigmas"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= FITTED_ROWS:
                table = pa.Table.from_batches(held)
                starts = station_starts(table)
                if len(starts) > 1:
                    yield fitted(table.slice(0, starts[-1]), starts[:-1])
                    held = table.slice(starts[-1]).to_batches()
                    n = table.num_rows - int(starts[-1])
        if n:
            table = pa.Table.from_batches(held)
            yield fitted(table, station_starts(table))

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "t").mapInArrow(run, TERMS)


def station_starts(rows: pa.Table) -> np.ndarray:
    """Where a station's rows begin, in rows that are sorted by station."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in KEY:
        codes = pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.nonzero(new)[0]


def refit_changed(series: DataFrame, saved: DataFrame, hashes: DataFrame, jumps: DataFrame | None = None) -> DataFrame:
    """Saved terms of stations whose series hash is unchanged, and new fits of the others.

    saved: terms with `hash`; hashes: station key and the `hash` its series has now."""
    same = saved.select(*KEY, "hash").distinct().join(hashes, [*KEY, "hash"], "left_semi").select(*KEY)
    kept = saved.join(same, KEY, "left_semi")
    changed = series.join(same, KEY, "left_anti")
    new = fit_trajectories(changed, None if jumps is None else jumps.join(same, KEY, "left_anti"))
    return kept.unionByName(new.join(hashes, KEY))


def evaluate(terms: DataFrame, dates: DataFrame, t: str = "t") -> DataFrame:
    """Modelled n, e, u of each station at each of its dates (station key and t), as columns only."""
    x = F.col(t)
    phase = 2 * np.pi * x * DAYS_IN_YEAR / F.col("at")
    basis = (
        F.when(F.col("term") == "poly", F.pow(x - F.col("at"), F.col("value"))).when(F.col("term") == "sin", F.sin(phase)).when(F.col("term") == "cos", F.cos(phase))
        .when((F.col("term") == "step") & (x > F.col("at")), 1.0)
        .when((F.col("term") == "decay") & (x > F.col("at")), F.log10(1 + (x - F.col("at")) / F.col("value"))).otherwise(0.0)
    )
    j = dates.join(terms.filter("term <> 'wrms'"), KEY).withColumn("basis", basis)
    return j.groupBy(*KEY, t).agg(*[F.sum(F.col("basis") * F.get("params", F.lit(i))).alias(c) for i, c in enumerate(COMPONENTS)])


def residuals(series: DataFrame, terms: DataFrame) -> DataFrame:
    """Observed less modelled, with `outlier` beyond 2.5 wrms in any component."""
    model = evaluate(terms, series.select(*KEY, "t")).withColumnsRenamed({c: f"m_{c}" for c in COMPONENTS})
    w = terms.filter("term = 'wrms'").select(*KEY, F.col("params").alias("wrms"))
    r = series.join(model, [*KEY, "t"]).join(w, KEY)
    r = r.withColumns({f"r_{c}": F.col(c) - F.col(f"m_{c}") for c in COMPONENTS})
    out = F.lit(False)
    for i, c in enumerate(COMPONENTS):
        out = out | (F.abs(f"r_{c}") > 2.5 * F.get("wrms", F.lit(i)))
    return r.withColumn("outlier", out).drop(*[f"m_{c}" for c in COMPONENTS], "wrms")


def position(series: DataFrame, terms: DataFrame, dates: DataFrame, floors=(0.10, 0.10, 0.15)) -> DataFrame:
    """N, e, u and sigmas at dates, from the observation where it is good, else from the model, else the mean.

    source: observed, filtered (an outlier, the model instead), modelled, mean."""
    res = residuals(series, terms).select(*KEY, "t", *[F.col(c).alias(f"o_{c}") for c in COMPONENTS], "outlier", *[f"r_{c}" for c in COMPONENTS])
    model = evaluate(terms, dates).withColumnsRenamed({c: f"m_{c}" for c in COMPONENTS})
    mean = series.groupBy(*KEY).agg(*[F.avg(c).alias(f"a_{c}") for c in COMPONENTS])
    j = dates.join(res, [*KEY, "t"], "left").join(model, [*KEY, "t"], "left").join(mean, KEY, "left")
    source = F.when(F.col("outlier") == False, "observed").when(F.col("outlier"), "filtered").when(F.col("m_n").isNotNull(), "modelled").otherwise("mean")  # noqa: E712
    values = {c: F.when(source == "observed", F.col(f"o_{c}")).when(source == "mean", F.col(f"a_{c}")).otherwise(F.col(f"m_{c}")) for c in COMPONENTS}
    sigmas = {f"sigma_{c}": F.greatest(F.when(source == "observed", F.abs(f"r_{c}")).otherwise(F.lit(0.0)), F.lit(floor)) for c, floor in zip(COMPONENTS, floors)}
    return j.withColumns({"source": source, **values, **sigmas}).select(*KEY, "t", "source", *COMPONENTS, *sigmas)


def velocity(terms: DataFrame) -> DataFrame:
    """The velocity terms and their sigmas, one row a station."""
    v = terms.filter("term = 'poly' and value = 1")
    return v.select(*KEY, *[F.get("params", F.lit(i)).alias(f"v_{c}") for i, c in enumerate(COMPONENTS)], *[F.get("sigmas", F.lit(i)).alias(f"s_{c}") for i, c in enumerate(COMPONENTS)])


def seasonal(terms: DataFrame) -> DataFrame:
    """Amplitude of each period and component."""
    s = terms.filter("term in ('sin', 'cos')").groupBy(*KEY, F.col("at").alias("period_days"))
    return s.agg(*[F.sqrt(F.sum(F.pow(F.get("params", F.lit(i)), 2))).alias(f"amp_{c}") for i, c in enumerate(COMPONENTS)])


def without_velocity(series: DataFrame, model: DataFrame) -> DataFrame:
    """The series less a given velocity (station key, t_ref, v_n, v_e, v_u)."""
    j = series.join(model, KEY)
    return j.withColumns({c: F.col(c) - F.col(f"v_{c}") * (F.col("t") - F.col("t_ref")) for c in COMPONENTS}).select(*series.columns)


def without_decay(series: DataFrame, model: DataFrame) -> DataFrame:
    """The series less given decays (station key, at, relaxation, a_n, a_e, a_u), as many as a station has."""
    basis = F.when(F.col("t") > F.col("at"), F.log10(1 + (F.col("t") - F.col("at")) / F.col("relaxation"))).otherwise(0.0)
    total = series.join(model, KEY).groupBy(*KEY, "t").agg(*[F.sum(F.col(f"a_{c}") * basis).alias(f"d_{c}") for c in COMPONENTS])
    j = series.join(total, [*KEY, "t"], "left")
    return j.withColumns({c: F.col(c) - F.coalesce(f"d_{c}", F.lit(0.0)) for c in COMPONENTS}).select(*series.columns)


def equipment_jumps(sessions: DataFrame, gaps: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Steps at antenna or radome changes, for stations with data all round the year; user terms added
    or removed (overrides: station key, at, action + or -, kind, relaxation)."""
    change = windows.changes(sessions, KEY, "DateStart", ["AntennaCode", "RadomeCode"])
    year = F.year("DateStart")
    at = year + (F.dayofyear("DateStart") - 0.5) / F.when(year % 4 == 0, 366).otherwise(365)
    auto = change.join(gaps.filter(F.col("largest_gap") <= LARGEST_GAP), KEY, "left_semi")
    auto = auto.select(*KEY, F.lit("step").alias("kind"), F.round(at, 6).alias("at"), F.lit(0.0).alias("relaxation"))
    if overrides is None:
        return auto
    taken = overrides.filter("action = '-'").select(*KEY, F.round("at", 6).alias("at"))
    added = overrides.filter("action = '+'").select(*KEY, "kind", F.round("at", 6).alias("at"), "relaxation")
    return auto.join(taken, [*KEY, "at"], "left_anti").unionByName(added)


def frame_jumps(solutions: DataFrame) -> DataFrame:
    """A step at the first day of every reference frame but a station's first."""
    first = selection.first_of_each(solutions, [*KEY, "ReferenceFrame"], [F.col("Year"), F.col("DOY")])
    later = windows.changes(first.withColumn("d", F.struct("Year", "DOY")), KEY, "d", ["ReferenceFrame"])
    at = F.col("Year") + (F.col("DOY") - 0.5) / F.when(F.col("Year") % 4 == 0, 366).otherwise(365)
    return later.select(*KEY, F.lit("step").alias("kind"), F.round(at, 6).alias("at"), F.lit(0.0).alias("relaxation"))


def detected_jumps(series: DataFrame, eps: float = 0.0028, least: int = 15) -> DataFrame:
    """Times at which the residual position leaves one dense stretch for another, east and north apart."""
    schema = "NetworkCode string, StationCode string, kind string, at double, relaxation double"

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t", kind="stable")
        t, found = rows["t"].to_numpy(dtype=float), []
        for c in ("e", "n"):
            y = rows[c].to_numpy(dtype=float)
            x = np.column_stack([(t - t[0]) * eps, y])
            labels = density_clusters(x, eps, least)
            own = np.nonzero(labels >= 0)[0]
            found += [float((t[a] + t[b]) / 2) for a, b in zip(own, own[1:]) if labels[a] != labels[b]]
        kept: list[float] = []
        for at in sorted(found):
            if not kept or at - kept[-1] > 10 / DAYS_IN_YEAR:
                kept.append(at)
        return pd.DataFrame([(*keys, "step", at, 0.0) for at in kept], columns=[*KEY, "kind", "at", "relaxation"])

    return series.groupBy(*KEY).applyInPandas(run, schema)


def repeatability(series: DataFrame) -> DataFrame:
    """Weighted RMS of day-to-day differences of each station and component, trend and constant taken out."""
    d = windows.lag_difference(series, KEY, "mjd", list(COMPONENTS)).filter("d_mjd = 1")
    long = d.select(*KEY, "t", F.explode(F.map_from_arrays(F.array(*map(F.lit, COMPONENTS)), F.array(*[f"d_{c}" for c in COMPONENTS]))).alias("component", "v"))
    return robust_trend(long, [*KEY, "component"], "t", "v").select(*KEY, "component", "wrms", "n_used")


def entropy_sigma(residual: DataFrame) -> DataFrame:
    """Velocity sigma of each component from the scatter of segment slopes.

    The residuals are cut into ever shorter segments; the spread of the segments' slopes, scaled to the whole span, is
    taken at the segment count of least entropy of their histogram."""
    schema = "NetworkCode string, StationCode string, component string, sigma double"

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("t"), []
        t = rows["t"].to_numpy(dtype=float)
        for c in COMPONENTS:
            y, best = rows[f"r_{c}"].to_numpy(dtype=float), (np.inf, np.nan)
            for n in range(2, max(3, len(t) // 30)):
                slopes = [np.polyfit(a - a.mean(), b, 1)[0] for a, b in zip(np.array_split(t, n), np.array_split(y, n)) if len(a) > 2 and np.ptp(a) > 0]
                if len(slopes) < 2:
                    continue
                h, _ = np.histogram(slopes, bins="sturges")
                p = h[h > 0] / h.sum()
                entropy = float(-(p * np.log(p)).sum() / np.log(n + 1))
                best = min(best, (entropy, float(np.std(slopes) / n**1.5)))
            out.append((*keys, c, best[1]))
        return pd.DataFrame(out, columns=[*KEY, "component", "sigma"])

    return residual.groupBy(*KEY).applyInPandas(run, schema)


def delay_fit(delays: DataFrame) -> DataFrame:
    """Polynomial and periodic terms of zenith delays, as terms with one parameter."""
    schema = "NetworkCode string, StationCode string, term string, at double, value double, param double, sigma double"

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, y = rows["t"].to_numpy(dtype=float), rows["ZTD"].to_numpy(dtype=float)
        terms = columns(t, float(t[0]), 2, periods_allowed(t), [])
        if len(t) <= len(terms):
            terms = terms[:1]
        f = robust_fit(np.column_stack([c[3] for c in terms]), y)
        return pd.DataFrame([(*keys, k, at, v, f.coefficients[j], f.sigma[j]) for j, (k, at, v, _) in enumerate(terms)], columns=[*KEY, "term", "at", "value", "param", "sigma"])

    return delays.groupBy(*KEY).applyInPandas(run, schema)


def change_parameters(current: DataFrame, changes: DataFrame) -> DataFrame:
    """User overrides with changes applied: a change replaces the row of its key, action `remove` deletes it.

    Unknown objects and jumps without a date are refused by a filter, listed by refused_changes."""
    keys = [*KEY, "soln", "object", "Year", "DOY"]
    good = changes.filter(accepted())
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kept = current.alias("a").join(good.select(*keys).distinct().alias("b"), same, "left_anti")
    return kept.unionByName(good.filter("action <> 'remove'").select(*current.columns))


def accepted() -> Column:
    jump = F.col("object") == "jump"
    return F.col("object").isin("polynomial", "periodic", "jump") & (~jump | (F.col("Year").isNotNull() & F.col("DOY").isNotNull()))


def refused_changes(changes: DataFrame) -> DataFrame:
    return changes.filter(~accepted())


def interseismic(terms: DataFrame, series: DataFrame, jumps: DataFrame, years: float = 2.0, sigma: float = 0.001) -> DataFrame:
    """Stations with a span of years, a velocity sigma below a bound in n and e, and no decay."""
    span = series.groupBy(*KEY).agg((F.max("t") - F.min("t")).alias("span")).filter(F.col("span") >= years)
    decays = jumps.filter("kind in ('decay', 'both')").select(*KEY).distinct()
    return velocity(terms).filter((F.col("s_n") < sigma) & (F.col("s_e") < sigma)).join(span, KEY).join(decays, KEY, "left_anti")


def postseismic(series: DataFrame, jumps: DataFrame, before_years: float = 0.5, after_years: float = 1.0) -> DataFrame:
    """Stations with data for long enough before and after an event with decay."""
    j = jumps.filter("kind in ('decay', 'both')").select(*KEY, "at")
    span = series.groupBy(*KEY).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return j.join(span, KEY).filter((F.col("at") - F.col("lo") >= before_years) & (F.col("hi") - F.col("at") >= after_years))
