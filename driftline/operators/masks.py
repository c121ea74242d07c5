"""Where an earthquake moves the ground: displacement at a place, masks on a grid, and their outlines.

All of it is expressions and joins: a grid is made by exploding sequences, cells are dealt out by event and row of the grid, a
station finds its cell by its number, and outlines are joined up by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import geodesy
from driftline.functions.dislocation import with_dislocation
from driftline.operators.seismic import affected
from driftline.storage import written

LIMIT_M = 1e-3
#: Cells along each side of a grid, and how many fault lengths it reaches to each side.
DENSITY, FAULT_LENGTHS = 250, 25
PLANE = ("strike", "dip", "rake")


def known(plane: str) -> Column:
    """Whether an event's nodal plane is given."""
    given = F.lit(True)
    for c in PLANE:
        given = given & F.col(f"{c}{plane}").isNotNull() & ~F.isnan(f"{c}{plane}")
    return given


def size(k: str) -> Column:
    """A measure of the fault from the magnitude."""
    c, m, unit = geodesy.FAULT[k]
    return F.pow(F.lit(10.0), c + m * F.col("mag")) * unit


def deep_enough(plane: str) -> Column:
    """Metres of depth that keep a plane's fault half a kilometre and more below ground; null where it is not given."""
    return F.when(known(plane), size("down_dip_m") / 2 * F.sin(F.radians(f"dip{plane}")) + 500)


def on_plane(rows: DataFrame, x_m: Column, y_m: Column, depth_m: Column, strike: Column, dip: Column, rake: Column, names: tuple[str, str, str]) -> DataFrame:
    """rows with the displacement in metres (north, east, up) by a nodal plane."""
    s, k, slip = F.radians(strike), F.radians(rake), size("mean_slip_m")
    along, across = x_m * F.sin(s) + y_m * F.cos(s), y_m * F.sin(s) - x_m * F.cos(s)
    out = with_dislocation(rows, ("m_1", "m_2", "m_3"), along, across, depth_m, size("along_strike_m"), size("down_dip_m"), dip, slip * F.cos(k), slip * F.sin(k))
    turned = (F.col("m_1") * F.cos(s) + F.col("m_2") * F.sin(s), F.col("m_1") * F.sin(s) - F.col("m_2") * F.cos(s), F.col("m_3"))
    return out.withColumns(dict(zip(names, turned))).drop("m_1", "m_2", "m_3")


def moved_by(names: tuple[str, str, str]) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))


def displacements(pairs: DataFrame, limit_m: float = LIMIT_M) -> DataFrame:
    """Pairs with d_n, d_e, d_u, the displacement by the nodal plane that moves the place more, and level2, whether
    it reaches limit_m. pairs: x_km (east), y_km (north) of the place from the event, mag, depth (km), strike1 to rake2.

    A fault that would reach above ground is put deeper, and the second plane no higher than the first. The result is
    written once: a later filter would have the optimizer derive constraints from every step of the formula."""
    x, y, depth = F.col("x_km") * 1000, F.col("y_km") * 1000, F.col("depth") * 1000
    rows, of = pairs, {p: tuple(f"m_{c}{p}" for c in "neu") for p in "12"}
    for p in "12":
        depth = F.greatest(depth, deep_enough(p))
        rows = on_plane(rows, x, y, depth, *[F.col(f"{c}{p}") for c in PLANE], of[p])
        rows = rows.withColumns({c: F.when(known(p), F.col(c)).otherwise(0.0) for c in of[p]})
    second = moved_by(of["2"]) > moved_by(of["1"])
    found = {f"d_{c}": F.when(second, F.col(f"m_{c}2")).otherwise(F.col(f"m_{c}1")) for c in "neu"}
    level2 = F.greatest(*[moved_by(n) for n in of.values()]) >= limit_m
    return written(rows.withColumns(found | {"level2": level2}).select(*pairs.columns, *found, "level2"), "displacements")


def grids(events: DataFrame, density: int = DENSITY) -> DataFrame:
    """The events' rows with half_m, step_m, i, j, x_m, y_m: a square grid of density^2 cells about each event."""
    half = (F.ceil(size("along_strike_m")) * FAULT_LENGTHS).cast("double")
    own = events.withColumns({"half_m": half, "step_m": 2 * half / (density - 1)})
    every = F.explode(F.sequence(F.lit(0), F.lit(density - 1)))
    # an event alone would be a single task's work: rows of the grid are dealt out
    rows = own.withColumn("i", every).repartition("id", "i").withColumn("j", every)
    return rows.withColumns({"x_m": F.col("i") * F.col("step_m") - F.col("half_m"), "y_m": F.col("j") * F.col("step_m") - F.col("half_m")})


def level2_masks(events: DataFrame, density: int = DENSITY, limit_m: float = LIMIT_M) -> tuple[DataFrame, DataFrame]:
    """Cells (id, i, j, during, after: whether the event, and what follows it, counts there), and of each event what
    places a point in them: id, half_m, step_m, during_m and after_m (metres of the grid for a km on the map).

    Cells where either nodal plane moves the ground by limit_m, so stretched that the farthest of them, for the fault at its
    depth or at the surface, lies at the reach of the event's magnitude; after the event the same mask reaches half as far again.
    Events without nodal planes have a round mask of their reach, unstretched. Events that move nothing anywhere have none."""
    reach = F.pow(F.lit(10.0), geodesy.SCORE_A * F.col("mag") + geodesy.SCORE_B)
    own = events.select("id", "mag", "depth", *[f"{c}{p}" for p in "12" for c in PLANE], reach.alias("reach_km"))
    either, away = known("1") | known("2"), F.sqrt(F.col("x_m") * F.col("x_m") + F.col("y_m") * F.col("y_m"))
    # a fault a row: each plane that is given, at the event's depth and at the surface
    fault = [F.when(known(p), F.struct(*[F.col(f"{c}{p}").alias(c) for c in PLANE], F.greatest(*lowest).alias("least_m"))) for p, lowest in (("1", [F.lit(0.0), deep_enough("1")]), ("2", [F.lit(0.0), deep_enough("1"), deep_enough("2")]))]
    faults = own.withColumn("deep", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("f", F.explode(F.array_compact(F.array(*fault))))
    faults = faults.select("id", "mag", "reach_km", "deep", F.greatest("f.least_m", F.when(F.col("deep"), F.col("depth") * 1000)).alias("depth_m"), *[F.col(f"f.{c}").alias(c) for c in PLANE])
    moved = on_plane(grids(faults, density), F.col("x_m"), F.col("y_m"), F.col("depth_m"), *map(F.col, PLANE), ("m_n", "m_e", "m_u"))
    moved = moved.select("id", "i", "j", "half_m", "step_m", "reach_km", "deep", away.alias("away"), (moved_by(("m_n", "m_e", "m_u")) >= limit_m).alias("hit"))
    # written as it is: a filter on top would have the optimizer derive constraints from every step of the formula
    hit = written(moved, "moved").filter("hit")
    far = F.max("away") / F.first("reach_km")
    frames = hit.groupBy("id").agg(F.first("half_m").alias("half_m"), F.first("step_m").alias("step_m"), far.alias("during_m"), (far / geodesy.AFTER_FACTOR).alias("after_m"))
    cells = hit.filter("deep").select("id", "i", "j").distinct().withColumns({"during": F.lit(True), "after": F.lit(True)})
    flat = grids(own.filter(~either), density).withColumn("away", away)
    round_ = flat.select("id", "i", "j", (F.col("away") < F.col("reach_km") * 1000).alias("during"), (F.col("away") < F.col("reach_km") * 1000 * geodesy.AFTER_FACTOR).alias("after")).filter("after")
    plain = own.filter(~either).withColumn("half_m", (F.ceil(size("along_strike_m")) * FAULT_LENGTHS).cast("double"))
    unscaled = plain.select("id", "half_m", (2 * F.col("half_m") / (density - 1)).alias("step_m"), F.lit(1000.0).alias("during_m"), F.lit(1000.0).alias("after_m"))
    return cells.unionByName(round_), frames.unionByName(unscaled)


def cell_of(km: Column, metres: str, density: int) -> Column:
    """The number of the grid line nearest to a place on the map; what lies outside takes the outermost."""
    at = F.round((km * F.col(metres) + F.col("half_m")) / F.col("step_m"))
    return F.least(F.greatest(at, F.lit(0.0)), F.lit(density - 1.0)).cast("int")


def masked_pairs(stations: DataFrame, events: DataFrame, density: int = DENSITY) -> DataFrame:
    """Pairs of stations and events (id, mag, depth, planes) by the masks: kind is both where the event itself counts,
    decay where only what follows it does; pairs where neither does are gone. Only pairs within the reach are looked up."""
    cells, frames = level2_masks(events, density)
    pairs = affected(stations, events)
    event = "id" if "id" not in stations.columns else "event_id"
    at = geodesy.azimuthal(F.col("lat"), F.col("lon"), F.col("event_lat"), F.col("event_lon"))
    pairs = pairs.withColumn("m_at", at).join(frames.withColumnRenamed("id", event), event)
    for name in ("during", "after"):
        own = cells.filter(name).select(F.col("id").alias(event), F.col("i").alias("m_i"), F.col("j").alias("m_j"), F.lit(True).alias(name))
        pairs = pairs.withColumns({"m_i": cell_of(F.col("m_at.x"), f"{name}_m", density), "m_j": cell_of(F.col("m_at.y"), f"{name}_m", density)})
        pairs = pairs.join(own, [event, "m_i", "m_j"], "left")
    kind = F.when(F.col("during"), "both").when(F.col("after"), "decay")
    return pairs.withColumn("kind", kind).filter("kind is not null").drop("m_at", "m_i", "m_j", "half_m", "step_m", "during_m", "after_m", "during", "after")


#: Sides of a square of four cells, named by where their middle lies in half cells from its first one, and the turns an
#: outline takes through it for each set of inner corners (1, 2, 4, 8 counter-clockwise from the first), inner cells at its left.
SIDES = {"s": (1, 0), "e": (2, 1), "n": (1, 2), "w": (0, 1)}
TURNS = {
    1: ("sw",), 2: ("es",), 3: ("ew",), 4: ("ne",), 5: ("sw", "ne"), 6: ("ns",), 7: ("nw",),
    8: ("wn",), 9: ("sn",), 10: ("es", "wn"), 11: ("en",), 12: ("we",), 13: ("se",), 14: ("ws",),
}


def outlines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The rings around the cells (keys, i, j, whole numbers): keys, ring, at (place in the ring from 0), i, j (of the ring's
    corners, halfway between an inner and an outer cell).

    Each square of four cells with some of them inside gives a piece of outline or two (marching squares), counter-clockwise around
    inner cells. A piece ends where another begins, so pointers double until each knows the least piece of its ring, and
    again for how many pieces remain before it."""
    corner = F.explode(F.array(*[F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b"), F.lit(bit).alias("bit")) for a, b, bit in ((0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8))]))
    squares = cells.select(*keys, "i", "j", corner.alias("c")).groupBy(*keys, (F.col("i") + F.col("c.a")).alias("i"), (F.col("j") + F.col("c.b")).alias("j"))
    turn = lambda s: F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), (*SIDES[s[0]], *SIDES[s[1]]))])
    found = F.create_map(*[x for bits, turns in TURNS.items() for x in (F.lit(bits), F.array(*[turn(t) for t in turns]))])
    pieces = squares.agg(F.sum("c.bit").cast("int").alias("bits")).filter("bits < 15").withColumn("t", F.explode(found[F.col("bits")]))
    # a piece is known by its first end, in half cells
    name = lambda a, b: F.struct((2 * F.col("i") + F.col(a)).alias("i"), (2 * F.col("j") + F.col(b)).alias("j"))
    ring = written(pieces.select(*keys, name("t.a", "t.b").alias("piece"), name("t.c", "t.d").alias("next")), "pieces")
    state = written(ring.select(*keys, "piece", F.col("next").alias("jump"), F.least("piece", "next").alias("ring")), "rings")
    while True:
        ahead = state.select(*keys, F.col("piece").alias("jump"), F.col("jump").alias("beyond"), F.col("ring").alias("other"))
        moved = state.join(ahead, [*keys, "jump"]).select(*keys, "piece", F.col("beyond").alias("jump"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("changed"))
        state = written(moved, "rings")
        if not state.filter("changed").limit(1).count():
            break
    # cut before the ring's least piece; the rest of the way to the cut is the place in the ring, counted backwards
    named = ring.join(state.select(*keys, "piece", "ring"), [*keys, "piece"])
    last = F.col("next") == F.col("ring")
    left = written(named.select(*keys, "piece", "ring", F.when(~last, F.col("next")).alias("jump"), F.when(last, 0).otherwise(1).alias("left")), "places")
    while left.filter("jump is not null").limit(1).count():
        ahead = left.select(*keys, F.col("piece").alias("jump"), F.col("jump").alias("beyond"), F.col("left").alias("more"))
        moved = left.join(ahead, [*keys, "jump"], "left")
        left = written(moved.select(*keys, "piece", "ring", F.col("beyond").alias("jump"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "places")
    length = left.groupBy(*keys, "ring").agg(F.max("left").alias("most"))
    placed = left.join(length, [*keys, "ring"])
    return placed.select(*keys, "ring", (F.col("most") - F.col("left")).alias("at"), (F.col("piece.i") / 2).alias("i"), (F.col("piece.j") / 2).alias("j"))


def ring_areas(rings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, area: of each ring in cells; negative for the edge of a hole. A sum over its pieces."""
    nxt = rings.select(*keys, "ring", (F.col("at") - 1).alias("at"), F.col("i").alias("i2"), F.col("j").alias("j2"))
    first = rings.filter("at = 0").select(*keys, "ring", F.col("i").alias("i0"), F.col("j").alias("j0"))
    pairs = rings.join(nxt, [*keys, "ring", "at"], "left").join(first, [*keys, "ring"])
    i2, j2 = F.coalesce("i2", "i0"), F.coalesce("j2", "j0")
    return pairs.groupBy(*keys, "ring").agg((F.sum(F.col("i") * j2 - i2 * F.col("j")) / 2).alias("area"))


def mask_polygons(masks: DataFrame, frames: DataFrame, events: DataFrame, part: str = "during", least_area: float = 0.0025) -> DataFrame:
    """K6: id, ring, polygon (KML, longitude and latitude) and area (square degrees) of each outer outline of a mask; part: during or
    after. Smaller ones than least_area and the edges of holes are left out."""
    rings = outlines(masks.filter(part).select("id", "i", "j"), ["id"])
    outer = ring_areas(rings, ["id"]).filter("area > 0").select("id", "ring")
    place = rings.join(outer, ["id", "ring"]).join(frames, "id").join(events.select("id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "id")
    km = lambda c: (F.col(c) * F.col("step_m") - F.col("half_m")) / F.col(f"{part}_m")
    place = place.withColumn("p", geodesy.from_azimuthal(km("i"), km("j"), F.col("lat0"), F.col("lon0")))
    # an outline is no longer than its event's grid has cells
    points = place.groupBy("id", "ring").agg(F.sort_array(F.collect_list(F.struct("at", "p.lon", "p.lat"))).alias("points"))
    nxt = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    area = F.abs(F.aggregate(F.zip_with("points", nxt, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]), F.lit(0.0), lambda s, v: s + v)) / 2
    text = F.transform(F.concat("points", F.slice("points", 1, 1)), lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"]))
    polygon = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.array_join(text, " "), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    return points.select("id", "ring", polygon.alias("polygon"), area.alias("area")).filter(F.col("area") > least_area)


def mask_placemarks(polygons: DataFrame, name: Column) -> DataFrame:
    """K6: placemark lines of outlines, for sinks.kml."""
    return polygons.select(F.concat(F.lit("<Placemark><name>"), name, F.lit("</name>"), F.col("polygon"), F.lit("</Placemark>")).alias("value"))
