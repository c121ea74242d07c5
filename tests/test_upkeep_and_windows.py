"""Flags kept by changes, cascades, windows as chains, and records valid at a time, against plain recomputations."""

import random
from datetime import datetime, timedelta

import pytest

from driftline.operators import joins, upkeep, windows
from driftline.operators.selection import KEY

S = "NetworkCode string, StationCode string"


def test_changes_of_a_table(spark):
    was = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (None, "d", 3)], "k int, a string, b int")
    now = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "e", 2), (None, "d", 3)], "k int, a string, b int")
    assert {(r["k"], r["change"]) for r in upkeep.changes(was, now, ["k"]).collect()} == {(2, "update"), (3, "delete"), (4, "insert")}
    assert upkeep.changes(was, was, ["k"]).count() == 0 and upkeep.changes(was.limit(0), was, ["k"]).count() == 4


def test_flags_equal_those_computed_from_nothing(spark):
    r = random.Random(3)
    stations = [("n", f"s{i}") for i in range(12)]
    records = [(*r.choice(stations), k, r.randrange(3)) for k in range(25)]
    files = [(*r.choice(stations), k, r.randrange(3)) for k in range(25)]
    meta = {s: (False, any(x[:2] == s for x in records)) for s in stations}
    schema = f"{S}, id int, v int"
    for _ in range(3):
        after = [[(*x[:3], x[3] + (r.random() < 0.1)) for x in rows if r.random() < 0.9] + [(*r.choice(stations), r.randrange(100, 999), 0)] for rows in (files, records)]
        keys = [*KEY, "id"]
        f0, r0, f1, r1 = (spark.createDataFrame(x, schema) for x in (files, records, *after))
        table = spark.createDataFrame([(*s, *v) for s, v in meta.items()], f"{S}, has_gaps_update_needed boolean, has_stationinfo boolean")
        got = {(x[0], x[1]): (x[2], x[3]) for x in upkeep.kept_flags(table, upkeep.changes(f0, f1, keys), upkeep.changes(r0, r1, keys), r1).collect()}
        hit = {x[:2] for old, new in ((files, after[0]), (records, after[1])) for x in set(old) ^ set(new)}
        meta = {s: (v[0] or s in hit, any(x[:2] == s for x in after[1])) for s, v in meta.items()}
        assert got == meta
        files, records = after


def test_aliases_that_are_codes_are_refused(spark):
    stations = spark.createDataFrame([("n", "abcd"), ("n", "efgh")], S)
    new = spark.createDataFrame([("n", "abcd", "efgh"), ("n", "abcd", "ijkl"), ("n", "efgh", None)], f"{S}, StationAlias string")
    good, refused = upkeep.split_aliases(stations, new)
    assert {r["StationAlias"] for r in good.collect()} == {"ijkl", None} and {r["StationAlias"] for r in refused.collect()} == {"efgh"}


def test_cascade_over_three_levels(spark):
    t = {
        "stations": spark.createDataFrame([("n", "a", 1), ("n", "b", 2)], f"{S}, api_id int"), "visits": spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "id int, station_id int"),
        "images": spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "id int, visit_id int"), "files": spark.createDataFrame([("n", "a", 5), ("n", "b", 6)], f"{S}, x int"), "rinex": spark.createDataFrame([("n", "a")], S),
    }
    links = [upkeep.Link("visits", ("station_id",), "stations", ("api_id",)), upkeep.Link("images", ("visit_id",), "visits", ("id",)), upkeep.Link("files", tuple(KEY), "stations", tuple(KEY))]
    left = upkeep.cascade(t, "stations", t["stations"].filter("StationCode = 'a'"), links)
    ids = lambda n, c: {r[c] for r in left[n].collect()}
    assert ids("stations", "api_id") == {2} and ids("visits", "id") == {12, 13} and ids("images", "id") == {3} and ids("files", "x") == {6} and left["rinex"].count() == 1


def folded(events, days):
    """The strongest event of each window of one key, one event after the other."""
    out, start, best = [], None, None
    for d, m in sorted(events, key=lambda e: (e[0], -e[1])):
        if start is None or d > start + days:
            out += [best] if best else []
            start, best = d, (d, m)
        elif m > best[1]:
            best = (d, m)
    return out + ([best] if best else [])


@pytest.mark.parametrize("days", [15.0, 0.7])
def test_windows_equal_a_fold(spark, days):
    r = random.Random(4)
    rows = [(k, round(r.random() * 400, r.randrange(3)), round(r.random() * 4, 1)) for k in ("a", "b", None) for _ in range(150)]
    rows += [("c", 3.0, 1.0), ("d", 0.0, 1.0), ("d", 15.0, 2.0), ("d", 30.0, 3.0), ("d", 30.0, 3.0), ("d", -100.5, 1.0), ("d", 9000.0, 1.0)]
    got = windows.strongest_in_window(spark.createDataFrame([*rows, ("d", None, 9.0)], "k string, t double, m double"), ["k"], "t", "m", days).collect()
    want = [(k, *e) for k in ("a", "b", "c", "d", None) for e in folded([x[1:] for x in rows if x[0] == k], days)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert windows.strongest_in_window(spark.createDataFrame([], "k string, t double, m double"), ["k"], "t", "m").count() == 0


@pytest.mark.parametrize("tolerance", [0, 40_000])
def test_record_valid_at_a_time(spark, tolerance):
    """Records that overlap, lie in one another, are open or empty; points between them; against all pairs."""
    r = random.Random(5)
    at = lambda: datetime(2020, 1, 1) + timedelta(hours=r.randrange(900))
    records = [("n", f"s{r.randrange(4)}", start := at(), None if r.random() < 0.1 else start + timedelta(hours=r.randrange(200)), i) for i in range(60)]
    starts = set()
    records = [x for x in records if not ((x[1], x[2]) in starts or starts.add((x[1], x[2])))]
    points = [("n", f"s{r.randrange(5)}", at(), i) for i in range(300)] + [("n", "s1", None, 900), ("n", None, at(), 901)]
    found = joins.valid_at(spark.createDataFrame(points, f"{S}, t timestamp_ntz, p int"), spark.createDataFrame(records, f"{S}, DateStart timestamp_ntz, DateEnd timestamp_ntz, x int"), KEY, "t", tolerance)
    far, slack = datetime(9999, 12, 31), timedelta(seconds=tolerance)
    want = {}
    for _, code, t, p in points:
        own = [x for x in records if t and x[1] == code and x[2] - slack <= t <= (x[3] or far) + (slack if x[3] else timedelta())]
        if own:
            want[p] = min(own, key=lambda x: x[2])[4]
    assert {g["p"]: g["x"] for g in found.collect()} == want


def test_rows_of_one_time_join_no_run_from_before(spark):
    """As a running sum over a range has it: the changes among rows of equal order come before all of them."""
    rows = [("x", 1, "a"), ("x", 2, "a"), ("x", 2, "b"), ("x", 3, "c"), ("y", 1, "b"), ("y", 2, "b"), ("y", 2, "a"), ("y", 3, "c"), ("z", 1, "a"), ("z", 2, "a"), ("z", 2, "a")]
    found = windows.runs(spark.createDataFrame(rows, "k string, t int, v string"), ["k"], "t", ["v"])
    want = [("x", 1, 1, "a", 1), ("x", 2, 2, "a", 1), ("x", 2, 2, "b", 1), ("x", 3, 3, "c", 1), ("y", 1, 1, "b", 1), ("y", 2, 2, "a", 1), ("y", 2, 2, "b", 1), ("y", 3, 3, "c", 1), ("z", 1, 2, "a", 3)]
    assert sorted((r["k"], r["first"], r["last"], r["v"], r["n"]) for r in found.collect()) == want
