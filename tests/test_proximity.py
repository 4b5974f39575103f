"""Nearby points and rings against brute force."""

from __future__ import annotations

import math
import random

import pytest

from histolith.operators.proximity import points_in_rings, points_within

SCHEMA = "id int, x double, y double, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def near(spark, a, b, r, **kw):
    got = points_within(frame(spark, a), frame(spark, b), r, query_key="id", point_key="id", **kw)
    return {(x["id"], x["id_near"]) for x in got.collect()}


def test_grid_equals_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)]
    b = [(i, round(rng.uniform(-50, 50)), round(rng.uniform(-50, 50))) for i in range(300)]
    b = [(i, float(x), float(y)) for i, x, y in b] + [(900, a[0][1] + 7.0, a[0][2])]
    want = {(i, j) for i, x, y in a for j, u, v in b if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 7.0}
    assert near(spark, a, b, 7.0) == want
    assert near(spark, a, b, 7.0, split_rows=2) == want  # every cell is split by salt


def test_radius_is_included_and_bad_rows_match_nothing(spark):
    a = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, float("inf"), 0.0)]
    b = [(1, 6.0, 8.0), (2, 6.0, 8.0000001), (3, None, None), (4, float("inf"), 0.0)]
    assert near(spark, a, b, 10.0) == {(1, 1)}
    assert near(spark, a, [], 10.0) == set() and near(spark, [], b, 10.0) == set()
    assert near(spark, [(1, 2.0, 3.0)], [(5, 2.0, 3.0), (6, 2.0, 3.1)], 0.0) == {(1, 5)}
    with pytest.raises(ValueError):
        near(spark, a, b, -1.0)


def test_great_circle(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(250)]
    pts += [(500, 179.99, 10.0), (501, -179.99, 10.0), (502, 0.0, 89.9), (503, 170.0, 89.9), (504, 0.0, 90.0), (505, 10.0, -90.0), (506, -100.0, -89.95)]

    def gap(p, q):
        f1, f2 = math.radians(p[2]), math.radians(q[2])
        h = math.sin((f2 - f1) / 2) ** 2 + math.cos(f1) * math.cos(f2) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h)))

    for r in (30_000.0, 700_000.0, 5_000_000.0):
        assert near(spark, pts, pts, r, metric="great_circle") == {(p[0], q[0]) for p in pts for q in pts if gap(p, q) <= r}


def inside(spark, points, rings):
    r = spark.createDataFrame([(i, None if v is None else [{"x": x, "y": y} for x, y in v], 1.0) for i, v in rings], "rid int, ring array<struct<x:double,y:double>>, x double")
    return {(x["id"], x["rid"]) for x in points_in_rings(frame(spark, points), r, point_key="id", ring_key="rid").collect()}


def test_rings(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    dented = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    rings = [
        (1, square), (2, square + square[:1]), (3, square[::-1]), (4, dented), (5, None), (6, []), (7, [(1.0, 1.0)] * 4), (8, square[:2]),
        (9, [(0.0, 0.0), (float("nan"), 0.0), (4.0, 4.0)]), (10, [(x * 1000 - 500, y * 1000 - 500) for x, y in square]), (1, square),
    ]
    points = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 3.0), (4, None, 1.0), (5, -100.0, 77.0), (1, 1.0, 1.0), (6, 4.5, 0.5)]
    want = {(1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (6, 4)} | {(i, 10) for i in (1, 2, 3, 5, 6)}
    assert inside(spark, points, rings) == want
    assert inside(spark, points, []) == set() and inside(spark, [], rings) == set()


def test_heavy_cells_on_both_sides(spark):
    """One ring around all points, and a third of the points in one cell: both sides are salted, no pair is lost."""
    rng = random.Random(5)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(200)] + [(200 + i, 50.0 + rng.uniform(0, 0.5), 50.0) for i in range(100)]
    rings = [(1, [(-1.0, -1.0), (101.0, -1.0), (101.0, 101.0), (-1.0, 101.0)])] + [(2 + i, [(x, x), (x + 3, x), (x + 3, x + 3)]) for i, x in enumerate(range(0, 90, 3))]
    r = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in v]) for i, v in rings], "rid int, ring array<struct<x:double,y:double>>")
    ask = lambda n: {(x["id"], x["rid"]) for x in points_in_rings(frame(spark, points), r, point_key="id", ring_key="rid", split_rows=n).collect()}
    want = ask(10**9)
    assert ask(160) == want and {(i, 1) for i in range(300)} <= want
    close = {(i, j) for i, x, y in points for j, u, v in points if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 2.0}
    assert near(spark, points, points, 2.0, split_rows=20) == close
    assert near(spark, points, points, 2.0, unique=True, split_rows=20) == close
