"""Points in areas, laid out by rows of edges, against rays cast at whole polygons."""

import math
import random

from larder.operators import geo as G

AREAS = "area_id int, city string, rings array<array<struct<longitude:double,latitude:double>>>, active boolean"
POINTS = "id int, city string, latitude double, longitude double"


def inside(lat, lng, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
            if (ay > lat) != (by > lat) and lng < (bx - ax) * (lat - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def outline(rng, x, y, size, n):
    """A star-shaped ring of n points around (x, y)."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * rng.uniform(0.4, 1) * math.cos(t), y + size * rng.uniform(0.4, 1) * math.sin(t)) for t in turns]


def test_equal_to_whole_polygons(spark):
    rng = random.Random(4)
    areas = []
    for i in range(30):
        x, y, size = rng.uniform(-7, -6), rng.uniform(53, 54), rng.choice([0.005, 0.03, 0.3])
        rings = [outline(rng, x, y, size, rng.choice([3, 8, 60]))]
        if i % 3 == 0:
            rings.append(outline(rng, x, y, size * 0.3, 6))  # a hole, or part of one
        if i % 5 == 0:
            rings.append(outline(rng, x + 0.1, y, size, 5))  # a second piece
        areas.append((i, rng.choice(["Dublin", "cork"]), rings, i % 7 != 6))
    # corners and sides on the lines of the grid
    areas.append((100, "Dublin", [[(-6.0, 53.0), (-5.98, 53.0), (-5.98, 53.02), (-6.0, 53.02)]], True))
    areas += [(101, "Dublin", [[]], True), (102, "Dublin", None, True), (103, "Dublin", [[(-6.5, 53.5)]], True)]
    points = [(i, rng.choice(["dublin", "Cork", None]), rng.uniform(52.8, 54.2), rng.uniform(-7.2, -5.8)) for i in range(1500)]
    points += [(5000 + i, "dublin", 53.0 + 0.01 * (i % 4), -6.01 + 0.01 * (i // 4)) for i in range(16)] + [(6000, "dublin", None, -6.0), (6001, "dublin", 53.0, None)]
    df = spark.createDataFrame(areas, AREAS)
    got = {r.id: r.area_id for r in G.assign_neighbourhoods(spark.createDataFrame(points, POINTS), df).collect()}
    live = [(a, c.lower(), r) for a, c, r, active in areas if active and r and all(r)]
    want = {i: min((a for a, c, r in live if city and lat is not None and lng is not None and c == city.lower() and inside(lat, lng, r)), default=None) for i, city, lat, lng in points}
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_edges_grow_with_the_outline(spark):
    """A large square: its cells are many, its edges few."""
    side = 2.0
    ring = [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]
    laid = G.laid_areas(spark.createDataFrame([(1, "X", [ring], True)], AREAS)).collect()
    rows = round(side / G.CELL) + 1
    assert len(laid) == rows and sum(len(r.edges) for r in laid) == 2 * rows
    # ten times the points, the same line: each small edge is in one row or two
    fine = [(0.0, side * i / 1000) for i in range(1000)] + [(side, side - side * i / 1000) for i in range(1000)]
    laid = G.laid_areas(spark.createDataFrame([(1, "X", [fine], True)], AREAS)).collect()
    assert sum(len(r.edges) for r in laid) <= 2000 + 2 * rows + 2
