"""The grid joins against all pairs, over the whole globe."""

import math
import random

import pytest

from wanderlens.operators import spatial
from wanderlens.operators.spatial import nearest_distance, within_radius


def km(a, b):
    (lng1, lat1), (lng2, lat2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6371.004 * math.asin(min(1.0, math.sqrt(h)))


def spread(rng, count):
    """Points everywhere, in a dense spot, at the poles and on both sides of the date line."""
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(count)]
    points += [(110 + rng.gauss(0, 0.05), 20 + rng.gauss(0, 0.05)) for _ in range(count)]
    points += [(rng.uniform(-180, 180), rng.choice([-1, 1]) * (90 - rng.random() * 0.5)) for _ in range(count // 4)]
    points += [(rng.choice([-1, 1]) * (180 - rng.random() * 0.2), rng.uniform(-1, 1)) for _ in range(count // 4)]
    return points


@pytest.fixture()
def globe(spark):
    rng = random.Random(11)
    centres = [(i, *p, rng.choice([0.05, 0.5, 1.0, 2.5, 12.5, 300.0, 5000.0])) for i, p in enumerate(spread(rng, 60))]
    points = [(i, *p) for i, p in enumerate(spread(rng, 200))]
    return (
        centres, points,
        spark.createDataFrame(centres, "cid int, lng double, lat double, radius_km double"),
        spark.createDataFrame(points, "pid int, lng double, lat double"),
    )


def test_within_radius(globe):
    centres, points, c, p = globe
    expected = {(i, j) for i, *a, r in centres for j, *b in points if km(a, b) <= r}
    found = [(r["cid"], r["pid"]) for r in within_radius(c, p).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 1000


def test_nearest(globe):
    centres, points, c, p = globe
    expected = {i: min(km(a, b) for _, *b in points) for i, *a, _ in centres}
    found = {r["cid"]: r["km"] for r in nearest_distance(c, p, "cid").collect()}
    assert found.keys() == expected.keys()
    assert all(found[i] == pytest.approx(expected[i], abs=1e-5) for i in found)


def test_nearest_over_several_positions_of_one_key(spark):
    c = spark.createDataFrame([(1, 110.0, 20.0), (1, 112.0, 20.0)], "k int, lng double, lat double")
    p = spark.createDataFrame([(112.0, 20.1), (109.0, 20.0), (None, 20.0)], "lng double, lat double")
    assert nearest_distance(c, p, "k").first()["km"] == pytest.approx(11.1195, abs=1e-3)


def test_a_crowded_cube_is_dealt_in_bounded_parts(spark, monkeypatch):
    """All points in one small place, many of them at one position: no task gets more than a part of them."""
    monkeypatch.setattr(spatial, "CROWD", 300)
    rng = random.Random(4)
    points = [(i, 110 + rng.random() * 1e-3, 20 + rng.random() * 1e-3) for i in range(6000)] + [(i, 110.0, 20.0) for i in range(6000, 9000)]
    p = spark.createDataFrame(points, "pid int, lng double, lat double")
    centres = [(1, 110.0, 20.0, 0.08), (2, 110.0005, 20.0005, 2.0), (3, 111.0, 20.0, 1.0)]
    c = spark.createDataFrame(centres, "cid int, lng double, lat double, radius_km double")
    dealt, crowded = spatial._dealt(spatial._point_cubes(p).filter("level < 2"))
    per_part = [r["count"] for r in dealt.groupBy(*spatial.CUBE, "part").count().collect()]
    assert crowded.count() >= 2 and sum(per_part) == 2 * len(points) and max(per_part) < 2 * 300
    expected = {(i, j) for i, *a, r in centres for j, *b in points if km(a, b) <= r}
    found = [(r["cid"], r["pid"]) for r in within_radius(c, p).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 12000
