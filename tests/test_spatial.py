import math
import random

import pytest

from ridgeline.operators import spatial as S


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * S.EARTH_KM * math.asin(min(1, math.sqrt(h)))


def inside(x, y, xs, ys):
    odd = False
    for i in range(len(xs)):
        x1, y1, x2, y2 = xs[i - 1], ys[i - 1], xs[i], ys[i]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_near_against_brute_force(spark):
    rng = random.Random(1)
    spots = [(46, 7), (0, 179.99), (0, -179.99), (89.95, 0), (-89.99, 120), (60, 10)]
    around = lambda n: [(i, *(lambda s: (max(-90.0, min(90.0, s[0] + rng.gauss(0, 0.03))), (s[1] + rng.gauss(0, 0.05) + 180) % 360 - 180))(rng.choice(spots))) for i in range(n)]
    points, targets = around(200), around(200)
    p = spark.createDataFrame([*points, (900, None, 1.0), (901, float("nan"), 2.0), (902, 95.0, 1.0)], "pid long, lat double, lon double")
    t = spark.createDataFrame([*targets, (900, None, None)], "tid long, lat double, lon double")
    for salts in (1, 3):
        got = {(r.pid, r.tid) for r in S.near(p, t, 4.0, point=("pid", "lat", "lon"), target=("tid", "lat", "lon"), salts=salts).collect()}
        want = {(i, j) for i, a, b in points for j, c, d in targets if km(a, b, c, d) <= 4.0}
        assert want and got == want


def star(n, cx, cy, rng):
    out = []
    for k in range(n):
        r, a = rng.uniform(0.3, 1.5), 2 * math.pi * k / n
        out.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return [x for x, _ in out], [y for _, y in out]


def test_regions_against_ray_casting(spark):
    rng = random.Random(2)
    rings, rows = {}, []
    for area in range(8):
        xs, ys = star(rng.randint(5, 40), rng.uniform(6, 9), rng.uniform(45, 47), rng)
        hole = star(7, sum(xs) / len(xs), sum(ys) / len(ys), random.Random(area))
        hx, hy = [sum(xs) / len(xs) + (x - sum(xs) / len(xs)) * 0.1 for x in hole[0]], [sum(ys) / len(ys) + (y - sum(ys) / len(ys)) * 0.1 for y in hole[1]]
        rings[area] = (xs, ys, hx, hy)
        closed = area % 2
        turn = -1 if area % 3 else 1
        rows.append((area, 1, False, (ys + ys[:1] * closed)[::turn], (xs + xs[:1] * closed)[::turn]))
        rows.append((area, 2, True, hy, hx))
    rows += [(50, 1, False, None, None), (51, 1, False, [45.0, 46.0], [7.0, 8.0]), (52, 1, False, [45.0, 46.0, 47.0], [7.0, 8.0, 9.0]), (53, 1, False, [], [])]
    areas = spark.createDataFrame(rows, "area_id long, ring_no int, is_hole boolean, ring_lat array<double>, ring_lon array<double>")
    points = [(i, rng.uniform(43, 49), rng.uniform(4, 11)) for i in range(1500)]
    p = spark.createDataFrame([*points, (9999, None, 7.0)], "record_id long, latitude double, longitude double")
    want = {(i, a) for i, y, x in points for a, (xs, ys, hx, hy) in rings.items() if inside(x, y, xs, ys) and not inside(x, y, hx, hy)}
    for limit in (10_000, 3):  # broadcast, and sharded
        got = [(r.record_id, r.area_id) for r in S.containing(p, areas, point=("record_id", "latitude", "longitude"), max_broadcast=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_tables(spark):
    p = spark.createDataFrame([], "record_id long, latitude double, longitude double")
    a = spark.createDataFrame([], "area_id long, ring_no int, is_hole boolean, ring_lat array<double>, ring_lon array<double>")
    t = spark.createDataFrame([], "tid long, lat double, lon double")
    assert S.containing(p, a, point=("record_id", "latitude", "longitude")).count() == 0
    assert S.near(p, t, 4.0, point=("record_id", "latitude", "longitude"), target=("tid", "lat", "lon")).count() == 0


def test_triangles_keep_the_area():
    rng = random.Random(3)
    for _ in range(30):
        xs, ys = star(rng.randint(3, 60), 0, 0, rng)
        t = S.ear_clip(xs, ys)
        part = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) for a, b, c in t)
        whole = abs(sum(xs[i - 1] * ys[i] - xs[i] * ys[i - 1] for i in range(len(xs))))
        assert abs(part - whole) < 1e-9 * max(1, whole)


@pytest.mark.parametrize("limit", [100_000, 3])
def test_circles_against_brute_force(spark, limit):
    rng = random.Random(11)
    spot = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(45, 45.3), rng.uniform(7, 7.3)), (rng.uniform(88.5, 90), rng.uniform(-180, 180)), (rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179.5, 180)), (90.0, 0.0), (-90.0, 10.0)])
    points = [(i, *spot()) for i in range(400)] + [(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, 91.0, 0.0), (3, 45.1, 7.1), (3, 45.1, 7.1)]
    targets = [(i, *spot()) for i in range(120)] + [(500, None, 1.0), (501, 45.1, 7.1)]
    p = spark.createDataFrame([(*r, "clash") for r in points], "pid long, lat double, lon double, area_id string")
    t = spark.createDataFrame(targets, "tid long, lat double, lon double")
    got = sorted((r.pid, r.tid) for r in S.within_circles(p, t, 15.0, point=("pid", "lat", "lon"), target=("tid", "lat", "lon"), max_broadcast=limit, shard=2).collect())

    def km(a, b):
        (_, y1, x1), (_, y2, x2) = a, b
        h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * S.EARTH_KM * math.asin(min(1, math.sqrt(h)))

    ok = lambda r: r[1] is not None and r[1] == r[1] and abs(r[1]) <= 90
    assert got == sorted((a[0], b[0]) for a in points if ok(a) for b in targets if ok(b) and km(a, b) <= 15.0)
    assert S.within_circles(p.limit(0), t, 15.0, point=("pid", "lat", "lon"), target=("tid", "lat", "lon")).count() == 0
