import math
import random

from harborlight.operators import geo

R = geo.EARTH_KM


def km(a, b):
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def places(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = rng.choice([(10.0, 106.0), (-17.3, 179.99), (89.99, 0.0), (0.0, 0.001)])
        lat, lon = base[0] + rng.uniform(-0.01, 0.01), base[1] + rng.uniform(-0.02, 0.02)
        if base[0] > 80:
            lon = rng.uniform(-180, 180)
        out.append((i, max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180))
    return out


def test_pairs_match_brute_force_at_poles_and_date_line(spark):
    pts = places(250, 1)
    df = geo.valid_points(spark.createDataFrame([(*p, "x") for p in pts], "id long, latitude double, longitude double, lat string").drop("lat"), "id")
    for limit in (0.05, 0.7):
        got = {(r.id_a, r.id_b) for r in geo.close_pairs(df, limit).collect()}
        assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a[1:], b[1:]) <= limit}


def test_invalid_points_take_no_part(spark):
    rows = [(1, None, 1.0), (2, 91.0, 1.0), (3, 1.0, 181.0), (4, 0.0, 0.0), (5, float("nan"), 1.0), (None, 1.0, 1.0), (6, 1.0, 0.0), (6, 1.0, 0.0)]
    df = geo.valid_points(spark.createDataFrame(rows, "id long, latitude double, longitude double"), "id")
    assert [r.id for r in df.collect()] == [6]


def even_odd(ring, lat, lon):
    xs = [ring[0][1]]
    for a, b in zip(ring, ring[1:]):
        xs.append(xs[-1] + (b[1] - a[1] + 180) % 360 - 180)
    hit = False
    for shift in (-360, 0, 360):
        x, inside, j = lon + shift, False, len(ring) - 1
        for i in range(len(ring)):
            if (ring[i][0] > lat) != (ring[j][0] > lat) and x < (xs[j] - xs[i]) * (lat - ring[i][0]) / (ring[j][0] - ring[i][0]) + xs[i]:
                inside = not inside
            j = i
        hit |= inside
    return hit


def test_regions_match_even_odd_over_the_date_line(spark):
    rng = random.Random(3)
    rings = {}
    for k in range(12):
        c = rng.choice([(10.0, 106.0), (-17.3, 179.95), (60.0, -179.9)])
        size = rng.choice([0.01, 0.3, 20.0])
        n = rng.randint(3, 9)
        rings[k] = [(max(-89, min(89, c[0] + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n) / 2)), (c[1] + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n) + 180) % 360 - 180) for i in range(n)]
    pts = [(i, rng.uniform(-40, 70), rng.uniform(-180, 180)) for i in range(150)] + [(1000 + i, c[0] + rng.uniform(-0.2, 0.2), (c[1] + rng.uniform(-0.2, 0.2) + 180) % 360 - 180) for i, c in enumerate([(10.0, 106.0), (-17.3, 179.95)] * 100)]
    regions = spark.createDataFrame([(k, [{"latitude": a, "longitude": o} for a, o in r]) for k, r in rings.items()] + [(99, None), (98, [])], "id long, boundary array<struct<latitude:double,longitude:double>>")
    points = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.id_a, r.id_b) for r in geo.within_regions(points, regions).collect()}
    assert got == {(p[0], k) for p in pts for k, r in rings.items() if even_odd(r, p[1], p[2])}
    assert geo.within_regions(points, regions.limit(0)).count() == 0
    assert geo.within_regions(points.limit(0), regions).count() == 0


def test_wrong_distances_leave_out_unknown_ends(spark):
    points = spark.createDataFrame([(1, 10.0, 106.0)], "id long, lat double, lon double")
    marks = spark.createDataFrame([(7, 10.0, 106.01)], "id long, lat double, lon double")
    true = km((10.0, 106.0), (10.0, 106.01))
    rows = [(1, 1, 7, true + 0.04), (2, 1, 7, true + 0.2), (3, 1, 8, 0.0), (4, 2, 7, 0.0), (5, 1, 7, None), (2, 1, 7, true + 0.2)]
    claims = spark.createDataFrame(rows, "id long, point_id long, place_id long, km double")
    assert [(r.id, r.place_id) for r in geo.wrong_distances(claims, points, marks, 0.05).collect()] == [(2, 7)]
