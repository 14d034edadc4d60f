"""Problem 3: points near other points or within regions, by space-filling-curve codes and exact refinement."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut_lineage, table

#: Fixed value: the mean radius of the earth in km.
EARTH_KM = 6371.0088
_BITS = 21  # by axis of the sphere's cube
_FLAT = 26  # by axis of the latitude-longitude plane
#: Cells that a region's cover may have before it is refined no further.
COVER_CELLS = 96


def _interleave(axes: list[str], bits: int) -> Column:
    """The Morton code of the indices in the columns ``axes``: their bits by turns, the lowest of the first axis lowest."""
    n = len(axes)
    terms = [F.shiftleft(F.shiftright(F.col(a), b).bitwiseAND(F.lit(1)), n * b + k) for b in range(bits) for k, a in enumerate(axes)]
    return reduce(lambda x, y: x.bitwiseOR(y), terms, F.lit(0).cast("long"))


def _cube(lat: str, lon: str) -> list[Column]:
    """A point on the unit sphere."""
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def _index(x: Column, level: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << level) - 1), F.floor((x + 1) / 2 * (1 << level)))).cast("long")


def distance_km(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> Column:
    """Great-circle distance on the sphere, by the haversine formula."""
    dlat, dlon = F.radians(F.col(lat_b) - F.col(lat_a)), F.radians(F.col(lon_b) - F.col(lon_a))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def valid_points(df: DataFrame, key: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(id, lat, lon) of the rows with a place on earth, one per key: both coordinates, within range, not exactly (0, 0)."""
    some = df.where(F.col(key).isNotNull() & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~((F.col(lat) == 0) & (F.col(lon) == 0)))
    return some.select(F.col(key).cast("long").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropDuplicates(["id"])


def within_distance(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(id_a, id_b, km): points ``id_a`` and centres ``id_b`` (both id, lat, lon) at most ``km`` apart.

    Points get a Morton code of their place in the cube around the sphere, which has neither poles nor a date line. A disc
    is covered by the up to eight cells, at the level whose cells are no smaller than the disc, that its box touches; each
    is a range of codes with one prefix, so the range join on the sorted codes is an equi-join on the prefix. What comes
    out is refined by the exact distance. A point meets a centre in one cell only. Cells bound a busy place to itself;
    skewed ones are split by adaptive execution.
    """
    if km <= 0:
        raise ValueError("km must be positive")
    level = max(0, min(_BITS, math.floor(math.log2(EARTH_KM / km))))
    reach = km / EARTH_KM + 1e-9
    axes = dict(zip("xyz", _cube("lat", "lon")))
    a = points.select("id", "lat", "lon", *(_index(v, level).alias(k) for k, v in axes.items()))
    a = a.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), _interleave([*axes], level).alias("cell"))
    b = centres.select("id", "lat", "lon", *(v.alias(k) for k, v in axes.items()))
    for k in axes:
        b = b.withColumn(k, F.explode(F.array_distinct(F.array(_index(F.col(k) - reach, level), _index(F.col(k) + reach, level)))))
    b = b.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), _interleave([*axes], level).alias("cell"))
    return a.join(b, "cell").withColumn("km", distance_km("lat_a", "lon_a", "lat_b", "lon_b")).where(F.col("km") <= km).select("id_a", "id_b", "km")


def close_pairs(points: DataFrame, km: float) -> DataFrame:
    """(id_a, id_b, km) of all pairs of points at most ``km`` apart, the smaller id first, each once."""
    return within_distance(points, points, km).where("id_a < id_b")


def _edges(ring: np.ndarray) -> np.ndarray:
    """(west, span, latitude there, slope) of a ring's sides, each the shorter way around; ring holds (latitude, longitude)."""
    nxt = np.roll(ring, -1, 0)
    d = (nxt[:, 1] - ring[:, 1] + 180) % 360 - 180
    west, lat = np.where(d >= 0, ring[:, 1], nxt[:, 1]), np.where(d >= 0, ring[:, 0], nxt[:, 0])
    span = np.abs(d)
    rise = np.where(d >= 0, nxt[:, 0] - ring[:, 0], ring[:, 0] - nxt[:, 0])
    return np.stack([west, span, lat, np.divide(rise, span, out=np.zeros_like(rise), where=span > 0)], 1)


def _cover(ring: np.ndarray, cells: int) -> list[tuple[int, int, int, bool]]:
    """(level, x, y, inside) of plane cells that cover a region; those inside need no refinement.

    Descends level by level from the cells around the region's box while there are about ``cells`` at most.
    """
    lon = ring[0, 1] + np.concatenate([[0], np.cumsum((np.diff(ring[:, 1]) + 180) % 360 - 180)])
    lat = ring[:, 0]
    x1, y1, x2, y2 = lon, lat, np.roll(lon, -1), np.roll(lat, -1)
    x2 = x1 + (x2 - x1 + 180) % 360 - 180

    def touches(w, s, e, n) -> np.ndarray:
        """For each rectangle, whether a side meets it: every side is clipped to every rectangle."""
        t0, t1 = np.zeros((len(w), len(x1))), np.ones((len(w), len(x1)))
        ok = np.ones((len(w), len(x1)), bool)
        for p, d, lo, hi in ((x1, x2 - x1, w[:, None], e[:, None]), (y1, y2 - y1, s[:, None], n[:, None])):
            flat = d == 0
            ok &= ~flat | ((p >= lo) & (p <= hi))
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (lo - p) / d, (hi - p) / d
            t0 = np.where(flat, t0, np.maximum(t0, np.minimum(a, b)))
            t1 = np.where(flat, t1, np.minimum(t1, np.maximum(a, b)))
        return (ok & (t0 <= t1)).any(1)

    def inside(px, py) -> np.ndarray:
        lo, hi = np.minimum(x1, x2), np.maximum(x1, x2)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = y1 + (y2 - y1) * (px[:, None] - x1) / (x2 - x1)
        return ((px[:, None] >= lo) & (px[:, None] < hi) & (at > py[:, None])).sum(1) % 2 == 1

    w, e, s, n = min(x1.min(), x2.min()), max(x1.max(), x2.max()), y1.min(), y1.max()
    level = int(np.clip(math.floor(math.log2(360 / max(e - w, 2 * (n - s), 1e-6))), 0, _FLAT))
    side = 1 << level
    xs = np.arange(math.floor((w + 180) / (360 / side)), math.floor((e + 180) / (360 / side)) + 1)
    ys = np.arange(max(0, math.floor((s + 90) / (180 / side))), min(side - 1, math.floor((n + 90) / (180 / side))) + 1)
    x, y = (a.ravel() for a in np.meshgrid(xs, ys))
    done: list[tuple[int, int, int, bool]] = []
    while len(x):
        dx, dy = 360 / (1 << level), 180 / (1 << level)
        west, south = x * dx - 180, y * dy - 90
        border = touches(west - 1e-9, south - 1e-9, west + dx + 1e-9, south + dy + 1e-9)
        full = ~border & inside(west + dx / 2, south + dy / 2)
        wrap = 1 << level
        done += [(level, int(a) % wrap, int(b), True) for a, b in zip(x[full], y[full])]
        x, y = x[border], y[border]
        if len(done) + 4 * len(x) > cells or level == _FLAT:
            done += [(level, int(a) % wrap, int(b), False) for a, b in zip(x, y)]
            break
        x, y = np.concatenate([2 * x, 2 * x + 1, 2 * x, 2 * x + 1]), np.concatenate([2 * y, 2 * y, 2 * y + 1, 2 * y + 1])
        level += 1
    return done


def _ring(corners) -> np.ndarray | None:
    pts = [(c["latitude"], c["longitude"]) for c in corners if c is not None] if corners is not None else []
    if len(pts) < 3 or any(v is None or not math.isfinite(v) for p in pts for v in p):
        return None
    return np.array(pts, float)


def _covers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [(key, *c) for key, corners in zip(pdf["id"], pdf["boundary"]) if (ring := _ring(corners)) is not None for c in _cover(ring, COVER_CELLS)]
        yield pd.DataFrame(rows, columns=["id_b", "level", "x", "y", "inside"])


def _sides(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [(key, _edges(ring).tolist()) for key, corners in zip(pdf["id"], pdf["boundary"]) if (ring := _ring(corners)) is not None]
        yield pd.DataFrame(rows, columns=["id_b", "sides"])


def within_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(id_a, id_b): points ``id_a`` (id, lat, lon) in regions ``id_b`` (id, boundary: corners of latitude and longitude).

    Regions are covered by cells of the plane's Morton curve, each a range of codes with one prefix; a point is looked for
    at every level that the covers use. Points in cells within a region are in it; those in cells at its border are
    refined: in it if a meridian north of them is crossed by an odd number of sides. Sides are straight in latitude and
    longitude and go the shorter way around. Regions of fewer than three corners, or with a corner not known, hold
    nothing. Regions may overlap; each pair comes once.
    """
    spark = regions.sparkSession
    own = regions.select("id", "boundary").dropDuplicates(["id"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    cells = own.mapInPandas(_covers, "id_b long, level int, x long, y long, inside boolean").select("id_b", "level", "inside", _interleave(["x", "y"], _FLAT).alias("cell"))
    cells = cut_lineage(cells)  # covers are dear, and used for the levels and for the join
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # at most 27
    if not levels:
        return points.select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).limit(0)
    top = float((1 << _FLAT) - 1)
    x = F.least(F.lit(top), F.floor((F.col("lon") + 180) / 360 * (1 << _FLAT))).cast("long")
    y = F.least(F.lit(top), F.floor((F.col("lat") + 90) / 180 * (1 << _FLAT))).cast("long")
    coded = points.select("id", "lat", "lon", x.alias("x"), y.alias("y")).select("id", "lat", "lon", _interleave(["x", "y"], _FLAT).alias("code"))
    at = coded.select(F.col("id").alias("id_a"), "lat", "lon", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("code", 2 * (_FLAT - k)).alias("cell")) for k in levels))).alias("p")).select("id_a", "lat", "lon", "p.level", "p.cell")
    met = at.join(cells, ["level", "cell"])
    sides = own.mapInPandas(_sides, "id_b long, sides array<array<double>>")
    border = met.where("not inside").join(sides, "id_b")
    crossed = F.expr("size(filter(sides, s -> pmod(lon - s[0], 360.0D) < s[1] and s[2] + s[3] * pmod(lon - s[0], 360.0D) > lat))")
    return met.where("inside").select("id_a", "id_b").unionAll(border.where(crossed % 2 == 1).select("id_a", "id_b")).distinct()


def wrong_distances(claims: DataFrame, points: DataFrame, places: DataFrame, tolerance_km: float) -> DataFrame:
    """(id, place_id) of claims (id, point_id, place_id, km) that differ by more than ``tolerance_km`` from the distance that
    the coordinates give. Claims without a distance, or whose ends have no place, are left out."""
    some = claims.where("km is not null and point_id is not null and place_id is not null")
    a = points.select(F.col("id").alias("point_id"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = places.select(F.col("id").alias("place_id"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    far = some.join(b, "place_id").join(a, "point_id").where(F.abs(F.col("km") - distance_km("lat_a", "lon_a", "lat_b", "lon_b")) > tolerance_km)
    return far.select("id", "place_id").distinct()


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Close hotels, landmarks near hotels, areas of hotels, and nearby places with a wrong distance."""
    hotels = valid_points(table(spark, sf_dir, "hotels"), "id")
    landmarks = valid_points(table(spark, sf_dir, "landmarks"), "landmark_id")
    areas = table(spark, sf_dir, "areas").select(F.col("area_id").alias("id"), "boundary")
    nearby = table(spark, sf_dir, "nearby_places").select("id", F.col("hotel_id").alias("point_id"), F.col("landmark_id").alias("place_id"), F.col("distance_km").cast("double").alias("km"))
    row = lambda kind, a, b: (F.lit(kind).alias("kind"), F.col(a).alias("id_a"), F.col(b).alias("id_b"))
    parts = [
        close_pairs(hotels, 0.05).select(*row("hotel", "id_a", "id_b")),
        within_distance(hotels, landmarks, 2).select(*row("landmark", "id_a", "id_b")),
        within_regions(hotels, areas).select(*row("area", "id_a", "id_b")),
        wrong_distances(nearby, hotels, landmarks, 0.05).select(*row("nearby", "id", "place_id")),
    ]
    return reduce(DataFrame.unionAll, parts)
