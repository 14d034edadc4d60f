"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from ..operators import geo, shred
from . import catalogue, knowledge, objects, serving

QUERIES: dict[str, Callable] = {
    "p2_found": shred.p2_found,
    "p2_faq": shred.p2_faq,
    "p2_comments": shred.p2_comments,
    "p2_members": shred.p2_members,
    "p3_found": geo.p3_found,
    **serving.QUERIES,
    **knowledge.QUERIES,
    **catalogue.QUERIES,
    **objects.QUERIES,
}

_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"


def _p3() -> str:
    km = lambda a, b: _KM.format(a=a, b=b)
    return f"""
WITH h AS (SELECT DISTINCT id, latitude, longitude FROM hotels
           WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
corner AS (SELECT area_id, unnest(boundary) AS p, generate_subscripts(boundary, 1) AS i, len(boundary) AS n FROM areas),
side AS (SELECT a.area_id, a.p.latitude AS lat1, a.p.longitude AS lon1, b.p.latitude AS lat2,
                (b.p.longitude - a.p.longitude + 540) - 360 * floor((b.p.longitude - a.p.longitude + 540) / 360) - 180 AS d
         FROM corner a JOIN corner b ON a.area_id = b.area_id AND b.i = a.i % a.n + 1),
west AS (SELECT area_id, CASE WHEN d >= 0 THEN lon1 ELSE lon1 + d END AS lon, CASE WHEN d >= 0 THEN lat1 ELSE lat2 END AS lat,
                abs(d) AS span, CASE WHEN d >= 0 THEN lat2 - lat1 ELSE lat1 - lat2 END AS rise FROM side WHERE d <> 0),
met AS (SELECT h.id, w.area_id, w.lat + w.rise * ((h.longitude - w.lon) - 360 * floor((h.longitude - w.lon) / 360)) / w.span AS border, h.latitude
        FROM h JOIN west w ON (h.longitude - w.lon) - 360 * floor((h.longitude - w.lon) / 360) < w.span)
SELECT 'hotel' AS kind, a.id AS id_a, b.id AS id_b FROM h a JOIN h b ON a.id < b.id WHERE {km("a", "b")} <= 0.05
UNION ALL
SELECT 'landmark', h.id, l.landmark_id FROM h JOIN landmarks l ON abs(h.latitude - l.latitude) < 0.02 WHERE {km("h", "l")} <= 2
UNION ALL
SELECT 'area', id, area_id FROM met WHERE border > latitude GROUP BY id, area_id HAVING count(*) % 2 = 1
UNION ALL
SELECT DISTINCT 'nearby', n.id, n.landmark_id FROM nearby_places n JOIN h ON h.id = n.hotel_id JOIN landmarks l ON l.landmark_id = n.landmark_id
WHERE n.distance_km IS NOT NULL AND abs(CAST(n.distance_km AS DOUBLE) - {km("h", "l")}) > 0.05
"""


ORACLE: dict[str, str] = {"p3_found": _p3(), **serving.ORACLE, **knowledge.ORACLE, **catalogue.ORACLE, **objects.ORACLE}
