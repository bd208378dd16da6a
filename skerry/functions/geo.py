"""Geometry as column expressions: ray casting, covering, distances, grid cells.

A polygon known when the plan is built becomes plain arithmetic over its edges, so it stays inside generated code; where
polygons are rows, `skerry.operators.spatial` joins them by grid cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
CELL_DEG = 0.05
# A distance is rounded to 10 m before it is compared, so a box must be that much wider.
ROUNDING_KM = 0.005


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, rounded to two decimals."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.round(F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a)), 2)


def _parity(edges: list[tuple[float, float, float, float]], lat: Column, lon: Column) -> Column:
    """Whether an odd number of edges (lat, lon, lat, lon) lies above the point."""
    inside = F.lit(False)
    for lat_i, lon_i, lat_j, lon_j in edges:
        if lon_i == lon_j:
            continue  # such an edge is never crossed
        low, high = min(lon_i, lon_j), max(lon_i, lon_j)
        at = F.lit(lat_j - lat_i) * (lon - F.lit(lon_i)) / F.lit(lon_j - lon_i) + F.lit(lat_i)
        inside = inside != ((lon >= F.lit(low)) & (lon < F.lit(high)) & (lat < at))
    return inside


def ring_edges(ring) -> list[tuple[float, float, float, float]]:
    points = [(float(a), float(b)) for a, b in ring]
    return [(*points[i], *points[i - 1]) for i in range(len(points))]


def in_ring(lat: Column, lon: Column, ring) -> Column:
    """Even-odd rule over a ring of (lat, lon): for a box, its lower edges are inside, its upper ones are not."""
    points = [(float(a), float(b)) for a, b in ring]
    if not points:
        return F.lit(False)
    lats, lons = [p[0] for p in points], [p[1] for p in points]
    box = lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons))
    return box & _parity(ring_edges(points), lat, lon)


def parts_of(geometry) -> list[list[list[tuple[float, float]]]]:
    """A GeoJSON polygon or multipolygon as parts of rings of (lat, lon)."""
    kind, coordinates = geometry["type"], geometry["coordinates"]
    if kind not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"geometry type {kind!r} is not supported")
    parts = [coordinates] if kind == "Polygon" else coordinates
    return [[[(float(y), float(x)) for x, y, *_ in ring] for ring in part] for part in parts]


def in_geometry(lat: Column, lon: Column, geometry) -> Column:
    """Covered by a GeoJSON geometry: inside a part and outside its holes, or on any edge."""
    covered = F.lit(False)
    for part in parts_of(geometry):
        edges = [e for ring in part for e in ring_edges(ring)]
        on = F.lit(False)
        for a, b, c, d in edges:
            level = (lat - F.lit(a)) * F.lit(d - b) == (lon - F.lit(b)) * F.lit(c - a)
            on = on | (level & lat.between(min(a, c), max(a, c)) & lon.between(min(b, d), max(b, d)))
        covered = covered | on | _parity(edges, lat, lon)
    return covered


def inside(lat: Column, lon: Column, polygon) -> Column:
    return in_geometry(lat, lon, polygon) if isinstance(polygon, dict) else in_ring(lat, lon, polygon)


def centroid(polygon) -> tuple[float, float]:
    """(lat, lon): the mean of a ring's vertices, or the area centroid of a GeoJSON geometry."""
    if not isinstance(polygon, dict):
        return sum(p[0] for p in polygon) / len(polygon), sum(p[1] for p in polygon) / len(polygon)
    area = y = x = 0.0
    for part in parts_of(polygon):
        for k, ring in enumerate(part):
            own = own_y = own_x = 0.0
            for a, b, c, d in ring_edges(ring):
                cross = d * a - b * c
                own, own_y, own_x = own + cross / 2, own_y + (a + c) * cross / 6, own_x + (b + d) * cross / 6
            turn = (1 if own > 0 else -1) * (-1 if k else 1)  # the first ring adds, holes take away
            area, y, x = area + turn * own, y + turn * own_y, x + turn * own_x
    return y / area, x / area


def cell(value: Column, size: float | Column = CELL_DEG) -> Column:
    return F.floor(value / (size if isinstance(size, Column) else F.lit(size))).cast("long")


def radius_deg(km: Column, lat: Column) -> tuple[Column, Column]:
    """Half widths in degrees of a box that holds the circle, rounding included."""
    reach = km + F.lit(ROUNDING_KM)
    high = F.degrees(reach / F.lit(EARTH_KM))
    # The meridians that touch the circle; one with a pole in it meets all of them.
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(reach / F.lit(EARTH_KM)) / F.greatest(F.cos(F.radians(F.abs(lat))), F.lit(1e-9)))))
    return high, F.when(F.abs(lat) + high >= 90, F.lit(180.0)).otherwise(wide)


def flip(polygon: Column) -> Column:
    """[lat, lon] pairs as [lon, lat]."""
    return F.transform(polygon, lambda p: F.array(p[1], p[0]))


def mean_centre(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.coalesce(F.avg(lat), F.lit(36.6)), F.coalesce(F.avg(lon), F.lit(-6.9))
