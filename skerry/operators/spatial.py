"""Spatial joins on grid cells: points in zones, and the nearest structure within its own radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import geo
from skerry.schemas import Zone

DEFAULT_RADIUS_M = 300.0
MATCH = "struct<km:double,ord:bigint,id:string,type:string,name:string>"
LEVELS_DEG = (0.02, 0.08, 0.32, 1.28, 5.12, 20.48, 400.0)
"""Cells by level. A structure is on the first level whose cells are as wide and high as its circle's box, so on four cells at most."""


def _cells(rows: DataFrame, south, north, west, east, size) -> DataFrame:
    """One row a covering cell (cy, cx)."""
    rows = rows.withColumn("cy", F.explode(F.sequence(geo.cell(south, size), geo.cell(north, size))))
    return rows.withColumn("cx", F.explode(F.sequence(geo.cell(west, size), geo.cell(east, size))))


def _size(level: str) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in LEVELS_DEG)), F.col(level) + 1)


def structure_hits(points: DataFrame, structures: DataFrame, keys: list[str]) -> DataFrame:
    """keys of a point and each structure whose radius it falls in, with km, the distance rounded to 10 m.

    Structures are spread over the cells, of a level by their radius, that the boxes around their circles touch (across 180
    degrees too). A point meets them by an equi-join on level and cell; levels that no structure is on are left out before
    that. Of what meets, the box is tested first, and the distance only inside it.
    """
    own = structures.select(
        F.col("ord").alias("s_ord"), F.col("id").alias("s_id"), F.col("type").alias("s_type"), F.col("name").alias("s_name"),
        F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), (F.coalesce("match_radius_m", F.lit(DEFAULT_RADIUS_M)) / 1000).alias("s_km")
    )
    high, wide = geo.radius_deg(F.col("s_km"), F.col("s_lat"))
    own = own.withColumns({"s_high": high, "s_wide": wide})
    side = F.greatest("s_high", "s_wide") * 2
    own = own.withColumn("level", sum((F.when(side > x, 1).otherwise(0) for x in LEVELS_DEG[:-1]), F.lit(0)))
    turn = F.array_compact(F.array(
        F.lit(0.0), F.when(F.col("s_lon") + F.col("s_wide") > 180, -360.0), F.when(F.col("s_lon") - F.col("s_wide") < -180, 360.0)
    ))
    own = own.withColumn("turn", F.explode(turn)).withColumn("s_at", F.col("s_lon") + F.col("turn")).drop("turn")
    y, x, size = F.col("s_lat"), F.col("s_at"), _size("level")
    spread = _cells(own, y - F.col("s_high"), y + F.col("s_high"), x - F.col("s_wide"), x + F.col("s_wide"), size)

    at = F.explode(F.array(*(
        F.struct(F.lit(i).alias("level"), geo.cell(F.col("lat"), size).alias("cy"), geo.cell(F.col("lon"), size).alias("cx"))
        for i, size in enumerate(LEVELS_DEG)
    )))
    slim = points.select(*keys, "lat", "lon", at.alias("at")).select(*keys, "lat", "lon", "at.*")
    slim = slim.join(F.broadcast(own.select("level").distinct()), "level", "left_semi")  # a row a level
    near = slim.join(spread, ["level", "cy", "cx"]).filter("abs(lat - s_lat) <= s_high and abs(lon - s_at) <= s_wide")
    km = geo.distance_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    return near.withColumn("km", km).filter("km <= s_km")


def _foremost(structures: DataFrame) -> DataFrame:
    """Structures without those that never are a match: at their place another reaches as far or further and is listed before."""
    place, listed = ["lat", "lon"], ["ord", "id", "type", "name"]
    own = structures.select(*listed, *place, F.coalesce("match_radius_m", F.lit(DEFAULT_RADIUS_M)).alias("match_radius_m"))
    first = own.groupBy(*place, "match_radius_m").agg(F.min(F.struct(*listed)).alias("first"))
    further = Window.partitionBy(*place).orderBy(F.desc("match_radius_m")).rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.min("first").over(further)).filter("before is null or first < before")
    return first.select("first.*", *place, "match_radius_m")


def match_structures(rows: DataFrame, structures: DataFrame) -> DataFrame:
    """rows with fixed_structure: the nearest structure (of equally near ones the first listed), or null.

    A match depends on the place alone. So each place is matched once, however many rows are there, against the structures that
    can be one's match, and only what was found for places meets the rows again.
    """
    places = rows.select("lat", "lon").distinct()
    found = F.min(F.struct("km", F.col("s_ord").alias("ord"), F.col("s_id").alias("id"), F.col("s_type").alias("type"), F.col("s_name").alias("name")))
    best = structure_hits(places, _foremost(structures), []).groupBy("lat", "lon").agg(found.cast(MATCH).alias("fixed_structure"))
    return rows.join(best, ["lat", "lon"], "left").select(*rows.columns, "fixed_structure")


MARGIN_DEG = 1e-9
"""What rounding can move an edge by, at most, where it is cut at the border of a cell."""


def zone_edges(zones: DataFrame) -> DataFrame:
    """zone_id, part and the edges (lat_i, lon_i to lat_j, lon_j) of zones (zone_id, parts: arrays of rings of [lat, lon])."""
    rings = zones.select("zone_id", F.posexplode("parts").alias("part", "rings")).select("zone_id", "part", F.explode("rings").alias("ring"))
    corners = rings.select("zone_id", "part", "ring", F.posexplode("ring").alias("i", "p"))
    before = F.expr("ring[if(i = 0, size(ring) - 1, i - 1)]")
    return corners.select(
        "zone_id", "part", F.col("p")[0].alias("lat_i"), F.col("p")[1].alias("lon_i"), before[0].alias("lat_j"), before[1].alias("lon_j")
    )


def _crossed() -> Column:
    """Whether the edge lies above the point; the arithmetic is that of literal zones."""
    low, high = F.least("lon_i", "lon_j"), F.greatest("lon_i", "lon_j")
    at = (F.col("lat_j") - F.col("lat_i")) * (F.col("lon") - F.col("lon_i")) / F.nullif(F.col("lon_j") - F.col("lon_i"), F.lit(0.0)) + F.col("lat_i")
    return F.coalesce((F.col("lon") >= low) & (F.col("lon") < high) & (F.col("lat") < at), F.lit(False))


def _touched() -> Column:
    """Whether the point is on the edge."""
    level = (F.col("lat") - F.col("lat_i")) * (F.col("lon_j") - F.col("lon_i")) == (F.col("lon") - F.col("lon_i")) * (F.col("lat_j") - F.col("lat_i"))
    between = lambda x, a, b: (F.col(x) >= F.least(a, b)) & (F.col(x) <= F.greatest(a, b))
    return level & between("lat", "lat_i", "lat_j") & between("lon", "lon_i", "lon_j")


def _odd() -> Column:
    return F.count_if(_crossed()) % 2 == 1


def zone_cover(edges: DataFrame, size: float = geo.CELL_DEG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges by column of cells (with cx), the cells that the border touches, and the cells that lie inside: zone_id, part, cy, cx.

    A column's cells between two that the border touches are all inside or all outside, which the middle of one of them decides
    against the column's edges alone.
    """
    columns = edges.withColumn("cx", F.explode(F.sequence(geo.cell(F.least("lon_i", "lon_j"), size), geo.cell(F.greatest("lon_i", "lon_j"), size))))
    run = F.nullif(F.col("lon_j") - F.col("lon_i"), F.lit(0.0))

    def cut(lon: Column) -> Column:
        """The edge's latitude at a longitude of the column, no further than its ends."""
        lon = F.least(F.greatest(lon, F.least("lon_i", "lon_j")), F.greatest("lon_i", "lon_j"))
        return F.col("lat_i") + (F.col("lat_j") - F.col("lat_i")) * (lon - F.col("lon_i")) / run

    a, b = cut(F.col("cx") * size - MARGIN_DEG), cut((F.col("cx") + 1) * size + MARGIN_DEG)
    low, high = F.coalesce(F.least(a, b), F.least("lat_i", "lat_j")), F.coalesce(F.greatest(a, b), F.greatest("lat_i", "lat_j"))
    cells = F.sequence(geo.cell(low - MARGIN_DEG, size), geo.cell(high + MARGIN_DEG, size))
    border = columns.select("zone_id", "part", "cx", F.explode(cells).alias("cy")).distinct()
    up = F.lead("cy").over(Window.partitionBy("zone_id", "part", "cx").orderBy("cy"))
    gaps = border.withColumn("to", up).filter("to > cy + 1")
    middle = gaps.withColumns({"lat": (F.col("cy") + 1.5) * size, "lon": (F.col("cx") + 0.5) * size})
    tested = middle.join(columns, ["zone_id", "part", "cx"]).groupBy("zone_id", "part", "cx", "cy", "to").agg(_odd().alias("in")).filter("in")
    inside = tested.select("zone_id", "part", "cx", F.explode(F.sequence(F.col("cy") + 1, F.col("to") - 1)).alias("cy"))
    return columns, border, inside


def zone_hits(points: DataFrame, zones: DataFrame, keys: list[str], size: float = geo.CELL_DEG, edges_inside: bool = False) -> DataFrame:
    """keys (which name a point) and zone_id where zones are rows (zone_id, and parts: arrays of rings of [lat, lon], or ring: one
    such ring); for registries too large for literals. Rings of a part after its first are holes; with edges_inside points on
    an edge are inside, as GeoJSON covers them.

    Points meet cells by an equi-join. In a cell inside a zone they need no test; in a cell on its border they are tested
    against the edges of their column of cells only, a row an edge, so a zone may have any number of edges.
    """
    several = "parts" in zones.columns
    if not several:
        zones = zones.select("zone_id", F.array(F.array("ring")).alias("parts"))
    columns, border, inside = zone_cover(zone_edges(zones), size)
    slim = points.select(*keys, "lat", "lon", geo.cell(F.col("lat"), size).alias("cy"), geo.cell(F.col("lon"), size).alias("cx"))
    sure = slim.join(inside, ["cy", "cx"]).select(*keys, "zone_id")
    tested = slim.join(border, ["cy", "cx"]).join(columns, ["zone_id", "part", "cx"]).groupBy(*keys, "zone_id", "part")
    found = tested.agg(((_odd() | F.coalesce(F.bool_or(_touched()), F.lit(False))) if edges_inside else _odd()).alias("in")).filter("in")
    hits = sure.unionByName(found.select(*keys, "zone_id"))
    return hits.distinct() if several else hits  # parts may meet


def literal_zone_hits(points: DataFrame, zones: list[Zone], keys: list[str]) -> DataFrame:
    """The same where zones are literals of the plan; no join."""
    found = F.array_compact(F.array(*(F.when(geo.inside(F.col("lat"), F.col("lon"), z.polygon), F.lit(z.id)) for z in zones)))
    return points.select(*keys, F.explode(found).alias("zone_id"))
