"""Raster front-end: moving sums, speckle filter, constant-false-alarm detection, blobs and labels.

Pixels are rows (chip_id, row, col, value); rows_n and cols_n are a chip's size. Moving sums are two separable windows over
pixels mirrored at the edges (without repeating the edge). Pixels are dealt by chip once, and all windows keep to that.

With `tile` a chip may be larger than a task: its pixels are dealt to square tiles, each with a halo as wide as the windows
reach, so a tile's sums are those of the whole chip. Components are labelled in each tile; labels that touch across a border
are joined, so a blob over any number of tiles is one, numbered as in the whole chip.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import graph, order
from skerry.sources import files


@dataclass(frozen=True)
class Cfar:
    pfa: float = 1e-4
    guard_radius: int = 2
    train_radius: int = 6
    enl: float = 4.0
    min_area_px: int = 2
    pixel_spacing_m: float = 10.0

    def __post_init__(self) -> None:
        if self.train_radius <= self.guard_radius:
            raise ValueError("train_radius must exceed guard_radius")

    @property
    def cells(self) -> int:
        return (2 * self.train_radius + 1) ** 2 - (2 * self.guard_radius + 1) ** 2

    @property
    def alpha(self) -> float:
        return self.cells * (self.pfa ** (-1.0 / self.cells) - 1.0)


@dataclass(frozen=True)
class Affine:
    origin_lat: float = 36.90
    origin_lon: float = -7.20
    pixel_deg_lat: float = 0.00009
    pixel_deg_lon: float = 0.00011


LEE_RADIUS = 3
# Fixed value: the id of a detection, by its number.
NUMBERED = "S1-%03d"
CHIP, TILE = ("chip_id",), ("chip_id", "tile_row", "tile_col")
"""What a task holds together."""


def _mirror(at: str, size: str, radius: int) -> Column:
    """All places that a pixel takes once its axis is mirrored at both ends."""
    i, n = F.col(at), F.col(size)
    low, high = F.when((i >= 1) & (i <= radius), -i), F.when((i <= n - 2) & (i >= n - 1 - radius), (n - 1) * 2 - i)
    return F.explode(F.array_compact(F.array(i, low, high)))


def _pass(pixels: DataFrame, along: str, across: str, size: str, names: list[str], radius: int, within: tuple[str, ...]) -> DataFrame:
    wide = pixels.withColumn("_at", _mirror(along, size, radius))
    by = Window.partitionBy(*within, across).orderBy("_at").rowsBetween(-radius, radius)
    return wide.withColumns({n: F.sum(n).over(by) for n in names}).filter(F.col("_at") == F.col(along)).drop("_at")


def box_sum(pixels: DataFrame, values: dict[str, Column], radius: int, within: tuple[str, ...] = CHIP) -> DataFrame:
    """Sums over the (2 radius + 1) square around every pixel; a chip must be larger than the radius. Within tiles the sums of
    pixels whose square reaches beyond the halo are those of a part."""
    rows = pixels.withColumns(values)
    rows = _pass(rows, "col", "row", "cols_n", list(values), radius, within)
    return _pass(rows, "row", "col", "rows_n", list(values), radius, within)


def tiled(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """pixels dealt to tiles of tile by tile, with tile_row, tile_col and own: whether the tile holds the pixel or has it in its
    halo only."""
    near = lambda c, n: F.sequence(
        F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / tile).cast("int"), F.floor(F.least(F.col(c) + halo, F.col(n) - 1) / tile).cast("int")
    )
    rows = pixels.withColumn("tile_row", F.explode(near("row", "rows_n"))).withColumn("tile_col", F.explode(near("col", "cols_n")))
    here = (F.floor(F.col("row") / tile) == F.col("tile_row")) & (F.floor(F.col("col") / tile) == F.col("tile_col"))
    return rows.withColumn("own", here)


def lee(pixels: DataFrame, enl: float = 4.0, radius: int = LEE_RADIUS, within: tuple[str, ...] = CHIP) -> DataFrame:
    """With filtered: the local mean, moved to the pixel where the neighbourhood varies more than speckle does."""
    n = (2 * radius + 1) ** 2
    rows = box_sum(pixels.repartition(*within), {"_s": F.col("value"), "_q": F.col("value") * F.col("value")}, radius, within)
    mean = F.col("_s") / n
    var = F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0))
    ratio = F.when(mean > 0, var / F.nullif(mean * mean, F.lit(0.0))).otherwise(F.lit(0.0))
    weight = F.least(F.greatest(F.lit(1.0) - F.lit(1.0 / enl) / F.greatest(ratio, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("filtered", mean + weight * (F.col("value") - mean)).drop("_s", "_q")


def cfar(filtered: DataFrame, config: Cfar, within: tuple[str, ...] = CHIP) -> DataFrame:
    """With background (mean of the training ring) and hit."""
    outer = box_sum(filtered, {"_o": F.col("filtered")}, config.train_radius, within)
    both = box_sum(outer, {"_g": F.col("filtered")}, config.guard_radius, within)
    background = (F.col("_o") - F.col("_g")) / config.cells
    return both.withColumn("background", background).withColumn("hit", F.col("filtered") > F.col("background") * config.alpha).drop("_o", "_g")


def label_runs(chip: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Numbers, from 1 in each chip, of the eight-connected components of pixels sorted by chip, row and column.

    Neighbours are found by search among the sorted pixels; roots of neighbours are hooked to the smaller one and paths
    halved until none differ, so the number of rounds is logarithmic and all chips are labelled together.
    """
    n = len(chip)
    wide, high = int(col.max()) + 2, int(row.max()) + 2
    key = (chip.astype(np.int64) * high + row) * wide + col
    ends = []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.minimum(np.searchsorted(key, key + step), n - 1)
        found = np.flatnonzero(key[at] == key + step)
        ends.append((found, at[found]))
    a, b = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    roots, place = np.unique(root, return_inverse=True)
    own = chip[roots]
    return (np.arange(len(roots)) - np.searchsorted(own, own) + 1)[place]


def components(hits: DataFrame, keep: tuple[str, ...] = (), within: tuple[str, ...] = CHIP) -> DataFrame:
    """chip_id, row, col, blob and the columns to keep: eight-connected components, numbered from 1 by their first pixel in reading order.

    Chips (or tiles) are whole within a partition and their pixels sorted; what a batch ends with is carried into the next one.
    """
    own = hits.select(*within, F.col("row").cast("int"), F.col("col").cast("int"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def places(rows: pa.Table) -> np.ndarray:
        """A number for each chip or tile, rising along the rows."""
        found = np.zeros(rows.num_rows, dtype=np.int64)
        for name in within:
            codes = np.asarray(rows[name].combine_chunks().dictionary_encode().indices)
            found[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(found)

    def labelled(rows: pa.Table) -> list[pa.RecordBatch]:
        blob = label_runs(places(rows), rows["row"].to_numpy(), rows["col"].to_numpy())
        return rows.append_column("blob", pa.array(blob, pa.int32())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            own = places(held)
            done = int(np.searchsorted(own, own[-1]))
            if done:
                yield from labelled(held.slice(0, done))
                held = held.slice(done)
        if held is not None:
            yield from labelled(held)

    return own.repartition(*within).sortWithinPartitions(*within, "row", "col").mapInArrow(run, f"{kinds}, blob int")


def _parts(marked: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """What pixels of a blob add up to."""
    return marked.groupBy(*by, "rows_n", "cols_n").agg(
        F.count("*").alias("area"), F.sum("value").alias("mass"), *(F.sum(F.col(c) * F.col("value")).alias(f"{c}_mass") for c in ("row", "col")),
        *(f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))),
        F.max(F.col("value") / F.col("background")).alias("peak"), F.min(F.struct("row", "col")).alias("first")
    )


def merged(marked: DataFrame, tile: int) -> DataFrame:
    """The blobs of chips from those of their tiles (marked pixels with tile_row, tile_col and blob), as _parts gives them.

    Pixels beside a border look for neighbours in the tiles they touch; what meets links two labels. Only pixels at borders and
    labels that meet take part in that; the others are blobs already.
    """
    marked = files.kept(marked)
    parts = files.kept(_parts(marked, (*TILE, "blob")).withColumn("node", F.monotonically_increasing_id()))
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    beside = marked.filter(edge("row") | edge("col")).join(parts.select(*TILE, "blob", "node"), [*TILE, "blob"]).select("chip_id", "row", "col", "node")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    ahead = beside.select("chip_id", "row", "col", F.col("node").alias("from"), steps.alias("s")).select(
        "chip_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "from"
    )
    links = ahead.join(beside, ["chip_id", "row", "col"]).filter("from <> node").select(F.col("from").alias("a"), F.col("node").alias("b"))
    joined = graph.components(links)
    parts = parts.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = {c: F.min(c).alias(c) for c in ("row_min", "col_min", "first")}
    whole = parts.groupBy("chip_id", "comp", "rows_n", "cols_n").agg(
        *(F.sum(c).alias(c) for c in ("area", "mass", "row_mass", "col_mass")), *low.values(), *(F.max(c).alias(c) for c in ("row_max", "col_max", "peak"))
    )
    return order.numbered(whole, ["chip_id"], ["first"], "blob")


def blobs(pixels: DataFrame, config: Cfar = Cfar(), affine: Affine = Affine(), tile: int | None = None) -> DataFrame:
    """Detections: position, length, confidence, pixel box. Numbers count small blobs too, which are left out afterwards.

    tile: the side of the tiles to deal a chip to (larger than what the windows reach); None keeps chips whole.
    """
    more = ("value", "background", "rows_n", "cols_n")
    if tile is None:
        rows = _parts(components(cfar(lee(pixels, config.enl), config).filter("hit"), more), ("chip_id", "blob"))
    else:
        halo = LEE_RADIUS + config.train_radius
        if tile <= halo:
            raise ValueError(f"tiles must be larger than {halo} pixels, what the windows reach")
        found = cfar(lee(tiled(pixels, tile, halo), config.enl, within=TILE), config, TILE).filter("hit and own")
        rows = merged(components(found, more, TILE), tile)
    rows = rows.filter(F.col("area") >= config.min_area_px).withColumns({
        "row_c": F.col("row_mass") / F.col("mass"), "col_c": F.col("col_mass") / F.col("mass"), "area_px": F.col("area").cast("int"),
        "blob": F.col("blob").cast("int")
    })
    extent = F.greatest(F.col("row_max") - F.col("row_min"), F.col("col_max") - F.col("col_min")) + 1
    lat, lon = affine.origin_lat - F.col("row_c") * affine.pixel_deg_lat, affine.origin_lon + F.col("col_c") * affine.pixel_deg_lon
    return rows.select(
        "chip_id", "blob", "rows_n", "cols_n", F.format_string(NUMBERED, "blob").alias("id"), F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"),
        F.round(extent * config.pixel_spacing_m, 1).alias("estimated_length_m"), F.round(1 - F.exp(-F.col("peak") / 10), 3).alias("detection_confidence"),
        F.round("row_c", 1).alias("row"), F.round("col_c", 1).alias("col"), "area_px", "row_min", "row_max", "col_min", "col_max",
    )


DETECTORS = {"cfar": blobs}


def detect(pixels: DataFrame, backend: str = "cfar", **settings) -> DataFrame:
    """Detections by a backend's name; others can be registered in DETECTORS."""
    if backend not in DETECTORS:
        raise NotImplementedError(f"no detector named {backend!r}")
    return DETECTORS[backend](pixels, **settings)


def label_box(pad: int = 1) -> list[Column]:
    """Centre and size of a padded, clamped pixel box, as shares of the chip: xc, yc, w, h."""
    r0, c0 = F.greatest(F.col("row_min") - pad, F.lit(0)), F.greatest(F.col("col_min") - pad, F.lit(0))
    r1, c1 = F.least(F.col("row_max") + pad, F.col("rows_n") - 1), F.least(F.col("col_max") + pad, F.col("cols_n") - 1)
    return [
        ((c0 + c1 + 1) / 2 / F.col("cols_n")).alias("xc"), ((r0 + r1 + 1) / 2 / F.col("rows_n")).alias("yc"),
        ((c1 - c0 + 1) / F.col("cols_n")).alias("w"), ((r1 - r0 + 1) / F.col("rows_n")).alias("h")
    ]


def label_lines(detections: DataFrame, pad: int = 1) -> DataFrame:
    """chip_id, blob, line: "class xc yc w h" with six decimals."""
    rows = detections.select("chip_id", "blob", *label_box(pad))
    return rows.select("chip_id", "blob", F.format_string("0 %.6f %.6f %.6f %.6f", "xc", "yc", "w", "h").alias("line"))


def recalled(truth: DataFrame, detections: DataFrame, slack: float = 2.0) -> DataFrame:
    """True targets (chip_id, row, col) with a detection within slack pixels."""
    d = detections.select(F.col("chip_id").alias("_c"), F.col("row").alias("_r"), F.col("col").alias("_x"))
    return truth.join(
        d, (F.col("chip_id") == F.col("_c")) & (F.abs(F.col("row") - F.col("_r")) <= slack) & (F.abs(F.col("col") - F.col("_x")) <= slack),
        "left_semi"
    )


def draw_targets(chips: DataFrame, size: int = 256, seed: int = 0, least: int = 2, most: int = 5, margin: int = 12) -> DataFrame:
    """Targets (chip_id, row, col, amplitude) of chips (chip_id): between least and most a chip, from seeded hashes, away from
    the edges and each in a column band of its own, so that no two touch."""
    number = F.lit(least) + F.pmod(F.xxhash64(F.lit(seed), "chip_id"), F.lit(most - least + 1))
    rows = chips.withColumn("_n", number.cast("int")).select("chip_id", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    drawn = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "chip_id", "_k"), n).cast("int")
    band = F.floor(F.lit(size - 2 * margin) / F.col("_n")).cast("int")
    col = F.lit(margin) + F.col("_k") * band + drawn("col", F.greatest(band - 4, F.lit(1)))
    row = F.lit(margin) + drawn("row", F.lit(size - 2 * margin))
    return rows.select("chip_id", row.alias("row"), col.cast("int").alias("col"), (F.lit(40.0) + drawn("amplitude", F.lit(400)) / 10).alias("amplitude"))


def synthetic(spark, targets: DataFrame, size: int = 256, clutter: float = 1.0, seed: int = 0) -> DataFrame:
    """Pixels of chips with exponential clutter; targets (chip_id, row, col, amplitude) bleed 40 % into four neighbours."""
    chips = targets.select("chip_id").distinct()
    place = lambda dr, dc, share: targets.select(
        "chip_id", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), (F.col("amplitude") * share).alias("a")
    )
    stamp = place(0, 0, 1.0)
    for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)):
        stamp = stamp.unionByName(place(dr, dc, 0.4))
    added = stamp.groupBy("chip_id", "row", "col").agg(F.sum("a").alias("a"))
    noise = F.xxhash64(F.lit(seed), "chip_id", "row", "col")
    uniform = (F.shiftrightunsigned(noise, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    grid = chips.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    rows = grid.withColumn("value", -F.log(uniform) * clutter).join(added, ["chip_id", "row", "col"], "left")
    return rows.select(
        "chip_id", F.lit(size).alias("rows_n"), F.lit(size).alias("cols_n"), "row", "col",
        (F.col("value") + F.coalesce("a", F.lit(0.0))).alias("value")
    )
