"""Orders without a task a group, cells of zones and structures, files with a commit."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import geo
from skerry.operators import dossier, order, spatial
from skerry.sources import files


def test_numbers_by_ranges(spark):
    rows = spark.range(5000).selectExpr("if(id % 9 = 0, 'small', if(id % 100 = 1, null, 'large')) as g", "id * 7919 % 41 as v", "id as ord", "'x' as _at")
    got = order.numbered(rows, ["g"], [F.desc("v"), "ord"], "pos", parts=7)
    assert got.columns == ["g", "v", "ord", "_at", "pos"]
    found = got.collect()
    for g in ("small", "large", None):
        own = sorted((r for r in found if r["g"] == g), key=lambda r: (-r["v"], r["ord"]))
        assert [r["pos"] for r in own] == list(range(1, len(own) + 1)) and own
    assert order.numbered(rows.limit(0), ["g"], ["ord"], "pos").count() == 0


def test_no_window_holds_a_scene(spark):
    rows = spark.range(1000).selectExpr("'one' as scene_id", "id as ord", "'high_priority' as classification", "id % 3 as score")
    placed = dossier.ordered(rows)
    assert [r["ord"] for r in placed.orderBy("pos").limit(3).collect()] == [2, 5, 8]
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "SinglePartition" not in plan


def test_a_scene_is_written_in_parts(spark, tmp_path):
    """No document holds more than it may; what is read back is what one document a scene gives."""
    from skerry.sources import scenes

    rows = spark.range(5007).selectExpr(
        "if(id % 1000 = 6, 'small', 'large') as scene_id", "5006 - id as ord", "date'2024-01-15' as day", "concat('D-', id) as id", "36 + id / 9000e0 as lat",
        "-7e0 as lon", "20e0 as estimated_length_m", "id % 3 = 0 as ais_matched", "0.5e0 as fishing_score"
    )
    got = {}
    for size in (None, 10000, 2):
        path = f"{tmp_path}/{size}"
        given = rows.filter("ord < 15 or scene_id = 'small'") if size == 2 else rows
        scenes.write_documents(given, path, **({"size": size} if size else {}))
        docs, name = scenes.read_scenes(spark, path), F.regexp_extract("scene_id", r"([^/]+)\.json$", 1).alias("scene")
        most = docs.agg(F.max(F.size("detections"))).first()[0]
        assert most == {2: 2, 10000: 5001, None: 5000}[size]
        assert sorted(tuple(r) for r in scenes.scene_rows(docs).select(name, "timestamp").collect()) == [(s, "2024-01-15T00:00:00Z") for s in ("large", "small")]
        read = [sorted(tuple(r) for r in t.select(name, "ord", "id", "day", "lat", "ais_matched").collect()) for t in (scenes.detection_rows(docs), scenes.read_strict_scenes(spark, path))]
        assert read[0] == read[1] and len(read[0]) == given.count()
        got[size] = read[0]
        own = [r["id"] for r in given.filter("scene_id = 'large'").orderBy("ord").collect()]
        assert [(o, i) for s, o, i, *_ in read[0] if s == "large"] == list(enumerate(own))
    assert got[None] == got[10000]


def star(rng, n, lat, lon, size):
    angles = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.2, 1, n)
    return [[float(lat + a * np.sin(t)), float(lon + a * np.cos(t))] for a, t in zip(r, angles, strict=True)]


@pytest.mark.parametrize("size", [0.05, 0.3])
def test_zones_as_rows_equal_literals(spark, size):
    """Parts with holes, rings with edges on the borders of cells, points on corners and edges."""
    rng = np.random.default_rng(3)
    box = lambda s, w, n, e: [[s, w], [s, e], [n, e], [n, w]]
    shapes = {
        "holed": [[box(36.2, -7.4, 36.9, -6.9), box(36.4, -7.2, 36.6, -7.0)]], "two": [[star(rng, 40, 36.5, -6.6, 0.3)], [box(36.9, -6.8, 37.1, -6.4)]],
        "touching": [[box(36.3, -7.1, 36.5, -6.8)], [box(36.5, -7.1, 36.7, -6.8)]], "star": [[star(rng, 200, 36.7, -6.9, 0.45), star(rng, 9, 36.7, -6.9, 0.08)]],
        "sliver": [[[[36.25, -6.5], [36.95, -6.5000001], [36.95, -6.49]]]],
    }
    corners = [tuple(p) for parts in shapes.values() for rings in parts for ring in rings for p in ring]
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for parts in shapes.values() for rings in parts for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)]
    spread = list(zip((36.15 + rng.integers(0, 1000, 1500) / 1000).tolist(), (-7.45 + rng.integers(0, 1100, 1500) / 1000).tolist(), strict=True))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([*corners, *middles, *spread])], "ord long, lat double, lon double")
    zones = spark.createDataFrame(list(shapes.items()), "zone_id string, parts array<array<array<array<double>>>>")
    for edges_inside in (True, False):
        got = {tuple(r) for r in spatial.zone_hits(points, zones, ["ord"], size, edges_inside).collect()}
        lat, lon = F.col("lat"), F.col("lon")
        want = set()
        for name, parts in shapes.items():
            geometry = {"type": "MultiPolygon", "coordinates": [[[[x, y] for y, x in ring] for ring in part] for part in parts]}
            if edges_inside:
                inside = geo.in_geometry(lat, lon, geometry)
            else:
                inside = F.lit(False)
                for part in parts:
                    inside = inside | geo._parity([e for ring in part for e in geo.ring_edges(ring)], lat, lon)
            want |= {(r["ord"], name) for r in points.filter(inside).select("ord").collect()}
        assert got == want and len(want) > 300


def test_cells_inside_need_no_edges(spark):
    ring = [[36.0, -7.0], [36.0, -6.0], [37.0, -6.0], [37.0, -7.0]]
    zones = spark.createDataFrame([("z", [[ring]])], "zone_id string, parts array<array<array<array<double>>>>")
    _, border, inside = spatial.zone_cover(spatial.zone_edges(zones), 0.05)
    assert inside.count() > 300 and border.join(inside, ["cy", "cx"]).count() == 0


def test_nearest_structure_at_every_level(spark):
    """Radii from a metre to thousands of kilometres, dense cells, both sides of 180 degrees, ties by the registry's order."""
    rng = np.random.default_rng(4)
    n, m = 400, 700
    lat = np.concatenate([rng.uniform(-80, 80, n - 100), 10 + rng.uniform(0, 0.01, 100)])
    lon = np.concatenate([rng.uniform(-180, 180, n - 100), 179.995 + rng.uniform(0, 0.005, 100)])
    reach = rng.choice([1.0, 300.0, 3000.0, 40e3, 900e3, 4000e3], n)
    structures = [(i, f"F{i}", f"n{i}", "platform", float(a), float(b), float(r) if i % 7 else None) for i, (a, b, r) in enumerate(zip(lat, lon, reach, strict=True))]
    structures += [(n + k, f"F{n + k}", "tie", "buoy", 50.0, 3.0, 500.0) for k in range(3)]
    p = np.concatenate([rng.uniform(-85, 85, m), lat[:200] + rng.normal(0, 0.002, 200), 10 + rng.uniform(0, 0.01, 100), [50.0]])
    q = np.concatenate([rng.uniform(-180, 180, m), lon[:200] + rng.normal(0, 0.002, 200), -180 + rng.uniform(0, 0.01, 100), [3.0]])
    points = [("S", i, float(a), float(((b + 180) % 360) - 180)) for i, (a, b) in enumerate(zip(p, q, strict=True))]
    own = spark.createDataFrame(structures, "ord long, id string, name string, type string, lat double, lon double, match_radius_m double")
    rows = spark.createDataFrame(points, "scene_id string, ord long, lat double, lon double")
    found = {r["ord"]: r["fixed_structure"] for r in spatial.match_structures(rows, own).collect()}
    s = own.selectExpr("ord as s", "id", "lat as y", "lon as x", "coalesce(match_radius_m, 300) / 1000 as reach")
    km = geo.distance_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    pairs = rows.crossJoin(s).withColumn("km", km).filter("km <= reach").groupBy("ord").agg(F.min(F.struct("km", "s", "id")).alias("b")).collect()
    want = {r["ord"]: (r["b"]["km"], r["b"]["id"]) for r in pairs}
    assert {k: (v["km"], v["id"]) for k, v in found.items() if v} == want and len(found) == len(points) and len(want) > 300
    assert found[len(points) - 1]["id"] == f"F{n}"
    assert any(-180 <= points[k][3] < -179.9 and structures[int(v["ord"])][5] > 179 for k, v in found.items() if v)


def test_a_place_is_matched_once(spark, monkeypatch):
    """Many rows at few places and many structures at one: pairs do not grow with either, and the matches are those of all pairs."""
    own = spark.range(600).selectExpr(
        "id as ord", "concat('F', id) as id", "'n' as name", "'buoy' as type", "10.0D as lat", "20.0D as lon",
        "if(id % 3 = 0, null, double(id * 7 % 5 * 500 + 100)) as match_radius_m"
    )
    rows = spark.range(4000).selectExpr("'S' as scene_id", "id as ord", "if(id = 9, null, 10 + id % 8 / 400D) as lat", "if(id % 8 = 0, -0.0D, 0.0D) + 20 as lon", "'x' as more")
    pairs, hits = [], spatial.structure_hits
    monkeypatch.setattr(spatial, "structure_hits", lambda *given: pairs.append(hits(*given)) or pairs[-1])
    matched = spatial.match_structures(rows, own)
    assert matched.columns == [*rows.columns, "fixed_structure"]
    found = {r["ord"]: r["fixed_structure"] and (r["fixed_structure"]["km"], r["fixed_structure"]["ord"]) for r in matched.collect()}
    km = geo.distance_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    s = own.selectExpr("ord as s", "lat as y", "lon as x", "coalesce(match_radius_m, 300) / 1000 as reach")
    all_pairs = rows.join(s, km <= F.col("reach")).groupBy("ord").agg(F.min(F.struct(km.alias("km"), "s")).alias("b"))
    want = {r["ord"]: (r["b"]["km"], r["b"]["s"]) for r in all_pairs.collect()}
    assert len(found) == 4000 and {k: v for k, v in found.items() if v} == want and len({v[1] for v in want.values()}) > 2
    assert pairs[0].count() <= 8 * 5


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    """Files that tasks had moved are taken back, and there is no marker; a later job that succeeds is whole."""
    path = f"{tmp_path}/out"
    rows = spark.range(40).repartition(4, "id").selectExpr("concat('d/', id, '.txt') as name", "cast(concat('t', id) as binary) as content")
    bad = rows.withColumn("name", F.when(F.col("name") == "d/17.txt", "../out.txt").otherwise(F.col("name")))
    with pytest.raises(Exception, match="no name for a file"):
        files.write_files(bad, path)
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file()] if (tmp_path / "out").exists() else []
    assert left == []
    assert files.write_files(rows, path) == 40
    listed = files.committed(spark, path)
    assert listed["files"] == 40 and listed["bytes"] == sum(len(f"t{i}") for i in range(40))
    names = {json.loads(x)["name"] for p in listed["parts"] for x in (tmp_path / "out" / p).read_text().splitlines()}
    assert names == {f"d/{i}.txt" for i in range(40)} == {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out" / "d").iterdir()}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]


def test_an_attempt_that_runs_twice_changes_nothing(tmp_path):
    writer = files.FilesWriter(str(tmp_path))
    rows = [("a", b"1"), ("b/c", b"22")]
    first, second = writer.write(iter(rows)), writer.write(iter(rows))  # the second attempt of a task whose first had moved its files
    writer.commit([second, None])
    assert (tmp_path / "a").read_bytes() == b"1" and (tmp_path / "b/c").read_bytes() == b"22" and first.part != second.part
    assert json.loads((tmp_path / "_COMMITTED").read_text())["parts"] == [second.part]


def test_stores():
    assert files.store_of("/a/b")[1] == files.store_of("file:/a/b")[1] == files.store_of("file:///a/b")[1] == "/a/b"
    with pytest.raises(ValueError, match="local, s3, gs, abfs and hdfs"):
        files.FilesWriter("viewfs://c/e")


def test_scratch_and_kept_tables(spark):
    rows = spark.range(10).selectExpr("id", "array(struct(id as a, 'x' as b)) as s")
    held = files.kept(rows)
    assert held.schema.simpleString() == rows.schema.simpleString() and held.count() == 10 and files.exists(spark, files.scratch(spark, "x"))
