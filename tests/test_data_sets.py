"""Chips read by ranges of bytes, manifests in parts, functions in SQL, ids found in prose."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import sql
from skerry.functions import text as T
from skerry.operators import dataset, raster, validate
from skerry.sources import files, scenes


def test_chips_by_ranges_of_bytes(spark, tmp_path):
    """A chip over four tasks and more; both orders of memory, whole numbers, one row; small files share a task."""
    rng = np.random.default_rng(0)
    chips = {
        "wide": rng.normal(size=(9, 50)), "column": np.asfortranarray(rng.normal(size=(40, 7))), "whole": rng.integers(0, 99, (12, 12)).astype(np.int16),
        "line": rng.normal(size=(1, 300)).astype(np.float32), **{f"small{k}": np.full((2, 3), float(k)) for k in range(20)}
    }
    for name, image in chips.items():
        np.save(tmp_path / f"{name}.npy", image)
    (tmp_path / "other.txt").write_text("no chip")
    for split in (600, 64 << 20):
        reader = scenes.ChipReader(str(tmp_path), split)
        parts = [p.value for p in reader.partitions()]
        if split == 600:
            assert sum(path.endswith("wide.npy") for p in parts for path, *_ in p) >= 4 and any(len(p) > 1 for p in parts)
        else:
            assert len(parts) == 1
        rows = scenes.read_chips(spark, str(tmp_path), split).collect()
        assert len(rows) == sum(x.size for x in chips.values())
        assert all(r["value"] == float(chips[r["chip_id"]][r["row"], r["col"]]) and (r["rows_n"], r["cols_n"]) == chips[r["chip_id"]].shape for r in rows)
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="two dimensions"):
        scenes.read_chips(spark, str(tmp_path)).collect()


def test_manifest_in_parts(spark, tmp_path):
    pixels = raster.synthetic(spark, raster.draw_targets(spark.createDataFrame([("a",), ("b",)], "chip_id string"), size=40, seed=1, margin=8), size=40, seed=1)
    lines = spark.createDataFrame([("a", 1, "0 0.5 0.5 0.1 0.1"), ("a", 2, "0 0.2 0.2 0.1 0.1")], "chip_id string, blob int, line string")
    said = dataset.write_dataset(pixels, lines, str(tmp_path / "set"))
    head = json.loads((tmp_path / "set" / "manifest.json").read_text())
    assert head == said and (head["chips"], head["candidate_labels_total"], head["entries"]) == (2, 2, "manifest")
    got = {r["name"]: (r["candidate_labels"], r["review_status"]) for r in scenes.manifest_entries(spark, str(tmp_path / "set")).collect()}
    assert got == {"a": (2, "pending"), "b": (0, "pending")} and files.committed(spark, str(tmp_path / "set/images"))["files"] == 2
    inline = dataset.manifest(spark.createDataFrame([("a",), ("b",)], "name string"), lines).first()["manifest"]
    (tmp_path / "manifest.json").write_text(inline)
    assert {r["name"]: (r["candidate_labels"], r["review_status"]) for r in scenes.manifest_entries(spark, str(tmp_path)).collect()} == got
    assert scenes.manifest_entries(spark, str(tmp_path / "nothing")).count() == 0


def test_functions_in_sql_are_inlined(spark):
    sql.install(spark)
    texts = ["Article 10, 38,5 km and 38.5", "ART. 10", "an aisle", None, "seen (RES‑03, 1224/2009)", "High-priority ones (D-1, D-22) and medium priority D-3"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = spark.sql("SELECT i, mentions_ais(t) AS m, anchors(t) AS a, distance_km(36.5, -6.0, 36.5 + i, -6.0) AS d FROM {rows}", rows=rows)
    want = rows.select("i", T.mentions_ais(F.col("t")).alias("m"), T.anchors(F.col("t")).alias("a"))
    assert found.select("i", "m", "a").collect() == want.collect() and [r["d"] for r in found.limit(2).collect()] == [0.0, 111.19]
    claims = spark.sql("SELECT i, claimed, id FROM {rows} AS r, LATERAL claims_of(r.t)", rows=rows)
    assert sorted((r["claimed"], r["id"]) for r in claims.collect()) == [("high_priority", "D-1"), ("high_priority", "D-22"), ("medium_priority", "D-3")]
    for df in (found, claims):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    spread = spark.sql("SELECT i, place, anchor FROM {rows} AS r, LATERAL anchors_of(r.t) ORDER BY i, place", rows=rows).collect()
    assert [tuple(r) for r in spread] == [(r["i"], k, a) for r in want.collect() for k, a in enumerate(r["a"])]


def test_ids_in_prose_by_grams(spark):
    """The same as a search for each id, also for ids inside others, at the ends, and of several lengths."""
    prose = [("a", "D-1 and XD-12, D-3."), ("b", "nothing"), ("c", None), ("d", "é D-7é")]
    ids = [("a", x) for x in ("D-1", "D-12", "D-2", "D-3.", "D-3", "D-1 and XD-12, D-3.", "D-1 and XD-12, D-3. ")] + [("b", "D-1"), ("c", "D-1"), ("d", "7é"), ("x", "D-1")]
    said, own = spark.createDataFrame(prose, "scene_id string, prose string"), spark.createDataFrame(ids, "scene_id string, id string")
    got = validate.named_in(said, own)
    assert sorted(map(tuple, got.collect())) == sorted((s, i) for s, i in ids if i in (dict(prose).get(s) or ""))
    assert "contains" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_blobs_over_many_tiles(spark):
    """A blob over four tiles, a ring and a line over many, and single pixels: as in the whole chip."""
    rng = np.random.default_rng(2)
    image = rng.exponential(1.0, (70, 90))
    image[23:26, 23:26] += 60  # over the corner of four tiles of 24
    image[50, 5:85] += 90
    image[5:40, 60], image[5:40, 75], image[5, 60:76], image[39, 60:76] = 80, 80, 80, 80
    for r, c in ((0, 0), (69, 89), (23, 40), (24, 41)):
        image[r, c] = 99
    pixels = spark.createDataFrame(
        [("c", 70, 90, r, c, float(image[r, c])) for r in range(70) for c in range(90)], "chip_id string, rows_n int, cols_n int, row int, col int, value double"
    )
    own = raster.Cfar(pfa=1e-3, guard_radius=2, train_radius=5, min_area_px=1)
    whole, tiled = (sorted(map(tuple, raster.blobs(pixels, own, tile=t).collect())) for t in (None, 24))
    assert whole == tiled and any(r[12] <= 23 and r[13] >= 24 and r[14] <= 23 and r[15] >= 24 for r in whole)
    with pytest.raises(ValueError, match="tiles"):
        raster.blobs(pixels, own, tile=8)
