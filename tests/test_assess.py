from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from skerry.functions import geo, temporal
from skerry.operators import assess, dossier, harness, spatial
from skerry.schemas import Config, Season, Zone
from tests import demo

# What is known of the scene in demo.py.
GOLDEN = [  # id, firm, degraded, notes, score, class, suppressed, km
    (
        "D-004", 2, 0, 0, 70, "high_priority", False, 40.77
    ), ("D-010", 2, 0, 0, 70, "high_priority", False, 38.0), ("D-006", 2, 0, 0, 60, "high_priority", False, 78.21), (
        "D-001", 1, 0, 1, 50, "medium_priority", False, 71.04
    ),
    ("D-002", 1, 0, 1, 50, "medium_priority", False, 68.15), (
        "D-008", 1, 0, 0, 50, "medium_priority", False, 102.56
    ), ("D-005", 1, 0, 0, 30, "medium_priority", True, 44.02), ("D-013", 0, 0, 2, 0, "fixed_structure", False, 70.36),
    (
        "D-003", 0, 0, 0, 0, "no_indicators", False, 65.11
    ), ("D-009", 0, 0, 0, 0, "no_indicators", False, 75.29), ("D-012", 0, 0, 0, 0, "no_indicators", False, 41.23), (
        "D-007", 0, 0, 0, 0, "ais_not_applicable", True, 73.52
    ), ("D-011", 0, 0, 0, 0, "ais_not_applicable", True, 78.64),
]


def test_golden_records_and_order(spark):
    rows = dossier.ordered(dossier.with_distance(demo.records(spark), demo.CONFIG)).orderBy("pos").collect()
    assert [(
        r["id"], r["firm"], r["degraded"], len(r["contextual_notes"]), r["score"], r["classification"], r["ais_indicator_suppressed"],
        r["distance_from_base_km"]
    ) for r in rows] == GOLDEN
    for r in rows:
        assert (r["score"] > 0) == bool(r["potential_indicators"])
        assert r["score"] == sum(i["points"] for i in r["score_breakdown"])
    assert next(r for r in rows if r["id"] == "D-013")["fixed_structure"]["km"] == 0.14


def test_patrol_and_subsets(spark):
    rows = demo.records(spark)
    assert [r["id"] for r in dossier.patrol(rows, demo.CONFIG).orderBy("stop").collect()] == ["D-010", "D-004", "D-006", "D-005", "D-002", "D-001", "D-008"]
    assert {r["id"] for r in dossier.suppressed(rows).collect()} == {"D-005", "D-007", "D-011"}
    assert {r["id"] for r in dossier.silent(rows).collect()} == {"D-007", "D-011"}
    assert {r["id"] for r in dossier.below_threshold(rows).collect()} == {"D-003", "D-009", "D-012", "D-013"}


def one(spark, lat, lon, length, ais, score, gear="unknown", flag=None, config=demo.CONFIG, zones=demo.ZONES, structures=None):
    rows = demo.detections(spark, [("D-X", lat, lon, length, ais, score, None, gear, None, flag)])
    return assess.assess(rows, zones, config, structures).collect()[0]


def test_single_cases(spark):
    r = one(spark, 36.5, -6.75, 9.0, False, 0.9, "bottom_trawl")
    assert r["classification"] == "medium_priority" and r["ais_indicator_suppressed"] and not any(
        i["kind"].startswith("ais") for i in r["potential_indicators"]
    )
    r = one(spark, 36.0, -6.0, 9.0, False, 0.2, "small_scale")
    assert r["classification"] == "ais_not_applicable" and r["score"] == 0 and "not an indicator" in r["ais_note"]
    strict = Config(ais_length_threshold_m=15.0, fishing_score_threshold=0.7)
    assert one(spark, 36.0, -6.0, 15.0, False, 0.9, config=strict)["ais_applicability"] == "not_applicable"
    assert one(spark, 36.0, -6.0, 15.01, False, 0.9, config=strict)["firm"] == 1
    near, firm = one(spark, 36.0, -6.0, 14.5, False, 0.9), one(spark, 36.0, -6.0, 30.0, False, 0.9)
    assert (near["score"], firm["score"]) == (30, 50) and near["potential_indicators"][0]["degraded"]
    assert one(spark, 36.0, -8.0, 14.0, False, 0.1)["classification"] == "below_candidate_threshold"
    r = one(spark, 36.72, -7.05, 34.0, None, 0.9, "bottom_trawl")
    assert r["ais_status"] == "unknown" and not r["potential_indicators"] and len(r["contextual_notes"]) == 2
    assert one(spark, 36.475, -6.75, 30.0, True, 0.05, "purse_seine")["classification"] == "no_indicators"
    fishing = one(spark, 36.475, -6.75, 30.0, True, 0.95, "purse_seine")
    assert fishing["score"] == 30  # the zone's indicator rests on the activity, which is not counted again
    fixed = one(spark, 36.701, -7.049, 30.0, False, 0.9, "bottom_trawl", structures=demo.structures(spark))
    assert fixed["classification"] == "fixed_structure" and fixed["score"] == 0 and fixed["fixed_structure"]["id"] == "FIX-01"
    assert any("suppressed as attributable" in n for n in fixed["contextual_notes"])


@pytest.mark.parametrize("column", ["estimated_length_m", "fishing_score"])
def test_missing_decisive_data_raises(spark, column):
    rows = demo.detections(spark).withColumn(column, F.when(F.col("id") != "D-003", F.col(column)))
    with pytest.raises(Exception, match="D-003"):
        assess.assess(rows, demo.ZONES, demo.CONFIG).collect()


def test_malformed_closure_names_its_zone():
    with pytest.raises(ValueError, match="CLS-02"):
        temporal.closure_dates(Zone("CLS-02", "n", "t", (), (), ("junk", "2026-01-01", "r")))


def test_geometry(spark):
    ring = [[36.6, -7.2], [36.6, -6.9], [36.85, -6.9], [36.85, -7.2]]
    outer = [[-7.2, 36.6], [-6.9, 36.6], [-6.9, 36.85], [-7.2, 36.85], [-7.2, 36.6]]
    hole = [[-7.1, 36.7], [-7.0, 36.7], [-7.0, 36.8], [-7.1, 36.8], [-7.1, 36.7]]
    second = [[[-6.5, 36.4], [-6.3, 36.4], [-6.3, 36.5], [-6.5, 36.5], [-6.5, 36.4]]]
    holed, multi = {"type": "Polygon", "coordinates": [outer, hole]}, {"type": "MultiPolygon", "coordinates": [[outer], second]}
    cases = [
        (36.7, -7.0, ring, True), (36.7, -6.0, ring, False), (36.6, -7.0, ring, True), (36.85, -7.0, ring, False), (36.62, -7.15, holed, True),
        (36.75, -7.05, holed, False), (36.5, -7.05, holed, False), (36.45, -6.4, multi, True), (36.85, -7.0, holed, True)
    ]
    for lat, lon, polygon, want in cases:
        assert spark.range(1).select(geo.inside(F.lit(lat), F.lit(lon), polygon)).first()[0] is want, (lat, lon)
    assert geo.centroid(ring) == pytest.approx((36.725, -7.05))
    assert geo.centroid(holed) == pytest.approx((36.725, -7.05), abs=0.01)


def test_grid_join_equals_literals(spark):
    points = spark.range(4000).selectExpr(
        "id as ord", "36.2 + (id * 7919 % 1000) / 1000 as lat", "-7.4 + (id * 104729 % 1200) / 1000 as lon"
    ).selectExpr("ord", "cast(lat as double) lat", "cast(lon as double) lon")
    rows = spark.createDataFrame([(z.id, [[float(a), float(b)] for a, b in z.polygon]) for z in demo.ZONES], "zone_id string, ring array<array<double>>")
    a = {tuple(r) for r in spatial.zone_hits(points, rows, ["ord"]).collect()}
    assert a and a == {tuple(r) for r in spatial.literal_zone_hits(points, demo.ZONES, ["ord"]).collect()}


@pytest.mark.parametrize(("when", "season", "want"), [
    ("2024-01-11T02:00:00Z", Season("11-01", "02-28"), "high"), (
        "2024-01-25T18:00:00Z", Season("11-01", "02-28"), "moderate"
    ), ("2024-01-18T03:53:00Z", Season("11-01", "02-28"), "low"), ("2024-07-05T22:00:00Z", Season("11-01", "02-28"), "out_of_season"),
])
def test_conditions(spark, when, season, want):
    config = Config(15.0, 0.7, season=season)
    assert temporal.conditions(spark.createDataFrame([(when,)], "timestamp string"), config).first()["suitability"] == want


def test_seasons_and_bad_dates(spark):
    inside = lambda d, s: spark.range(1).select(temporal.in_season(F.lit(date.fromisoformat(d)), s)).first()[0]
    wrap = Season("11-01", "02-28")
    assert inside("2024-12-20", wrap) and inside("2025-02-15", wrap) and not inside("2024-09-15", wrap) and inside("2028-02-29", Season())
    with pytest.raises(ValueError):
        temporal.in_season(F.lit(date(2024, 1, 1)), Season("13-45", "02-28"))
    with pytest.raises(Exception, match="invalid"):
        spark.createDataFrame([("not-a-date",)], "t string").select(temporal.scene_date(F.col("t"))).collect()
    local = spark.createDataFrame([("2024-01-11T00:30:00+02:00",)], "t string").select(temporal.scene_date(F.col("t"))).first()[0]
    assert local == date(2024, 1, 11)  # the date as written, not in UTC


def test_every_fault_is_caught_on_every_record(spark):
    """The scene once for each turn of the faults, so every record carries each that applies to it."""
    turns = len(harness.BRIEF_FAULTS)
    base = demo.detections(spark)
    rows = base.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumns({
        "scene_id": F.concat(F.lit("S"), "t"), "ord": F.col("ord") + F.col("t")
    }).drop("t")
    found = harness.verdicts(assess.assess(rows, demo.ZONES, demo.CONFIG, demo.structures(spark)), demo.CONFIG)
    seen = found.collect()
    assert len(seen) == 2 * turns * len(demo.ROWS) and [r for r in seen if not r["ok"]] == []
    faults = {f.name for f in (*harness.BRIEF_FAULTS, *harness.RANKING_FAULTS)}
    assert {r["fault"] for r in seen} - {None} == faults
    rules = {"V0", "V1", "V2", "VA", "VB", "VC", "V3", "V3b", "V4", "V5", "V6", "V7", "V8", "V8b", "V9", "V10", "V11", "V12a", "V12b", "V13", "Q2", "Q3", "Q5"}
    assert {r["expected"] for r in seen} - {None} == rules
    rates = {r["family"]: (r["hits"], r["total"]) for r in harness.catch_rate(found).collect()}
    assert rates["overall"] == (len(seen), len(seen)) and rates["adversarial"][1] + rates["control"][1] == len(seen)


def test_a_missed_fault_is_counted(spark):
    """A rule that finds nothing lowers the rate: without the config's language the wording of indicators is not compared."""
    mute = replace(demo.CONFIG, output_language="Spanish")
    rates = {r["family"]: (r["hits"], r["total"]) for k in (3, 9) for r in harness.catch_rate(harness.verdicts(demo.records(spark), mute, shift=k)).collect()}
    assert any(hits < total for hits, total in rates.values())


def test_document(spark):
    import json

    scenes = spark.createDataFrame([("S", demo.TIMESTAMP, "area")], "scene_id string, timestamp string, area string")
    row = dossier.document(demo.records(spark), scenes, demo.ZONES, demo.CONFIG).first()
    doc = json.loads(row["dossier"])
    assert [r["id"] for r in doc["records"]] == [g[0] for g in GOLDEN]
    assert doc["classification_summary"] == {"high_priority": 3, "medium_priority": 4, "fixed_structure": 1, "no_indicators": 3, "ais_not_applicable": 2}
    assert doc["patrol_sequence"][0]["id"] == "D-010" and doc["environmental_context"]["suitability"] == "out_of_season" and doc["active_closures"][0]["zone"] == "River Mouth"


def test_a_dossier_in_parts(spark):
    """The lists of a scene's parts, one after the other, are those of its one document; no part holds more than it may."""
    import json

    scenes = spark.createDataFrame([("S", demo.TIMESTAMP, "area")], "scene_id string, timestamp string, area string")
    given = (demo.records(spark), scenes, demo.ZONES, demo.CONFIG)
    for keep in (True, False):
        want = json.loads(dossier.document(*given, keep_records=keep).first()["dossier"])
        found = dossier.parts(*given, keep_records=(True, False), size=3).filter(F.col("kept") == keep).orderBy("part").collect()
        docs = [json.loads(r["dossier"]) for r in found]
        assert [r["part"] for r in found] == list(range(len(docs))) and len(docs) == -(-len(GOLDEN) // 3)
        lists = [k for k, v in want.items() if isinstance(v, list) and k not in ("regulated_zones", "active_closures")]
        assert len(lists) == 4 + keep and all(len(d[k]) <= 3 for d in docs for k in lists)
        assert {k: [x for d in docs for x in d[k]] for k in lists} == {k: want[k] for k in lists}
        assert {k: v for k, v in docs[0].items() if k not in lists} == {k: v for k, v in want.items() if k not in lists}
        assert all(set(d) == set(lists) for d in docs[1:])


def test_no_task_gets_all_documents_of_a_scene(spark):
    """Also where no table is small enough to be sent to all tasks."""
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"
    }
    scenes = spark.createDataFrame([("S", demo.TIMESTAMP, "area")], "scene_id string, timestamp string, area string")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        docs = dossier.parts(demo.records(spark), scenes, demo.ZONES, demo.CONFIG, size=1)
        found = docs.select("part", F.spark_partition_id().alias("task")).collect()
    finally:
        for k in own:
            spark.conf.unset(k)
    assert sorted(r["part"] for r in found) == list(range(len(GOLDEN))) and len({r["task"] for r in found}) > 1


def test_weights_of_a_document_overlay_the_defaults():
    from skerry.sources import scenes

    own = scenes.configuration({"ais_length_threshold_m": 15, "fishing_score_threshold": 0.7, "score_weights": {"_note": "n", "ais_dark": 55}}).weights
    assert (own.ais_dark, own.zone_violation) == (55, Config(15.0, 0.7).weights.zone_violation)


def test_stages_are_timed(spark):
    import pandas as pd

    stages = harness.stages(lambda: demo.detections(spark), lambda rows: assess.assess(rows, demo.ZONES, demo.CONFIG), demo.CONFIG)
    runs = spark.createDataFrame(pd.DataFrame(harness.timed(stages, 1), columns=["stage", "run", "seconds"]))
    named = [(name, "validation" if name.startswith("validate") else "assessment") for name in stages]
    sections = spark.createDataFrame(named, "stage string, section string")
    found = {(r["section"], r["stage"]): r["seconds"] for r in harness.latency(runs, sections, len(demo.ROWS)).collect()}
    assert len(found) == 4 + 2 + 1 and found[None, None] == pytest.approx(sum(v for (_, stage), v in found.items() if stage))
