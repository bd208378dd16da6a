import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import dataset, harness, present, raster, responses, validate
from skerry.sources import scenes
from skerry.streaming import scenes as stream
from tests import demo


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def records(spark):
    return demo.records(spark)


def rules(spark, records, briefs):
    rows = spark.createDataFrame(
        briefs,
        "scene_id string, brief_ord bigint, id string, position string, priority string, indicators array<string>, regulation_concerned string, suggested_action string, caveat string"
    )
    return {(r["place"].split()[-1], r["rule"], r["severity"]) for r in validate.brief_issues(rows, records, demo.CONFIG).collect()}


def clean(records, name):
    r = harness.clean_briefs(records, demo.CONFIG).filter(F.col("id") == name).first()
    return r.asDict()


def test_each_brief_rule_fires_and_the_faithful_brief_is_silent(spark, records):
    base = {n: clean(records, n) for n in ("D-004", "D-006", "D-001")}
    assert rules(spark, records, [tuple(b.values()) for b in base.values()]) == set()
    spoil = lambda n, **change: tuple((base[n] | change).values())
    cases = [
        (
            spoil("D-006", regulation_concerned="Article 10 (AIS carriage requirement)"), {"V3"}
        ), (spoil("D-006", caveat="AIS data may lag behind"), {"V3b"}), (spoil("D-004", position="40.0, -3.7"), {"V4"}), (
            spoil("D-004", position='{"lat": 36.47, "lon": -6.74}'), set()
        ),
        (spoil("D-004", position="somewhere"), {"V4"}), (
            spoil("D-004", regulation_concerned="none"), {"V5"}
        ), (spoil("D-004", priority="low"), {"V7"}), (
            spoil("D-001", regulation_concerned="Inner Reserve (RES-03)"), {"V8"}
        ), (spoil("D-004", caveat=" "), {"VA"}),
        (spoil("D-004", caveat="measures less than 15 m"), {"VB"}), (
            spoil("D-004", suggested_action="seize the vessel and its catch"), {"VC"}
        ), (spoil("D-004", suggested_action="40.77 km from base"), {"V11"}), (
            spoil("D-004", suggested_action="38.0 km from base: board and verify gear"), set()
        ),
        (
            spoil("D-004", indicators=base["D-004"]["indicators"] + ["and a further vessel 22.0 m was seen nearby fishing"]), {"V10"}
        ), (spoil("D-004", indicators=["ais"]), {"V9", "V12a"}), (spoil("D-004", indicators=[" ".join(base["D-004"]["indicators"])]), set()),
        (spoil("D-004", regulation_concerned=base["D-004"]["indicators"][0] + " (RES-03)"), {"V8b"}), (spoil("D-004", id="D-999"), {"V0"}),
        (spoil("D-004", indicators=[x.replace("-", "‑").replace(".", ",") for x in base["D-004"]["indicators"]]), set()),
    ]
    for brief, want in cases:
        assert {r for _, r, _ in rules(spark, records, [brief])} == want, brief


def test_narrative_and_missing(spark, records):
    none = spark.createDataFrame([], "scene_id string, id string")
    got = {(r["place"], r["severity"]) for r in validate.missing_briefs(none, records).collect()}
    assert ("brief D-010", "BLOCKER") in got and ("brief D-008", "WARNING") in got and len(got) == 7
    said = lambda t: spark.createDataFrame([("S", t)], "scene_id string, prose string")
    flagged = lambda t: {r["message"].split()[0] for r in validate.wrong_claims(said(t), records, "narrative", "V14a").collect()}
    assert flagged("High-priority vessels (D-010, D-004) and medium-priority vessels (D-001)") == set()
    assert flagged("high-priority detections D-010 and D-005") == {"D-005"}
    assert flagged("high-priority first, then the medium‑priority ones (D-005)") == set()
    assert flagged("The high-priority group near the coast holds several vessels (D-008, D-010)") == {"D-008"}
    assert {r["message"].split()[0] for r in validate.silent_in_prose(said("near D-007 and D-001"), records, "narrative", "V14b").collect()} == {"D-007"}


def test_ranking_rules(spark, records):
    ranked = harness.clean_ranked(records)
    prose = harness.clean_prose(records)
    assert validate.prioritisation_issues(ranked, prose, records).count() == 0
    more = ranked.unionByName(spark.createDataFrame(
        [("S", 90, "D-999", "x"), ("S", 91, "D-012", "y"), ("S", 92, "D-008", "a length of 19.5 m")],
        "scene_id string, rank_ord bigint, id string, reason string"
    )).filter("id <> 'D-010'")
    assert {(r["rule"], r["severity"]) for r in validate.prioritisation_issues(more, prose, records).collect()} == {
        ("Q2", "BLOCKER"), ("Q3", "BLOCKER"), ("Q5", "BLOCKER")
    }


def test_structure_rules(spark):
    docs = [
        ("ok", '{"prioritised_candidates":[{"id":"a"}],"ais_not_applicable":[],"observed_pattern":"","overall_recommendation":"","limitations":[]}'),
        ("none", "{}"), ("kind", '{"prioritised_candidates":"x"}'), ("nameless", '{"prioritised_candidates":[{"id":"a"},{"x":1},3]}')
    ]
    rows = spark.createDataFrame(docs, "scene_id string, t string").withColumn("doc", F.parse_json("t"))
    got = {}
    for r in validate.structure_issues(rows).collect():
        got.setdefault(r["scene_id"], []).append(r["severity"])
    assert "ok" not in got and got["none"].count("WARNING") == 5 and got["none"].count("BLOCKER") == 1
    assert got["kind"].count("BLOCKER") == 1 and got["nameless"].count("BLOCKER") == 2


def test_answers(spark):
    cases = {
        "plain": ('{"a": "1"}', "1"), "fence": (
            'Sure:\n```json\n{"a": "1"}\n```\nbye', "1"
        ), "prose": ('I say {"a": "1"} and } more', "1"), "braces": ('{"a": "{1}", "b": "}"}', "{1}"), "quotes": ('{"a": "say \\"}\\" now"}', 'say "}" now'),
        "comma": ('{"a": "1",}', "1"), "comment": ('{\n// why\n"a": "1"\n}', "1"), "cut": ('{"a": "1"', None), "empty": ("", None), "loop": ("The same again. " * 200, None), "text": ("no object here", None),
    }
    rows = responses.parse(spark.createDataFrame([(k, "analyst", 1, v[0]) for k, v in cases.items()], "scene_id string, agent string, attempt int, raw string"))
    got = {r["scene_id"]: r for r in rows.select("scene_id", F.expr("try_variant_get(doc, '$.a', 'string')").alias("a"), "failure").collect()}
    assert {k: got[k]["a"] for k in cases} == {k: v[1] for k, v in cases.items()}
    assert got["cut"]["failure"] == "the object is not closed" and got["empty"]["failure"] == "no content" and got["loop"]["failure"].startswith("the same")


def test_attempts(spark, records):
    rank = lambda *ids: json.dumps({"prioritised_candidates": [{"id": i, "rank": k, "reason": ""} for k, i in enumerate(ids)]})
    raw = [("S", "analyst", 1, rank("D-004")), ("S", "analyst", 2, rank("D-004", "D-010")), ("T", "analyst", 1, "broken {"), ("T", "analyst", 2, "also")]
    rows = spark.createDataFrame(raw, "scene_id string, agent string, attempt int, raw string")
    assert [r["scene_id"] for r in responses.first_parsed(rows).collect()] == ["S"]
    assert [(r["scene_id"], r["attempt"]) for r in responses.dead_letters(rows).collect()] == [("T", 2)]
    from skerry.operators import dossier

    best = responses.best_attempt(dossier.candidates(records), responses.parse(rows).filter("doc is not null")).first()
    assert (best["attempt"], best["omitted"]) == (2, 5)


def test_text_functions(spark):
    assert value(spark, T.position(F.col("t")), t="at 36.5, -6.25 N") == (36.5, -6.25)
    assert value(spark, T.position(F.col("t")), t='{"lat": "36.5", "lon": -6}') == (36.5, -6.0)
    assert value(spark, T.position(F.col("t")), t="one 5") is None
    assert sorted(value(spark, T.anchors(F.col("t")), t="RES‑03 at 15,0 m under 1224/2009, 7 of 15.0")) == ["1224/2009", "15.0", "RES-03"]
    for text, want in (("el artículo 10 del Reglamento (CE) nº 1224", True), ("raise the main sail", False), ("AIS", True)):
        assert value(spark, T.mentions_ais(F.col("t")), t=text) is want


@pytest.mark.parametrize("gap", ["\t", "\n", "\u00a0", "\u2003", "\x1c"])
def test_white_space_of_every_kind(spark, records, gap):
    assert value(spark, T.stripped("t"), t=f"{gap}high{gap}{gap}") == "high" and value(spark, T.stripped("t"), t=None) == ""
    assert value(spark, T.mentions_ais(F.col("t")), t=f"Article{gap}10") is True
    assert value(spark, T.instruction(F.col("t")), t=f"7,5{gap}km off: board it{gap}") == "board it"
    base = clean(records, "D-004")
    spoil = lambda **change: rules(spark, records, [tuple((base | change).values())])
    assert spoil(priority=f"HIGH{gap}") == set()
    assert {r for _, r, _ in spoil(caveat=gap * 3)} == {"VA"}
    assert {r for _, r, _ in spoil(caveat=f"it is below{gap}15 m")} == {"VB"}


def test_words_end_where_unicode_says(spark):
    for text, want in (("éais", False), ("aisé", False), ("AIS.", True), ("¿ais?", True)):
        assert value(spark, T.mentions_ais(F.col("t")), t=text) is want, text


def test_feed(spark):
    entries = [
        {
            "id": "A", "detect_lat": 36.7, "detect_lon": -7.0, "length_m": 34.0, "matched_category": "matched", "fishing_score": 0.9,
            "mmsi": "224000", "shipname": "N", "flag": "ESP", "geartype": "trawlers"
        }, {"id": "B", "lat": 36.5, "lon": -6.75, "length_m": 22.0, "matched_category": "unmatched", "is_fishing": True},
        {"properties": {
            "detect_lat": 36.6, "detect_lon": -6.9, "length_m": 18.0, "matched_category": "possibly", "fishing_score": 0.8
        }}, {
            "detect_lat": 36.4, "detect_lon": -6.7, "matched_category": "unmatched", "fishing_score": 0.5
        }, {"detect_lat": 36.3, "detect_lon": -6.6, "length_m": 12.0, "matched_category": "unmatched"},
        {"id": 0, "lat": "36.1", "lon": "-6.6", "length": 9, "matched": False, "score": 0.1},
    ]
    for body in (entries, {"entries": entries}, {"x": 1, "features": entries}):
        rows = scenes.map_feed(scenes.feed_entries(spark.createDataFrame([(json.dumps(body),)], "body string")))
        got = {r["id"]: r for r in scenes.usable(rows).collect()}
        assert set(got) == {"A", "B", "GFW-0002", "GFW-0005"}
        assert got["A"]["ais_matched"] is True and got["A"]["likely_gear"] == "trawlers" and got["A"]["vessel_name"] == "N"
        assert got["B"]["ais_matched"] is False and got["B"]["fishing_score"] == 1.0 and got["B"]["likely_gear"] == "unknown"
        assert got["GFW-0002"]["ais_matched"] is None and got["GFW-0005"]["ais_matched"] is None
        assert tuple(scenes.skipped(rows).first()) == (4, 2)
    with pytest.raises(Exception, match="unexpected answer"):
        scenes.feed_entries(spark.createDataFrame([('{"other": 1}',)], "body string")).collect()
    assert scenes.query_parameters(end="2026-07-18")["start-date"] == "2026-07-17"


def test_documents_are_read(spark, tmp_path):
    doc = {
        "_note": "n", "scene": {"source": "s", "timestamp": demo.TIMESTAMP},
        "detections": [
            {"id": "a", "lat": 36.5, "lon": -6.75, "estimated_length_m": 9, "fishing_score": 0.9, "ais_matched": None},
            {"id": "b", "lat": 36.5, "lon": -6.75, "estimated_length_m": 9.5, "fishing_score": 0.1}
        ]
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert [r["ais_matched"] for r in scenes.detection_rows(scenes.read_scenes(spark, str(tmp_path / "d.json"))).orderBy("ord").collect()] == [None, None]
    assert [r["ais_matched"] for r in scenes.read_strict_scenes(spark, str(tmp_path / "d.json")).orderBy("ord").collect()] == [False, None]
    doc["detections"][1]["estimated_length_m"] = "12"
    (tmp_path / "e.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="detection b"):
        scenes.read_strict_scenes(spark, str(tmp_path / "e.json")).collect()
    law = {
        "config": {"ais_length_threshold_m": 15, "fishing_score_threshold": 0.7, "_n": "x", "patrol_base": {"lat": 1, "lon": 2, "name": "b"}},
        "zones": [{"id": "Z-01", "name": "n", "type": "t", "prohibited_gear": [], "closure": None, "polygon": [[0, 0], [0, 1], [1, 1]]}],
        "fixed_structures": [{"id": "F", "lat": 1, "lon": 2}]
    }
    (tmp_path / "z.json").write_text(json.dumps(law))
    config, zones, structures = scenes.regulations(spark, str(tmp_path / "z.json"))
    assert config.vms == 12.0 and config.base == (1.0, 2.0, "b") and zones[0].id == "Z-01" and structures.first()["match_radius_m"] is None


def brute_box(image, radius):
    padded = np.pad(image, radius, mode="reflect")
    return sum(padded[i : i + image.shape[0], j : j + image.shape[1]] for i in range(2 * radius + 1) for j in range(2 * radius + 1))


def test_raster(spark, tmp_path):
    image = np.random.default_rng(1).exponential(1.0, (12, 15))
    (tmp_path / "c").mkdir()
    np.save(tmp_path / "c" / "chip.npy", image)
    pixels = scenes.read_chips(spark, str(tmp_path / "c"))
    got = np.zeros_like(image)
    for r in raster.box_sum(pixels, {"s": F.col("value")}, 3).collect():
        got[r["row"], r["col"]] = r["s"]
    assert np.allclose(got, brute_box(image, 3))
    with pytest.raises(ValueError):
        raster.Cfar(guard_radius=3, train_radius=3)
    with pytest.raises(NotImplementedError):
        raster.detect(pixels, "other")


def brute_components(pixels):
    """Numbers by a walk from each pixel in reading order."""
    number, now = {}, 0
    for start in sorted(pixels):
        if start in number:
            continue
        now += 1
        todo = [start]
        while todo:
            r, c = todo.pop()
            if (r, c) in pixels and (r, c) not in number:
                number[r, c] = now
                todo += [(r + y, c + x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    return number


def test_components_against_a_walk(spark):
    rng = np.random.default_rng(4)
    images = {f"c{k}": {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((9 + k, 14)) < 0.2 + 0.1 * k), strict=True)} for k in range(5)}
    images["snake"] = {(r, c) for r in range(0, 40, 2) for c in range(30)} | {(r, 29 if r % 4 == 1 else 0) for r in range(1, 39, 2)}
    rows = [(name, r, c) for name, own in images.items() for r, c in own]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # chips are cut by batches
    try:
        found = raster.components(spark.createDataFrame(rows, "chip_id string, row int, col int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["chip_id"], r["row"], r["col"]): r["blob"] for r in found} == {
        (n, *at): b for n, own in images.items() for at, b in brute_components(own).items()
    }
    assert raster.components(spark.createDataFrame([], "chip_id string, row int, col int")).count() == 0


def test_drawn_targets_are_found_whichever_way_pixels_are_dealt(spark):
    chips = spark.createDataFrame([(f"t{k}",) for k in range(4)], "chip_id string")
    targets = raster.draw_targets(chips, size=96, seed=7)
    assert {2 <= r["count"] <= 5 for r in targets.groupBy("chip_id").count().collect()} == {True}
    assert sorted(targets.collect()) == sorted(raster.draw_targets(chips.repartition(3), size=96, seed=7).collect())
    pixels = raster.synthetic(spark, targets, size=96, seed=3)
    found = [sorted(raster.blobs(pixels, tile=own).select("chip_id", "id", "area_px").collect()) for own in (None, 24)]
    assert found[0] == found[1] and len(found[0]) >= targets.count()
    assert raster.recalled(targets, raster.blobs(pixels)).count() == targets.count()


def test_targets_are_found(spark):
    truth = [("c", 40, 60, 60.0), ("c", 90, 20, 45.0), ("c", 20, 90, 80.0), ("c", 75, 75, 55.0)]
    targets = spark.createDataFrame(truth, "chip_id string, row int, col int, amplitude double")
    found = raster.blobs(raster.synthetic(spark, targets, size=112, seed=5)).cache()
    assert raster.recalled(targets.select("chip_id", "row", "col"), found).count() == 4 and found.count() <= 5
    lines = raster.label_lines(found).select("chip_id", "blob", "line")
    numbered = lines.select(F.col("chip_id").alias("path"), F.col("blob").alias("line_no"), "line")
    assert dataset.label_problems(numbered).count() == 0
    doc = json.loads(dataset.manifest(spark.createDataFrame([("c",), ("d",)], "name string"), lines).first()["manifest"])
    assert doc["chips"] == 2 and doc["candidate_labels_total"] == found.count() and len(doc["entries"]) == 2


def test_split_and_labels(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(6)], "name string")
    parts = {r["name"]: r["part"] for r in dataset.split(names, 0.34).collect()}
    assert sorted(parts.values()) == ["train"] * 4 + ["val"] * 2 and parts == {r["name"]: r["part"] for r in dataset.split(names, 0.34).collect()}
    assert [r["part"] for r in dataset.split(names.limit(1), 0.34).collect()] == ["train"]
    bad = dataset.label_problems(spark.createDataFrame(
        [("f", 1, "0 1.5 0.5 0.2 0.2"), ("f", 2, " "), ("f", 3, "0 .5 .5 .1 .1")], "path string, line_no int, line string"
    ))
    assert [tuple(r) for r in bad.collect()] == [("f", 1, "a coordinate is not a share of the chip")]
    with pytest.raises(ValueError, match="f:1"):
        dataset.check(bad)


def test_listing_and_gate(spark, records):
    issues = validate.missing_briefs(spark.createDataFrame([], "scene_id string, id string"), records)
    assert "[BLOCKER] brief D-004" in validate.listing(issues).first()["text"] and validate.has_blockers(issues).first()["blocked"]
    text = {r["scene_id"]: r["text"] for r in validate.listing(issues, spark.createDataFrame([("S",), ("T",)], "scene_id string")).collect()}
    assert text["T"] == "Output validation: no issues" and text["S"].startswith("Output validation: 7 issue(s)")
    assert tuple(validate.passed(issues, issues.select("scene_id", "place").distinct(), ["scene_id", "place"]).first()) == (7, 0)
    lines = present.dossier_lines(records, "S", demo.CONFIG)
    assert any("D-010" in x for x in lines) and present.brief_lines(harness.clean_briefs(records, demo.CONFIG))
    times = spark.createDataFrame(pd.DataFrame(harness.timed({"a": lambda: None}, 3), columns=["stage", "run", "seconds"]))
    assert harness.latency(times, spark.createDataFrame([("a", "s")], "stage string, section string"), 13).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = demo.detections(spark)
    rows.write.parquet(str(tmp_path / "in"))
    own = stream.assessed(stream.read(spark, str(tmp_path / "in"), demo.DDL), demo.ZONES, demo.CONFIG).select("id", "classification", "score")
    stream.write(own, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    from skerry.operators import assess

    batch = assess.assess(rows, demo.ZONES, demo.CONFIG).select("id", "classification", "score")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_documents_over_many_lines(spark, tmp_path):
    doc = {
        "scene": {"source": "s", "timestamp": demo.TIMESTAMP},
        "detections": [{"id": "a", "lat": 36.5, "lon": -6.75, "estimated_length_m": 9, "fishing_score": 0.9}]
    }
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=2))
    assert [r["id"] for r in scenes.read_strict_scenes(spark, str(tmp_path / "d.json")).collect()] == ["a"]
    (tmp_path / "manifest.json").write_text(json.dumps({"chips": 1, "entries": [{"name": "c", "candidate_labels": 0, "review_status": "pending"}]}, indent=2))
    assert scenes.read_manifest(spark, f"{tmp_path}/manifest.json").select(dataset.pending()).first()[0] == 1
    assert scenes.read_manifest(spark, f"file://{tmp_path}/none.json").count() == 0


def test_data_set_on_disk(spark, tmp_path):
    pixels = raster.synthetic(spark, raster.draw_targets(spark.createDataFrame([("a",), ("b",)], "chip_id string"), size=64, seed=1, margin=8), size=64, seed=1)
    path = f"file://{tmp_path}/set"
    dataset.write_dataset(pixels, raster.label_lines(raster.blobs(pixels)), path)
    assert [r["chip_id"] for r in scenes.chip_paths(spark, f"{path}/images").collect()] == ["a", "b"]
    back = scenes.read_chips(spark, f"{path}/images")
    assert back.join(pixels, ["chip_id", "row", "col"]).filter(F.abs(back["value"] - pixels["value"]) > 0).count() == 0 and back.count() == 2 * 64 * 64
    lines = scenes.read_labels(spark, f"{path}/labels")
    assert {r["stem"] for r in lines.collect()} == {"a", "b"} and dataset.label_problems(lines).count() == 0
    assert sorted(r["part"] for r in dataset.prepare(spark, path, 0.5, 3).collect()) == ["train", "val"]
    assert "names: ['vessel']" in (tmp_path / "set" / "data.yaml").read_text()
    with pytest.raises(ValueError, match="no images"):
        dataset.prepare(spark, f"file://{tmp_path}/nothing")
    (tmp_path / "set" / "labels" / "a.txt").write_text("0 2 0.5 0.1 0.1")
    with pytest.raises(ValueError, match="a.txt:1"):
        dataset.prepare(spark, path)


def test_report_head(spark, records):
    rows = spark.createDataFrame([("S", demo.TIMESTAMP)], "scene_id string, timestamp string")
    lines = present.dossier_lines(records, "S", demo.CONFIG, rows, demo.ZONES)
    text = "\n".join(lines)
    assert "13 detections" in text and "Closed: River Mouth (spawning)" in text and "Base: base, radius 120.0 km" in text and "out_of_season" in text
    assert [x for x in present.ranking_lines(harness.clean_ranked(records).withColumn("rank", F.col("rank_ord"))) if "D-010" in x]


def test_conversations(spark):
    """What does not parse is asked again; what fails or hangs leaves a row and never the task."""

    def call(prompt):
        if "slow" in prompt:
            time.sleep(3)
        if "fails" in prompt:
            raise OSError("no route")
        if "again" in prompt and "Answer again" not in prompt:
            return "sorry, here is prose"
        return '{"ok": true}'

    dossiers = spark.createDataFrame([(k, f"the {k} scene") for k in ("plain", "again", "fails", "slow")], "scene_id string, dossier string").coalesce(1)
    asked = responses.prompts(dossiers, "Write in {language}.", "Spanish")
    assert {r["prompt"] for r in asked.filter("scene_id = 'plain'").collect()} == {"Write in Spanish.\n\nthe plain scene"}
    got = {(r["scene_id"], r["attempt"]): (r["raw"], r["error"]) for r in responses.converse(asked, call, "analyst", timeout=0.5).collect()}
    assert got["plain", 1] == ('{"ok": true}', None) and got["again", 2] == ('{"ok": true}', None) and ("plain", 2) not in got
    assert got["fails", 2] == (None, "OSError: no route") and got["slow", 1] == (None, "no answer in time")
    answers = responses.converse(asked.filter("scene_id in ('plain', 'again')"), call, "analyst")
    assert {r["scene_id"]: r["attempt"] for r in responses.first_parsed(answers).collect()} == {"plain": 1, "again": 2}
