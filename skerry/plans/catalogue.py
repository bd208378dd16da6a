"""The query catalogue: every operator over the star-schema tables. Each entry takes (spark, sf_dir)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skerry.functions import geo, sql, temporal
from skerry.functions import text as T
from skerry.operators import assess, dataset, dossier, harness, order, raster, responses, spatial, validate
from skerry.plans.derive import CONFIG, GEOMETRY, REGULATION, ZONES, detections, read, structures
from skerry.schemas import Season
from skerry.sources import feed, files, scenes

QUERIES: dict = {}


def _day():
    return F.col("day").cast("string").alias("day")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def records(spark, sf_dir: str) -> DataFrame:
    return assess.assess(detections(spark, sf_dir), ZONES, CONFIG, structures(spark, sf_dir))


@query
def detections_scan(spark, d):
    return detections(spark, d).select(
        "ord", F.col("day").cast("string").alias("day"), "lat", "lon", "estimated_length_m", "fishing_score", "ais_matched", "likely_gear"
    )


@query
def ais_by_zone(spark, d):
    """Per zone and AIS status: detections and how many of them are active."""
    rows = detections(spark, d).withColumn("status", assess.ais_status(F.col("ais_matched")))
    hits = spatial.literal_zone_hits(rows, ZONES, ["status", "fishing_score"])
    return hits.groupBy("zone_id", "status").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("fishing_score") >= CONFIG.fishing_score_threshold, 1)).alias("active")
    )


@query
def ais_status(spark, d):
    return detections(spark, d).groupBy(assess.ais_status(F.col("ais_matched")).alias("status")).agg(F.count("*").alias("n"))


@query
def ais_applicability(spark, d):
    rows = detections(spark, d)
    state = assess.applicability(F.col("estimated_length_m"), CONFIG.ais_length_threshold_m, CONFIG.length_sigma_m, CONFIG.length_sigma_k)
    vms = F.when(F.col("estimated_length_m") - 2.0 >= 12.0, "cross_check").when(F.col("estimated_length_m") + 2.0 >= 12.0, "may_or_may_not").otherwise("none")
    return rows.select("ord", state.alias("state"), vms.alias("vms"))


@query
def zone_containment(spark, d):
    return spatial.literal_zone_hits(detections(spark, d), ZONES[:3], ["ord"])


@query
def zone_containment_ring(spark, d):
    return spatial.literal_zone_hits(detections(spark, d), ZONES[3:], ["ord"])


@query
def zone_containment_grid(spark, d):
    """The same zones as rows, joined by grid cell."""
    rows = [(z.id, [[float(a), float(b)] for a, b in z.polygon]) for z in ZONES]
    return spatial.zone_hits(detections(spark, d), spark.createDataFrame(rows, "zone_id string, ring array<array<double>>"), ["ord"])


@query
def geojson_containment(spark, d):
    return detections(spark, d).select("ord", geo.in_geometry(F.col("lat"), F.col("lon"), GEOMETRY).alias("covered"))


@query
def geojson_containment_rows(spark, d):
    """The same geometry as a row with parts and holes, joined by cell."""
    rows = detections(spark, d).select("ord", "lat", "lon")
    zone = spark.createDataFrame([("all", geo.parts_of(GEOMETRY))], "zone_id string, parts array<array<array<array<double>>>>")
    found = spatial.zone_hits(rows, zone, ["ord"], edges_inside=True).withColumn("covered", F.lit(True))
    return rows.join(found, "ord", "left").select("ord", F.coalesce("covered", F.lit(False)).alias("covered"))


@query
def fixed_structure_match(spark, d):
    rows = spatial.match_structures(detections(spark, d), structures(spark, d)).filter("fixed_structure is not null")
    return rows.select("ord", F.col("fixed_structure.id").alias("structure_id"), F.col("fixed_structure.km").alias("km"))


@query
def base_distance(spark, d):
    return dossier.with_distance(detections(spark, d), CONFIG).select("ord", "distance_from_base_km")


@query
def closure_active(spark, d):
    days = detections(spark, d).select("day").distinct()
    return days.select(_day(), temporal.closure_active(ZONES[1], F.col("day")).alias("active"))


@query
def season_gate(spark, d):
    days = detections(spark, d).select("day").distinct()
    return days.select(
        _day(), temporal.in_season(F.col("day"), Season("01-15", "01-25")).alias("plain"),
        temporal.in_season(F.col("day"), Season("01-20", "01-05")).alias("wraps")
    )


@query
def lunar_phase(spark, d):
    turn = temporal.phase(F.col("ts"))
    rows = detections(spark, d)
    return rows.select(
        "ord", F.round(temporal.illumination(turn), 3).alias("illumination"), F.round(temporal.spring_index(turn), 3).alias("spring"),
        temporal.phase_name(turn).alias("name")
    )


@query
def suitability(spark, d):
    turn = temporal.phase(F.col("ts"))
    return detections(spark, d).select(
        "ord",
        temporal.suitability(
            temporal.in_season(F.col("day"), CONFIG.season), temporal.illumination(turn), temporal.spring_index(turn), CONFIG.dark_illumination
        ).alias("suitability")
    )


@query
def indicators_long(spark, d):
    rows = records(spark, d).select("ord", F.posexplode("potential_indicators").alias("place", "i"))
    return rows.select(
        "ord", "place", F.col("i.kind").alias("kind"), F.col("i.zone_id").alias("zone_id"), F.col("i.degraded").alias("degraded"),
        F.col("i.rests_on_activity").alias("rests")
    )


@query
def context_notes(spark, d):
    return records(spark, d).select(
        "ord", F.size("contextual_notes").alias("n_notes"),
        F.size(F.filter("contextual_notes", lambda x: x.startswith("suppressed as"))).alias("n_demoted")
    ).filter("n_notes > 0")


@query
def score_breakdown(spark, d):
    return records(spark, d).select("ord", F.posexplode("score_breakdown").alias("place", "i")).select("ord", "place", F.col("i.points").alias("points"))


@query
def assessed_records(spark, d):
    return dossier.with_distance(records(spark, d), CONFIG).select(
        "ord", "ais_status", "ais_applicability", "ais", F.array_join(
            F.transform("zones", lambda z: z.id), "|"
        ).alias("zone_ids"), "firm", "degraded", F.size("contextual_notes").alias("notes"), "score", "classification",
        "ais_indicator_suppressed", F.col("fixed_structure.id").alias("structure_id"), "distance_from_base_km",
    )


@query
def classification_summary(spark, d):
    return dossier.summary(records(spark, d)).select("scene_id", "classification", "n", "rank")


@query
def active_closures(spark, d):
    return dossier.active_closures(detections(spark, d).select("day").distinct(), ZONES).select(_day(), "zone_id", "reason")


@query
def inspection_candidates(spark, d):
    return dossier.candidates(records(spark, d)).select(
        "id", "classification", "score", F.size("potential_indicators").alias("n_indicators"), dossier.citation(basis="AIS").alias("citation")
    )


@query
def suppressed(spark, d):
    return dossier.suppressed(records(spark, d)).select("id", "classification", F.col("ais_note").contains("VMS").alias("mentions_vms"))


@query
def silently_suppressed(spark, d):
    return dossier.silent(records(spark, d)).select("id")


@query
def fixed_suppressed(spark, d):
    return dossier.fixed(records(spark, d)).select("id", F.col("fixed_structure.id").alias("structure_id"))


@query
def below_threshold(spark, d):
    return dossier.below_threshold(records(spark, d)).select("id", "classification", "score", "summary")


@query
def record_texts(spark, d):
    """What is said of every record: its note, and why an AIS indicator is suppressed."""
    return records(spark, d).select("ord", "note", "ais_note")


@query
def contextual_notes(spark, d):
    return records(spark, d).select("ord", F.explode("contextual_notes").alias("note"))


@query
def score_factors(spark, d):
    return records(spark, d).select("ord", F.explode("score_breakdown").alias("i")).select("ord", F.col("i.factor").alias("factor"), F.col("i.points").alias("points"))


@query
def record_order(spark, d):
    """Places in one scene that holds all records, and in each day's; no task holds a scene."""
    rows = files.kept(records(spark, d).select("scene_id", "ord", "classification", "score"))
    whole = dossier.ordered(rows.withColumn("scene_id", F.lit("all"))).select("ord", F.col("pos").alias("place"))
    return dossier.ordered(rows).select("ord", "pos").join(whole, "ord")


@query
def patrol_sequence(spark, d):
    rows = records(spark, d).select("scene_id", "ord", "classification", "score", "lat", "lon")
    return dossier.patrol(rows, CONFIG).select("ord", "stop", "distance_from_base_km")


@query
def map_points(spark, d):
    return dossier.map_points(records(spark, d)).groupBy("classification", "colour", "radius").agg(
        F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon")
    )


@query
def candidate_rows(spark, d):
    return dossier.candidate_rows(records(spark, d), CONFIG).select("id", "priority", "position", "length_m", "AIS", "indicators", "km_from_base")


@query
def score_invariant(spark, d):
    """Rows that break `score > 0` exactly where there is an indicator: there are none."""
    rows = records(spark, d)
    return rows.agg(F.count(F.when((F.col("score") > 0) != (F.size("potential_indicators") > 0), 1)).alias("broken"), F.count("*").alias("n"))


# --- text ------------------------------------------------------------------------------------------------------------------


def _documents(spark, d):
    return read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query
def invariant_tokens(spark, d):
    return _documents(spark, d).select("doc_id", F.explode(T.anchors(F.col("text"))).alias("token"))


@query
def ais_wording(spark, d):
    return _documents(spark, d).select("doc_id", T.mentions_ais(F.col("text")).alias("mentions"))


@query
def word_overlap(spark, d):
    """Documents and benchmark items that share long words: a document's own words meet the items' by an equi-join."""
    docs = _documents(spark, d).select("doc_id", F.explode(F.array_distinct(T.long_words(F.col("text")))).alias("word"))
    items = read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.long_words(F.col("text")))).alias("word"))
    return docs.join(items, "word").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("word").alias("words"))


@query
def position_parse(spark, d):
    at = T.position(F.regexp_replace("text", r"[^0-9.,\- ]", " "))
    return _documents(spark, d).select("doc_id", at["lat"].alias("lat"), at["lon"].alias("lon"))


@query
def degenerate_text(spark, d):
    return _documents(spark, d).select("doc_id", T.degenerate(F.col("text")).alias("looped")).filter("looped")


@query
def forbidden_actions(spark, d):
    return read(spark, d, "conversations").select(
        "conv_id", "turn", F.lower("text").rlike(T.FORBIDDEN_VERBS).alias("forbidden"), F.char_length(T.instruction(F.col("text"))).alias("n")
    )


def claimed_prose(rows: DataFrame) -> DataFrame:
    """Prose on every record: under its own class, or under none if it is no candidate; every seventh under both classes."""
    high, medium = F.concat(F.lit("High-priority vessels seen today ("), "id", F.lit(").")), F.concat(F.lit("Medium priority detections "), "id", F.lit("."))
    wrong = F.concat(F.lit("High-priority vessels seen today ("), "id", F.lit("). Then medium priority detections "), "id", F.lit("."))
    own = F.when(F.col("classification") == "high_priority", high).when(F.col("classification") == "medium_priority", medium)
    own = own.otherwise(F.concat(F.lit("Other vessels seen today ("), "id", F.lit(").")))
    return rows.select(F.concat(F.lit("S"), "ord").alias("scene_id"), F.when(F.col("ord") % 7 == 0, wrong).otherwise(own).alias("prose"))


@query
def priority_claims(spark, d):
    """Claims in templated prose over all records: every seventh record is listed under a wrong class, all others rightly."""
    rows = records(spark, d)
    own = rows.withColumn("scene_id", F.concat(F.lit("S"), "ord"))
    return validate.wrong_claims(claimed_prose(rows), own, "narrative", "V14a").select("scene_id", "severity", "rule", "message")


@query
def json_repair_parse(spark, d):
    """Events wrapped as models' answers: fenced, with a trailing comma, truncated, or plain."""
    body = F.concat(F.lit('{"id": "'), F.col("event_id"), F.lit('", "text": "a } in { a \\" string", "n": [1, 2]'))
    raw = F.when(
        F.col("event_id") % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("}\n```\nDone {ok}"))
    ).when(
        F.col("event_id") % 4 == 1, F.concat(body, F.lit(",}"))
    ).when(F.col("event_id") % 4 == 2, body).otherwise(F.concat(F.lit("\n// note\n"), body, F.lit("} trailing }")))
    rows = read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("scene_id"), F.lit("analyst").alias("agent"), F.lit(1).alias("attempt"), raw.alias("raw")
    )
    return responses.parse(rows).select("scene_id", F.expr("try_variant_get(doc, '$.id', 'string')").alias("id"), "failure")


# --- validation ------------------------------------------------------------------------------------------------------------


def judged(spark, d: str) -> DataFrame:
    """Records, assessed once for all rules."""
    return files.kept(records(spark, d), "records")


def all_report_issues(spark, d: str) -> DataFrame:
    """Issues of a brief a record, with a fault planted in most, and of a narrative a scene."""
    rows = judged(spark, d)
    return validate.report_issues(harness.given(harness.planted_briefs(rows, CONFIG)), harness.spoiled_prose(rows), rows, CONFIG)


@query
def report_issues(spark, d):
    """Every issue of the reports, with its message."""
    return all_report_issues(spark, d).select("scene_id", "place", "rule", "severity", "message")


@query
def issue_listing(spark, d):
    """The text of each scene's issues, in order."""
    events = detections(spark, d).select("scene_id")
    return validate.listing(all_report_issues(spark, d).filter("rule in ('V13', 'V14a', 'V14b')"), events)


@query
def report_gate(spark, d):
    """Whether a scene's report is held back."""
    return validate.has_blockers(all_report_issues(spark, d))


@query
def missing_briefs(spark, d):
    rows = judged(spark, d)
    return validate.missing_briefs(harness.given(harness.planted_briefs(rows, CONFIG)), rows).select("severity", "place", "message")


@query
def foreign_anchors(spark, d):
    """Briefs whose regulation carries another detection's anchors."""
    rows = judged(spark, d)
    issues = validate.brief_issues(harness.given(harness.planted_briefs(rows, CONFIG)), rows, CONFIG)
    return issues.filter("rule = 'V8'").select("place", "severity", "message")


@query
def prioritisation_issues(spark, d):
    """Every issue of a ranking of all records, with faults planted in it, and of a narrative a scene."""
    rows = judged(spark, d)
    issues = validate.prioritisation_issues(harness.given(harness.planted_ranking(rows)), harness.spoiled_prose(rows), rows)
    return issues.select("scene_id", "place", "rule", "severity", "message")


@query
def omitted_candidates(spark, d):
    rows = judged(spark, d)
    return responses.omitted(dossier.candidates(rows), harness.given(harness.planted_ranking(rows))).select("id", "classification")


@query
def unknown_ids(spark, d):
    """Ranked ids that are not in the dossier, or are there without being candidates."""
    rows = judged(spark, d)
    found = validate.ranking_issues(harness.given(harness.planted_ranking(rows)), rows).filter("rule = 'Q2'")
    return found.select("place", F.col("message").contains("not in the dossier").alias("absent"))


@query
def top_severity(spark, d):
    """The worst severity of each brief."""
    rows = judged(spark, d)
    briefs = harness.given(harness.planted_briefs(rows, CONFIG))
    issues = validate.brief_issues(briefs, rows, CONFIG).select("scene_id", "place", "severity")
    outputs = briefs.select("scene_id", F.concat(F.lit("brief "), "id").alias("place")).distinct()
    return validate.top_severity(issues, outputs, ["scene_id", "place"])


@query
def passed_briefs(spark, d):
    rows = judged(spark, d)
    briefs = harness.given(harness.planted_briefs(rows, CONFIG))
    outputs = briefs.select("scene_id", F.concat(F.lit("brief "), "id").alias("place")).distinct()
    return validate.passed(validate.brief_issues(briefs, rows, CONFIG).select("scene_id", "place", "severity"), outputs, ["scene_id", "place"])


@query
def catch_rate(spark, d):
    """Which faults, planted in a brief and a rank of every record, their rules find."""
    return harness.catch_rate(harness.verdicts(records(spark, d), CONFIG))


@query
def structure_issues(spark, d):
    """Answers of every shape: keys left out, candidates that are no list or carry no id."""
    k = F.col("event_id") % 6
    items = F.when(k == 0, '[{"id": "a"}]').when(k == 1, '"none"').when(
        k == 2, '[{"id": "a"}, {"rank": 1}, 3, {"id": ""}]'
    ).when(k == 3, "null").when(k == 4, "{}").otherwise("[]")
    keys = F.when(
        F.col("event_id") % 4 == 0, ', "limitations": []'
    ).otherwise(', "observed_pattern": "", "overall_recommendation": "", "limitations": [], "ais_not_applicable": []')
    doc = F.when(F.col("event_id") % 11 == 0, "{}").otherwise(F.concat(F.lit('{"prioritised_candidates": '), items, keys, F.lit("}")))
    answers = read(spark, d, "events").select(F.col("event_id").cast("string").alias("scene_id"), F.parse_json(doc).alias("doc"))
    return validate.structure_issues(answers).select("scene_id", "severity", "message")


@query
def odd_spaces(spark, d):
    """White space of every kind, at both ends of a text and inside of patterns."""
    k = (F.col("event_id") % 5).cast("int")
    gap = F.element_at(F.array(*(F.lit(c) for c in (" ", "\t", "\u00a0", "\n", "\u2003"))), k + 1)
    rows = read(spark, d, "events").select(
        "event_id", "event_type", F.concat(gap, "event_type", gap, F.lit("Article"), gap, F.lit("10"), gap).alias("t"),
        F.concat(F.lit("é"), F.lit("ais"), gap).alias("u")
    )
    action = F.concat(F.lit("7,5"), gap, F.lit("km off: "), "event_type", gap)
    return rows.select(
        "event_id", F.char_length(T.stripped("t")).alias("n"), T.mentions_ais(F.col("t")).alias("cited"), T.mentions_ais(F.col("u")).alias("inner"),
        T.instruction(action).alias("rest")
    )


@query
def latency_median(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("value") / 1000).alias("seconds"))
    sections = spark.createDataFrame(
        [("purchase", "sale"), ("click", "visit"), ("view", "visit"), ("signup", "visit"), ("error", "fault")], "stage string, section string"
    )
    return harness.latency(rows, sections, 100).select(
        "section", "stage", F.round("seconds", 9).alias("seconds"), F.round("per_detection", 11).alias("per_detection")
    )


# --- raster and data sets ------------------------------------------------------------------------------------------------------

SMALL = raster.Cfar(pfa=0.05, guard_radius=1, train_radius=2, enl=4.0, min_area_px=2)


def chips(spark, d: str) -> DataFrame:
    """Embeddings as 8 x 8 chips of positive values."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("chip_id"), F.posexplode("embedding").alias("k", "v"))
    return rows.select(
        "chip_id", F.lit(8).alias("rows_n"), F.lit(8).alias("cols_n"), F.expr("k div 8").cast("int").alias("row"),
        (F.col("k") % 8).cast("int").alias("col"), F.pow(F.abs("v").cast("double"), F.lit(3.0)).alias("value")
    )


@query
def box_sum(spark, d):
    return raster.box_sum(chips(spark, d).repartition("chip_id"), {"s": F.col("value")}, 2).select("chip_id", "row", "col", F.round("s", 6).alias("s"))


@query
def lee_filter(spark, d):
    return raster.lee(chips(spark, d)).select("chip_id", "row", "col", F.round("filtered", 6).alias("filtered"))


@query
def cfar_mask(spark, d):
    return raster.cfar(raster.lee(chips(spark, d)), SMALL).groupBy("chip_id").agg(
        F.count_if("hit").alias("hits"), F.round(F.avg("background"), 6).alias("background")
    )


@query
def blobs(spark, d):
    return raster.blobs(chips(spark, d), SMALL).drop("blob", "rows_n", "cols_n")


def strip(spark, d: str) -> DataFrame:
    """All chips side by side as one, eight pixels high and as wide as all of them."""
    rows = order.numbered(read(spark, d, "embeddings").select("vec_id", "embedding"), [], ["vec_id"], "at")
    wide = rows.agg((F.count("*") * 8).cast("int").alias("cols_n"))
    pixels = rows.select(((F.col("at") - 1) * 8).cast("int").alias("left"), F.posexplode("embedding").alias("k", "v"))
    return pixels.crossJoin(F.broadcast(wide)).select(  # one row
        F.lit("strip").alias("chip_id"), F.lit(8).alias("rows_n"), "cols_n", F.expr("k div 8").cast("int").alias("row"),
        (F.col("left") + F.col("k") % 8).alias("col"), F.pow(F.abs("v").cast("double"), F.lit(3.0)).alias("value")
    )


@query
def tiled_blobs(spark, d):
    """Blobs of one chip that holds all others, in tiles of twelve pixels: no task holds the chip."""
    return raster.blobs(strip(spark, d), SMALL, tile=12).drop("blob", "rows_n", "cols_n")


@query
def yolo_boxes(spark, d):
    return raster.label_lines(raster.blobs(chips(spark, d), SMALL)).select("chip_id", "blob", "line")


@query
def pixel_boxes(spark, d):
    """Boxes from parts: padded, clamped and normalised."""
    rows = read(spark, d, "part").select(
        F.col("p_partkey").alias("chip_id"), F.lit(1).alias("blob"), F.lit(32).alias("rows_n"), F.lit(64).alias("cols_n"),
        F.expr("cast(p_partkey % 30 as int)").alias("row_min"), F.expr("cast(p_partkey % 60 as int)").alias("col_min")
    )
    rows = rows.withColumn(
        "row_max", F.least(F.col("row_min") + F.col("chip_id") % 5, F.lit(31)).cast("int")
    ).withColumn("col_max", F.least(F.col("col_min") + F.col("chip_id") % 7, F.lit(63)).cast("int"))
    return rows.select("chip_id", *(F.round(c, 9).alias(n) for c, n in zip(raster.label_box(), ("xc", "yc", "w", "h"), strict=True)))


@query
def label_validation(spark, d):
    key = F.col("p_partkey")
    line = F.when(key % 5 == 0, "0 0.5 0.5 0.2").when(key % 5 == 1, "0 1.5 0.5 0.2 0.2").when(key % 5 == 2, "x 0.5 0.5 0.2 0.2").when(key % 5 == 3, "3 0.5 0.5 0 -1").otherwise("0 0.5 0.5 0.25 0.25")
    rows = read(spark, d, "part").select(F.concat(F.lit("labels/"), key, F.lit(".txt")).alias("path"), F.lit(1).alias("line_no"), line.alias("line"))
    return dataset.label_problems(rows).select("path", "problem")


@query
def split_assignment(spark, d):
    return dataset.split(read(spark, d, "labels").select(F.col("doc_id").alias("name"), "quality"), 0.34, 7).select("name", "part")


@query
def split_checks(spark, d):
    """Two parts that share nothing, hold all, and have the size that was asked for; another seed gives another split."""
    names = read(spark, d, "labels").select(F.col("doc_id").alias("name"))
    one, two = dataset.split(names, 0.34, 7), dataset.split(names, 0.34, 8).withColumnRenamed("part", "other")
    both = one.join(two, "name", "full")
    is_val = F.col("part") == "val"
    return both.agg(
        F.count_if(is_val).alias("val"), F.count_if(F.col("part") == "train").alias("train"), F.count_distinct("name").alias("names"),
        F.count_if(F.col("other") == "val").alias("other_val"), (F.count_if(is_val & (F.col("other") == "train")) > 0).alias("differ")
    )


@query
def drawn_targets(spark, d):
    """Scenes drawn from seeds, one a nation: whether each has two to five targets, and whether detection finds all of them."""
    targets = raster.draw_targets(read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("chip_id")), size=96, seed=7)
    targets = files.kept(targets)
    found = raster.recalled(targets, raster.blobs(raster.synthetic(spark, targets, size=96, seed=3)))
    hits = found.groupBy("chip_id").agg(F.count("*").alias("hits"))
    per = targets.groupBy("chip_id").agg(F.count("*").alias("n")).join(hits, "chip_id", "left")
    return per.select("chip_id", F.col("n").between(2, 5).alias("drawn"), (F.coalesce("hits", F.lit(0)) == F.col("n")).alias("all_found"))


@query
def labelled_chips(spark, d):
    images = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    labels = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("stem"))
    return dataset.by_label(images, labels).groupBy("labelled").agg(F.count("*").alias("n"))


# --- sources and sinks ---------------------------------------------------------------------------------------------------------


def scene_files(spark, d: str) -> str:
    """Detections as scene documents, one a day."""
    path = files.scratch(spark, "scenes")
    scenes.write_documents(detections(spark, d), path, source="radar", mode="survey", area=CONFIG.study_area)
    return path


_READ = ("scene", "ord", "id", "day", "lat", "lon", "estimated_length_m", "fishing_score", "ais_matched", "likely_gear")


def _read_back(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"scene": F.regexp_extract("scene_id", r"([^/]+)\.json$", 1), "day": F.col("day").cast("string")}).select(*_READ)


@query
def scene_documents(spark, d):
    """Scene documents, written and read back; ord is the place in the document."""
    return _read_back(scenes.detection_rows(scenes.read_scenes(spark, scene_files(spark, d))))


@query
def strict_scenes(spark, d):
    """The same by the reader that takes no number for granted."""
    return _read_back(scenes.read_strict_scenes(spark, scene_files(spark, d)))


@query
def dispatched_source(spark, d):
    """The local source of the dispatcher, and the feed: odd days have an answer, on all others it falls back."""
    path, answers = scene_files(spark, d), feed_bodies(spark, d)
    url, first, last = feed_folder(spark, answers.filter(F.dayofmonth("day") % 2 == 1), answers)
    local = scenes.load_detections(spark, path)
    given = scenes.load_detections(spark, path, "feed", url=url, start=first, end=last, limit=LIMIT)
    return local.withColumn("source", F.lit("local")).unionByName(given.withColumn("source", F.lit("feed"))).select(
        "source", F.regexp_replace("scene_id", r"^.*/([^/]+)\.json$", "$1").alias("scene"), _day(), "lat", "lon", "estimated_length_m"
    )


@query
def scene_conditions(spark, d):
    """The environment of every scene, from its document's timestamp."""
    rows = scenes.scene_rows(scenes.read_scenes(spark, scene_files(spark, d)))
    rows = temporal.conditions(rows, CONFIG).withColumn("day", temporal.scene_date(F.col("timestamp")).cast("string"))
    return rows.select(
        "day", "in_season", "season_window", "moon_phase", "moon_illumination", "darkness_favourability", "spring_tide_tendency", "suitability",
        "rationale"
    )


@query
def scene_environment(spark, d):
    """What the environment of a scene is for, and what it cannot see."""
    rows = scenes.scene_rows(scenes.read_scenes(spark, scene_files(spark, d)))
    rows = temporal.conditions(rows, CONFIG).withColumn("day", temporal.scene_date(F.col("timestamp")).cast("string"))
    return rows.select("day", "source", "mode", "area", "role", "sensor_scope", "cross_check_required")


OVERLAY = {"_note": "raised for the season", "ais_dark": 45, "zone_violation": 33}


@query
def overlaid_weights(spark, d):
    """Scores by a document that sets two weights; the others keep their defaults, and notes are passed over."""
    own = scenes.configuration(REGULATION["config"] | {"score_weights": OVERLAY})
    rows = assess.assess(detections(spark, d), ZONES, own, structures(spark, d))
    return rows.select("ord", "score", "classification")


def regulation_file(spark, d: str) -> str:
    """The regulation as a document, with suppliers as its structures."""
    path = files.scratch(spark, "regulation")
    item = F.struct("id", "name", "type", "lat", "lon", "match_radius_m")
    own = structures(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("s")))), lambda x: x.s).alias("fixed_structures"))
    listed = json.loads(own.select(F.to_json(F.struct("fixed_structures"))).first()[0])
    files.write_text(spark, path, "regulation.json", json.dumps(REGULATION | listed))
    return f"{path}/regulation.json"


@query
def regulated_structures(spark, d):
    _, _, rows = scenes.regulations(spark, regulation_file(spark, d))
    return rows


@query
def regulated_zones(spark, d):
    """Detections in the zones of the document."""
    _, zones, _ = scenes.regulations(spark, regulation_file(spark, d))
    return spatial.literal_zone_hits(detections(spark, d), zones, ["ord"])


ANSWERED = 1 << 19
"""Events, by number, whose entries share a day's answer: so no answer, and no task, holds more than so many."""


def feed_bodies(spark, d: str) -> DataFrame:
    """Answers of a feed, by day and part: entries under changing names, and in changing envelopes."""
    e = detections(spark, d).withColumn("k", F.col("ord") % 5)
    say = lambda k, name, value: F.when(F.col("k") == k, F.concat(F.lit(f'"{name}": '), value)).otherwise(F.lit(None))
    text, word = lambda c: F.col(c).cast("string"), lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    parts = [
        *(say(k, n, text("lat")) for k, n in ((0, "detect_lat"), (1, "lat"), (2, "latitude"), (3, "lat"), (4, "detect_lat"))),
        *(say(k, n, text("lon")) for k, n in ((0, "detect_lon"), (1, "lon"), (2, "longitude"), (3, "lon"), (4, "detect_lon"))),
        *(say(k, n, text("estimated_length_m")) for k, n in ((0, "length_m"), (1, "estimated_length_m"), (2, "length"), (4, "length_m"))),
        say(0, "id", word("id")), say(1, "detect_id", word("id")), say(2, "detection_id", word("id")), say(4, "id", F.lit("0")),
        say(0, "fishing_score", text("fishing_score")), say(
            1, "is_fishing", (F.col("fishing_score") >= 0.5).cast("string")
        ), say(2, "score", text("fishing_score")), say(4, "vessel_class", F.lit('"Fishing vessel"')),
        say(0, "matched_category", F.when(F.col("ais_matched"), '"matched"').when(~F.col("ais_matched"), '"unmatched"').otherwise('"discrepancy"')),
        say(1, "matched", F.col("ais_matched").cast("string")), say(2, "match_category", F.when(F.col("ais_matched"), '"matched"').otherwise("null")),
        say(0, "geartype", word("likely_gear")), say(0, "ssvid", word("id")), say(0, "shipname", word("id")), say(0, "flag", F.lit('"ESP"')), say(0, "speed", F.lit("3.5")),
    ]
    entry = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))
    entry = F.when(F.col("k") == 4, F.concat(F.lit('{"properties": '), entry, F.lit("}"))).otherwise(entry)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("t")))), lambda x: x.t), ", ")
    turn = F.dayofmonth("day") % 4
    body = F.when(turn == 0, F.concat(F.lit("["), "t", F.lit("]"))).otherwise(F.concat(
        F.lit('{"n": 1, "'), F.element_at(F.array(F.lit("entries"), F.lit("data"), F.lit("features")), F.greatest(turn, F.lit(1))), F.lit('": ['),
        "t", F.lit("]}")
    ))
    part = F.expr(f"ord div {ANSWERED}").alias("part")
    return e.groupBy("day", part).agg(listed.alias("t")).select("day", "part", body.alias("body"))


_FED = ("day", "ord", "id", "lat", "lon", "estimated_length_m", "ais_matched", "fishing_score", "speed_kn", "likely_gear", "mmsi", "vessel_name", "flag")


def mapped_feed(answers: DataFrame) -> DataFrame:
    """Detections of answers (day, body) with usable; every answer is mapped by itself."""
    entries = scenes.feed_entries(answers)
    return scenes.map_feed(entries, keep=("day",)).withColumn("day", F.col("day").cast("string"))


LIMIT = 100
"""The most entries of an answer: days have more, so their boxes are split."""


def feed_folder(spark, answers: DataFrame, days: DataFrame) -> tuple[str, str, str]:
    """Recorded answers, a folder a day, as the feed's address; the first and the last day."""
    path = files.scratch(spark, "feed")
    named = answers.select(F.concat(F.col("day").cast("string"), F.lit("/"), "part", F.lit(".json")).alias("name"), F.encode("body", "utf-8").alias("content"))
    files.write_files(named, path)
    first, last = days.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    return f"{path}/{{day}}", first, last


BOX = "-7.5,36.0,-6.0,37.5"


@query
def feed_detections(spark, d):
    """The feed through its reader, which never gets more than LIMIT entries at once; what lacks position, length or a sign of
    activity is left out."""
    answers = feed_bodies(spark, d)
    url, first, last = feed_folder(spark, answers, answers)
    rows = feed.mapped(feed.load(spark, url=url, start=first, end=last, limit=LIMIT, bbox=BOX))
    return scenes.usable(rows).withColumn("day", _day()).select(*_FED)


@query
def feed_window(spark, d):
    """Conditions on day and position that the feed applies itself."""
    answers = feed_bodies(spark, d)
    url, first, last = feed_folder(spark, answers, answers)
    rows = feed.load(spark, url=url, start=first, end=last, limit=LIMIT, bbox=BOX)
    rows = rows.filter("day >= '2024-01-10' and day < '2024-01-20' and lat > 36.5 and lon <= -6.75")
    return rows.groupBy(_day()).agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lon").alias("east"))


@query
def feed_records(spark, d):
    """Records of what the feed gives: whose vessel it is, where the feed is sure of the match."""
    answers = feed_bodies(spark, d)
    url, first, last = feed_folder(spark, answers, answers)
    rows = scenes.usable(feed.mapped(feed.load(spark, url=url, start=first, end=last, limit=LIMIT, bbox=BOX)))
    rows = assess.assess(rows.withColumn("scene_id", F.col("day").cast("string")), ZONES, CONFIG)
    return rows.select(
        _day(), "ord", "id", "ais_status", "jurisdiction", F.col("identity.mmsi").alias("mmsi"), F.col("identity.name").alias("name"),
        F.col("identity.flag").alias("flag")
    )


@query
def feed_pass(spark, d):
    """What is read, used and left out, counted by the pass that reads the feed."""
    answers, seen = feed_bodies(spark, d), Observation("feed")
    url, first, last = feed_folder(spark, answers, answers)
    rows = feed.mapped(feed.load(spark, url=url, start=first, end=last, limit=LIMIT, bbox=BOX), seen)
    counts = seen.get
    return scenes.usable(rows).groupBy(_day()).agg(F.count("*").alias("n")).withColumns({c: F.lit(counts[c]) for c in ("mapped", "skipped")})


@query
def feed_skipped(spark, d):
    return scenes.skipped(mapped_feed(feed_bodies(spark, d)))


@query
def dossier_documents(spark, d):
    """Each scene's dossier as JSON in parts, with and without the full list of records."""
    rows, heads = judged(spark, d), files.kept(scenes.scene_rows(scenes.read_scenes(spark, scene_files(spark, d))), "heads")
    heads = heads.withColumn("scene_id", F.regexp_extract("scene_id", r"([^/]+)\.json$", 1))
    doc = dossier.parts(rows, heads, ZONES, CONFIG, (True, False))
    lists = {"records": "records", "candidates": "inspection_candidates", "suppressed": "ais_indicator_suppressed", "fixed": "fixed_structure_suppressed", "stops": "patrol_sequence"}
    heads = {"total": "total_detections", "closures": "active_closures", "analysis_date": "analysis_date", "environment": "environmental_context"}
    doc = doc.select("scene_id", "kept", "part", F.json_tuple("dossier", *lists.values(), *heads.values()).alias(*lists, *heads))
    # A part is read once, and only what is narrow meets in the aggregation.
    doc = doc.select(
        "scene_id", "kept", "part", *(F.json_array_length(c).alias(c) for c in lists), "total", F.json_array_length("closures").alias("closures"), "analysis_date",
        F.get_json_object("candidates", "$[0].id").alias("first_candidate"), F.get_json_object("stops", "$[0].id").alias("first_stop"), F.get_json_object("environment", "$.suitability").alias("suitability"),
    )
    count = lambda c: F.coalesce(F.sum(c), F.lit(-1)).cast("int").alias(c)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("part"))).alias(c)
    head = lambda c: F.max(F.when(F.col("part") == 0, F.col(c)))
    return doc.groupBy("scene_id", "kept").agg(
        head("total").cast("long").alias("total"), *(count(c) for c in lists), F.coalesce(head("closures"), F.lit(-1)).alias("closures"),
        first("first_candidate"), first("first_stop"), head("analysis_date").alias("analysis_date"), head("suitability").alias("suitability"),
    )


@query
def map_layers(spark, d):
    """Per scene the centre of its view; for every zone its outline with longitude first, and its centre."""
    rows = detections(spark, d)
    lat, lon = geo.mean_centre(F.col("lat"), F.col("lon"))
    views = rows.groupBy(F.col("scene_id").alias("layer")).agg(
        F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")
    ).withColumn("outline", F.lit(None).cast("string"))
    outlines = spark.createDataFrame(
        [(z.id, *(float(x) for x in geo.centroid(z.polygon)), [[float(a), float(b)] for a, b in z.polygon]) for z in ZONES],
        "layer string, lat double, lon double, ring array<array<double>>"
    )
    drawn = outlines.select("layer", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.to_json(geo.flip(F.col("ring"))).alias("outline"))
    return views.unionByName(drawn)


@query
def run_archive(spark, d):
    """Issues archived as JSON lines, a scene a line, and read back."""
    path = files.scratch(spark, "archive")
    issues = validate.listing(all_report_issues(spark, d).filter("rule = 'V13'"), detections(spark, d).select("scene_id"))
    scenes.write_archive(issues.withColumn("n", F.size(F.split("text", "\n")) - 1), path)
    return spark.read.schema("scene_id string, text string, n int").json(path).select("scene_id", "n")


def data_set(spark, d: str) -> str:
    """Chips, labels and manifest as a data set of files."""
    path, own = files.scratch(spark, "dataset"), chips(spark, d)
    dataset.write_dataset(own, raster.label_lines(raster.blobs(own, SMALL)), path)
    return path


@query
def chip_files(spark, d):
    """Chips as .npy files, read back pixel by pixel."""
    path = files.scratch(spark, "chips")
    scenes.write_chips(chips(spark, d), path)
    return scenes.read_chips(spark, path).groupBy("chip_id", "rows_n", "cols_n").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("row") * 8 + F.col("col"))), 6).alias("weighed")
    )


@query
def chip_ranges(spark, d):
    """One chip that holds all others, as a file of which each task reads a range of bytes."""
    path = files.scratch(spark, "strip")
    scenes.write_chips(strip(spark, d), path)
    rows = scenes.read_chips(spark, path, split=1 << 16)
    return rows.withColumn("part", F.expr("col div 256")).groupBy("chip_id", "rows_n", "cols_n", "part").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("row") * 256 + F.col("col") % 256 + 1)), 6).alias("weighed")
    )


@query
def label_files(spark, d):
    """Label files of a data set, by stem and line."""
    return scenes.read_labels(spark, f"{data_set(spark, d)}/labels").select("stem", "line_no", "line")


@query
def manifest_totals(spark, d):
    """What a manifest counts, and what its entries, which lie in parts beside it, add up to."""
    path = data_set(spark, d)
    head = scenes.read_manifest(spark, f"{path}/manifest.json")
    at = lambda p: F.get_json_object("manifest", p)
    listed = scenes.manifest_entries(spark, path).agg(
        F.count_if(F.col("review_status") == "pending").alias("pending"), F.count_if(F.col("candidate_labels") > 0).alias("labelled"),
        F.max("candidate_labels").alias("most")
    )
    return head.select(at("$.chips").cast("long").alias("chips"), at("$.candidate_labels_total").cast("long").alias("labels")).crossJoin(listed)  # a row each


@query
def sql_distances(spark, d):
    """Distances by SQL text over a function of the session."""
    sql.install(spark)
    lat, lon, _ = CONFIG.base
    rows = detections(spark, d).select("ord", "lat", "lon")
    return spark.sql(
        f"SELECT ord, distance_km({lat}e0, {lon}e0, lat, lon) AS distance_from_base_km FROM {{rows}} WHERE distance_km({lat}e0, {lon}e0, lat, lon) <= 60", rows=rows
    )


@query
def sql_wording(spark, d):
    """Wording by SQL text: how many documents and turns invoke the duty to carry AIS."""
    sql.install(spark)
    docs, turns = _documents(spark, d), read(spark, d, "conversations")
    return spark.sql(
        """SELECT 'document' AS kind, mentions_ais(text) AS cited, count(*) AS n FROM {docs} GROUP BY ALL
        UNION ALL SELECT 'turn', mentions_ais(text), count(*) FROM {turns} GROUP BY ALL""", docs=docs, turns=turns
    )


@query
def sql_anchors(spark, d):
    """Anchors by SQL text over a table function, joined laterally."""
    sql.install(spark)
    return spark.sql("SELECT doc_id, anchor FROM {docs} AS d, LATERAL anchors_of(d.text)", docs=_documents(spark, d))


@query
def sql_claims(spark, d):
    """Claims in the prose of all records by SQL text over a table function."""
    sql.install(spark)
    prose = claimed_prose(records(spark, d).select("ord", "id", "classification"))
    return spark.sql("SELECT scene_id, claimed, id FROM {prose} AS p, LATERAL claims_of(p.prose)", prose=prose)


@query
def prepared_dataset(spark, d):
    """The labelled chips of a data set, split in two."""
    return dataset.prepare(spark, data_set(spark, d), 0.34, 7).select("name", "part")


@query
def answer_attempts(spark, d):
    """Two attempts a scene: the first that parses counts, where none does the last is kept."""
    k = F.col("event_id") % 4
    good, cut = F.concat(F.lit('{"n": '), F.col("event_id"), F.lit("}")), F.lit('{"n": 1')
    rows = read(spark, d, "events").select(F.col("event_id").cast("string").alias("scene_id"), F.lit("analyst").alias("agent"), F.explode(F.array(
        F.struct(F.lit(1).alias("attempt"), F.when(k.isin(0, 1), good).otherwise(cut).alias("raw")), F.struct(
            F.lit(2).alias("attempt"), F.when(k.isin(0, 2), good).otherwise("sorry").alias("raw")
        ),
    )).alias("a")).select("scene_id", "agent", "a.*")
    chosen = responses.first_parsed(rows).select("scene_id", "attempt", F.lit("parsed").alias("state"))
    lost = responses.dead_letters(rows).select("scene_id", "attempt", F.col("failure").alias("state"))
    return chosen.unionByName(lost)


@query
def best_attempts(spark, d):
    """Of two rankings a scene the one that omits fewer candidates; the first wins a tie."""
    rows = judged(spark, d)
    listed = lambda keep: F.concat(
        F.lit('{"prioritised_candidates": ['),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "id")))), lambda x: F.concat(F.lit('{"id": "'), x["id"], F.lit('"}'))),
            ", "
        ),
        F.lit("]}")
    )
    every, odd = dossier.candidates(rows), F.col("ord") % 3 != 0
    said = every.groupBy("scene_id").agg(listed(odd).alias("one"), listed(~odd).alias("two")).select(
        "scene_id", F.posexplode(F.array("one", "two")).alias("k", "raw")
    )
    answers = said.select("scene_id", (F.col("k") + 1).alias("attempt"), F.parse_json("raw").alias("doc"))
    return responses.best_attempt(every, answers).select("scene_id", "attempt", "omitted")


@query
def recalled_targets(spark, d):
    """Parts as true targets, events' detections as found: those with one within two pixels."""
    truth = read(spark, d, "part").select(
        (F.col("p_partkey") % 7).alias("chip_id"), (F.col("p_partkey") * 13 % 200).cast("int").alias("row"),
        (F.col("p_partkey") * 29 % 200).cast("int").alias("col")
    )
    found = read(spark, d, "supplier").select(
        (F.col("s_suppkey") % 7).alias("chip_id"), (F.col("s_suppkey") * 17 % 200).alias("row"), (F.col("s_suppkey") * 31 % 200).alias("col")
    )
    return raster.recalled(truth, found)


@query
def document_positions(spark, d):
    """Positions given as an object or as a text, parsed and shown."""
    given = F.when(
        F.col("ord") % 3 == 0, F.concat(F.lit('{"lat": '), "lat", F.lit(', "lon": "'), "lon", F.lit('"}'))
    ).when(F.col("ord") % 3 == 1, F.concat_ws(", ", "lat", "lon")).otherwise(F.lit("not known"))
    rows = detections(spark, d).select("ord", given.alias("g"))
    return rows.select(
        "ord", T.position(F.col("g"))["lat"].alias("lat"), T.position(F.col("g"))["lon"].alias("lon"), T.position_text(F.col("g")).alias("shown")
    )
