"""Assessment: detections against zones, closures, structures and thresholds, as one chain of column expressions.

Zones and thresholds are configuration and become literals of the plan, so nothing is shuffled for them and the whole
chain is generated code; structures, which may be many, are matched by an equi-join on grid cells before it.

Missing decisive data (length, activity score, date) raise. An absent AIS flag is `unknown`, never `dark`. A suppressed
indicator does not remove the row. Score is positive exactly where there is an indicator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import geo, temporal
from skerry.operators import spatial
from skerry.schemas import INDICATOR, SCORE_ITEM, Config, Zone

HIGH_COUNT = 2


def length_of(length: Column, name: Column) -> Column:
    """The length; an error names the detection that has none."""
    return F.coalesce(
        length,
        temporal.fail(F.concat(F.lit("detection "), F.coalesce(name, F.lit("?")), F.lit(": estimated_length_m is missing or not numeric")), "double")
    )


def score_of(score: Column, name: Column) -> Column:
    return F.coalesce(
        score,
        temporal.fail(
            F.concat(F.lit("detection "), F.coalesce(name, F.lit("?")), F.lit(": fishing_score is missing; that is not absence of activity")),
            "double"
        )
    )


def ais_status(matched: Column) -> Column:
    return F.when(matched.isNull(), "unknown").when(matched, "matched").otherwise("dark")


def applicability(length: Column, threshold: float, sigma: float, k: float) -> Column:
    """Strictly above beyond the margin, strictly above within it, or not."""
    return F.when(length - k * sigma > threshold, "applicable").when(length + k * sigma > threshold, "near_threshold_inconclusive").otherwise("not_applicable")


def _indicator(kind: str, zone: Zone | None, degraded: bool, rests: bool, reason: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(zone.name if zone else None).cast("string").alias("zone"), F.lit(zone.id if zone else None).cast("string").alias("zone_id"),
        F.lit(degraded).alias("degraded"), F.lit(rests).alias("rests_on_activity"), reason.alias("reason"),
    ).cast(INDICATOR)


def _item(factor: str, points: int) -> Column:
    return F.struct(F.lit(factor).alias("factor"), F.lit(points).alias("points")).cast(SCORE_ITEM)


def _present(parts: list[Column], kind: str) -> Column:
    return F.array_compact(F.array(*parts)) if parts else F.expr("array()").cast(f"array<{kind}>")


def assess(detections: DataFrame, zones: list[Zone], config: Config, structures: DataFrame | None = None, day: str = "day") -> DataFrame:
    """Records: the detections' columns with status, zones, indicators, notes, score and class."""
    w = config.weights
    basis = config.ais_legal_basis or "the AIS carriage and operation requirement"
    limit, sigma, k = config.ais_length_threshold_m, config.length_sigma_m, config.length_sigma_k
    name, lat, lon = F.col("id"), F.col("lat"), F.col("lon")

    # What is matched first is narrow; the texts below are made from what comes of it.
    if structures is not None:
        rows = spatial.match_structures(detections, structures)
    else:
        rows = detections.withColumn("fixed_structure", F.lit(None).cast(spatial.MATCH))
    rows = rows.withColumn(
        "estimated_length_m", length_of(F.col("estimated_length_m"), name)
    ).withColumn("fishing_score", score_of(F.col("fishing_score"), name))
    rows = rows.withColumn("ais_status", ais_status(F.col("ais_matched"))).withColumn("likely_gear", F.coalesce("likely_gear", F.lit("unknown")))
    rows = rows.withColumn("fishing", F.col("fishing_score") >= config.fishing_score_threshold)
    rows = rows.withColumn("ais_applicability", applicability(F.col("estimated_length_m"), limit, sigma, k))
    rows = rows.withColumns({f"_in{i}": geo.inside(lat, lon, z.polygon) for i, z in enumerate(zones)})

    dark, matched, fishing, gear = F.col("ais_status") == "dark", F.col("ais_status") == "matched", F.col("fishing"), F.col("likely_gear")
    applies, near = F.col("ais_applicability") == "applicable", F.col("ais_applicability") == "near_threshold_inconclusive"
    metres = F.concat(F.col("estimated_length_m").cast("string"), F.lit(" m"))
    firm_reason = F.concat(
        F.lit("estimated length "), metres,
        F.lit(f" exceeds {limit} m by more than the sensor's uncertainty and no AIS broadcast was matched; the duty to carry AIS may be engaged ({basis})")
    )
    near_reason = F.concat(
        F.lit("estimated length "), metres,
        F.lit(
            f" lies near {limit} m (uncertainty {k}*{sigma} m): inconclusive; without a matched AIS broadcast the duty to carry it could be engaged ({basis})"
        )
    )
    indicators = [
        F.when(dark & applies, _indicator("ais", None, False, False, firm_reason)),
        F.when(dark & near, _indicator("ais_inconclusive", None, True, False, near_reason))
    ]
    items = [
        F.when(dark & applies, _item("AIS broadcast not matched, length firmly above the threshold", w.ais_dark)),
        F.when(dark & near, _item("AIS broadcast not matched, length near the threshold: inconclusive", w.ais_dark_inconclusive))
    ]
    context = [F.when(F.col("ais_status") == "unknown", F.lit("AIS matching is unknown here, so the absence of a broadcast cannot be asserted"))]
    found = []
    for i, z in enumerate(zones):
        here = F.col(f"_in{i}")
        found.append(F.when(here, F.struct(F.lit(z.id).alias("id"), F.lit(z.name).alias("name"), F.lit(z.type).alias("type"))))
        label = f"{z.type} '{z.name}' ({z.id})"
        if "all" in z.prohibited_gear:
            hit = here & fishing
            indicators.append(F.when(
                hit,
                _indicator("zone", z, False, True, F.lit(f"likely fishing by the activity classifier inside {label}, where all gear is prohibited"))
            ))
            items.append(F.when(hit, _item(f"likely fishing where all gear is prohibited ({z.id})", w.zone_violation)))
        elif z.prohibited_gear:
            banned = here & gear.isin(*z.prohibited_gear)
            indicators.append(F.when(
                banned & matched,
                _indicator("zone", z, False, False, F.concat(F.lit("registered gear '"), gear, F.lit(f"' is prohibited inside {label}")))
            ))
            items.append(F.when(banned & matched, _item(f"registered gear is prohibited in the zone ({z.id})", w.zone_violation)))
            context.append(F.when(
                banned & ~matched,
                F.concat(F.lit("inferred gear '"), gear, F.lit(f"' would be prohibited inside {label}; inferred gear is context only"))
            ))
        if z.closure:
            shut = here & fishing & temporal.closure_active(z, F.col(day))
            indicators.append(F.when(
                shut,
                _indicator(
                    "zone", z, False, True,
                    F.lit(f"likely fishing by the activity classifier inside '{z.name}' ({z.id}) while it is closed ({z.closure[2]})")
                )
            ))
            items.append(F.when(shut, _item(f"likely fishing during a closure ({z.id})", w.zone_violation)))

    zone_type = "struct<id:string,name:string,type:string>"
    rows = rows.withColumns({
        "zones": _present(found, zone_type), "_ind": _present(indicators, INDICATOR), "_ctx": _present(context, "string"),
        "_items": _present(items, SCORE_ITEM)
    })
    rows = rows.drop(*(f"_in{i}" for i in range(len(zones))))
    rows = rows.withColumn("_items", F.when(
        fishing & (F.size("_ind") > 0) & ~F.exists("_ind", lambda x: (x.kind == "zone") & x.rests_on_activity),
        F.array_append("_items", _item("activity classifier indicates likely fishing: corroboration only", w.fishing_context)),
    ).otherwise(F.col("_items")))

    fixed = F.col("fixed_structure").isNotNull()
    demoted = F.transform(
        "_ind",
        lambda x: F.concat(F.lit("suppressed as attributable to fixed structure "), F.coalesce(F.col("fixed_structure.id"), F.lit("?")), F.lit(": "), x.reason)
    )
    empty = lambda kind: F.expr("array()").cast(f"array<{kind}>")
    rows = rows.withColumns({
        "potential_indicators": F.when(fixed, empty(INDICATOR)).otherwise(F.col("_ind")),
        "contextual_notes": F.when(fixed, F.concat("_ctx", demoted)).otherwise(F.col("_ctx")),
        "score_breakdown": F.when(fixed, empty(SCORE_ITEM)).otherwise(F.col("_items")),
        "ais_indicator_suppressed": dark & ~applies & ~near & ~fixed,
    }).drop("_ind", "_ctx", "_items")
    rows = rows.withColumn("score", F.aggregate("score_breakdown", F.lit(0), lambda a, x: a + x.points))
    rows = rows.withColumn(
        "firm", F.size(F.filter("potential_indicators", lambda x: ~x.degraded))
    ).withColumn("degraded", F.size("potential_indicators") - F.col("firm"))

    margin, vms, own = k * sigma, config.vms, F.col("estimated_length_m")
    note = F.concat(
        F.lit("Below the length from which AIS must be carried: silence is not an indicator. Other indicators, if any, remain."),
        F.when(own - margin >= vms, F.lit(f" The right cross-check is VMS, which is carried from {vms} m.")).when(
            own + margin >= vms, F.lit(f" The length is within uncertainty of {vms} m, so a VMS cross-check may or may not apply.")
        ).otherwise(F.lit("")),
    )
    rows = rows.withColumn("ais_note", F.when(F.col("ais_indicator_suppressed"), note))
    firm, worse = F.col("firm"), F.col("degraded")
    rows = rows.withColumn("classification", (
        F.when(fixed, "fixed_structure").when(firm >= HIGH_COUNT, "high_priority").when(firm >= 1, "medium_priority").when(worse > 0, "below_candidate_threshold")
        .when(F.col("ais_indicator_suppressed"), "ais_not_applicable").otherwise("no_indicators")
    ))
    text = lambda c: c.cast("string")
    rows = rows.withColumn("note", (
        F.when(
            fixed,
            F.concat(
                F.lit("Coincides with fixed structure "), F.coalesce("fixed_structure.id", F.lit("?")), F.lit(" ("),
                F.coalesce("fixed_structure.type", F.lit("unknown")), F.lit("); verify that no vessel operates beside it.")
            )
        )
        .when(firm >= HIGH_COUNT, F.concat(text(firm), F.lit(" independent indicators concur.")))
        .when(
            firm >= 1,
            F.concat(
                text(firm), F.lit(" indicator; corroboration is needed."),
                F.when(worse > 0, F.concat(F.lit(" "), text(worse), F.lit(" further degraded indicator(s) corroborate only."))).otherwise(F.lit(""))
            )
        )
        .when(worse > 0, F.concat(text(worse), F.lit(" degraded indicator(s) only: recorded, not enough for an inspection.")))
        .when(F.col("ais_indicator_suppressed"), F.col("ais_note")).otherwise(F.lit("Nothing that would justify an inspection."))
    ))
    has = set(detections.columns)
    opt = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    return rows.withColumns({
        "ais": F.when(matched, "matched").when(dark, "unmatched (dark)").otherwise("unknown"),
        "jurisdiction": F.when(matched, F.coalesce(opt("flag"), F.lit("unknown"))).otherwise(F.lit("unknown")),
        "identity": F.when(matched, F.struct(opt("mmsi").alias("mmsi"), opt("vessel_name").alias("name"), opt("flag").alias("flag"))),
    })
