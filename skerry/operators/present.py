"""Text reports for people. The only place where rows come to the driver: the listings of one scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import temporal
from skerry.functions import text as T
from skerry.operators import dossier
from skerry.schemas import Config, Zone


def head_lines(scenes: DataFrame, scene_id: str, zones: list[Zone], config: Config, detections: int) -> list[str]:
    """What stands above a scene's listings: scenes (scene_id, timestamp)."""
    row = temporal.conditions(scenes.filter(F.col("scene_id") == scene_id), config).withColumn("day", temporal.scene_date(F.col("timestamp")))
    shut = dossier.active_closures(row.select("scene_id", "day"), zones).collect()
    env = row.first()
    out = [f"Study area {config.study_area or '-'}, scene of {env['timestamp']}", f"{detections} detections"]
    out.append(f"AIS is compulsory above {config.ais_length_threshold_m} m; lengths are known to {config.length_sigma_m} m")
    out += [f"Conditions ({env['moon_phase']}): {env['suitability']}; {env['rationale']}", f"  {env['role']}"]
    out += [f"Closed: {r['zone']} ({r['reason']})" for r in shut]
    if config.base:
        out.append(f"Base: {config.base[2]}" + (f", radius {config.patrol_radius_km} km" if config.patrol_radius_km is not None else ""))
    return out


def dossier_lines(records: DataFrame, scene_id: str, config: Config, scenes: DataFrame | None = None, zones: list[Zone] = ()) -> list[str]:
    """A scene's summary, candidates, patrol, what lies below the threshold, and what was suppressed; with scenes, its head."""
    own = records.filter(F.col("scene_id") == scene_id)
    out = [f"Dossier of {scene_id}", *(head_lines(scenes, scene_id, list(zones), config, own.count()) if scenes is not None else ()), "", "Classes:"]
    out += [f"  {r['classification']:<28}{r['n']}" for r in dossier.summary(own).orderBy("rank").collect()]
    out.append("\nCandidates:")
    rows = dossier.ordered(dossier.with_distance(dossier.candidates(own), config)).orderBy("pos")
    for r in rows.collect():
        who = f" [{r['identity']['name']} / {r['identity']['flag']}]" if r["identity"] and r["identity"]["name"] else ""
        out.append(f"  {r['id']}{who} {r['classification']} score {r['score']} at {r['lat']}, {r['lon']}, {r['distance_from_base_km']} km")
        out += [f"    zone {z['name']} ({z['type']})" for z in r["zones"]]
        out += [f"    indicator: {i['reason']}" for i in r["potential_indicators"]]
        out += [f"    note: {n}" for n in r["contextual_notes"]]
        out += [f"    +{i['points']} {i['factor']}" for i in r["score_breakdown"]]
    out.append("\nPatrol:")
    out += [f"  {r['stop']}. {r['id']} {r['classification']} {r['distance_from_base_km']} km" for r in dossier.patrol(own, config).orderBy("stop").collect()]
    out.append("\nBelow the threshold:")
    out += [
        f"  {r['id']} ({r['classification']}, score {r['score']}): {r['summary']}" for r in dossier.ordered(dossier.below_threshold(own)).orderBy("pos").collect()
    ]
    out.append("\nAIS indicator suppressed:")
    out += [f"  {r['id']} ({r['classification']}): {r['ais_note']}" for r in dossier.ordered(dossier.suppressed(own)).orderBy("pos").collect()]
    out.append("\nFixed structures:")
    out += [f"  {r['id']} -> {r['fixed_structure']['id']}: {r['note']}" for r in dossier.ordered(dossier.fixed(own)).orderBy("pos").collect()]
    return out


def ranking_lines(ranked: DataFrame) -> list[str]:
    return [f"{r['rank']}. {r['id']}: {r['reason']}" for r in ranked.orderBy("rank_ord").collect()]


def brief_lines(briefs: DataFrame) -> list[str]:
    out = []
    for r in briefs.withColumn("position", T.position_text(F.col("position"))).orderBy("brief_ord").collect():
        out += [
            f"[{(r['priority'] or '').upper()}] {r['id']} - {r['position']}", *(f"  - {i}" for i in r["indicators"] or []),
            f"  regulation: {r['regulation_concerned']}", f"  action: {r['suggested_action']}", f"  caveat: {r['caveat']}"
        ]
    return out
