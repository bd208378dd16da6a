"""Detections, structures and zones derived from the star-schema tables, and the configuration that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.schemas import Config, Season, Zone

_GEAR = ("bottom_trawl", "purse_seine")
ZONES = [
    Zone("BNK-21", "Shelf Bank", "marine_protected_area", ((36.31, -7.33), (36.31, -6.97), (36.58, -6.97), (36.58, -7.33)), _GEAR),
    Zone(
        "EST-34", "Estuary Front", "seasonal_closure", ((36.95, -6.9), (37.12, -6.72), (37.12, -6.48), (36.81, -6.55)), _GEAR[:1],
        ("2024-01-08", "2024-01-19", "spawning")
    ),
    Zone("NUR-47", "Nursery Core", "integral_reserve", ((36.66, -7.12), (36.66, -6.81), (36.84, -6.81), (36.84, -7.12)), ("all",)),
    Zone("HAV-58", "Haven", "restricted_area", ((36.21, -6.75), (36.48, -6.62), (36.24, -6.38), (36.45, -6.31), (36.33, -6.79)), _GEAR[1:]),
]
CONFIG = Config(
    ais_length_threshold_m=15.0, fishing_score_threshold=0.7, length_sigma_m=2.0, length_sigma_k=1.0, vms_length_threshold_m=12.0,
    ais_legal_basis="Article 10(1), Council Regulation (EC) No 1224/2009", base=(36.53, -6.29, "patrol base"), patrol_radius_km=60.0, study_area="Gulf", season=Season("01-15", "01-25"),
)
# The same configuration as a document.
REGULATION = {
    "_note": "thresholds in metres",
    "config": {
        "ais_length_threshold_m": CONFIG.ais_length_threshold_m, "fishing_score_threshold": CONFIG.fishing_score_threshold, "length_sigma_m": CONFIG.length_sigma_m,
        "vms_length_threshold_m": CONFIG.vms_length_threshold_m, "ais_legal_basis": CONFIG.ais_legal_basis, "patrol_radius_km": CONFIG.patrol_radius_km, "study_area": CONFIG.study_area,
        "patrol_base": dict(zip(("lat", "lon", "name"), CONFIG.base, strict=True)), "environment": {"season": {
            "start": CONFIG.season.start, "end": CONFIG.season.end
        }},
    },
    "zones": [
        {
            "id": z.id, "name": z.name, "type": z.type, "polygon": [list(p) for p in z.polygon], "prohibited_gear": list(z.prohibited_gear),
            "closure": dict(zip(("start", "end", "reason"), z.closure, strict=True)) if z.closure else None
        }
        for z in ZONES
    ],
}
GEOMETRY = {"type": "MultiPolygon", "coordinates": [
    [[[-7.3, 36.3], [-6.8, 36.3], [-6.8, 36.7], [-7.3, 36.7], [-7.3, 36.3]], [[-7.1, 36.4], [-7.0, 36.4], [-7.0, 36.6], [-7.1, 36.6], [-7.1, 36.4]]],
    [[[-6.7, 36.9], [-6.4, 36.9], [-6.5, 37.1], [-6.7, 37.1], [-6.7, 36.9]]],
]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections, a scene a day."""
    return read(spark, sf_dir, "events").select(
        F.concat(
            F.lit("S-"), F.expr("cast(cast(ts as date) as string)")
        ).alias("scene_id"), F.col("event_id").alias("ord"), F.concat(
            F.lit("D-"), F.col("event_id").cast("string")
        ).alias("id"), F.expr("cast(ts as date)").alias("day"), "ts",
        F.expr("(36200 + (event_id * 7919) % 1000) / 1000.0e0").alias("lat"), F.expr("(-7450 + (event_id * 104729) % 1200) / 1000.0e0").alias("lon"),
        F.expr(
            "5.0e0 + (cast(round(value * 100) as bigint) % 500) / 10.0e0"
        ).alias("estimated_length_m"), F.expr("cast(get_json_object(props, '$.k') as int) / 100.0e0").alias("fishing_score"),
        F.expr("case when event_type in ('purchase', 'click') then true when event_type in ('view', 'error') then false end").alias("ais_matched"),
        F.expr(
            "case user_id % 5 when 0 then 'bottom_trawl' when 1 then 'purse_seine' when 2 then 'small_scale' when 3 then 'in_transit' else 'unknown' end"
        ).alias("likely_gear"),
    )


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.concat(
            F.lit("FIX-"), F.col("s_suppkey").cast("string")
        ).alias("id"), F.col("s_name").alias("name"), F.lit("platform").alias("type"),
        F.expr("(36200 + (s_suppkey * 6151) % 1000) / 1000.0e0").alias("lat"), F.expr("(-7450 + (s_suppkey * 3571) % 1200) / 1000.0e0").alias("lon"),
        F.expr("case when s_suppkey % 5 = 0 then null else 300 + (s_suppkey % 5) * 700 end").cast("double").alias("match_radius_m"),
    )
