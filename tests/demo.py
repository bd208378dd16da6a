"""A small scene with known results, as literals: fixed values all of them, down to ROWS, ZONES and CONFIG."""

from skerry.schemas import Config, Season, Weights, Zone

TIMESTAMP = "2026-07-18T06:12:00Z"
# id, lat, lon, length, AIS flag (None: absent), activity score, speed, gear, name, flag
ROWS = [
    ("D-001", 36.72, -7.05, 34.0, False, 0.91, 3.1, "bottom_trawl", None, None),
    ("D-002", 36.71, -7.02, 28.5, False, 0.86, 2.8, "bottom_trawl", None, None),
    ("D-003", 36.78, -6.95, 41.0, True, 0.34, 9.4, "in_transit", "A", "ESP"),
    ("D-004", 36.47, -6.74, 22.0, False, 0.88, 2.2, "purse_seine", None, None),
    ("D-005", 36.49, -6.78, 9.5, False, 0.72, 3.0, "small_scale", None, None),
    ("D-006", 37.02, -6.92, 31.0, True, 0.89, 2.6, "bottom_trawl", "B", "ESP"),
    ("D-007", 37.05, -6.80, 12.0, False, 0.55, 4.1, "small_scale", None, None),
    ("D-008", 36.30, -7.40, 55.0, False, 0.93, 2.4, "bottom_trawl", None, None),
    ("D-009", 36.65, -7.12, 18.0, True, 0.28, 11.0, "in_transit", "C", "PRT"),
    ("D-010", 36.44, -6.70, 26.5, False, 0.95, 1.9, "bottom_trawl", None, None),
    ("D-011", 36.95, -7.00, 8.0, False, 0.41, 5.5, "small_scale", None, None),
    ("D-012", 36.20, -6.50, 47.0, True, 0.90, 2.7, "purse_seine", "D", "MAR"),
    ("D-013", 36.701, -7.049, 30.0, False, 0.90, 0.2, "bottom_trawl", None, None),
]


def box(south, north, west, east):
    return ((south, west), (south, east), (north, east), (north, west))


ZONES = [
    Zone("MPA-01", "North Bank", "marine_protected_area", box(36.60, 36.85, -7.20, -6.90), ("bottom_trawl", "purse_seine")),
    Zone("CLS-02", "River Mouth", "seasonal_closure", box(36.90, 37.15, -7.10, -6.75), ("bottom_trawl",), ("2026-06-01", "2026-09-30", "spawning")),
    Zone("RES-03", "Inner Reserve", "integral_reserve", box(36.40, 36.55, -6.85, -6.65), ("all",)),
]
CONFIG = Config(
    ais_length_threshold_m=15.0, fishing_score_threshold=0.7, length_sigma_m=2.0, length_sigma_k=1.0, vms_length_threshold_m=12.0, weights=Weights(), ais_legal_basis="Article 10(1), Council Regulation (EC) No 1224/2009",
    base=(36.53, -6.29, "base"), patrol_radius_km=120.0, season=Season("10-10", "03-31"),
)
DDL = "scene_id string, ord bigint, id string, lat double, lon double, estimated_length_m double, ais_matched boolean, fishing_score double, speed_kn double, likely_gear string, vessel_name string, flag string, mmsi string, day date"


def detections(spark, rows=ROWS, day="2026-07-18", scene="S"):
    from datetime import date

    out = [(scene, k, *r[:8], r[8], r[9], None, date.fromisoformat(day)) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, DDL)


def structures(spark, radius=400.0):
    return spark.createDataFrame(
        [(0, "FIX-01", "Platform", "fixed_platform", 36.70, -7.05, radius)],
        "ord bigint, id string, name string, type string, lat double, lon double, match_radius_m double"
    )


def records(spark):
    from skerry.operators import assess

    return assess.assess(detections(spark), ZONES, CONFIG, structures(spark))
