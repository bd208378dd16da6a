"""Types and fixed domains of the data model. Every reader declares its types; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

# Order of classes in every listing: the earlier, the more urgent.
CLASS_ORDER = ("high_priority", "medium_priority", "below_candidate_threshold", "fixed_structure", "no_indicators", "ais_not_applicable")
CANDIDATES = ("high_priority", "medium_priority")
BLOCKER, WARNING, CLEAN = "BLOCKER", "WARNING", "clean"

SCENE = "struct<source:string,mode:string,timestamp:string,area:string>"
DETECTION = (
    "struct<id:string,lat:double,lon:double,estimated_length_m:double,ais_matched:boolean,fishing_score:double,speed_kn:double,heading:bigint,"
    "likely_gear:string,mmsi:string,vessel_name:string,flag:string>"
)
SCENE_DOCUMENT = f"scene {SCENE}, first_detection bigint, detections array<{DETECTION}>"
DETECTIONS = (
    "scene_id string, ord bigint, id string, lat double, lon double, estimated_length_m double, ais_matched boolean, fishing_score double, speed_kn double, "
    "likely_gear string, mmsi string, vessel_name string, flag string, timestamp string"
)
STRUCTURES = "ord bigint, id string, name string, type string, lat double, lon double, match_radius_m double"
INDICATOR = "struct<kind:string,zone:string,zone_id:string,degraded:boolean,rests_on_activity:boolean,reason:string>"
SCORE_ITEM = "struct<factor:string,points:int>"
BRIEF = "struct<id:string,position:string,priority:string,indicators:array<string>,regulation_concerned:string,suggested_action:string,caveat:string>"
REPORT = f"struct<executive_summary:string,inspection_briefs:array<{BRIEF}>,methodological_note:string,human_decision_required:string>"
RANKED = "struct<id:string,rank:int,reason:string,indicator_type:string,confidence:string>"
PRIORITISATION = f"struct<prioritised_candidates:array<{RANKED}>,ais_not_applicable:array<string>,observed_pattern:string,overall_recommendation:string,limitations:array<string>>"
ISSUES = "scene_id string, severity string, place string, message string, rule string, ord bigint"


@dataclass(frozen=True)
class Weights:
    ais_dark: int = 40
    ais_dark_inconclusive: int = 20
    zone_violation: int = 30
    fishing_context: int = 10


@dataclass(frozen=True)
class Season:
    start: str | None = "10-10"
    end: str | None = "03-31"


@dataclass(frozen=True)
class Config:
    """What a jurisdiction sets. Without a patrol base there is no patrol; without a radius no stop is out of range."""

    ais_length_threshold_m: float
    fishing_score_threshold: float
    length_sigma_m: float = 0.0
    length_sigma_k: float = 1.0
    vms_length_threshold_m: float | None = None
    weights: Weights = field(default_factory=Weights)
    ais_legal_basis: str | None = None
    lawful_dark_derogation: str | None = None
    base: tuple[float, float, str] | None = None
    patrol_radius_km: float | None = None
    study_area: str | None = None
    output_language: str = "English"
    season: Season = field(default_factory=Season)
    dark_illumination: float = 0.25

    @property
    def vms(self) -> float:
        return 12.0 if self.vms_length_threshold_m is None else self.vms_length_threshold_m


@dataclass(frozen=True)
class Zone:
    """polygon: a ring of (lat, lon) pairs, or a GeoJSON geometry as a mapping. closure: start, end, reason."""

    id: str
    name: str
    type: str
    polygon: object
    prohibited_gear: tuple[str, ...] = ()
    closure: tuple[str, str, str] | None = None
    designation: str | None = None
