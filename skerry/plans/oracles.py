"""SQL for the catalogue, for an engine that knows nothing of this library."""

from __future__ import annotations

from skerry.functions import temporal
from skerry.functions.geo import parts_of, ring_edges
from skerry.plans.derive import CONFIG, GEOMETRY, ZONES
from skerry.sources.scenes import REGION

_EDGES = ", ".join(f"('{z.id}', {k}, {a}e0, {b}e0, {c}e0, {e}e0)" for k, z in enumerate(ZONES) for a, b, c, e in ring_edges(z.polygon))
_CROSSED = "((lon_i > lon) <> (lon_j > lon)) AND lat < (lat_j - lat_i) * (lon - lon_i) / nullif(lon_j - lon_i, 0e0) + lat_i"
_KM = lambda a, b, c, e: f"round(12742.0e0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))), 2)"
_BASE_KM = _KM(f"{CONFIG.base[0]}e0", f"({CONFIG.base[1]}e0)", "lat", "lon")
_RANK = "CASE classification WHEN 'high_priority' THEN 0 WHEN 'medium_priority' THEN 1 WHEN 'below_candidate_threshold' THEN 2 WHEN 'fixed_structure' THEN 3 WHEN 'no_indicators' THEN 4 ELSE 5 END"

_Z = [z.id for z in ZONES]
_SHUT = f"day BETWEEN DATE '{ZONES[1].closure[0]}' AND DATE '{ZONES[1].closure[1]}'"
_BANNED = " OR ".join(
    f"(zone_id = '{z.id}' AND likely_gear IN ({', '.join(repr(g) for g in z.prohibited_gear)}))" for z in ZONES if "all" not in z.prohibited_gear
)
DET = """det AS (SELECT event_id AS ord, 'S-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scene_id, 'D-' || CAST(event_id AS VARCHAR) AS
  id, CAST(ts AS DATE) AS
  day, ts, (36200 + (event_id * 7919) % 1000) / 1000.0e0 AS lat, (-7450 + (event_id * 104729) % 1200) / 1000.0e0 AS lon,
  5.0e0 + (CAST(round(value * 100) AS BIGINT) % 500) / 10.0e0 AS estimated_length_m, CAST(json_extract_string(props, '$.k')
  AS INTEGER) / 100.0e0 AS
  fishing_score,
  CASE WHEN event_type IN ('purchase', 'click') THEN true WHEN event_type IN ('view', 'error') THEN false END AS ais_matched,
  CASE user_id % 5 WHEN 0 THEN 'bottom_trawl' WHEN 1 THEN 'purse_seine' WHEN 2 THEN 'small_scale' WHEN 3 THEN 'in_transit'
  ELSE 'unknown' END AS
  likely_gear FROM events)"""
STRUCT = """st AS (SELECT s_suppkey AS s_ord, 'FIX-' || CAST(s_suppkey AS VARCHAR) AS structure_id, (36200 + (s_suppkey * 6151) % 1000) /
  1000.0e0 AS slat, (-7450
  + (s_suppkey * 3571) % 1200) / 1000.0e0 AS slon,
  coalesce(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 300 + (s_suppkey % 5) * 700 END, 300) / 1000.0e0 AS s_km FROM supplier)"""
HITS = f"""edges AS (SELECT * FROM (VALUES {_EDGES}) AS e(zone_id, z, lat_i, lon_i, lat_j, lon_j)),
hits AS (SELECT ord, zone_id, z FROM det, edges WHERE {_CROSSED} GROUP BY ord, zone_id, z HAVING count(*) % 2 = 1)"""
FIXED = f"""pairs AS (SELECT ord, structure_id, s_ord, s_km, {_KM("lat", "lon", "slat", "slon")} AS km FROM det, st WHERE abs(lat - slat)
  < 0.1e0 AND abs(lon -
  slon) < 0.1e0),
fx AS (SELECT ord, structure_id, km FROM pairs WHERE km <= s_km QUALIFY row_number() OVER (PARTITION BY ord ORDER BY km,
  s_ord) = 1)"""
_BASIS = CONFIG.ais_legal_basis
_LABELS = ", ".join(f"('{z.id}', '{z.name}', '{z.type}')" for z in ZONES)
ASSESS = f"""WITH {DET}, {STRUCT}, {HITS}, {FIXED},
base AS (SELECT det.*, CASE WHEN ais_matched IS NULL THEN 'unknown' WHEN ais_matched THEN 'matched' ELSE 'dark' END AS
  ais_status,
  CASE WHEN estimated_length_m - 2.0e0 > 15.0e0 THEN 'applicable' WHEN estimated_length_m + 2.0e0 > 15.0e0 THEN
  'near_threshold_inconclusive' ELSE
  'not_applicable' END AS ais_applicability,
  fishing_score >= 0.7e0 AS fishing, {_BASE_KM} AS distance_from_base_km FROM det),
label AS (SELECT * FROM (VALUES {_LABELS}) AS l(zone_id, zname, ztype)),
raw AS (
  SELECT ord, 0 AS k, 'ais' AS kind, NULL AS zone_id, false AS degraded, false AS rests, 40 AS points,
    'estimated length ' || CAST(estimated_length_m AS VARCHAR) ||
  ' m exceeds 15.0 m by more than the sensor''s uncertainty and no AIS broadcast was matched; the duty to carry AIS may be engaged ({_BASIS})' AS
  reason
    FROM base WHERE ais_status = 'dark' AND ais_applicability = 'applicable'
  UNION ALL SELECT ord, 0, 'ais_inconclusive', NULL, true, false, 20,
    'estimated length ' || CAST(estimated_length_m AS VARCHAR) ||
  ' m lies near 15.0 m (uncertainty 1.0*2.0 m): inconclusive; without a matched AIS broadcast the duty to carry it could be engaged ({_BASIS})'
    FROM base WHERE ais_status = 'dark' AND ais_applicability = 'near_threshold_inconclusive'
  UNION ALL SELECT ord, 10 + 2 * z, 'zone', zone_id, false, true, 30,
    'likely fishing by the activity classifier inside ' || ztype || ' ''' || zname || ''' (' || zone_id ||
  '), where all gear is prohibited'
    FROM base JOIN hits USING (ord) JOIN label USING (zone_id) WHERE zone_id = '{_Z[2]}' AND fishing
  UNION ALL SELECT ord, 10 + 2 * z, 'zone', zone_id, false, false, 30,
    'registered gear ''' || likely_gear || ''' is prohibited inside ' || ztype || ' ''' || zname || ''' (' || zone_id || ')'
    FROM base JOIN hits USING (ord) JOIN label USING (zone_id) WHERE ais_status = 'matched' AND ({_BANNED})
  UNION ALL SELECT ord, 11 + 2 * z, 'zone', zone_id, false, true, 30,
    'likely fishing by the activity classifier inside ''' || zname || ''' (' || zone_id ||
  ') while it is closed ({ZONES[1].closure[2]})'
    FROM base JOIN hits USING (ord) JOIN label USING (zone_id) WHERE zone_id = '{_Z[1]}' AND fishing AND {_SHUT}),
ind AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY k) - 1 AS INTEGER) AS place FROM raw WHERE ord NOT IN
  (SELECT ord FROM fx)),
agg AS (SELECT ord, count(*) AS n, count(*) FILTER (NOT degraded) AS firm, count(*) FILTER (degraded) AS degraded,
  sum(points) AS points, bool_or(kind
  = 'zone' AND rests) AS rests, bool_or(kind LIKE 'ais%') AS has_ais,
  list(zone_id ORDER BY k) FILTER (zone_id IS NOT NULL) AS cited, list(reason ORDER BY k) AS reasons FROM ind GROUP BY ord),
notes AS (SELECT ord, 1 AS demoted FROM raw WHERE ord IN (SELECT ord FROM fx) UNION ALL SELECT ord, 0 FROM base WHERE
  ais_status = 'unknown'
  UNION ALL SELECT ord, 0 FROM base JOIN hits USING (ord) WHERE ais_status <> 'matched' AND ({_BANNED})),
rec AS (SELECT b.*, fx.structure_id, coalesce(firm, 0) AS firm, coalesce(degraded, 0) AS degraded, coalesce(n, 0) AS
  n_indicators, cited,
  coalesce(reasons, []) AS reasons, coalesce(has_ais, false) AS has_ais,
  CAST(coalesce(points, 0) + CASE WHEN fishing AND coalesce(n, 0) > 0 AND NOT rests THEN 10 ELSE 0 END AS INTEGER) AS score,
  ais_status = 'dark' AND ais_applicability = 'not_applicable' AND fx.ord IS NULL AS ais_indicator_suppressed,
  CASE WHEN fx.ord IS NOT NULL THEN 'fixed_structure' WHEN firm >= 2 THEN 'high_priority' WHEN firm >= 1 THEN
  'medium_priority' WHEN degraded > 0 THEN
  'below_candidate_threshold'
    WHEN ais_status = 'dark' AND ais_applicability = 'not_applicable' THEN 'ais_not_applicable' ELSE 'no_indicators' END AS
  classification
  FROM base AS b LEFT JOIN fx USING (ord) LEFT JOIN agg USING (ord))"""
_NAMES = "CASE z " + " ".join(f"WHEN '{z.id}' THEN '{z.name} ({z.id})'" for z in ZONES) + " END"
_MOON = """moon AS (SELECT *, (t - floor(t / 29.530588853e0) * 29.530588853e0) / 29.530588853e0 AS turn FROM (SELECT *,
  date_diff('microsecond', TIMESTAMP
  '2000-01-06 18:14:00', ts) / 86400e6 AS t FROM det)),
lit AS (SELECT *, (1.0e0 - cos(2.0e0 * pi() * turn)) / 2 AS light, (cos(4.0e0 * pi() * turn) + 1) / 2 AS tide FROM moon)"""


def _geometry() -> str:
    """Per part: parity over all rings, or on an edge."""
    values, flags = [], []
    for part, rings in enumerate(parts_of(GEOMETRY)):
        values += [f"({part}, {a}e0, {b}e0, {c}e0, {e}e0)" for ring in rings for a, b, c, e in ring_edges(ring)]
        flags.append(part)
    return f"""WITH {DET}, edges AS (SELECT * FROM (VALUES {", ".join(values)}) AS v(part, lat_i, lon_i, lat_j, lon_j)),
p AS (SELECT ord, part, count(*) FILTER ({_CROSSED}) % 2 = 1 OR bool_or((lat - lat_i) * (lon_j - lon_i) = (lon - lon_i) *
  (lat_j - lat_i) AND lat
  BETWEEN least(lat_i, lat_j) AND greatest(lat_i, lat_j) AND lon BETWEEN least(lon_i, lon_j) AND greatest(lon_i, lon_j)) AS
  hit FROM det, edges GROUP
  BY ord, part)
SELECT ord, bool_or(hit) AS covered FROM p GROUP BY ord"""


_COLOUR = "CASE classification WHEN 'high_priority' THEN 'rgba(214,40,40,0.86)' WHEN 'medium_priority' THEN 'rgba(243,166,30,0.86)' WHEN 'no_indicators' THEN 'rgba(140,140,140,0.47)' WHEN 'ais_not_applicable' THEN 'rgba(90,140,200,0.63)' ELSE 'rgba(140,140,140,0.63)' END"
_ORDER = f"{_RANK}, score DESC, ord"
_CANDIDATE = "classification IN ('high_priority', 'medium_priority')"

ORACLES: dict[str, str] = {
    "detections_scan": f"WITH {DET} SELECT ord, CAST(day AS VARCHAR) AS day, lat, lon, estimated_length_m, fishing_score, ais_matched, likely_gear FROM det",
    "ais_by_zone": f"""{ASSESS} SELECT zone_id, ais_status AS status, count(*) AS n, count(*) FILTER (fishing) AS active FROM base JOIN hits USING
  (ord) GROUP BY ALL""",
    "ais_status": f"{ASSESS} SELECT ais_status AS status, count(*) AS n FROM base GROUP BY ALL",
    "ais_applicability": f"""{ASSESS} SELECT ord, ais_applicability AS state, CASE WHEN estimated_length_m - 2.0e0 >= 12.0e0 THEN 'cross_check' WHEN
  estimated_length_m + 2.0e0 >=
  12.0e0 THEN 'may_or_may_not' ELSE 'none' END AS vms FROM base""",
    "zone_containment": f"WITH {DET}, {HITS} SELECT ord, zone_id FROM hits WHERE zone_id <> '{_Z[3]}'",
    "zone_containment_ring": f"WITH {DET}, {HITS} SELECT ord, zone_id FROM hits WHERE zone_id = '{_Z[3]}'",
    "zone_containment_grid": f"WITH {DET}, {HITS} SELECT ord, zone_id FROM hits",
    "geojson_containment": _geometry(),
    "geojson_containment_rows": _geometry(),
    "fixed_structure_match": f"WITH {DET}, {STRUCT}, {FIXED} SELECT ord, structure_id, km FROM fx",
    "base_distance": f"WITH {DET} SELECT ord, {_BASE_KM} AS distance_from_base_km FROM det",
    "closure_active": f"WITH {DET} SELECT DISTINCT CAST(day AS VARCHAR) AS day, {_SHUT} AS active FROM det",
    "season_gate": f"""WITH {DET}, m AS (SELECT DISTINCT day, month(day) * 100 + day(day) AS md FROM det) SELECT CAST(day AS VARCHAR) AS day, md
  BETWEEN 115 AND 125 AS
  plain, md >= 120 OR md <= 105 AS wraps FROM m""",
    "lunar_phase": f"""WITH {DET}, {_MOON} SELECT ord, round(light, 3) AS illumination, round(tide, 3) AS spring, ['new moon', 'waxing crescent',
  'first quarter',
  'waxing gibbous', 'full moon', 'waning gibbous', 'last quarter', 'waning crescent'][CAST(floor(turn * 8 + 0.5e0) AS BIGINT)
  % 8 + 1] AS name FROM
  lit""",
    "suitability": f"""WITH {DET}, {_MOON} SELECT ord, CASE WHEN NOT (month(day) * 100 + day(day) BETWEEN 115 AND 125) THEN 'out_of_season' WHEN
  light <= 0.25e0 AND tide >=
  0.5e0 THEN 'high' WHEN light <= 0.25e0 OR tide >= 0.5e0 THEN 'moderate' ELSE 'low' END AS suitability FROM lit""",
    "indicators_long": f"{ASSESS} SELECT ord, place, kind, zone_id, degraded, rests FROM ind",
    "context_notes": f"{ASSESS} SELECT ord, CAST(count(*) AS INTEGER) AS n_notes, CAST(sum(demoted) AS INTEGER) AS n_demoted FROM notes GROUP BY ord",
    "score_breakdown": f"""{ASSESS} SELECT ord, place, points FROM ind UNION ALL SELECT ord, CAST(n_indicators AS INTEGER), 10 FROM rec JOIN agg USING
  (ord) WHERE fishing AND n
  > 0 AND NOT rests""",
    "assessed_records": f"""{ASSESS}, zs AS (SELECT ord, string_agg(zone_id, '|' ORDER BY z) AS zone_ids FROM hits GROUP BY ord), ns AS (SELECT ord,
  count(*) AS notes FROM notes
  GROUP BY ord)
SELECT ord, ais_status, ais_applicability, CASE ais_status WHEN 'dark' THEN 'unmatched (dark)' ELSE ais_status END AS ais,
  coalesce(zone_ids, '') AS
  zone_ids, CAST(firm AS INTEGER) AS firm, CAST(degraded AS INTEGER) AS degraded, CAST(coalesce(notes, 0) AS INTEGER) AS
  notes,
score, classification, ais_indicator_suppressed, structure_id, distance_from_base_km FROM rec LEFT JOIN zs USING (ord) LEFT
  JOIN ns USING (ord)""",
    "classification_summary": f"{ASSESS} SELECT scene_id, classification, count(*) AS n, CAST({_RANK} AS INTEGER) AS rank FROM rec GROUP BY ALL",
    "active_closures": f"""WITH {DET} SELECT DISTINCT CAST(day AS VARCHAR) AS day, '{_Z[1]}' AS zone_id, '{ZONES[1].closure[2]}' AS reason FROM det
  WHERE {_SHUT}""",
    "inspection_candidates": f"""{ASSESS} SELECT id, classification, score, CAST(n_indicators AS INTEGER) AS n_indicators, array_to_string(list_filter([CASE
  WHEN has_ais THEN 'AIS'
  END], lambda x: x IS NOT NULL)
 || coalesce(list_transform(list_filter(cited, lambda z, i: list_position(cited, z) = i), lambda z: {_NAMES}), []), '; ') AS
  citation FROM rec WHERE
  {_CANDIDATE}""",
    "suppressed": f"{ASSESS} SELECT id, classification, estimated_length_m + 2.0e0 >= 12.0e0 AS mentions_vms FROM rec WHERE ais_indicator_suppressed",
    "silently_suppressed": f"{ASSESS} SELECT id FROM rec WHERE ais_indicator_suppressed AND n_indicators = 0",
    "fixed_suppressed": f"{ASSESS} SELECT id, structure_id FROM rec WHERE classification = 'fixed_structure'",
    "below_threshold": f"""{ASSESS} SELECT id, classification, score,
  CASE WHEN n_indicators = 0 THEN 'no indicators' ELSE substr(reasons[1], 1, 90) || '...' END AS summary
FROM rec WHERE classification NOT LIKE '%_priority' AND NOT ais_indicator_suppressed""",
    "record_texts": f"""{ASSESS}, w AS (SELECT *, CASE WHEN ais_indicator_suppressed
  THEN 'Below the length from which AIS must be carried: silence is not an indicator. Other indicators, if any, remain.'
  || CASE WHEN estimated_length_m - 2.0e0 >= 12.0e0 THEN ' The right cross-check is VMS, which is carried from 12.0 m.'
    WHEN estimated_length_m + 2.0e0 >= 12.0e0 THEN ' The length is within uncertainty of 12.0 m, so a VMS cross-check may or may not apply.'
    ELSE '' END END AS ais_note FROM rec)
SELECT ord, ais_note, CASE classification
  WHEN 'fixed_structure' THEN 'Coincides with fixed structure ' || structure_id || ' (platform); verify that no vessel operates beside it.'
  WHEN 'high_priority' THEN firm || ' independent indicators concur.'
  WHEN 'medium_priority' THEN firm || ' indicator; corroboration is needed.'
    || CASE WHEN degraded > 0 THEN ' ' || degraded || ' further degraded indicator(s) corroborate only.' ELSE '' END
  WHEN 'below_candidate_threshold' THEN degraded || ' degraded indicator(s) only: recorded, not enough for an inspection.'
  WHEN 'ais_not_applicable' THEN ais_note ELSE 'Nothing that would justify an inspection.' END AS note FROM w""",
    "contextual_notes": f"""{ASSESS}
SELECT ord, 'suppressed as attributable to fixed structure ' || structure_id || ': ' || reason AS note FROM raw JOIN fx USING (ord)
UNION ALL SELECT ord, 'AIS matching is unknown here, so the absence of a broadcast cannot be asserted' FROM base WHERE ais_status = 'unknown'
UNION ALL SELECT ord, 'inferred gear ''' || likely_gear || ''' would be prohibited inside ' || ztype || ' ''' || zname || ''' (' || zone_id
  || '); inferred gear is context only' FROM base JOIN hits USING (ord) JOIN label USING (zone_id) WHERE ais_status <> 'matched' AND ({_BANNED})""",
    "score_factors": f"""{ASSESS} SELECT ord, CASE WHEN kind = 'ais' THEN 'AIS broadcast not matched, length firmly above the threshold'
  WHEN kind = 'ais_inconclusive' THEN 'AIS broadcast not matched, length near the threshold: inconclusive'
  WHEN k % 2 = 1 THEN 'likely fishing during a closure (' || zone_id || ')'
  WHEN rests THEN 'likely fishing where all gear is prohibited (' || zone_id || ')'
  ELSE 'registered gear is prohibited in the zone (' || zone_id || ')' END AS factor, points FROM ind
UNION ALL SELECT ord, 'activity classifier indicates likely fishing: corroboration only', 10
FROM rec JOIN agg USING (ord) WHERE fishing AND n > 0 AND NOT agg.rests""",
    "record_order": f"""{ASSESS} SELECT ord, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY {_ORDER}) AS INTEGER) AS pos,
  CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS place FROM rec""",
    "patrol_sequence": f"""{ASSESS} SELECT ord, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY {_RANK}, distance_from_base_km, score DESC, ord)
  AS INTEGER) AS stop,
  distance_from_base_km FROM rec WHERE {_CANDIDATE} AND distance_from_base_km <= 60.0e0""",
    "map_points": f"""{ASSESS} SELECT classification, {_COLOUR} AS colour, CASE WHEN {_CANDIDATE} THEN 1400 ELSE 700 END AS radius, count(*) AS n,
  round(avg(lat), 6) AS
  lat, round(avg(lon), 6) AS lon FROM rec GROUP BY ALL""",
    "candidate_rows": f"""{ASSESS} SELECT id, replace(classification, '_priority', '') AS priority, CAST(lat AS VARCHAR) || ', ' || CAST(lon AS
  VARCHAR) AS position,
  estimated_length_m AS length_m, CASE ais_status WHEN 'dark' THEN 'unmatched (dark)' ELSE ais_status END AS AIS,
  CAST(n_indicators AS INTEGER) AS
  indicators, distance_from_base_km AS km_from_base FROM rec WHERE {_CANDIDATE}""",
    "score_invariant": f"{ASSESS} SELECT count(*) FILTER ((score > 0) <> (n_indicators > 0)) AS broken, count(*) AS n FROM rec",
}

# --- text, validation, raster, data sets ---------------------------------------------------------------------------------------

# White space, digits and word edges of Unicode, spelled out, since the patterns of this SQL know ASCII only.
_S = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LEFT, _RIGHT = r"(?:^|[^\pL\pM\p{Nd}\p{Nl}\p{Pc}])", r"(?:$|[^\pL\pM\p{Nd}\p{Nl}\p{Pc}])"
_ANCHOR = r"[A-Z]{2,4}-\p{Nd}{2,}|\p{Nd}{4}/\p{Nd}{4}|\p{Nd}+[.,]\p{Nd}+"
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'))"
_AIS = rf"{_LEFT}ais{_RIGHT}|carriage requirement|article{_S}*10|art[íi]culo{_S}*10|{_LEFT}art\.?{_S}*10{_RIGHT}|1224/2009|reglamento{_S}*\(ce\){_S}*n?\S*{_S}*1224"
_VERBS = rf"{_LEFT}(seize|confiscate|arrest|impound|incautar|detener|apresar|confiscar){_RIGHT}"
_strip = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_instruction = lambda x: _strip(
    f"regexp_replace({_strip(x)}, '(?i)^[\\p{{Nd}}.,]+{_S}*(km|nm|miles)(?:$|[^\\pL\\pM\\p{{Nd}}\\p{{Pc}}:.][^:.]*|)([:.]{_S}*|$)', '')"
)
_plain = lambda x: f"translate({x}, '‐‑‒–—―', '------')"
_anchors = lambda x: f"list_distinct(list_transform(regexp_extract_all({_plain(x)}, '{_ANCHOR}'), lambda t: replace(t, ',', '.')))"
_words = lambda x: f"regexp_extract_all(lower({x}), '[a-z]{{4,}}')"
_SENTENCES = f"list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda s: {_strip('s')}), lambda s: s <> '')"
_SILENT = "ais_indicator_suppressed AND n_indicators = 0"
_FIRST = "reasons[1]"
_CITATION = f"""CASE WHEN n_indicators = 0 THEN 'none identified' ELSE array_to_string(list_filter([CASE WHEN has_ais THEN '{{basis}}' END], lambda x: x IS NOT NULL)
 || coalesce(list_transform(list_filter(cited, lambda z, i: list_position(cited, z) = i), lambda z: {_NAMES}), []), '; ') END"""

# What a model is made to say: a brief a record, spoiled by the remainder of its ord.
_SAID = f"""lent AS (SELECT scene_id, max(zone_id) AS zone FROM ind JOIN rec USING (ord) GROUP BY scene_id),
facts AS (SELECT *, array_to_string(reasons, ' ') AS rtext, {_anchors("array_to_string(reasons, ' ')")} AS own, n_indicators
  > 0 AS has, {_CANDIDATE}
  AS cand, {_SILENT} AS silent,
  CASE WHEN NOT coalesce(list_contains(cited, zone), false) THEN zone END AS lent, ord % 22 AS m,
  {_CITATION.replace("{basis}", _BASIS)} AS provisions
  FROM rec LEFT JOIN lent USING (scene_id)),
said AS (SELECT *, CASE WHEN m = 17 THEN 'D-none' ELSE id END AS bid,
  CASE m WHEN 5 THEN CAST(lat + 0.05e0 AS VARCHAR) || ', ' || CAST(lon AS VARCHAR) WHEN 6 THEN 'off the coast' ELSE CAST(lat
  AS VARCHAR) || ', ' ||
  CAST(lon AS VARCHAR) END AS position,
  CASE m WHEN 9 THEN 'low' ELSE replace(classification, '_priority', '') END AS stated,
  CASE WHEN m = 12 AND has THEN ['the vessel behaved strangely close to the coast'] WHEN m = 13 THEN list_append(reasons,
  'its crew was hauling nets at night') WHEN m = 15 THEN ['zone']
    WHEN m = 16 AND has THEN ['qqqqq wwwww kkkkk jjjjj zzzzz xxxxx'] ELSE reasons END AS listed,
  CASE WHEN m = 3 AND NOT has_ais THEN provisions || '; Article 10 on carriage' WHEN m = 7 AND has THEN '' WHEN m = 8 AND NOT
  has THEN
  'national fisheries code, chapter four'
    WHEN m = 10 AND lent IS NOT NULL THEN provisions || '; see ' || lent WHEN m = 11 AND has AND length({_FIRST}) > 40 THEN
  provisions || ' ' ||
  {_FIRST} ELSE provisions END AS regulation,
  CASE m WHEN 2 THEN 'seize the vessel and all of its gear' WHEN 14 THEN '12.5 km from base' ELSE
  'board and verify gear and documents on site' END AS
  action,
  CASE WHEN m = 0 AND has THEN '' WHEN m = 1 AND estimated_length_m >= 15 THEN 'the vessel is below 15 m' WHEN m = 4 AND
  ais_status = 'matched' THEN
  'inferred from radar; article 10 was considered'
    ELSE 'inferred from radar; confirm on inspection' END AS caveat
  FROM facts WHERE NOT (m = 18 AND cand))"""
_AT = "regexp_extract_all(position, '-?\\d+(?:\\.\\d+)?')"
_mentions = lambda x: f"regexp_matches(lower({x}), '{_AIS}')"
_NONE = "regexp_matches(lower(regulation), 'none identified|not applicable')"
# The rules, on what was said.
_RULES = f"""owners AS (SELECT scene_id, anchor, arg_max(id, ord) AS owner FROM (SELECT scene_id, id, ord, unnest(own) AS anchor FROM
  facts) GROUP BY ALL),
alien AS (SELECT ord, string_agg(anchor || ' (' || owner || ')', ', ' ORDER BY anchor || ' (' || owner || ')') AS alien
  FROM (SELECT scene_id, ord, unnest(list_filter({_anchors("regulation")}, lambda x: NOT list_contains(own, x))) AS anchor
  FROM said WHERE bid = id)
  JOIN owners USING (scene_id, anchor) GROUP BY ord),
known AS (SELECT said.*, alien, CASE ais_status WHEN 'matched' THEN 'vessel is broadcasting' ELSE
  'no AIS indicator stands for this vessel' END AS
  why, CAST({_AT}[1] AS DOUBLE) AS y, CAST({_AT}[2] AS DOUBLE) AS x
  FROM said LEFT JOIN alien USING (ord) WHERE bid = id),
lines AS (SELECT scene_id, ord, id, rtext, unnest(listed) AS line FROM known),
spoken AS (
  SELECT scene_id, ord, id, 'V1' AS rule, 'BLOCKER' AS severity,
  'its AIS indicator is suppressed and nothing else stands against it: it must not be briefed' AS message FROM known WHERE
  silent
  UNION ALL SELECT scene_id, ord, id, 'V2', 'WARNING', 'its class is ' || classification || ', which warrants no brief' FROM
  known WHERE NOT cand
  UNION ALL SELECT scene_id, ord, id, 'VA', 'BLOCKER', 'the caveat that indicators require is missing' FROM known WHERE has
  AND caveat = ''
  UNION ALL SELECT scene_id, ord, id, 'VB', 'BLOCKER', 'the caveat places it under 15.0 m, the record gives ' ||
  CAST(estimated_length_m AS VARCHAR)
  || ' m' FROM known
    WHERE estimated_length_m >= 15 AND regexp_matches(lower(caveat),
  '(under|below|less than){_S}*15|menos de{_S}*15|not meet|no alcanza')
  UNION ALL SELECT scene_id, ord, id, 'VC', 'BLOCKER', 'the action ''' || action || ''' exceeds an inspector''s authority'
  FROM known WHERE
  regexp_matches(lower(action), '{_VERBS}')
  UNION ALL SELECT scene_id, ord, id, 'V3', 'BLOCKER', why || ', yet the regulation invokes the duty to carry AIS' FROM known
  WHERE NOT has_ais AND
  {_mentions("regulation")}
  UNION ALL SELECT scene_id, ord, id, 'V3', 'BLOCKER', why || ', yet the indicators invokes the duty to carry AIS' FROM known
  WHERE NOT has_ais AND
  {_mentions("array_to_string(listed, ' ')")}
  UNION ALL SELECT scene_id, ord, id, 'V3', 'BLOCKER', why || ', yet the action invokes the duty to carry AIS' FROM known
  WHERE NOT has_ais AND
  {_mentions("action")}
  UNION ALL SELECT scene_id, ord, id, 'V3b', 'WARNING', 'vessel is broadcasting, yet the caveat discusses AIS' FROM known
  WHERE ais_status = 'matched'
  AND {_mentions("caveat")}
  UNION ALL SELECT scene_id, ord, id, 'V4', 'WARNING', 'position is missing or cannot be read' FROM known WHERE y IS NULL OR
  x IS NULL
  UNION ALL SELECT scene_id, ord, id, 'V4', 'BLOCKER', 'position differs from the computed one' FROM known WHERE abs(y - lat)
  > 0.001e0 OR abs(x -
  lon) > 0.001e0
  UNION ALL SELECT scene_id, ord, id, 'V5', 'WARNING', 'it has indicators but no regulation is named' FROM known WHERE has
  AND (regulation = '' OR
  {_NONE} OR lower(regulation) = 'none')
  UNION ALL SELECT scene_id, ord, id, 'V6', 'BLOCKER', 'it has no indicators, yet a regulation is named' FROM known WHERE NOT
  has AND regulation <> ''
  AND NOT {_NONE}
  UNION ALL SELECT scene_id, ord, id, 'V7', 'BLOCKER', 'priority is stated as ' || stated || ', the record is ' ||
  classification FROM known WHERE
  stated NOT IN ('', classification, replace(classification, '_priority', ''))
  UNION ALL SELECT scene_id, ord, id, 'V8', 'BLOCKER', 'the regulation carries anchors of another detection: ' || alien FROM
  known WHERE alien IS NOT
  NULL
  UNION ALL SELECT scene_id, ord, id, 'V8b', 'WARNING', 'the regulation repeats an indicator instead of naming a provision'
  FROM known WHERE
  len(list_filter(reasons, lambda r: length(r) > 40 AND contains(lower(regulation), lower(substr(r, 1, 60))))) > 0
  UNION ALL SELECT scene_id, ord, id, 'V9', 'BLOCKER',
  'its indicators carry no zone, figure or reference of the record''s own' FROM known WHERE
  len(own) > 0 AND NOT list_has_any(own, {_anchors("array_to_string(listed, ' ')")})
  UNION ALL SELECT scene_id, ord, id, 'V10', 'BLOCKER', 'it lists ' || CAST(len(listed) AS VARCHAR) ||
  ' indicators, the record has ' ||
  CAST(n_indicators AS VARCHAR) FROM known WHERE len(listed) > n_indicators
  UNION ALL SELECT scene_id, ord, id, 'V11', 'WARNING', 'the action ''' || action || ''' is no instruction' FROM known WHERE
  length({_instruction("action")}) < 15
  UNION ALL SELECT scene_id, ord, id, 'V12a', 'BLOCKER', 'indicator ''' || line || ''' is a label, not a statement' FROM
  lines WHERE length(line) < 25
  UNION ALL SELECT scene_id, ord, id, 'V12b', 'WARNING', 'an indicator shares no wording with the record''s' FROM lines WHERE
  length(line) >= 25 AND
  len({_words("line")}) > 0 AND rtext <> '' AND NOT list_has_any({_words("line")}, {_words("rtext")})
  UNION ALL SELECT scene_id, ord, bid, 'V0', 'BLOCKER', 'its id is not in the dossier' FROM said WHERE bid <> id),
unsaid AS (SELECT scene_id, ord, id, 'V13' AS rule, CASE classification WHEN 'high_priority' THEN 'BLOCKER' ELSE 'WARNING'
  END AS severity,
  classification || ' record has no brief' AS message FROM facts
  WHERE cand AND id NOT IN (SELECT bid FROM said)),
named AS (SELECT scene_id, arg_min(id, ord) FILTER (classification = 'medium_priority') AS medium, arg_min(id, ord) FILTER
  (silent) AS quiet FROM
  facts GROUP BY scene_id),
prose AS (SELECT scene_id, 'High-priority vessels seen today (' || coalesce(medium, 'none') || '). Activity gathers near ' ||
  coalesce(quiet,
  'the bank') || '.' AS prose FROM named),
claimed AS (SELECT scene_id, unnest(regexp_extract_all(regexp_extract(prose, '\\(([^)]*)\\)', 1), 'D-\\d+')) AS id FROM
  prose),
told AS (SELECT scene_id, 1 AS ord, 'V14a' AS rule, 'WARNING' AS severity, id || ' is ' || classification ||
  ' but is listed among high_priority records' AS message FROM claimed JOIN facts USING (scene_id, id) WHERE classification
  <> 'high_priority'
  UNION ALL SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY id), 'V14b', 'BLOCKER', id ||
  ' has its AIS indicator suppressed and nothing else, yet is named' FROM facts JOIN prose USING (scene_id) WHERE silent AND
  contains(prose, id)),
issues AS (SELECT scene_id, 'brief ' || id AS place, rule, severity, message FROM spoken UNION ALL SELECT scene_id, 'brief '
  || id, rule, severity,
  message FROM unsaid UNION ALL SELECT scene_id, 'narrative', rule, severity, message FROM told)"""
_RANKED = f"""ranked AS (SELECT *, CASE WHEN q = 2 THEN 'X-' || id ELSE id END AS rid, CASE WHEN q = 0 THEN 'seen at 9999.9 m' ELSE
  coalesce({_FIRST},
  'worth a look') END AS why FROM (SELECT *, ord % 5 AS q FROM facts) WHERE NOT (q = 1 AND cand)),
misranked AS (
  SELECT scene_id, ord, rid AS id, 'Q2' AS rule, 'BLOCKER' AS severity, 'its id is not in the dossier' AS message FROM ranked
  WHERE rid <> id
  UNION ALL SELECT scene_id, ord, rid, 'Q2', 'BLOCKER', 'it is no candidate (class ' || classification || ')' FROM ranked
  WHERE rid = id AND NOT cand
  UNION ALL SELECT scene_id, ord, rid, 'Q3', 'BLOCKER', 'its reason cites 9999.9, none of it the record''s' FROM ranked WHERE
  q = 0),
unranked AS (SELECT scene_id, ord, 'Q5' AS rule, CASE classification WHEN 'high_priority' THEN 'BLOCKER' ELSE 'WARNING' END
  AS severity, id || ' is '
  || classification || ' but was not ranked' AS message FROM facts WHERE cand AND id NOT IN (SELECT rid FROM ranked))"""
# Which rule must find what was planted, by the same remainders.
_EXPECTED = {0: ("has", "VA", "omission"), 1: (
    "estimated_length_m >= 15", "VB", "figures"
), 2: ("true", "VC", "authority"), 3: ("NOT has_ais", "V3", "legal"), 4: ("ais_status = 'matched'", "V3b", "legal"),
             5: ("true", "V4", "position"), 6: ("true", "V4", "position"), 7: ("has", "V5", "omission"), 8: ("NOT has", "V6", "legal"), 9: ("true", "V7", "rank"), 10: ("lent IS NOT NULL", "V8", "legal"),
             11: (
                 f"has AND length({_FIRST}) > 40", "V8b", "legal"
             ), 12: ("has", "V9", "fabrication"), 13: ("true", "V10", "fabrication"), 14: ("true", "V11", "authority"), 15: ("true", "V12a", "fabrication"),
             16: ("has", "V12b", "fabrication"), 17: ("true", "V0", "fabrication"), 18: ("cand", "V13", "omission")}
_pick = lambda at: "CASE " + " ".join(f"WHEN m = {k} AND {v[0]} THEN '{v[at]}'" for k, v in _EXPECTED.items()) + " END"
_CAUGHT = f"""want AS (SELECT ord, 'brief' AS kind, {_pick(1)} AS rule, {_pick(2)} AS family, cand, CASE WHEN silent THEN 'V1' ELSE 'V2'
  END AS other FROM facts
  UNION ALL SELECT ord, 'ranking', CASE WHEN ord % 5 = 0 THEN 'Q3' WHEN ord % 5 = 1 AND cand THEN 'Q5' WHEN ord % 5 = 2 THEN
  'Q2' END, CASE WHEN ord %
  5 = 0 THEN 'figures' WHEN ord % 5 = 1 AND cand THEN 'omission' WHEN ord % 5 = 2 THEN 'fabrication' END, cand, 'Q2' FROM
  facts),
aim AS (SELECT ord, kind, coalesce(rule, CASE WHEN NOT cand THEN other END) AS rule, coalesce(family, CASE WHEN cand THEN
  'control' ELSE 'over-report'
  END) AS family FROM want),
got AS (SELECT ord, kind, list(DISTINCT rule) AS rules FROM (SELECT ord, 'brief' AS kind, rule FROM spoken UNION ALL SELECT
  ord, 'brief', rule FROM
  unsaid UNION ALL SELECT ord, 'ranking', rule FROM misranked UNION ALL SELECT ord, 'ranking', rule FROM unranked) GROUP BY
  ALL),
verdict AS (SELECT family, CASE WHEN aim.rule IS NULL THEN rules IS NULL ELSE coalesce(list_contains(rules, aim.rule), false)
  END AS ok FROM aim LEFT
  JOIN got USING (ord, kind))"""
_CHIPS = "px AS (SELECT vec_id AS chip_id, CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col, pow(CAST(abs(embedding[i + 1]) AS DOUBLE), 3.0e0) AS value FROM (SELECT *, unnest(range(64)) AS i FROM embeddings))"


def _box(name: str, source: str, value: str, radius: int, last: str = "7") -> str:
    """Sums over squares, with rows (0 to 7) and columns (0 to last) mirrored at the edges."""
    mirror = lambda at, n: f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > {n} THEN 2 * {n} - ({at}) ELSE {at} END"
    return f"""{name} AS (SELECT a.chip_id, a.row, a.col, sum(b.{value}) AS s FROM (SELECT chip_id, row, col, {mirror("(row + dr.d)", 7)} AS r,
  {mirror("(col + dc.d)", last)} AS c FROM {source}, (SELECT unnest(range({-radius}, {radius + 1})) AS d) AS dr,
  (SELECT unnest(range({-radius}, {radius + 1})) AS d) AS dc) AS a
JOIN {source} AS b ON b.chip_id = a.chip_id AND b.row = a.r AND b.col = a.c GROUP BY ALL)"""


_ALPHA = "(16 * (pow(0.05e0, -1.0e0 / 16) - 1.0e0))"


def _lee(chips: str, last: str = "7") -> str:
    return f"""{chips}, sq AS (SELECT *, value * value AS q FROM px), {_box("bs", "sq", "value", 3, last)}, {_box("bq", "sq", "q", 3, last)},
mo AS (SELECT chip_id, row, col, value, bs.s / 49 AS mean, greatest(bq.s / 49 - (bs.s / 49) * (bs.s / 49), 0.0e0) AS var FROM
  px JOIN bs USING
  (chip_id, row, col) JOIN bq USING (chip_id, row, col)),
lee AS (SELECT chip_id, row, col, value, mean + least(greatest(1.0e0 - 0.25e0 / greatest(CASE WHEN mean > 0 THEN var /
  nullif(mean * mean, 0.0e0) ELSE
  0.0e0 END, 1e-9), 0.0e0), 1.0e0) * (value - mean) AS filtered FROM mo)"""


def _cfar(chips: str, last: str = "7") -> str:
    return f"""{_lee(chips, last)}, {_box("bo", "lee", "filtered", 2, last)}, {_box("bg", "lee", "filtered", 1, last)},
cf AS (SELECT chip_id, row, col, value, (bo.s - bg.s) / 16 AS background, filtered > (bo.s - bg.s) / 16 * {_ALPHA} AS hit
  FROM lee JOIN bo USING
  (chip_id, row, col) JOIN bg USING (chip_id, row, col))"""


def _blobs(chips: str, last: str = "7") -> str:
    return f"""{_cfar(chips, last)}, hit AS (SELECT chip_id, row, col, row * ({last} + 1) + col AS k, value, background FROM cf WHERE hit),
steps AS (SELECT a.d AS dr, b.d AS dc FROM (SELECT unnest(range(-1, 2)) AS d) AS a, (SELECT unnest(range(-1, 2)) AS d) AS b),
beside AS (SELECT a.chip_id, a.k, b.k AS other FROM (SELECT chip_id, k, row + dr AS r, col + dc AS c FROM hit, steps) AS a JOIN hit AS b
  ON b.chip_id = a.chip_id AND b.row = a.r AND b.col = a.c),
reach AS (SELECT chip_id, k AS node, k AS seen FROM hit UNION SELECT r.chip_id, r.node, n.other FROM reach AS r JOIN beside AS n ON
  n.chip_id = r.chip_id AND n.k = r.seen),
lab AS (SELECT chip_id, node AS k, min(seen) AS first_k FROM reach GROUP BY ALL),
num AS (SELECT *, dense_rank() OVER (PARTITION BY chip_id ORDER BY first_k) AS blob FROM lab),
blob AS (SELECT chip_id, blob, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, sum(row *
  value) / sum(value) AS rc,
  sum(col * value) / sum(value) AS cc, max(value / background) AS peak
  FROM num JOIN hit USING (chip_id, k) GROUP BY ALL HAVING count(*) >= 2)"""


_LEE, _CFAR, _BLOBS = _lee(_CHIPS), _cfar(_CHIPS), _blobs(_CHIPS)


def _detected(blobs: str) -> str:
    return f"""WITH RECURSIVE {blobs} SELECT chip_id, printf('S1-%03d', blob) AS id, CAST(area AS INTEGER) AS area_px, r0 AS row_min, r1 AS
      row_max, c0 AS col_min,
      c1 AS col_max, round((greatest(r1 - r0, c1 - c0) + 1) * 10.0e0, 1) AS estimated_length_m,
    round(36.9e0 - rc * 0.00009e0, 5) AS lat, round(-7.2e0 + cc * 0.00011e0, 5) AS lon, round(1 - exp(-peak / 10), 3) AS
      detection_confidence, round(rc,
      1) AS row, round(cc, 1) AS col FROM blob"""


# All chips side by side.
_STRIP = """px AS (SELECT 'strip' AS chip_id, CAST(i // 8 AS INTEGER) AS row, CAST(nth * 8 + i % 8 AS INTEGER) AS col,
  pow(CAST(abs(embedding[i + 1]) AS DOUBLE), 3.0e0) AS value
  FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS nth, unnest(range(64)) AS i FROM embeddings))"""

ORACLES |= {
    "invariant_tokens": f"SELECT doc_id, unnest({_anchors("coalesce(text, '')")}) AS token FROM documents",
    "ais_wording": f"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{_AIS}') AS mentions FROM documents",
    "word_overlap": f"""WITH dw AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), iw AS (SELECT item_id, unnest({_WORDS}) AS word FROM
  benchmark) SELECT item_id,
  count(DISTINCT doc_id) AS docs, count(DISTINCT word) AS words FROM dw JOIN iw USING (word) GROUP BY item_id""",
    "position_parse": r"""WITH n AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[^0-9.,\- ]', ' ', 'g'), '-?\d+(?:\.\d+)?')
  AS k FROM documents)
  SELECT doc_id, CASE WHEN len(k) >= 2 THEN CAST(k[1] AS DOUBLE) END AS lat, CASE WHEN len(k) >= 2 THEN CAST(k[2] AS DOUBLE)
  END AS lon FROM n""",
    "degenerate_text": f"""WITH s AS (SELECT doc_id, text, {_SENTENCES} AS p FROM documents) SELECT doc_id, true AS looped FROM s WHERE length(text) >=
  2000 AND NOT
  contains(text, '{{') AND len(p) >= 20 AND len(list_distinct(p)) < 0.1e0 * len(p)""",
    "forbidden_actions": f"""SELECT conv_id, turn, regexp_matches(lower(text), '{_VERBS}') AS forbidden, CAST(length({_instruction('text')}) AS INTEGER)
  AS n FROM conversations""",
    "priority_claims": f"""{ASSESS}, c AS (SELECT 'S' || ord AS scene_id, id, classification, unnest(CASE WHEN ord % 7 = 0 THEN ['high_priority',
  'medium_priority'] WHEN
  {_CANDIDATE} THEN [classification] ELSE [] END) AS claimed FROM rec)
SELECT scene_id, 'WARNING' AS severity, 'V14a' AS rule, id || ' is ' || classification || ' but is listed among ' || claimed
  || ' records' AS message
  FROM c WHERE claimed <> classification""",
    "json_repair_parse": """SELECT CAST(event_id AS VARCHAR) AS scene_id, CASE WHEN event_id % 4 = 2 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS id,
  CASE WHEN event_id % 4 =
  2 THEN 'the object is not closed' END AS failure FROM events""",
    "report_issues": f"{ASSESS}, {_SAID}, {_RULES} SELECT scene_id, place, rule, severity, message FROM issues",
    "issue_listing": f"""{ASSESS}, {_SAID}, {_RULES}, l AS (SELECT scene_id, 1 AS b, ord, 'brief ' || id AS place, severity, message FROM unsaid UNION
  ALL SELECT scene_id,
  CASE rule WHEN 'V14a' THEN 2 ELSE 3 END, ord, 'narrative', severity, message FROM told),
t AS (SELECT scene_id, 'Output validation: ' || count(*) || ' issue(s)' || chr(10) || string_agg('  [' || severity || '] ' ||
  place || ': ' ||
  message, chr(10) ORDER BY b, ord) AS text FROM l GROUP BY scene_id)
SELECT scene_id, coalesce(text, 'Output validation: no issues') AS text FROM (SELECT DISTINCT scene_id FROM det) LEFT JOIN t
  USING (scene_id)""",
    "report_gate": f"{ASSESS}, {_SAID}, {_RULES} SELECT scene_id, bool_or(severity = 'BLOCKER') AS blocked FROM issues GROUP BY scene_id",
    "missing_briefs": f"{ASSESS}, {_SAID}, {_RULES} SELECT severity, 'brief ' || id AS place, message FROM unsaid",
    "foreign_anchors": f"{ASSESS}, {_SAID}, {_RULES} SELECT place, severity, message FROM issues WHERE rule = 'V8'",
    "prioritisation_issues": f"""{ASSESS}, {_SAID}, {_RULES}, {_RANKED} SELECT scene_id, 'prioritised ' || id AS place, rule, severity, message FROM misranked
UNION ALL SELECT scene_id, 'analyst prioritisation', rule, severity, message FROM unranked UNION ALL SELECT scene_id,
  'analyst narrative', CASE rule
  WHEN 'V14a' THEN 'Q1' ELSE 'Q4' END, severity, message FROM told""",
    "omitted_candidates": f"{ASSESS}, {_SAID}, {_RANKED} SELECT id, classification FROM facts WHERE cand AND id NOT IN (SELECT rid FROM ranked)",
    "unknown_ids": f"""{ASSESS}, {_SAID}, {_RANKED} SELECT 'prioritised ' || id AS place, message LIKE '%not in the dossier' AS absent FROM
  misranked WHERE rule = 'Q2'""",
    "top_severity": f"""{ASSESS}, {_SAID}, {_RULES}, o AS (SELECT DISTINCT scene_id, 'brief ' || bid AS place FROM said), w AS (SELECT scene_id,
  'brief ' || id AS place,
  max(CASE severity WHEN 'BLOCKER' THEN 2 ELSE 1 END) AS w FROM spoken GROUP BY ALL)
SELECT scene_id, place, CASE w WHEN 2 THEN 'BLOCKER' WHEN 1 THEN 'WARNING' ELSE 'clean' END AS severity FROM o LEFT JOIN w
  USING (scene_id, place)""",
    "passed_briefs": f"""{ASSESS}, {_SAID}, {_RULES}, o AS (SELECT DISTINCT scene_id, bid AS id FROM said) SELECT count(*) AS total, count(*) FILTER
  ((scene_id, id) NOT IN
  (SELECT (scene_id, id) FROM spoken)) AS passed FROM o""",
    "catch_rate": f"""{ASSESS}, {_SAID}, {_RULES}, {_RANKED}, {_CAUGHT}, g AS (SELECT unnest(CASE family WHEN 'control' THEN ['control', 'overall']
  ELSE [family,
  'adversarial', 'overall'] END) AS family, ok FROM verdict)
SELECT family, count(*) FILTER (ok) AS hits, count(*) AS total FROM g GROUP BY family""",
    "structure_issues": """WITH a AS (SELECT CAST(event_id AS VARCHAR) AS scene_id, event_id % 6 AS k, event_id % 4 = 0 AS few, event_id % 11 = 0 AS
  none FROM events),
m AS (SELECT scene_id, unnest(CASE WHEN none THEN ['prioritised_candidates', 'ais_not_applicable', 'observed_pattern',
  'overall_recommendation',
  'limitations'] WHEN few THEN ['ais_not_applicable', 'observed_pattern', 'overall_recommendation'] ELSE [] END) AS key FROM
  a)
SELECT scene_id, 'WARNING' AS severity, 'the answer lacks ' || key AS message FROM m
UNION ALL SELECT scene_id, 'BLOCKER', 'there is no list of candidates' FROM a WHERE none OR k = 3
UNION ALL SELECT scene_id, 'BLOCKER', 'candidates are ' || CASE k WHEN 1 THEN 'STRING' ELSE 'OBJECT<>' END || ', not a list'
  FROM a WHERE NOT none AND
  k IN (1, 4)
UNION ALL SELECT scene_id, 'BLOCKER', 'candidate ' || n || ' carries no id' FROM (SELECT scene_id, unnest([2, 3, 4]) AS n
  FROM a WHERE NOT none AND k
  = 2)""",
    "odd_spaces": f"""WITH g AS (SELECT *, [' ', chr(9), chr(160), chr(10), chr(8195)][event_id % 5 + 1] AS gap FROM events), t AS (SELECT *, gap
  || event_type || gap ||
  'Article' || gap || '10' || gap AS t, 'éais' || gap AS u, '7,5' || gap || 'km off: ' || event_type || gap AS a FROM g)
SELECT event_id, CAST(length({_strip("t")}) AS INTEGER) AS n, {_mentions("t")} AS cited, {_mentions("u")} AS inner,
  {_instruction("a")} AS rest FROM t""",
    "latency_median": """WITH t AS (SELECT event_type AS stage, median(value / 1000) AS s FROM events GROUP BY ALL), x AS (SELECT CASE stage WHEN
  'purchase' THEN 'sale' WHEN
  'error' THEN 'fault' ELSE 'visit' END AS section, stage, s FROM t WHERE stage IN ('purchase', 'click', 'view', 'signup',
  'error'))
SELECT section, stage, round(sum(s), 9) AS seconds, round(sum(s) / 100, 11) AS per_detection FROM x GROUP BY ROLLUP (section,
  stage)""",
    "box_sum": f"WITH {_CHIPS}, {_box('bx', 'px', 'value', 2)} SELECT chip_id, row, col, round(s, 6) AS s FROM bx",
    "lee_filter": f"WITH {_LEE} SELECT chip_id, row, col, round(filtered, 6) AS filtered FROM lee",
    "cfar_mask": f"WITH {_CFAR} SELECT chip_id, count(*) FILTER (hit) AS hits, round(avg(background), 6) AS background FROM cf GROUP BY chip_id",
    "blobs": _detected(_BLOBS),
    "tiled_blobs": _detected(_blobs(_STRIP, "(SELECT 8 * count(*) - 1 FROM embeddings)")),
    "yolo_boxes": f"""WITH RECURSIVE {_BLOBS}, bx AS (SELECT chip_id, blob, greatest(r0 - 1, 0) AS y0, least(r1 + 1, 7) AS y1, greatest(c0 - 1, 0)
  AS x0, least(c1 + 1, 7)
  AS x1 FROM blob)
SELECT chip_id, CAST(blob AS INTEGER) AS blob, printf('0 %.6f %.6f %.6f %.6f', (x0 + x1 + 1) / 2 / 8, (y0 + y1 + 1) / 2 / 8,
  (x1 - x0 + 1) / 8, (y1 -
  y0 + 1) / 8) AS line FROM bx""",
    "pixel_boxes": """WITH p AS (SELECT p_partkey AS chip_id, p_partkey % 30 AS a, p_partkey % 60 AS b, least(p_partkey % 30 + p_partkey % 5, 31)
  AS c, least(p_partkey % 60
  + p_partkey % 7, 63) AS e FROM part),
q AS (SELECT chip_id, greatest(a - 1, 0) AS y0, least(c + 1, 31) AS y1, greatest(b - 1, 0) AS x0, least(e + 1, 63) AS x1 FROM
  p)
SELECT chip_id, round((x0 + x1 + 1) / 2 / 64, 9) AS xc, round((y0 + y1 + 1) / 2 / 32, 9) AS yc, round((x1 - x0 + 1) / 64, 9)
  AS w, round((y1 - y0 + 1)
  / 32, 9) AS h FROM q""",
    "label_validation": """WITH p AS (SELECT 'labels/' || CAST(p_partkey AS VARCHAR) || '.txt' AS path, p_partkey % 5 AS m FROM part)
SELECT path, '4 fields instead of five' AS problem FROM p WHERE m = 0 UNION ALL SELECT path,
  'a coordinate is not a share of the chip' FROM p WHERE m
  = 1 UNION ALL SELECT path, 'a field is no number' FROM p WHERE m = 2
UNION ALL SELECT path, unnest(['unknown class 3', 'a coordinate is not a share of the chip', 'the box is empty']) FROM p
  WHERE m = 3""",
    "split_assignment": """WITH n AS (SELECT doc_id AS name, row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*)
  OVER () AS n FROM labels)
  SELECT name, CASE WHEN n > 1 AND k <= greatest(1, floor(n * 0.34e0)) THEN 'val' ELSE 'train' END AS part FROM n""",
    "labelled_chips": """SELECT l.doc_id IS NOT NULL AS labelled, count(*) AS n FROM documents AS d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) AS
  l ON l.doc_id = d.doc_id
  GROUP BY ALL""",
}

# --- sources and sinks ---------------------------------------------------------------------------------------------------------

_IN_SCENE = "CAST(row_number() OVER (PARTITION BY scene_id ORDER BY ord) - 1 AS BIGINT)"
_DOCUMENT = f"WITH {DET} SELECT scene_id AS scene, {_IN_SCENE} AS ord, id, CAST(day AS VARCHAR) AS day, lat, lon, estimated_length_m, fishing_score, ais_matched, likely_gear FROM det"
_WAXING = "['new moon', 'waxing crescent', 'first quarter', 'waxing gibbous', 'full moon', 'waning gibbous', 'last quarter', 'waning crescent']"
_SEASON = f"{CONFIG.season.start} to {CONFIG.season.end}"
_MONTH_DAY = lambda x: int(x[:2]) * 100 + int(x[3:])
_CONDITIONS = f"""WITH {DET}, sc AS (SELECT DISTINCT scene_id, day, date_diff('microsecond', TIMESTAMP '2000-01-06 18:14:00', CAST(day AS
  TIMESTAMP)) / 86400e6 AS t
  FROM det),
tu AS (SELECT *, (t - floor(t / 29.530588853e0) * 29.530588853e0) / 29.530588853e0 AS turn FROM sc),
li AS (SELECT *, (1.0e0 - cos(2.0e0 * pi() * turn)) / 2 AS light, (cos(4.0e0 * pi() * turn) + 1) / 2 AS tide, month(day) *
  100 + day(day) BETWEEN
  {_MONTH_DAY(CONFIG.season.start)} AND {_MONTH_DAY(CONFIG.season.end)} AS in_season, {_WAXING}[CAST(floor(turn * 8 + 0.5e0)
  AS BIGINT) % 8 + 1] AS
  moon_phase FROM tu),
su AS (SELECT *, CASE WHEN NOT in_season THEN 'out_of_season' WHEN light <= 0.25e0 AND tide >= 0.5e0 THEN 'high' WHEN light
  <= 0.25e0 OR tide >= 0.5e0
  THEN 'moderate' ELSE 'low' END AS suitability, CAST(CAST(round_even(light * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS pct
  FROM li)"""
_WHY = f"""CASE suitability WHEN 'out_of_season' THEN 'outside the season ({_SEASON}): the moon raises no priority while the fishery is closed' WHEN 'high' THEN moon_phase || ': dark night (' || pct || ' lit) with spring tides, in season'
  WHEN 'moderate' THEN moon_phase || ', in season: ' || CASE WHEN light <= 0.25e0 THEN 'a dark night' ELSE 'spring tides' END || ' only' ELSE moon_phase || ': bright night (' || pct || ' lit) near neap tides' END"""


def _text(words: str) -> str:
    return "'" + words.replace("'", "''") + "'"


# Entries of a day are numbered by position and text; texts at one position differ in the length first, then in the id.
_BY_TEXT = "CAST(row_number() OVER (PARTITION BY scene_id ORDER BY lat, lon, CAST(estimated_length_m AS VARCHAR), id) - 1 AS BIGINT)"
_FED = f"""WITH {DET}, fe AS (SELECT *, ord % 5 AS k, {_BY_TEXT} AS place FROM det),
fm AS (SELECT *, CASE k WHEN 0 THEN ais_matched WHEN 1 THEN CASE WHEN ais_matched THEN true END WHEN 2 THEN CASE WHEN
  ais_matched THEN true END END AS
  matched,
  CASE k WHEN 1 THEN CASE WHEN fishing_score >= 0.5 THEN 1.0e0 ELSE 0.0e0 END WHEN 4 THEN 1.0e0 ELSE fishing_score END AS
  active, k <> 3 AS usable
  FROM fe)"""
_CENTRES = ", ".join(
    f"('{z.id}', {sum(p[0] for p in z.polygon) / len(z.polygon)!r}e0, {sum(p[1] for p in z.polygon) / len(z.polygon)!r}e0, '[{','.join(f'[{b},{a}]' for a, b in z.polygon)}]')" for z in ZONES
)

ORACLES |= {
    "scene_documents": _DOCUMENT,
    "strict_scenes": _DOCUMENT,
    "dispatched_source": f"""{_FED}, lo AS (SELECT scene_id AS scene, CAST(day AS VARCHAR) AS day, lat, lon, estimated_length_m FROM det)
SELECT 'local' AS source, * FROM lo UNION ALL SELECT 'feed', * FROM lo WHERE day(CAST(day AS DATE)) % 2 = 0 UNION ALL
SELECT 'feed', 'feed ' || CAST(day AS VARCHAR), CAST(day AS VARCHAR), lat, lon, estimated_length_m FROM fm
WHERE usable AND day(day) % 2 = 1 AND lon BETWEEN {REGION[0]}e0 AND {REGION[2]}e0 AND lat BETWEEN {REGION[1]}e0 AND {REGION[3]}e0""",
    "scene_conditions": f"""{_CONDITIONS} SELECT CAST(day AS VARCHAR) AS day, in_season, '{_SEASON}' AS season_window, moon_phase, round(light, 3) AS
  moon_illumination, round(1 -
  light, 3) AS darkness_favourability, round(tide, 3) AS spring_tide_tendency,
suitability, {_WHY} AS rationale FROM su""",
    "regulated_structures": """SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS ord, 'FIX-' || CAST(s_suppkey AS VARCHAR) AS id, s_name
  AS name, 'platform' AS
  type, (36200 + (s_suppkey * 6151) % 1000) / 1000.0e0 AS lat, (-7450 + (s_suppkey * 3571) % 1200) / 1000.0e0 AS lon,
CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 300 + (s_suppkey % 5) * 700 END AS DOUBLE) AS match_radius_m FROM supplier""",
    "regulated_zones": f"WITH {DET}, {HITS} SELECT ord, zone_id FROM hits",
    "feed_detections": f"""{_FED} SELECT CAST(day AS VARCHAR) AS day, place AS ord, CASE WHEN k = 4 THEN printf('GFW-%04d', place) ELSE id END AS id,
  lat, lon,
  estimated_length_m, matched AS ais_matched, active AS fishing_score, CASE WHEN k = 0 THEN 3.5e0 END AS speed_kn,
CASE WHEN k = 0 AND matched THEN likely_gear ELSE 'unknown' END AS likely_gear, CASE WHEN k = 0 AND matched THEN id END AS
  mmsi, CASE WHEN k = 0 AND
  matched THEN id END AS vessel_name, CASE WHEN k = 0 AND matched THEN 'ESP' END AS flag FROM fm WHERE usable""",
    "feed_window": f"""{_FED} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, min(lat) AS south, max(lon) AS east FROM fm
WHERE day >= DATE '2024-01-10' AND day < DATE '2024-01-20' AND lat > 36.5e0 AND lon <= -6.75e0 GROUP BY day""",
    "scene_environment": f"""WITH {DET} SELECT DISTINCT CAST(day AS VARCHAR) AS day, 'radar' AS source, 'survey' AS mode, '{CONFIG.study_area}' AS area,
  {_text(temporal.ROLE)} AS role, {_text(temporal.SCOPE)} AS sensor_scope, {_text(temporal.CROSS_CHECK)} AS cross_check_required FROM det""",
    "overlaid_weights": f"""{ASSESS}, more AS (SELECT ord, sum(CASE kind WHEN 'ais' THEN 5 WHEN 'zone' THEN 3 ELSE 0 END) AS extra FROM ind GROUP BY ord)
SELECT ord, CAST(score + coalesce(extra, 0) AS INTEGER) AS score, classification FROM rec LEFT JOIN more USING (ord)""",
    "split_checks": """SELECT greatest(1, CAST(floor(count(*) * 0.34e0) AS BIGINT)) AS val, count(*) - greatest(1, CAST(floor(count(*) * 0.34e0) AS BIGINT)) AS train,
  count(*) AS names, greatest(1, CAST(floor(count(*) * 0.34e0) AS BIGINT)) AS other_val, true AS differ FROM labels""",
    "drawn_targets": "SELECT CAST(n_nationkey AS VARCHAR) AS chip_id, true AS drawn, true AS all_found FROM nation",
    "feed_records": f"""{_FED} SELECT CAST(day AS VARCHAR) AS day, place AS ord, CASE WHEN k = 4 THEN printf('GFW-%04d', place) ELSE id END AS id,
  CASE WHEN matched IS NULL THEN 'unknown' WHEN matched THEN 'matched' ELSE 'dark' END AS ais_status,
  CASE WHEN k = 0 AND matched THEN 'ESP' ELSE 'unknown' END AS jurisdiction, CASE WHEN k = 0 AND matched THEN id END AS mmsi,
  CASE WHEN k = 0 AND matched THEN id END AS name, CASE WHEN k = 0 AND matched THEN 'ESP' END AS flag FROM fm WHERE usable""",
    "feed_pass": f"""{_FED} SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (usable) AS n,
(SELECT count(*) FILTER (usable) FROM fm) AS mapped, (SELECT count(*) FILTER (NOT usable) FROM fm) AS skipped FROM fm GROUP BY day HAVING n > 0""",
    "feed_skipped": f"{_FED} SELECT count(*) FILTER (usable) AS mapped, count(*) FILTER (NOT usable) AS skipped FROM fm",
    "dossier_documents": f"""{ASSESS}, {_CONDITIONS.removeprefix(f"WITH {DET}, ")}, st1 AS (SELECT scene_id, id, row_number() OVER (PARTITION BY scene_id
  ORDER BY {_RANK},
  distance_from_base_km, score DESC, ord) AS p FROM rec WHERE {_CANDIDATE} AND distance_from_base_km <= 60.0e0),
sp AS (SELECT scene_id, count(*) AS stops, arg_min(id, p) AS first_stop FROM st1 GROUP BY scene_id), ca AS (SELECT scene_id,
  id, row_number() OVER
  (PARTITION BY scene_id ORDER BY {_ORDER}) AS p FROM rec WHERE {_CANDIDATE}), fc AS (SELECT scene_id, arg_min(id, p) AS
  first_candidate FROM ca GROUP
  BY scene_id),
g AS (SELECT scene_id, any_value(day) AS day, count(*) AS total, count(*) FILTER ({_CANDIDATE}) AS candidates, count(*)
  FILTER
  (ais_indicator_suppressed) AS suppressed, count(*) FILTER (classification = 'fixed_structure') AS fixed FROM rec GROUP BY
  scene_id)
SELECT scene_id, kept, total, CAST(CASE WHEN kept THEN total ELSE -1 END AS INTEGER) AS records, CAST(candidates AS INTEGER)
  AS candidates,
  CAST(suppressed AS INTEGER) AS suppressed, CAST(fixed AS INTEGER) AS fixed, CAST(coalesce(stops, 0) AS INTEGER) AS stops,
CAST(CASE WHEN {_SHUT.replace("day", "g.day")} THEN 1 ELSE 0 END AS INTEGER) AS closures, first_candidate, first_stop,
  CAST(g.day AS VARCHAR) AS
  analysis_date, suitability
FROM g LEFT JOIN sp USING (scene_id) LEFT JOIN fc USING (scene_id) JOIN su USING (scene_id), (VALUES (true), (false)) AS
  v(kept)""",
    "map_layers": f"""WITH {DET}, zo AS (SELECT * FROM (VALUES {_CENTRES}) AS v(layer, lat, lon, outline)) SELECT scene_id AS layer,
  round(avg(lat), 6) AS lat,
  round(avg(lon), 6) AS lon, CAST(NULL AS VARCHAR) AS outline FROM det GROUP BY scene_id UNION ALL SELECT layer, round(lat,
  6), round(lon, 6), outline
  FROM zo""",
    "run_archive": f"""{ASSESS}, {_SAID}, {_RULES} SELECT scene_id, CAST(count(unsaid.ord) AS INTEGER) AS n FROM (SELECT DISTINCT scene_id FROM det)
  LEFT JOIN unsaid USING
  (scene_id) GROUP BY scene_id""",
    "chip_files": f"""WITH {_CHIPS} SELECT CAST(chip_id AS VARCHAR) AS chip_id, 8 AS rows_n, 8 AS cols_n, count(*) AS n, round(sum(value * (row * 8
  + col)), 6) AS weighed
  FROM px GROUP BY chip_id""",
    "label_files": f"""WITH RECURSIVE {_BLOBS}, bx AS (SELECT chip_id, blob, greatest(r0 - 1, 0) AS y0, least(r1 + 1, 7) AS y1, greatest(c0 - 1, 0)
  AS x0, least(c1 + 1, 7)
  AS x1 FROM blob)
SELECT CAST(chip_id AS VARCHAR) AS stem, CAST(row_number() OVER (PARTITION BY chip_id ORDER BY blob) AS INTEGER) AS line_no,
  printf('0 %.6f %.6f %.6f %.6f', (x0 + x1 + 1) / 2 / 8, (y0 + y1 + 1) / 2 / 8, (x1 - x0 + 1) / 8, (y1 - y0 + 1) / 8) AS line
  FROM bx""",
    "chip_ranges": f"""WITH {_STRIP} SELECT 'strip' AS chip_id, 8 AS rows_n, CAST((SELECT 8 * count(*) FROM embeddings) AS INTEGER) AS cols_n, CAST(col // 256 AS BIGINT) AS part,
  count(*) AS n, round(sum(value * (row * 256 + col % 256 + 1)), 6) AS weighed FROM px GROUP BY col // 256""",
    "manifest_totals": f"""WITH RECURSIVE {_BLOBS}, c AS (SELECT count(DISTINCT vec_id) AS n FROM embeddings),
l AS (SELECT chip_id, count(*) AS k FROM blob GROUP BY chip_id)
SELECT n AS chips, (SELECT count(*) FROM blob) AS labels, n AS pending, (SELECT count(*) FROM l) AS labelled, (SELECT max(k) FROM l) AS most FROM c""",
    "sql_distances": f"WITH {DET} SELECT ord, {_BASE_KM} AS distance_from_base_km FROM det WHERE {_BASE_KM} <= 60",
    "sql_wording": f"""SELECT 'document' AS kind, regexp_matches(lower(coalesce(text, '')), '{_AIS}') AS cited, count(*) AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'turn', regexp_matches(lower(coalesce(text, '')), '{_AIS}'), count(*) FROM conversations GROUP BY ALL""",
    "sql_anchors": f"SELECT doc_id, unnest({_anchors("coalesce(text, '')")}) AS anchor FROM documents",
    "sql_claims": f"""{ASSESS}, c AS (SELECT 'S' || ord AS scene_id, id, unnest(CASE WHEN ord % 7 = 0 THEN ['high_priority',
  'medium_priority'] WHEN {_CANDIDATE} THEN [classification] ELSE [] END) AS claimed FROM rec) SELECT scene_id, claimed, id FROM c""",
    "prepared_dataset": f"""WITH RECURSIVE {_BLOBS}, u AS (SELECT DISTINCT CAST(chip_id AS VARCHAR) AS name FROM blob), r AS (SELECT name, row_number()
  OVER (ORDER BY md5('7:' ||
  name), name) AS k, count(*) OVER () AS n FROM u)
SELECT name, CASE WHEN n > 1 AND k <= greatest(1, floor(n * 0.34e0)) THEN 'val' ELSE 'train' END AS part FROM r""",
    "answer_attempts": """SELECT CAST(event_id AS VARCHAR) AS scene_id, CASE WHEN event_id % 4 IN (2, 3) THEN 2 ELSE 1 END AS attempt, CASE WHEN
  event_id % 4 = 3 THEN
  'no object' ELSE 'parsed' END AS state FROM events""",
    "best_attempts": f"""{ASSESS}, c AS (SELECT scene_id, count(*) FILTER (ord % 3 <> 0) AS odd, count(*) FILTER (ord % 3 = 0) AS even FROM rec WHERE
  {_CANDIDATE} GROUP BY
  scene_id)
SELECT scene_id, CASE WHEN odd >= even THEN 1 ELSE 2 END AS attempt, least(odd, even) AS omitted FROM c""",
    "recalled_targets": """WITH t AS (SELECT p_partkey % 7 AS chip_id, CAST(p_partkey * 13 % 200 AS INTEGER) AS row, CAST(p_partkey * 29 % 200 AS
  INTEGER) AS col FROM part), f
  AS (SELECT s_suppkey % 7 AS c, s_suppkey * 17 % 200 AS r, s_suppkey * 31 % 200 AS x FROM supplier)
SELECT chip_id, row, col FROM t WHERE EXISTS (SELECT 1 FROM f WHERE c = chip_id AND abs(row - r) <= 2 AND abs(col - x) <= 2)""",
    "document_positions": f"""WITH {DET} SELECT ord, CASE WHEN ord % 3 < 2 THEN lat END AS lat, CASE WHEN ord % 3 < 2 THEN lon END AS lon, CASE WHEN ord %
  3 < 2 THEN CAST(lat AS
  VARCHAR) || ', ' || CAST(lon AS VARCHAR) ELSE 'not known' END AS shown FROM det""",
}
