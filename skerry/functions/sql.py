"""The functions of this package as SQL functions of a session: `install(spark)`, then use them in SQL text.

Each is an SQL expression, so the optimizer puts it in place of the call: nothing runs outside generated code and built-in
functions, and conditions are pushed down through it. Patterns and constants are those of `functions.text` and `functions.geo`.

| function | result |
|-|-|
| distance_km(lat1, lon1, lat2, lon2) | great-circle distance, rounded to 10 m |
| mentions_ais(text) | whether a text invokes the duty to carry AIS; false for null |
| anchors(text) | array of distinct anchors, figures with a decimal point |
| anchors_of(text) | table (place, anchor) of the same, for lateral joins |
| claims_of(text) | table (claimed, id): the ids that a text lists under a priority class, once each |
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from skerry.functions import geo, text


def literal(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    assert '"' not in pattern
    return f'r"{pattern}"'


def definitions() -> list[str]:
    plain = f"translate(coalesce(t, ''), '{text.DASHES}', '{'-' * len(text.DASHES)}')"
    found = f"array_distinct(transform(regexp_extract_all({plain}, {literal(text.ANCHOR)}, 0), x -> replace(x, ',', '.')))"
    square = (
        "pow(sin(radians(lat2 - lat1) / 2), 2.0e0) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2.0e0)"
    )
    listed = lambda pattern, k: f"regexp_extract_all(coalesce(t, ''), {literal(pattern)}, {k})"
    pair = lambda pattern, k: f"zip_with({listed(pattern, 1)}, {listed(pattern, k)}, (c, l) -> named_struct('c', c, 'l', l))"
    said = f"concat({pair(text.CLAIM_IN_BRACKETS, 3)}, {pair(text.CLAIM_BARE.replace('{id}', text.ID), 2)})"
    ids = literal(rf"(?U)\b{text.ID}\b")
    return [
        f"""CREATE OR REPLACE TEMPORARY FUNCTION distance_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
        RETURN round({2 * geo.EARTH_KM}e0 * asin(sqrt({square})), 2)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION mentions_ais(t STRING) RETURNS BOOLEAN
        RETURN lower(coalesce(t, '')) RLIKE {literal(text.AIS_WORDING)}""",
        f"CREATE OR REPLACE TEMPORARY FUNCTION anchors(t STRING) RETURNS ARRAY<STRING> RETURN {found}",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION anchors_of(t STRING) RETURNS TABLE (place INT, anchor STRING)
        RETURN SELECT pos, col FROM posexplode({found})""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION claims_of(t STRING) RETURNS TABLE (claimed STRING, id STRING)
        RETURN SELECT DISTINCT concat(lower(said.col.c), '_priority'), named.col
        FROM explode({said}) AS said, LATERAL explode(regexp_extract_all(said.col.l, {ids}, 0)) AS named""",
    ]


def install(spark: SparkSession) -> None:
    """Define the functions in the session's catalogue."""
    for statement in definitions():
        spark.sql(statement)
