"""Queries of the catalogue over generated tables: every record takes part."""

import pytest

from skerry.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """3,000 detections whose ids start above 2,000, and one structure."""
    d = str(tmp_path_factory.mktemp("tables"))
    kind = "element_at(array('purchase', 'click', 'view', 'error', 'signup'), cast(id % 5 + 1 as int))"
    spark.range(2001, 5001).selectExpr(
        "id as event_id", "timestamp'2024-01-15 06:00:00' + make_interval(0, 0, 0, cast(id % 9 as int)) as ts", "(id * 37 % 500) / 100.0e0 as value",
        "concat('{\"k\": ', pmod(xxhash64(id, 1), 100), '}') as props", f"{kind} as event_type", "pmod(xxhash64(id, 2), 5) as user_id"
    ).write.parquet(f"{d}/events.parquet")
    spark.range(1, 4).selectExpr("id as s_suppkey", "'platform' as s_name").write.parquet(f"{d}/supplier.parquet")
    return d


def test_catch_rate_uses_every_record(spark, tables):
    rates = {r["family"]: (r["hits"], r["total"]) for r in catalogue.catch_rate(spark, tables).collect()}
    assert rates["overall"] == (6000, 6000) and all(hits == total for hits, total in rates.values())  # a brief and a rank each


def test_priority_claims_cover_every_record(spark, tables, monkeypatch):
    given, check = {}, catalogue.validate.wrong_claims
    monkeypatch.setattr(catalogue.validate, "wrong_claims", lambda prose, rows, *a: given.update(prose=prose, rows=rows) or check(prose, rows, *a))
    found = sorted(r["scene_id"] for r in catalogue.priority_claims(spark, tables).collect())
    assert given["prose"].count() == given["rows"].count() == 3000
    rows = catalogue.records(spark, tables).select("ord", "classification").collect()
    assert found == sorted(
        f"S{r['ord']}" for r in rows if r["ord"] % 7 == 0 for _ in range(1 if r["classification"] in ("high_priority", "medium_priority") else 2)
    )
    # Right prose says a candidate's class: listed under the other one it would be found.
    own = given["rows"].withColumn("classification", catalogue.F.expr("if(classification = 'high_priority', 'medium_priority', 'high_priority')"))
    right = [r for r in rows if r["ord"] % 7 and r["classification"].endswith("y_priority")]
    assert {f"S{r['ord']}" for r in right} <= {r["scene_id"] for r in check(given["prose"], own, "narrative", "V14a").collect()}
