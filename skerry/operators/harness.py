"""Known-good outputs derived from records, faults planted in them, how many of these the rules catch, and timing.

A fault spoils one field of one output and names the rule that must find it. Every record gets a brief and a place in the
ranking; its ord decides which fault they carry, if it applies there, so all scenes are judged in one job and records are
never copied. What carries no fault is a control and must stay without issues, unless the record warrants no output at all.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators import dossier, validate
from skerry.schemas import CANDIDATES, Config
from skerry.sources.files import kept

CONTROL = "control"


@dataclass(frozen=True)
class Fault:
    """applies: SQL over a record's columns. changes: SQL by field, over the output's and the record's columns; none: left out."""

    name: str
    family: str
    rule: str | None
    applies: str = "true"
    changes: dict[str, str] = field(default_factory=dict)


_HAS, _FIRST = "size(potential_indicators) > 0", "potential_indicators[0].reason"
_ENGAGED = "exists(potential_indicators, i -> startswith(i.kind, 'ais'))"
_IS_CANDIDATE = f"classification in {CANDIDATES}"
BORROWED = "zone_of_another"
BRIEF_FAULTS = (
    Fault("white_caveat", "omission", "VA", _HAS, {"caveat": "'\\t \\n'"}),
    Fault("understated_length", "figures", "VB", "estimated_length_m >= 15", {"caveat": "'the vessel is below 15 m'"}),
    Fault("ordered_force", "authority", "VC", "true", {"suggested_action": "'seize the vessel and all of its gear'"}),
    Fault("carriage_duty_cited", "legal", "V3", f"not {_ENGAGED}", {"regulation_concerned": "concat(regulation_concerned, '; Article 10 on carriage')"}),
    Fault("broadcaster_explained", "legal", "V3b", "ais = 'matched'", {"caveat": "'inferred from radar; article 10 was considered'"}),
    Fault("shifted_position", "position", "V4", "true", {"position": "concat_ws(', ', lat + 0.05e0, lon)"}),
    Fault("no_position", "position", "V4", "true", {"position": "'off the coast'"}),
    Fault("no_provision", "omission", "V5", _HAS, {"regulation_concerned": "' '"}),
    Fault("invented_provision", "legal", "V6", f"not {_HAS}", {"regulation_concerned": "'national fisheries code, chapter four'"}),
    Fault("lowered_priority", "rank", "V7", "true", {"priority": "'low'"}),
    Fault(BORROWED, "legal", "V8", "lent is not null", {"regulation_concerned": "concat(regulation_concerned, '; see ', lent)"}),
    Fault("copied_reason", "legal", "V8b", f"{_HAS} and char_length({_FIRST}) > 40", {"regulation_concerned": f"concat(regulation_concerned, ' ', {_FIRST})"}),
    Fault("figures_left_out", "fabrication", "V9", _HAS, {"indicators": "array('the vessel behaved strangely close to the coast')"}),
    Fault("indicator_added", "fabrication", "V10", "true", {"indicators": "array_append(indicators, 'its crew was hauling nets at night')"}),
    Fault("distance_only", "authority", "V11", "true", {"suggested_action": "'12.5 km from base'"}),
    Fault("label_only", "fabrication", "V12a", "true", {"indicators": "array('zone')"}),
    Fault("unrelated_words", "fabrication", "V12b", _HAS, {"indicators": "array('qqqqq wwwww kkkkk jjjjj zzzzz xxxxx')"}),
    Fault("unknown_vessel", "fabrication", "V0", "true", {"id": "'D-none'"}),
    Fault("no_brief", "omission", "V13", _IS_CANDIDATE),
    Fault("spaced_priority", CONTROL, None, "true", {"priority": "concat('\\t', upper(priority), '\\n')"}),
    Fault("as_it_is", CONTROL, None),
    Fault("as_it_is_too", CONTROL, None),
)
RANKING_FAULTS = (
    Fault("figure_of_no_record", "figures", "Q3", "true", {"reason": "'seen at 9999.9 m'"}),
    Fault("not_ranked", "omission", "Q5", _IS_CANDIDATE),
    Fault("unknown_vessel_ranked", "fabrication", "Q2", "true", {"id": "concat('X-', id)"}),
    Fault("ranked_as_it_is", CONTROL, None),
    Fault("ranked_as_it_is_too", CONTROL, None),
)


def clean_briefs(records: DataFrame, config: Config, every: bool = False) -> DataFrame:
    """A correct brief for every candidate (every: for every record), in input order."""
    rows = records if every else dossier.candidates(records)
    return rows.select("scene_id", F.col("ord").alias("brief_ord"), *(v.alias(k) for k, v in _brief(config).items()))


def _brief(config: Config) -> dict[str, Column]:
    return {
        "id": F.col("id"), "position": F.concat_ws(", ", "lat", "lon"), "priority": F.replace("classification", F.lit("_priority"), F.lit("")),
        "indicators": F.transform("potential_indicators", lambda i: i.reason), "regulation_concerned": dossier.citation(basis=config.ais_legal_basis),
        "suggested_action": F.lit("board and verify gear and documents on site"), "caveat": F.lit("inferred from radar; confirm on inspection"),
    }


def clean_ranked(records: DataFrame, every: bool = False) -> DataFrame:
    """A correct ranking: every candidate with its first reason."""
    rows = records if every else dossier.candidates(records)
    return rows.select(
        "scene_id", F.col("ord").alias("rank_ord"), "id",
        F.coalesce(F.get(F.col("potential_indicators"), F.lit(0))["reason"], F.lit("worth a look")).alias("reason")
    )


def clean_prose(records: DataFrame) -> DataFrame:
    return records.select("scene_id").distinct().withColumn(
        "prose", F.lit("Several detections carry concurring indicators. Priority orders attention; a person decides on patrols.")
    )


def spoiled_prose(records: DataFrame) -> DataFrame:
    """Per scene: its first medium record is claimed to be high, and its first silent one is named."""
    silent = F.col("ais_indicator_suppressed") & (F.size("potential_indicators") == 0)
    medium = F.col("classification") == "medium_priority"
    per = records.groupBy("scene_id").agg(
        F.min_by(F.when(medium, F.col("id")), F.when(medium, F.col("ord"))).alias("m"),
        F.min_by(F.when(silent, F.col("id")), F.when(silent, F.col("ord"))).alias("s")
    )
    return per.select(
        "scene_id",
        F.concat(
            F.lit("High-priority vessels seen today ("), F.coalesce("m", F.lit("none")), F.lit("). Activity gathers near "),
            F.coalesce("s", F.lit("the bank")), F.lit(".")
        ).alias("prose")
    )


def _planted(rows: DataFrame, faults: tuple[Fault, ...], fields: tuple[str, ...], shift: int) -> DataFrame:
    """rows with the fault that their ord and shift choose and that applies: fault, family, expected; those left out go."""
    turn = F.pmod(F.col("ord") + shift, F.lit(len(faults)))
    rows = rows.withColumn("k", F.coalesce(*(F.when((turn == k) & F.expr(f.applies), k) for k, f in enumerate(faults))))
    is_candidate = F.col("classification").isin(*CANDIDATES)
    chosen = lambda of: F.coalesce(*(F.when(F.col("k") == k, F.lit(of(f))) for k, f in enumerate(faults)))
    rows = rows.withColumns({"fault": chosen(lambda f: f.name), "family": chosen(lambda f: f.family), "expected": chosen(lambda f: f.rule)})
    # A record that is no candidate warrants no output: the rule on that must speak where no fault does.
    unwarranted = F.col("expected").isNull() & ~is_candidate
    by_rule = F.lit("Q2") if "reason" in fields else F.when(F.col("ais_indicator_suppressed") & (F.size("potential_indicators") == 0), "V1").otherwise("V2")
    rows = rows.withColumns({
        "family": F.when(unwarranted, "over-report").otherwise(F.coalesce("family", F.lit(CONTROL))),
        "expected": F.when(unwarranted, by_rule).otherwise(F.col("expected"))
    })
    changed = {c: F.coalesce(
        *(F.when(F.col("k") == k, F.expr(f.changes[c])) for k, f in enumerate(faults) if c in f.changes), F.col(c)
    ) for c in fields if any(c in f.changes for f in faults)}
    left_out = [k for k, f in enumerate(faults) if f.rule and not f.changes]
    return rows.withColumns(changed).withColumn("left_out", F.coalesce(F.col("k").isin(*left_out), F.lit(False)))


BRIEF_FIELDS = ("id", "position", "priority", "indicators", "regulation_concerned", "suggested_action", "caveat")


def planted_briefs(records: DataFrame, config: Config, shift: int = 0) -> DataFrame:
    """A brief a record, with fault, family, expected (a rule or null) and left_out; brief_ord is the record's ord."""
    zone = F.explode(F.array_distinct(F.filter(F.transform("potential_indicators", lambda i: i.zone_id), lambda z: z.isNotNull())))
    lent = records.select("scene_id", zone.alias("z")).groupBy("scene_id").agg(F.max("z").alias("lent"))
    rows = records.join(lent, "scene_id", "left")
    rows = rows.withColumn("lent", F.when(~F.exists("potential_indicators", lambda i: i.zone_id.eqNullSafe(F.col("lent"))), F.col("lent")))
    rows = rows.withColumns({k: v for k, v in _brief(config).items() if k != "id"})
    rows = _planted(rows, BRIEF_FAULTS, BRIEF_FIELDS, shift)
    return rows.select("scene_id", F.col("ord").alias("brief_ord"), *BRIEF_FIELDS, "fault", "family", "expected", "left_out")


def planted_ranking(records: DataFrame, shift: int = 0) -> DataFrame:
    """A place in the ranking a record, with fault, family, expected and left_out."""
    rows = records.withColumn("reason", F.coalesce(F.get(F.col("potential_indicators"), F.lit(0))["reason"], F.lit("worth a look")))
    rows = _planted(rows, RANKING_FAULTS, ("id", "reason"), shift)
    return rows.select("scene_id", F.col("ord").alias("rank_ord"), "id", "reason", "fault", "family", "expected", "left_out")


def given(planted: DataFrame) -> DataFrame:
    """What a model would have given: the outputs that are not left out."""
    return planted.filter(~F.col("left_out")).drop("fault", "family", "expected", "left_out")


def verdicts(records: DataFrame, config: Config, shift: int = 0) -> DataFrame:
    """scene_id, ord, kind (brief or ranking), fault, family, expected and ok of every planted output."""
    records = kept(records, "records")
    briefs, ranking = planted_briefs(records, config, shift), planted_ranking(records, shift)
    on_briefs = validate.brief_issues(given(briefs), records, config).select("scene_id", F.expr(f"ord div {validate.PLACES}").alias("ord"), "rule")
    missing = validate.missing_briefs(given(briefs), records).select("scene_id", (F.col("ord") - validate.BLOCK).alias("ord"), "rule")
    on_ranks = validate.ranking_issues(given(ranking), records).select("scene_id", (F.col("ord") % (validate.BLOCK)).alias("ord"), "rule")

    def judged(planted: DataFrame, key: str, issues: DataFrame, kind: str) -> DataFrame:
        rules = issues.groupBy("scene_id", F.col("ord").alias(key)).agg(F.collect_set("rule").alias("rules"))
        rows = planted.join(rules, ["scene_id", key], "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
        ok = F.when(F.col("expected").isNull(), F.size("rules") == 0).otherwise(F.array_contains("rules", F.col("expected")))
        return rows.select("scene_id", F.col(key).alias("ord"), F.lit(kind).alias("kind"), "fault", "family", "expected", ok.alias("ok"))

    return judged(briefs, "brief_ord", on_briefs.unionByName(missing), "brief").unionByName(judged(ranking, "rank_ord", on_ranks, "ranking"))


def catch_rate(found: DataFrame) -> DataFrame:
    """Hits and totals by family, with the totals of all faults (`adversarial`) and of everything (`overall`)."""
    groups = F.when(F.col("family") == CONTROL, F.array("family", F.lit("overall"))).otherwise(F.array("family", F.lit("adversarial"), F.lit("overall")))
    return found.select(F.explode(groups).alias("family"), "ok").groupBy("family").agg(F.count_if("ok").alias("hits"), F.count("*").alias("total"))


def timed(stages: dict[str, Callable[[], object]], repeat: int) -> list[tuple[str, int, float]]:
    """(stage, run, seconds) of every run of every stage, after one that does not count."""
    rows = []
    for name, run in stages.items():
        run()
        for k in range(repeat):
            began = time.perf_counter()
            run()
            rows.append((name, k, time.perf_counter() - began))
    return rows


def stages(read: Callable[[], DataFrame], assessed: Callable[[DataFrame], DataFrame], config: Config) -> dict[str, Callable[[], object]]:
    """The four stages that are timed: load, cross-reference, validate the ranking, validate the report. Each runs to its end."""
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    records = kept(assessed(read()), "records")
    prose = clean_prose(records)
    return {
        "load": lambda: done(read()), "cross_reference": lambda: done(assessed(read())),
        "validate_prioritisation": lambda: done(validate.prioritisation_issues(clean_ranked(records), prose, records)),
        "validate_report": lambda: done(validate.report_issues(clean_briefs(records, config), prose, records, config)),
    }


def latency(times: DataFrame, sections: DataFrame, detections: int) -> DataFrame:
    """Median seconds by stage, with the totals of each section and of all (stage null), and per detection."""
    medians = times.groupBy("stage").agg(F.median("seconds").alias("seconds")).join(F.broadcast(sections), "stage")  # a row a stage
    return medians.rollup("section", "stage").agg(F.sum("seconds").alias("seconds")).withColumn("per_detection", F.col("seconds") / detections)
