"""Validation: what a model wrote against what was computed, as relational rules that emit issues.

Rules on one brief are conditions of a single projection; rules on what is missing are anti-joins; the rule on anchors of
other detections is an equi-join on the anchor with its last owner. All scenes are checked in one job.
Issues: scene_id, severity, place, message, rule, ord (their order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import dossier
from skerry.schemas import BLOCKER, CANDIDATES, WARNING, Config
from skerry.sources import files

TOLERANCE_DEG = 0.001
PLACES, BLOCK = 1 << 20, 1 << 60
"""Issues of one output are numbered within so many places; kinds of issues within blocks of so many."""


def latest(records: DataFrame) -> DataFrame:
    """One record for each id of a scene: of equal ids the last. Select what is needed first: all columns are dealt by id."""
    by = Window.partitionBy("scene_id", "id").orderBy(F.desc("ord"))
    return records.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def reasons(indicators: str = "potential_indicators") -> Column:
    return F.array_join(F.transform(indicators, lambda i: i.reason), " ")


_ASKED = (
    "scene_id", "id", "ord", "classification", "ais", "lat", "lon", "estimated_length_m", "potential_indicators", "ais_indicator_suppressed"
)


def facts_of(records: DataFrame) -> DataFrame:
    """What the rules ask of each record (of equal ids the last), columns prefixed r_. Rules on one set of records share it: keep
    it once (`files.kept`) where several are evaluated."""
    rows, said = latest(records.select(*_ASKED)), reasons()
    silent = F.col("ais_indicator_suppressed") & (F.size("potential_indicators") == 0)
    facts = {
        "r_ord": F.col("ord"), "r_class": F.col("classification"), "r_ais": F.col("ais"), "r_lat": F.col("lat"), "r_lon": F.col("lon"),
        "r_length": F.col("estimated_length_m"), "r_reasons": F.transform("potential_indicators", lambda i: i.reason),
        "r_engaged": F.exists("potential_indicators", lambda i: i.kind.startswith("ais")), "r_has": F.size("potential_indicators") > 0,
        "r_anchors": T.anchors(said), "r_text": F.lower(said), "r_silent": silent,
    }
    return rows.select("scene_id", "id", *(v.alias(k) for k, v in facts.items()))


def _issue(when: Column, severity, rule: str, message) -> Column:
    say = message if isinstance(message, Column) else F.lit(message)
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(when, F.struct(level.alias("severity"), F.lit(rule).alias("rule"), say.alias("message")))


def _alien(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with alien: the anchors that a brief cites, its own record lacks and another detection has, each with the last owner."""
    owners = facts.select("scene_id", F.explode("r_anchors").alias("anchor"), "id", "r_ord")
    owners = owners.groupBy("scene_id", "anchor").agg(F.max(F.struct("r_ord", "id")).alias("o"))
    cited = rows.filter("r_found").select("scene_id", "brief_ord", F.explode(F.array_except("cited", "r_anchors")).alias("anchor"))
    named = F.concat("anchor", F.lit(" ("), "o.id", F.lit(")"))
    alien = cited.join(owners, ["scene_id", "anchor"]).groupBy("scene_id", "brief_ord").agg(F.array_sort(F.collect_set(named)).alias("alien"))
    return rows.join(alien.withColumn("alien", F.array_join("alien", ", ")), ["scene_id", "brief_ord"], "left")


def _brief_rules(config: Config) -> list[Column]:
    has, engaged, sending = F.col("r_has"), F.col("r_engaged"), F.col("r_ais") == "matched"
    regulation, caveat, action, stated = (F.col(c) for c in ("regulation", "caveat", "action", "stated"))
    limit, none_named = config.ais_length_threshold_m, F.lower(regulation).rlike(T.NOTHING_NAMED)
    why = F.when(sending, "vessel is broadcasting").otherwise("no AIS indicator stands for this vessel")
    wording = [("the regulation", regulation), ("the indicators", F.array_join("listed", " ")), ("the action", action)]
    far = (F.abs(F.col("at.lat") - F.col("r_lat")) > TOLERANCE_DEG) | (F.abs(F.col("at.lon") - F.col("r_lon")) > TOLERANCE_DEG)
    plain = F.replace("r_class", F.lit("_priority"), F.lit(""))
    repeated = F.exists(
        "r_reasons", lambda r: (F.char_length(T.stripped(r)) > 40) & F.contains(F.lower(regulation), F.lower(F.substring(T.stripped(r), 1, 60)))
    )
    number = lambda c: F.size(c).cast("string")
    text = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    return [
        _issue(F.col("r_silent"), BLOCKER, "V1", "its AIS indicator is suppressed and nothing else stands against it: it must not be briefed"),
        _issue(~F.col("r_class").isin(*CANDIDATES), WARNING, "V2", text("its class is ", F.col("r_class"), ", which warrants no brief")),
        _issue(has & (caveat == ""), BLOCKER, "VA", "the caveat that indicators require is missing"),
        _issue(
            (F.col("r_length") >= limit) & F.lower(caveat).rlike(T.below_claim(limit)), BLOCKER, "VB",
            text(f"the caveat places it under {limit} m, the record gives ", F.col("r_length").cast("string"), " m")
        ),
        _issue(F.lower(action).rlike(T.FORBIDDEN_VERBS), BLOCKER, "VC", text("the action '", action, "' exceeds an inspector's authority")),
        *(_issue(~engaged & T.mentions_ais(c), BLOCKER, "V3", text(why, f", yet {n} invokes the duty to carry AIS")) for n, c in wording),
        _issue(sending & T.mentions_ais(caveat), WARNING, "V3b", "vessel is broadcasting, yet the caveat discusses AIS"),
        _issue(F.col("at").isNull(), WARNING, "V4", "position is missing or cannot be read"),
        _issue(far, BLOCKER, "V4", "position differs from the computed one"),
        _issue(has & ((regulation == "") | none_named | F.lower(regulation).rlike("^none$")), WARNING, "V5", "it has indicators but no regulation is named"),
        _issue(~has & (regulation != "") & ~none_named, BLOCKER, "V6", "it has no indicators, yet a regulation is named"),
        _issue(
            (stated != "") & (stated != plain) & (stated != F.col("r_class")), BLOCKER, "V7",
            text("priority is stated as ", stated, ", the record is ", F.col("r_class"))
        ),
        _issue(F.col("alien").isNotNull(), BLOCKER, "V8", text("the regulation carries anchors of another detection: ", F.col("alien"))),
        _issue(repeated, WARNING, "V8b", "the regulation repeats an indicator instead of naming a provision"),
        _issue(
            (F.size("r_anchors") > 0) & ~F.arrays_overlap("r_anchors", "own"), BLOCKER, "V9",
            "its indicators carry no zone, figure or reference of the record's own"
        ),
        _issue(
            F.size("listed") > F.size("r_reasons"), BLOCKER, "V10",
            text("it lists ", number("listed"), " indicators, the record has ", number("r_reasons"))
        ),
        _issue(F.char_length(T.instruction(action)) < 15, WARNING, "V11", text("the action '", action, "' is no instruction")),
    ]


def _line_rules(config: Config) -> Column:
    """What is wrong with each listed indicator."""
    english = F.lit(config.output_language.casefold() == "english")
    issue = lambda level, rule, message: F.struct(F.lit(level).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"))
    unlike = lambda x: (F.size(T.long_words(x)) > 0) & (F.col("r_text") != "") & ~F.arrays_overlap(T.long_words(x), T.long_words(F.col("r_text")))
    label = lambda x: F.concat(F.lit("indicator '"), T.stripped(x), F.lit("' is a label, not a statement"))
    return F.transform("listed", lambda x: (
        F.when(F.char_length(T.stripped(x)) < 25, issue(BLOCKER, "V12a", label(x)))
        .when(english & unlike(x), issue(WARNING, "V12b", F.lit("an indicator shares no wording with the record's")))
    ))


def brief_issues(briefs: DataFrame, records: DataFrame, config: Config, facts: DataFrame | None = None) -> DataFrame:
    """Rules on single briefs (scene_id, brief_ord, id, position, priority, indicators, regulation_concerned, suggested_action, caveat).
    facts: those of the records, where they are kept already."""
    facts = facts_of(records) if facts is None else facts
    rows = briefs.join(facts.withColumn("r_found", F.lit(True)), ["scene_id", "id"], "left")
    rows = rows.withColumns({
        "regulation": T.stripped("regulation_concerned"), "caveat": T.stripped("caveat"), "action": T.stripped("suggested_action"),
        "stated": F.lower(T.stripped("priority"))
    })
    rows = rows.withColumn("listed", F.coalesce("indicators", F.expr("array()").cast("array<string>")))
    rows = rows.withColumns({"at": T.position(F.col("position")), "cited": T.anchors(F.col("regulation")), "own": T.anchors(F.array_join("listed", " "))})
    rows = _alien(rows, facts)
    missing = F.array(F.struct(F.lit(BLOCKER).alias("severity"), F.lit("V0").alias("rule"), F.lit("its id is not in the dossier").alias("message")))
    every = F.when(F.col("r_found"), F.array_compact(F.concat(F.array(*_brief_rules(config)), _line_rules(config)))).otherwise(missing)
    found = rows.select("scene_id", "id", "brief_ord", F.posexplode(every).alias("k", "i"))
    place, order = F.concat(F.lit("brief "), F.coalesce("id", F.lit("?"))), (F.col("brief_ord") * PLACES + F.col("k")).cast("bigint")
    return found.select("scene_id", "i.severity", place.alias("place"), "i.message", "i.rule", order.alias("ord"))


def missing_briefs(briefs: DataFrame, records: DataFrame) -> DataFrame:
    wanted = dossier.candidates(records.select("scene_id", "id", "ord", "classification")).join(briefs.select("scene_id", "id"), ["scene_id", "id"], "left_anti")
    severity = F.when(F.col("classification") == "high_priority", BLOCKER).otherwise(WARNING)
    place, message = F.concat(F.lit("brief "), "id"), F.concat("classification", F.lit(" record has no brief"))
    order = (F.lit(BLOCK) + F.col("ord")).cast("bigint")
    return wanted.select("scene_id", severity.alias("severity"), place.alias("place"), message.alias("message"), F.lit("V13").alias("rule"), order.alias("ord"))


def wrong_claims(prose: DataFrame, records: DataFrame, place: str, rule: str, id_pattern: str = T.ID, facts: DataFrame | None = None) -> DataFrame:
    """Ids that prose (scene_id, prose) lists under a class that is not theirs; each once."""
    if facts is None:
        own = latest(records.select("scene_id", "id", "ord", "classification")).select("scene_id", "id", "classification")
    else:
        own = facts.select("scene_id", "id", F.col("r_class").alias("classification"))
    said = prose.select("scene_id", F.posexplode(T.claims(F.coalesce("prose", F.lit("")), id_pattern)).alias("k", "c"))
    ids = F.regexp_extract_all(F.col("c.listed"), F.lit(rf"(?U)\b{id_pattern}\b"), F.lit(0))
    said = said.select("scene_id", "k", F.col("c.claimed").alias("claimed"), F.posexplode(ids).alias("j", "id"))
    rows = said.join(own, ["scene_id", "id"]).filter("classification <> claimed")
    rows = rows.groupBy("scene_id", "id", "claimed", "classification").agg(F.min(F.col("k") * PLACES + F.col("j")).cast("bigint").alias("ord"))
    message = F.concat("id", F.lit(" is "), "classification", F.lit(" but is listed among "), "claimed", F.lit(" records"))
    return rows.select("scene_id", F.lit(WARNING).alias("severity"), F.lit(place).alias("place"), message.alias("message"), F.lit(rule).alias("rule"), "ord")


def named_in(prose: DataFrame, ids: DataFrame) -> DataFrame:
    """scene_id and id of the ids (scene_id, id) that stand in their scene's prose (scene_id, prose), wherever.

    Many ids meet a prose at once: its substrings of each length that an id of the scene has are joined with the ids, so work is
    the prose's length times the number of lengths, not times the number of ids.
    """
    text = F.coalesce("prose", F.lit(""))
    lengths = ids.select("scene_id", F.char_length("id").alias("n")).distinct()
    cut = prose.select("scene_id", text.alias("t")).join(lengths, "scene_id").filter("char_length(t) >= n")
    grams = cut.select("scene_id", F.explode(F.expr("transform(sequence(1, char_length(t) - n + 1), i -> substring(t, i, n))")).alias("id")).distinct()
    return ids.join(grams, ["scene_id", "id"]).select("scene_id", "id")


def silent_in_prose(prose: DataFrame, records: DataFrame, place: str, rule: str, facts: DataFrame | None = None) -> DataFrame:
    """Ids that must not be named but are, in order."""
    if facts is None:
        own = latest(records.select("scene_id", "id", "ord", "ais_indicator_suppressed", "potential_indicators"))
        ids = dossier.silent(own).select("scene_id", "id")
    else:
        ids = facts.filter("r_silent").select("scene_id", "id")
    order = F.row_number().over(Window.partitionBy("scene_id").orderBy("id")).cast("bigint")  # of the ids that a prose names
    message = F.concat("id", F.lit(" has its AIS indicator suppressed and nothing else, yet is named"))
    return named_in(prose, ids).select(
        "scene_id", F.lit(BLOCKER).alias("severity"), F.lit(place).alias("place"), message.alias("message"), F.lit(rule).alias("rule"),
        order.alias("ord")
    )


def _shift(issues: DataFrame, block: int) -> DataFrame:
    return issues.withColumn("ord", F.col("ord") + F.lit(block * BLOCK))


def report_issues(briefs: DataFrame, prose: DataFrame, records: DataFrame, config: Config, id_pattern: str = T.ID) -> DataFrame:
    """All issues of reports: briefs, then what is missing, then the narrative (scene_id, prose)."""
    facts = files.kept(facts_of(records), "facts")
    parts = [
        brief_issues(briefs, records, config, facts), missing_briefs(briefs, records),
        _shift(wrong_claims(prose, records, "narrative", "V14a", id_pattern, facts), 2),
        _shift(silent_in_prose(prose, records, "narrative", "V14b", facts), 3)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def figures(records: DataFrame) -> Column:
    """Every figure and id that a record legitimately holds."""
    texts = F.array_union(T.anchors(reasons()), T.anchors(F.array_join("contextual_notes", " ")))
    numbers = [c for c in ("estimated_length_m", "distance_from_base_km", "fishing_score", "speed_kn", "score", "lat", "lon") if c in records.columns]
    said = F.array_compact(F.array(*(F.col(c).cast("string") for c in numbers), F.abs("lat").cast("string"), F.abs("lon").cast("string")))
    return F.array_union(F.array_union(texts, said), F.transform("zones", lambda z: z.id))


def ranking_issues(ranked: DataFrame, records: DataFrame) -> DataFrame:
    """Issues of rankings (scene_id, rank_ord, id, reason): what is no candidate, foreign figures, candidates left out."""
    own = records.select("scene_id", "id", "ord", "classification", figures(records).alias("r_figures"))
    facts = latest(own).select("scene_id", "id", F.col("ord").alias("r_ord"), F.col("classification").alias("r_class"), "r_figures")
    rows = ranked.join(facts, ["scene_id", "id"], "full")  # a record that nobody ranked comes without a rank
    given, cited = F.col("rank_ord").isNotNull(), T.anchors(F.col("reason"))
    is_candidate = F.col("r_class").isin(*CANDIDATES)
    foreign = (F.size(cited) > 0) & (F.size("r_figures") > 0) & ~F.arrays_overlap(cited, "r_figures")
    place = F.concat(F.lit("prioritised "), F.coalesce("id", F.lit("None")))

    def issue(when: Column, severity, where: Column, message: Column, rule: str, block: int) -> Column:
        order = F.coalesce("rank_ord", "r_ord").cast("bigint") + F.lit(block * BLOCK)
        level = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(when, F.struct(level.alias("severity"), where.alias("place"), message.alias("message"), F.lit(rule).alias("rule"), order.alias("ord")))

    by_class = F.when(F.col("r_class") == "high_priority", BLOCKER).otherwise(WARNING)
    not_ranked = F.concat("id", F.lit(" is "), "r_class", F.lit(" but was not ranked"))
    found = F.array_compact(F.array(
        issue(given & F.col("r_class").isNull(), BLOCKER, place, F.lit("its id is not in the dossier"), "Q2", 1),
        issue(given & ~is_candidate, BLOCKER, place, F.concat(F.lit("it is no candidate (class "), "r_class", F.lit(")")), "Q2", 1),
        issue(
            given & F.col("r_class").isNotNull() & foreign, BLOCKER, place,
            F.concat(F.lit("its reason cites "), F.array_join(F.array_sort(cited), ", "), F.lit(", none of it the record's")), "Q3", 2
        ),
        issue(~given & is_candidate, by_class, F.lit("analyst prioritisation"), not_ranked, "Q5", 4),
    ))
    return rows.select("scene_id", F.explode(found).alias("i")).select("scene_id", "i.severity", "i.place", "i.message", "i.rule", "i.ord")


def prioritisation_issues(ranked: DataFrame, prose: DataFrame, records: DataFrame, id_pattern: str = T.ID) -> DataFrame:
    """Issues of prioritisations: ranked (scene_id, rank_ord, id, reason) and their narrative (scene_id, prose)."""
    out = wrong_claims(prose, records, "analyst narrative", "Q1", id_pattern).unionByName(ranking_issues(ranked, records))
    return out.unionByName(_shift(silent_in_prose(prose, records, "analyst narrative", "Q4"), 3))


ANALYST_KEYS = ("prioritised_candidates", "ais_not_applicable", "observed_pattern", "overall_recommendation", "limitations")


def structure_issues(answers: DataFrame, doc: str = "doc") -> DataFrame:
    """Issues with the shape of analysts' answers: scene_id and doc, a VARIANT object."""
    v = lambda path, kind="variant": F.expr(f"try_variant_get({doc}, '$.{path}', '{kind}')")
    have = F.json_object_keys(F.expr(f"to_json({doc})"))
    absent = F.transform(
        F.array_except(F.array(*(F.lit(k) for k in ANALYST_KEYS)), have),
        lambda k: F.struct(F.lit(WARNING).alias("severity"), F.concat(F.lit("the answer lacks "), k).alias("message"))
    )
    given = v("prioritised_candidates")
    kind = F.schema_of_variant(given)
    blocker = lambda m: F.struct(F.lit(BLOCKER).alias("severity"), (m if isinstance(m, Column) else F.lit(m)).alias("message"))
    items = v("prioritised_candidates", "array<variant>")
    nameless = F.array_compact(F.transform(
        items, lambda x,
        i: F.when(
            F.coalesce(F.try_variant_get(x, "$.id", "string"), F.lit("")) == "",
            blocker(F.concat(F.lit("candidate "), (i + 1).cast("string"), F.lit(" carries no id")))
        )
    ))
    shape = F.when(given.isNull() | (kind == "VOID"), F.array(blocker("there is no list of candidates"))).when(
        ~kind.startswith("ARRAY"), F.array(blocker(F.concat(F.lit("candidates are "), kind, F.lit(", not a list"))))
    ).otherwise(nameless)
    rows = answers.select("scene_id", F.posexplode(F.concat(absent, shape)).alias("k", "i"))
    return rows.select(
        "scene_id", F.col("i.severity").alias("severity"), F.lit("analyst structure").alias("place"), F.col("i.message").alias("message"),
        F.lit("S").alias("rule"), F.col("k").cast("bigint").alias("ord")
    )


def top_severity(issues: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """For every output the worst severity of its issues: BLOCKER, WARNING or clean."""
    rank = F.when(F.col("severity") == BLOCKER, 2).when(F.col("severity") == WARNING, 1)
    worst = issues.groupBy(*keys).agg(F.max(rank).alias("w"))
    return outputs.join(worst, keys, "left").withColumn(
        "severity", F.when(F.col("w") == 2, BLOCKER).when(F.col("w") == 1, WARNING).otherwise("clean")
    ).drop("w")


def has_blockers(issues: DataFrame) -> DataFrame:
    """scene_id, blocked: the gate that lets nothing through while a blocker stands."""
    return issues.groupBy("scene_id").agg(F.bool_or(F.col("severity") == BLOCKER).alias("blocked"))


def listing(issues: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """scene_id and text: a line an issue, in order; "no issues" for a scene of `scenes` that has none."""
    line = F.concat(F.lit("  ["), "severity", F.lit("] "), "place", F.lit(": "), "message")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "rule", line.alias("t")))), lambda x: x.t)
    head = F.concat(F.lit("Output validation: "), F.count("*").cast("string"), F.lit(" issue(s)\n"))
    out = issues.groupBy("scene_id").agg(F.concat(head, F.array_join(lines, "\n")).alias("text"))
    if scenes is None:
        return out
    return scenes.select("scene_id").distinct().join(out, "scene_id", "left").withColumn("text", F.coalesce("text", F.lit("Output validation: no issues")))


def passed(issues: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many outputs there are and how many of them have no issue."""
    judged = top_severity(issues, outputs, keys)
    return judged.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "clean").alias("passed"))
