"""Models' answers as rows: parsing, choosing an attempt, dead letters, and the payload that an agent is sent.

responses: scene_id, agent, attempt, raw. Calling a model is outside; `ask` is a seam for a caller's own function.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.schemas import PRIORITISATION, REPORT
from skerry.sources.files import once

MAX_ATTEMPTS = 2
ECHO_CHARS = 2000


def parse(responses: DataFrame) -> DataFrame:
    """With doc (VARIANT or null) and failure: why there is none."""
    rows = responses.withColumn("looped", T.degenerate(F.col("raw"))).withColumn("doc", F.when(~F.col("looped"), T.parsed(F.col("raw"))))
    why = F.when(T.stripped("raw") == "", "no content").when(
        F.col("looped"), "the same sentences again and again"
    ).when(~F.contains("raw", F.lit("{")), "no object").when(
        T.first_object(T.unfenced(F.col("raw"))).isNull(), "the object is not closed"
    ).otherwise("not JSON")
    return rows.withColumn("failure", F.when(F.col("doc").isNull(), why)).drop("looped")


def first_parsed(responses: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The first attempt of each scene and agent that parses."""
    good = parse(responses).filter(F.col("doc").isNotNull() & (F.col("attempt") <= attempts))
    text = good.select("scene_id", "agent", "attempt", F.to_json("doc").alias("json"))
    return text.groupBy("scene_id", "agent").agg(F.min(F.struct("attempt", "json")).alias("b")).select(
        "scene_id", "agent", "b.attempt", F.parse_json("b.json").alias("doc")
    )


def dead_letters(responses: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The last raw answer of scenes and agents of which no attempt parsed."""
    rows = parse(responses).filter(F.col("attempt") <= attempts)
    lost = rows.groupBy("scene_id", "agent").agg(F.bool_and(F.col("doc").isNull()).alias("lost"), F.max(F.struct("attempt", "raw", "failure")).alias("b"))
    return lost.filter("lost").select("scene_id", "agent", "b.*")


def retry_prompt(raw: str | Column, hint: str = "Answer again with the JSON object alone: no prose, fences, comments or trailing commas.") -> Column:
    """What is fed back after a failure: the start of the answer, and what was wrong with it."""
    return F.concat(F.substring(raw, 1, ECHO_CHARS), F.lit("\n\n"), F.lit(hint))


def as_prioritisation(doc: str = "doc") -> Column:
    return F.from_json(F.to_json(doc), PRIORITISATION)


def as_report(doc: str = "doc") -> Column:
    return F.from_json(F.to_json(doc), REPORT)


def ranked(answers: DataFrame) -> DataFrame:
    """scene_id, rank_ord, id, rank, reason of each ranked candidate."""
    rows = answers.select("scene_id", F.posexplode(as_prioritisation()["prioritised_candidates"]).alias("rank_ord", "c"))
    return rows.select("scene_id", F.col("rank_ord").cast("bigint").alias("rank_ord"), "c.id", "c.rank", "c.reason")


def briefs(answers: DataFrame) -> DataFrame:
    rows = answers.select("scene_id", F.posexplode(as_report()["inspection_briefs"]).alias("brief_ord", "b"))
    return rows.select("scene_id", F.col("brief_ord").cast("bigint").alias("brief_ord"), "b.*")


def prose(answers: DataFrame, report: bool = True) -> DataFrame:
    fields = ("executive_summary", "methodological_note", "human_decision_required") if report else ("observed_pattern", "overall_recommendation")
    return answers.select(
        "scene_id", F.concat_ws(" ", *(F.coalesce(F.expr(f"try_variant_get(doc, '$.{f}', 'string')"), F.lit("")) for f in fields)).alias("prose")
    )


def omitted(candidates: DataFrame, ranks: DataFrame, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Candidates that were not ranked."""
    return candidates.join(ranks.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")


def best_attempt(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Of parsed attempts (scene_id, attempt, doc) the one that omits fewest candidates; the earlier one wins a tie."""
    ranks = answers.select(
        "scene_id", "attempt", F.explode_outer(as_prioritisation()["prioritised_candidates"]).alias("c")
    ).select("scene_id", "attempt", F.col("c.id").alias("id"))
    wanted = candidates.select("scene_id", "id").join(answers.select("scene_id", "attempt"), "scene_id")
    lost = wanted.join(ranks.distinct(), ["scene_id", "attempt", "id"], "left_anti").groupBy("scene_id", "attempt").agg(F.count("*").alias("lost"))
    rows = answers.select(
        "scene_id", "attempt", F.to_json("doc").alias("json")
    ).join(lost, ["scene_id", "attempt"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    best = rows.groupBy("scene_id").agg(F.min(F.struct("lost", "attempt", "json")).alias("b"))
    return best.select("scene_id", "b.attempt", F.col("b.lost").alias("omitted"), F.parse_json("b.json").alias("doc"))


def language_prompt(template: str, language: str) -> Column:
    return F.replace(F.lit(template), F.lit("{language}"), F.lit(language))


def prompts(dossiers: DataFrame, template: str, language: str = "English") -> DataFrame:
    """scene_id and prompt: the template in a language, then the scene's dossier."""
    return dossiers.select("scene_id", F.concat_ws("\n\n", language_prompt(template, language), "dossier").alias("prompt"))


ANSWERS = "scene_id string, agent string, attempt int, raw string, error string"


def ask(asked: DataFrame, call: Callable[[str], str], agent: str, attempt: int = 1, workers: int = 4, timeout: float = 600.0, tries: int = 2) -> DataFrame:
    """ANSWERS of a caller's function to prompts (scene_id, prompt), on the executors. Nothing here reaches a network by itself.

    Of each batch `workers` calls run at a time. A call that fails is tried again, `tries` times in all; one that fails for
    good, or gives nothing within `timeout` seconds, leaves a row without an answer and says why, so it never fails the task.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        wrong = None
        for _ in range(tries):
            try:
                return call(prompt), None
            except Exception as e:  # noqa: BLE001  whatever the call raises, the other prompts go on
                wrong = f"{type(e).__name__}: {e}"
        return None, wrong

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(workers)
        for b in batches:
            began = time.monotonic()
            waiting, found = [pool.submit(one, p) for p in b["prompt"]], []
            for k, w in enumerate(waiting):
                try:  # each round of `workers` calls has its own time
                    found.append(w.result(max(0.0, began + timeout * tries * (k // workers + 1) - time.monotonic())))
                except TimeoutError:
                    w.cancel()
                    found.append((None, "no answer in time"))
            yield pd.DataFrame({"scene_id": b["scene_id"], "agent": agent, "attempt": attempt, "raw": [f[0] for f in found], "error": [f[1] for f in found]})
        pool.shutdown(wait=False, cancel_futures=True)

    return asked.select("scene_id", "prompt").mapInPandas(run, ANSWERS)


def converse(asked: DataFrame, call: Callable[[str], str], agent: str, attempts: int = MAX_ATTEMPTS, **settings) -> DataFrame:
    """ANSWERS of all attempts: what does not parse is asked again, with the start of the answer and what was wrong with it."""
    out, todo = None, asked.select("scene_id", "prompt")
    for attempt in range(1, attempts + 1):
        answers = once(ask(todo, call, agent, attempt, **settings))
        out = answers if out is None else out.unionByName(answers)
        failed = parse(answers).filter("doc is null").select("scene_id", F.coalesce("raw", F.lit("")).alias("raw"))
        again = F.concat_ws("\n\n", "prompt", retry_prompt("raw"))
        todo = once(asked.join(failed, "scene_id").select("scene_id", again.alias("prompt")))
        if not todo.limit(1).count():
            break
    return out
