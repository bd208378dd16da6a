"""Mixing sources to target weights by hierarchical budgeting.

The tree has three levels: domain, language, source. A node's capacity is the tokens below it times MAX_EPOCHS. From
the root down each node's budget is dealt to its children in proportion to their weights; what a child cannot hold goes
to its siblings, and only what all of them cannot hold stays with the ancestors' other children. That is water
filling with capacities summed from the leaves, in whole numbers. Rounding leaves at most one token a child unspent.

A leaf's budget is spent on whole epochs first, then on a prefix of the next epoch: documents in the order of
md5(seed:epoch:id), ties by id and text, up to the last token of the budget; the last document may be cut.
Order and sums are found through BUCKETS ranges of that digest, so no leaf is sorted in one task.

Null languages and sources are named `unknown`; documents without tokens are never taken. Rows that are equal in
every column of the result but text order are one unit: they are taken together. Nodes of weight 0 get nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 17
MAX_EPOCHS = 2
SHARE_PERCENT = 60
"""The root's budget as a percentage of all tokens."""
BUCKET_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"
DOMAIN = "concat('domain', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4, 0))"
# Target weights in parts of the siblings' sum; what is not named has OTHER.
WEIGHTS = {"domain": {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10}, "lang": {"en": 40, "de": 20, "es": 20, "fr": 20}, "source": {}}
OTHER = 10
LEVELS = ("domain", "lang", "source")


def _weight(level: str, weights: dict) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in sorted(weights.get(level, {}).items()))
    return f"CASE {cases} ELSE {OTHER} END" if cases else str(OTHER)


def budgets(leaves: DataFrame, weights: dict = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the column budget."""
    spark = leaves.sparkSession
    nodes = leaves.agg(F.floor(F.sum(F.col("tokens").cast("decimal(38,0)")) * share_percent / 100).cast("decimal(20,0)").alias("budget"))
    for depth in range(1, len(LEVELS) + 1):
        path, parent, level = list(LEVELS[:depth]), list(LEVELS[: depth - 1]), LEVELS[depth - 1]
        own = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast("decimal(20,0)").alias("cap"))
        own = own.withColumn("w", F.expr(f"cast({_weight(level, weights)} as decimal(10,0))")).filter("w > 0")
        own = own.join(nodes, parent) if parent else own.crossJoin(F.broadcast(nodes))  # one row: the root
        by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = by.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn(
            "c_before", F.coalesce(F.sum("cap").over(before), F.lit(0))
        ).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("w_all", F.sum("w").over(by))
        own = own.withColumn("full", F.expr("cap * cast(w_all - w_before as decimal(12,0)) <= w * cast(budget - c_before as decimal(20,0))"))
        own = own.withColumn(
            "c_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(by)
        ).withColumn("w_rest", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(F.lit(0))).over(by))
        dealt = "cast((cast(budget - c_full as decimal(20,0)) * w) div nullif(cast(w_rest as decimal(12,0)), 0) as decimal(20,0))"
        nodes = own.select(*path, F.expr(f"CASE WHEN full THEN cap ELSE {dealt} END").alias("budget"))
    del spark
    return leaves.join(nodes.withColumn("budget", F.col("budget").cast("long")), list(LEVELS))


def tokens_of(text) -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def choose(
    docs: DataFrame, text: str = "text", key: str = "doc_id", domain: str = DOMAIN, weights: dict = WEIGHTS, share_percent: int = SHARE_PERCENT,
    epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """Units chosen: key, h (hash of the text), domain, lang, source, n_tokens, epoch (from 0), take_tokens. No text is moved."""
    units = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"), tokens_of(F.col(text)).alias("n_tokens")
    )
    units = units.filter("n_tokens > 0").withColumn("domain", F.expr(domain))
    units = common.materialize(units.groupBy("doc_id", "h", *LEVELS, "n_tokens").agg(F.count("*").alias("m")))
    leaves = budgets(units.groupBy(*LEVELS).agg(F.sum(F.col("n_tokens") * F.col("m")).alias("tokens")), weights, share_percent, epochs)
    leaves = common.materialize(leaves.select(
        *LEVELS, F.expr("cast(budget div tokens as int)").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")
    ).filter("whole > 0 or rest > 0"))
    own = units.join(leaves, list(LEVELS)) if leaves.count() > 10_000 else units.join(F.broadcast(leaves), list(LEVELS))
    own = own.withColumn(
        "order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    ).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    sums = own.groupBy(*LEVELS, "bucket").agg(F.sum(F.col("n_tokens") * F.col("m")).alias("in_bucket"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = common.materialize(sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))))
    own = own.join(sums, [*LEVELS, "bucket"])
    ahead = own.filter("before + in_bucket <= rest").withColumn("left", F.expr("n_tokens * m"))
    edge = own.filter("before < rest and before + in_bucket > rest")
    within = Window.partitionBy(*LEVELS, "bucket").orderBy("order", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("left", F.expr("rest - before") - F.coalesce(F.sum(F.expr("n_tokens * m")).over(within), F.lit(0)))
    columns = ["doc_id", "h", *LEVELS, "n_tokens"]
    last = ahead.unionByName(edge).withColumn("take_tokens", F.expr("least(n_tokens, left div m)")).filter("take_tokens > 0").select(
        *columns, F.col("whole").alias("epoch"), "take_tokens"
    )
    full = own.filter("whole > 0").select(*columns, F.explode(F.expr("sequence(0, whole - 1)")).alias("epoch"), F.col("n_tokens").alias("take_tokens"))
    return full.unionByName(last)


def select(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """The chosen rows of docs, all columns, once an epoch; a text that is cut ends after its last token."""
    uid, h, n, take, own = common.free_names(docs, "_id", "_h", "_n", "_take", "_own")
    names = {"doc_id": uid, "h": h, "n_tokens": n, "take_tokens": take}
    chosen = choose(docs, text, key, **settings).select(*(F.col(c).alias(name) for c, name in names.items()))
    joined = docs.withColumn(own, F.xxhash64(F.col(text))).join(chosen, F.col(key).eqNullSafe(F.col(uid)) & (F.col(own) == F.col(h)))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col(take).cast("int")), "")
    joined = joined.withColumn(text, F.when(F.col(take) < F.col(n), cut).otherwise(F.col(text)))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    return choose(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("h")


def _oracle() -> str:
    parts = [
        "WITH u0 AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)",
        "u AS (SELECT *, 'domain' || CAST(coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4, 0) AS VARCHAR) AS domain FROM u0 WHERE n_tokens > 0)",
        "leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM u GROUP BY ALL)",
        f"b0 AS (SELECT sum(tokens) * {SHARE_PERCENT} // 100 AS budget FROM leaves)",
    ]
    for depth in range(1, len(LEVELS) + 1):
        path, parent, level = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]), LEVELS[depth - 1]
        by = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN b{depth - 1} USING ({parent})" if parent else "CROSS JOIN b0"
        parts += [
            f"c{depth} AS (SELECT n.*, budget FROM (SELECT {path}, sum(tokens) * {MAX_EPOCHS} AS cap, CAST({_weight(level, WEIGHTS)} AS HUGEINT) AS w FROM leaves GROUP BY {path}) AS n {join})",
            f"d{depth} AS (SELECT *, coalesce(sum(cap) OVER q, 0) AS c_before, coalesce(sum(w) OVER q, 0) AS w_before, sum(w) OVER ({by}) AS w_all FROM c{depth} WINDOW q AS ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"e{depth} AS (SELECT *, cap * (w_all - w_before) <= w * (budget - c_before) AS is_full FROM d{depth})",
            f"f{depth} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS c_full, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS w_rest FROM e{depth})",
            f"b{depth} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE (budget - c_full) * w // nullif(w_rest, 0) END AS budget FROM f{depth})",
        ]
    parts += [
        "l AS (SELECT domain, lang, source, CAST(budget // tokens AS INTEGER) AS whole, CAST(budget % tokens AS BIGINT) AS rest FROM leaves JOIN b3 USING (domain, lang, source))",
        f"o AS (SELECT u.*, whole, rest, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS h FROM u JOIN l USING (domain, lang, source))",
        "p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)",
    ]
    return ",\n".join(parts) + """
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS INTEGER) AS epoch, CAST(least(n_tokens, rest - before) AS BIGINT) AS take_tokens FROM p WHERE before < rest
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(e AS INTEGER) AS epoch, n_tokens AS take_tokens FROM (SELECT *, unnest(range(whole)) AS e FROM o)
"""


ORACLE = _oracle()
