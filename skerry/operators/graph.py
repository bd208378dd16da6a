"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources import files


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node of its component) for the ends of links (a, b): least labels, with pointer jumping, so the
    number of rounds is logarithmic in the length of a chain. Labels are kept in the shared folder after each round."""
    edges = files.once(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = files.once(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("comp")).withColumnRenamed("u", "node"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("least"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = files.once(hooked.join(jump, "comp").select("node", "old", F.least("comp", "next").alias("comp")))
        labels = new.select("node", "comp")
        if not new.filter("comp <> old").limit(1).count():
            return labels
