"""Connected components of link tables, as checkpointed DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def min_label_components(nodes: DataFrame, links: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """node, comp for each of ``nodes``: the smallest node that ``links`` (a, b) reach.

    Each round, a node takes the least label among itself and its neighbours,
    then the label of its label (pointer jumping), so long chains
    shrink by doubling. Only linked nodes take part. A hub's labels are
    pre-aggregated before each shuffle. Rounds end when no label moves. ``rows``: about how many nodes there are, for ``keep``."""
    both = keep(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "both-ways", rows)
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "label", rows)
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("low"))
        jump = low.join(label.select(F.col("node").alias("low"), F.col("comp").alias("next")), "low", "left")
        new = keep(jump.select("node", "was", F.least("low", F.coalesce("next", "low")).alias("comp")), "label", rows)
        discard(both.sparkSession, label)
        label = new.select("node", "comp")
        if not new.filter("was <> comp").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
