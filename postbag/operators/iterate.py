"""Fix-points over DataFrames. Lineage is cut by ``checkpoint`` in the shared folder, so a lost
executor costs a reread and not the loop."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder: ``spark.checkpoint.dir``, or in a local session one of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            os.makedirs("/tmp/checkpoints", exist_ok=True)
            at = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        sc.setCheckpointDir(at)


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their history."""
    shared(df.sparkSession)
    return df.checkpoint()


def global_rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Add ``out``: 1, 2, ... in the order of ``order`` (ties in all of it as they come), without a window over all rows.

    Rows are dealt into ranges and sorted there; a row's number in its range is the low part of its partition's
    running id, and a prefix sum over the ranges (a row each) gives where a range begins."""
    placed = cut(df).repartitionByRange(*order).sortWithinPartitions(*order)  # cut, as finding the ranges reads the rows once more
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")


def running_sums(ranked: DataFrame, values: dict[str, str], rank: str = "rank", each: int = 50_000) -> DataFrame:
    """Add running sums of columns (``values``: new name to column) over rows up to each ``rank`` (1, 2, ... without gaps), in blocks of
    ``each`` ranks and a prefix sum over the blocks."""
    seen = ranked.withColumn("_block", F.floor((F.col(rank) - 1) / each))
    inside = Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    totals = seen.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    bases = totals.select("_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    run = seen.withColumns({f"_r_{n}": F.sum(c).over(inside) for n, c in values.items()}).join(bases, "_block")
    return run.withColumns({n: F.col(f"_r_{n}") + F.col(f"_b_{n}") for n in values}).drop("_block", *[f"{x}_{n}" for n in values for x in ("_r", "_b")])


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], bool], most: int = 100, every: int = 1) -> DataFrame:
    """Apply ``step`` until ``changed(old, new)`` is false; lineage is cut every ``every`` rounds."""
    state = cut(state)
    for turn in range(1, most + 1):
        new = step(state)
        if turn % every == 0:
            new = cut(new)
            if not changed(state, new):
                return new
        state = new
    raise RuntimeError(f"no fix-point in {most} rounds")


def connected_components(vertices: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component (the smallest id reached) for each id of ``vertices`` under ``edges`` (src, dst), either way.

    Labels fall to the least of a vertex's neighbours', then jump to the label's label, so long paths take logarithmically many rounds."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())

    def step(label: DataFrame) -> DataFrame:
        near = both.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        low = label.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("low"))
        return low.join(label.select(F.col("id").alias("low"), F.col("component").alias("next")), "low", "left").select("id", F.least("low", F.coalesce("next", "low")).alias("component"))

    start = vertices.select("id").distinct().select("id", F.col("id").alias("component"))
    return fixpoint(start, step, lambda a, b: not a.join(b.withColumnRenamed("component", "c"), "id").filter("component <> c").isEmpty(), most)


def two_hop_aggregate(incidence: DataFrame, x: DataFrame) -> DataFrame:
    """node, y of H'(Hx) - c*x for incidence (edge_id, node_id) and x (node, value): two sums and
    no pair of nodes, where c counts a node's edges."""
    on_edge = incidence.join(x, incidence.node_id == x.node).groupBy("edge_id").agg(F.sum("value").alias("s"))
    back = incidence.join(on_edge, "edge_id").groupBy("node_id").agg(F.sum("s").alias("s"), F.count("*").alias("c"))
    return back.join(x, back.node_id == x.node, "left").select(F.col("node_id").alias("node"), (F.col("s") - F.col("c") * F.coalesce("value", F.lit(0.0))).alias("y"))
