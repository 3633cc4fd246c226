"""Hypergraphs as incidence tables: edge_id, node_id; weights and orders beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import people, symmetrise
from .iterate import connected_components, cut, global_rank, running_sums


# -------------------------------------------------------------- construction
def members(incidence: DataFrame) -> DataFrame:
    """edge_id, members: sorted distinct nodes."""
    return incidence.groupBy("edge_id").agg(F.sort_array(F.collect_set("node_id")).alias("members"))


def to_incidence(hyperedges: DataFrame) -> DataFrame:
    return hyperedges.select("edge_id", F.explode("members").alias("node_id"))


def merge(hyperedges: DataFrame) -> DataFrame:
    """Hyperedges with the same members become one and their weights add; the smallest edge_id names it."""
    return hyperedges.groupBy(F.array_sort("members").alias("members")).agg(F.min("edge_id").alias("edge_id"), F.sum("weight").alias("weight")).select("edge_id", "members", "weight")


def from_messages(msgs: DataFrame, parts: tuple[str, ...] = ("sender", "recipients"), maxset: int | None = None, focal: int | None = None, mindegree: int = 0) -> DataFrame:
    """edge_id, members, weight from messages: sets of people of at most ``maxset``, without the focal
    person, of two or more; merged; nodes of clique degree under ``mindegree`` taken out in one pass;
    merged again (an edge that is left with one node stays); the largest component of the star expansion, nodes and edges counted."""
    p = msgs.select(F.col("msg_id").alias("edge_id"), people(parts).alias("members"))
    if maxset is not None:
        p = p.filter(F.size("members") <= maxset)
    if focal is not None:
        p = p.withColumn("members", F.array_remove("members", focal))
    h = cut(merge(p.filter(F.size("members") > 1).withColumn("weight", F.lit(1))))
    if mindegree:
        keep = clique_degree(h).filter(F.col("degree") >= mindegree).select("node_id")
        inc = to_incidence(h).join(keep, "node_id", "left_semi")
        h = cut(merge(members(inc).join(h.select("edge_id", "weight"), "edge_id")))
    star = star_expansion(to_incidence(h))
    ends = star.select(F.col("src").alias("id")).distinct()
    comp = cut(connected_components(ends, star))
    size = comp.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    inside = comp.join(F.broadcast(size), "component", "left_semi").filter("id < 0").select((-F.col("id") - 1).alias("edge_id"))  # a single row
    return h.join(inside, "edge_id", "left_semi")


def star_expansion(incidence: DataFrame, n: int | None = None) -> DataFrame:
    """Bipartite edges in both directions; edge e is vertex -e - 1, or n + e if the number of nodes is given."""
    e = -F.col("edge_id") - 1 if n is None else F.col("edge_id") + n
    one = incidence.select(F.col("node_id").alias("src"), e.alias("dst"), F.lit(1).alias("w"))
    return one.union(one.select("dst", "src", "w"))


def unroll(hyperedges: DataFrame) -> DataFrame:
    """A hyperedge of whole weight w becomes w copies, numbered by ``copy``."""
    return hyperedges.select("edge_id", "members", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("copy"))


def clique_projection(hyperedges: DataFrame, weight: str = "raw", most_order: int | None = None) -> DataFrame:
    """Symmetric edges between members. ``weight``: raw (w of each hyperedge), pair (w over the number of pairs),
    order (w over the number of members) or binary. Pairs are made inside each row."""
    k = F.size("members")
    w = {"raw": F.col("weight"), "pair": F.col("weight") * 2.0 / (k * (k - 1)), "order": F.col("weight") / k, "binary": F.lit(1)}[weight]
    h = hyperedges.filter(k > 1)
    if most_order is not None:
        h = h.filter(k <= most_order)
    pairs = h.select(F.posexplode("members").alias("i", "src"), "members", w.alias("w")).select("src", F.explode(F.slice("members", F.lit(1), F.col("i"))).alias("dst"), "w")
    agg = F.max("w") if weight == "binary" else F.sum("w")
    return symmetrise(pairs.groupBy("src", "dst").agg(agg.alias("w")))


def gadget_edges(hyperedges: DataFrame, n: int, delta: float, pair_orders: int = 3) -> DataFrame:
    """Directed edges of the threshold-linear gadgets: order 2, an edge of w each way; order 3 (if
    ``pair_orders`` is 3), all pairs at w / 2; larger, two auxiliary vertices with w in and out and delta * w between.
    Auxiliary ids are n + 2 * rank and one more, by edge_id; orders under 2 vanish."""
    k = F.size("members")
    small = hyperedges.filter((k >= 2) & (k <= pair_orders)).select("members", F.when(k == 2, F.col("weight") * 1.0).otherwise(F.col("weight") / 2.0).alias("w"))
    pairs = small.select(F.explode("members").alias("src"), "members", "w").select("src", F.explode("members").alias("dst"), "w").filter("src <> dst")
    large = global_rank(hyperedges.filter(k > pair_orders), ["edge_id"], "aux").withColumn("aux", F.lit(n) + 2 * (F.col("aux") - 1))
    into = large.select(F.explode("members").alias("src"), F.col("aux").alias("dst"), (F.col("weight") * 1.0).alias("w"))
    out = large.select((F.col("aux") + 1).alias("src"), F.explode("members").alias("dst"), (F.col("weight") * 1.0).alias("w"))
    through = large.select(F.col("aux").alias("src"), (F.col("aux") + 1).alias("dst"), (F.col("weight") * delta).alias("w"))
    return pairs.union(into).union(out).union(through).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def terminal_edges(degrees: DataFrame, seeds: DataFrame, gamma: float, source: int, sink: int) -> DataFrame:
    """Edges from ``source`` to seeds and from the rest to ``sink``, each of gamma * degree."""
    d = degrees.join(seeds.select(F.col("node_id"), F.lit(True).alias("seed")), "node_id", "left")
    w = (F.col("degree") * gamma).alias("w")
    s = d.filter("seed").select(F.lit(source).alias("src"), F.col("node_id").alias("dst"), w)
    return s.union(d.filter("seed is null").select(F.col("node_id").alias("src"), F.lit(sink).alias("dst"), w))


# ------------------------------------------------------------------ measures
def order(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("edge_id").agg(F.count("*").alias("order"))


def node_degree(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("node_id").agg(F.count("*").alias("degree"))


def clique_degree(hyperedges: DataFrame) -> DataFrame:
    """Sum of w * (order - 1) over a node's hyperedges."""
    return hyperedges.select(F.explode("members").alias("node_id"), (F.col("weight") * (F.size("members") - 1)).alias("d")).groupBy("node_id").agg(F.sum("d").alias("degree"))


def tl_cut(incidence: DataFrame, sets: DataFrame, delta: float) -> DataFrame:
    """For each label of ``sets`` (node_id, label): cut (sum of min(inside, outside, delta) over hyperedges),
    vol (degrees inside), cond and ncut. Weights aren't used. One pass over the incidences."""
    inc = incidence.join(order(incidence), "edge_id")
    inside = inc.join(sets, "node_id").groupBy("label", "edge_id").agg(F.count("*").alias("k"), F.first("order").alias("order"))
    by = inside.groupBy("label").agg(F.sum(F.least("k", F.col("order") - F.col("k"), F.lit(delta))).alias("cut"), F.sum("k").alias("vol"))
    total = incidence.agg(F.count("*").alias("total"))
    rest = F.col("total") - F.col("vol")
    return by.join(F.broadcast(total)).select("label", "cut", "vol", F.when(F.least("vol", rest) > 0, F.col("cut") / F.least("vol", rest)).alias("cond"), F.when((F.col("vol") > 0) & (rest > 0), F.col("cut") / F.col("vol") + F.col("cut") / rest).alias("ncut"))  # a single row


def all_or_nothing_cut(incidence: DataFrame, sets: DataFrame) -> DataFrame:
    return tl_cut(incidence, sets, 1.0)


def local_conductance(incidence: DataFrame, seeds: DataFrame, members_: DataFrame, delta: float, eps: float) -> DataFrame:
    """cut / ((1 + eps) vol(seeds in S) - eps vol(S)) of one set S (node_id); null where that isn't positive."""
    c = tl_cut(incidence, members_.select("node_id", F.lit(0).alias("label")), delta).select("cut", "vol")
    inner = incidence.join(members_.join(seeds, "node_id", "left_semi"), "node_id", "left_semi").agg(F.count("*").alias("vrs"))
    base = (1 + eps) * F.col("vrs") - eps * F.col("vol")
    return c.join(inner).select("cut", "vol", F.when(base > 0, F.col("cut") / base).alias("lcond"))  # one row each


def sweep_profile(incidence: DataFrame, scores: DataFrame, delta: float, least: int = 0) -> DataFrame:
    """rank, node_id, vol, cut, cond of each prefix of ``scores`` (node_id, score; top first, ties by id; zeros end it) of
    ``least`` nodes or more.

    Inside a hyperedge the j-th arrival moves min(j, order - j, delta) by a known step; steps add up
    by rank and one running sum gives the cut of all prefixes."""
    ranked = cut(global_rank(scores.filter("score > 0").select("node_id", "score"), [F.desc("score"), F.asc("node_id")]))
    total = incidence.count()
    arrive = incidence.join(ranked.select("node_id", "rank"), "node_id").join(order(incidence), "edge_id")
    j = F.row_number().over(Window.partitionBy("edge_id").orderBy("rank"))
    a = arrive.withColumn("j", j)
    pen = lambda k: F.least(k, F.col("order") - k, F.lit(delta))
    steps = a.groupBy("rank").agg(F.sum(pen(F.col("j")) - pen(F.col("j") - 1)).alias("d"), F.count("*").alias("dv"))
    rows = ranked.join(steps, "rank", "left").select("rank", "node_id", F.coalesce("dv", F.lit(0)).alias("dv"), F.coalesce("d", F.lit(0.0)).alias("d"))
    rows = running_sums(rows, {"vol": "dv", "cut": "d"}).select("rank", "node_id", "vol", "cut")
    smaller = F.least("vol", F.lit(total) - F.col("vol"))
    return rows.withColumn("cond", F.when(smaller > 0, F.col("cut") / smaller)).filter(F.col("rank") >= least)


# -------------------------------------------------------------- neighbourhoods
def neighbours(incidence: DataFrame, seeds: DataFrame, most_order: int | None = None, with_seeds: bool = False) -> DataFrame:
    """node_id of all that share a hyperedge (of at most ``most_order`` nodes) with ``seeds``, with or without the seeds."""
    inc = incidence
    if most_order is not None:
        inc = inc.join(order(inc).filter(F.col("order") <= most_order), "edge_id", "left_semi")
    touched = inc.join(seeds, "node_id", "left_semi").select("edge_id").distinct()
    near = inc.join(touched, "edge_id", "left_semi").select("node_id").distinct()
    return near if with_seeds else near.join(seeds, "node_id", "left_anti")


def neighbour_lists(incidence: DataFrame) -> DataFrame:
    """node_id, neighbours: sorted distinct co-members."""
    a, b = incidence.select("edge_id", "node_id"), incidence.select("edge_id", F.col("node_id").alias("other"))
    return a.join(b, "edge_id").filter("node_id <> other").groupBy("node_id").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def grow(incidence: DataFrame, seeds: DataFrame, k: int, best: bool = False) -> DataFrame:
    """Seeds and the k nodes that most of the seeds' hyperedges touch (``best``: as a share of their own degree)."""
    touched = incidence.join(seeds, "node_id", "left_semi").select("edge_id").distinct()
    hits = incidence.join(touched, "edge_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("hits"))
    score = hits.join(node_degree(incidence), "node_id").select("node_id", (F.col("hits") / F.col("degree") if best else F.col("hits").cast("double")).alias("score"))
    top = score.join(seeds, "node_id", "left_anti").orderBy(F.desc("score"), "node_id").limit(k).select("node_id")
    return seeds.select("node_id").union(top)
