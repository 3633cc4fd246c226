"""Graphs from messages, and what is asked of weighted graphs.

Messages: msg_id, thread, pos (1 = newest), ts, sender, recipients, cc. Edges:
src, dst, w; undirected graphs store both directions and loops once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import connected_components, cut, global_rank, running_sums


# --------------------------------------------------------------- construction
def others(keepcc: bool) -> Column:
    """Recipients, and after them cc: not deduplicated."""
    return F.concat("recipients", "cc") if keepcc else F.col("recipients")


def people(parts: tuple[str, ...] = ("sender", "recipients", "cc")) -> Column:
    """Distinct people of a message, the sender among them if asked for."""
    return F.array_sort(F.array_distinct(F.concat(*[F.array(p) if p == "sender" else F.col(p) for p in parts])))


def to_from_edges(msgs: DataFrame, keepcc: bool = False, maxset: int | None = None, focal: int | None = None, fractional: bool = False) -> DataFrame:
    """Directed edges from the sender to each of the others, of messages with at most ``maxset`` others.
    Weight 1, or 1 / (number of others, the focal person counted); edges at ``focal`` are dropped."""
    seen = msgs.select("sender", others(keepcc).alias("to"))
    if maxset is not None:
        seen = seen.filter(F.size("to") <= maxset)  # before the explode: Catalyst won't move it there
    w = F.lit(1.0) / F.size("to") if fractional else F.lit(1)
    edges = seen.select(F.col("sender").alias("src"), F.explode("to").alias("dst"), w.alias("w"))
    if focal is not None:
        edges = edges.filter((F.col("src") != focal) & (F.col("dst") != focal))
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def replied_to_edges(msgs: DataFrame, focal: int | None = None) -> DataFrame:
    """Edge from the sender of an older message to the sender of a newer one in the same thread that
    was addressed or copied to them. The membership test is an equi-join on (thread, person)."""
    newer = msgs.select("thread", F.col("pos").alias("new"), F.col("sender").alias("dst"), F.explode(F.array_distinct(F.concat("recipients", "cc"))).alias("src"))
    older = msgs.select("thread", F.col("pos").alias("old"), F.col("sender").alias("src"))
    edges = newer.join(older, ["thread", "src"]).filter("old > new")
    if focal is not None:
        edges = edges.filter((F.col("src") != focal) & (F.col("dst") != focal))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("w"))


def projection_edges(msgs: DataFrame, parts: tuple[str, ...] = ("sender", "recipients"), maxset: int | None = None, focal: int | None = None, fractional: bool = False) -> DataFrame:
    """Pairs src > dst of people who share a message: one triangle. Pairs are made inside the row, without a shuffle."""
    seen = msgs.select(people(parts).alias("p"))
    if maxset is not None:
        seen = seen.filter(F.size("p") <= maxset)
    w = F.lit(2.0) / (F.size("p") * (F.size("p") - 1)) if fractional else F.lit(1)
    seen = seen.filter(F.size("p") > 1).select("p", w.alias("w"))
    edges = seen.select(F.posexplode("p").alias("i", "src"), "p", "w").select("src", F.explode(F.slice("p", F.lit(1), F.col("i"))).alias("dst"), "w")
    if focal is not None:
        edges = edges.filter((F.col("src") != focal) & (F.col("dst") != focal))
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def symmetrise(edges: DataFrame, how: str = "max") -> DataFrame:
    """Elementwise max, min (of pairs that go both ways) or sum with the transpose."""
    swap = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    if how == "min":
        return edges.join(swap.withColumnRenamed("w", "v"), ["src", "dst"]).select("src", "dst", F.least("w", "v").alias("w"))
    agg = F.max("w") if how == "max" else F.sum("w")
    return edges.select("src", "dst", "w").union(swap).groupBy("src", "dst").agg(agg.alias("w")).filter("w <> 0")


def drop_small(edges: DataFrame, tol: float) -> DataFrame:
    """Entries over ``tol`` in size."""
    return edges.filter(F.abs("w") > tol)


def simple(edges: DataFrame) -> DataFrame:
    """Without loops and zeros, all weights 1."""
    return edges.filter("src <> dst and w <> 0").select("src", "dst", F.lit(1).alias("w"))


def upper(edges: DataFrame) -> DataFrame:
    return edges.filter("src < dst")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in ``members`` (id)."""
    return edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def compact(members: DataFrame) -> DataFrame:
    """id, new_id: dense numbers from 0 in the order of ids."""
    return global_rank(members.select("id"), ["id"], "new_id").withColumn("new_id", F.col("new_id") - 1)


def min_degree(edges: DataFrame, least: int, weighted: bool = False) -> DataFrame:
    """One pass, not a core: edges among vertices whose degree (entries, loops once; or weight) is at least ``least``."""
    degree = edges.groupBy("src").agg((F.sum("w") if weighted else F.count("*")).alias("d"))
    return induced(edges, degree.filter(F.col("d") >= least).select(F.col("src").alias("id")))


def largest_component(edges: DataFrame) -> DataFrame:
    """id of the largest connected component of the vertices that have edges; ties go to the smallest id."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    comp = connected_components(ends, edges)
    sizes = comp.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return comp.join(F.broadcast(sizes), "component", "left_semi").select("id")  # a single row


def min_degree_component(edges: DataFrame, least: int) -> DataFrame:
    kept = cut(min_degree(edges, least) if least else edges)
    return induced(kept, largest_component(kept))


def outside_component(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(largest_component(edges), "id", "left_anti")


def graph_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b elementwise, without zeros."""
    both = a.select("src", "dst", "w").union(b.select("src", "dst", (-F.col("w")).alias("w")))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w <> 0")


def realign(edges: DataFrame, names: DataFrame, onto: DataFrame) -> DataFrame:
    """Edges under the ids of ``onto`` (id, name), where both ends' names of ``names`` (id, name) are there."""
    move = names.join(onto.select("name", F.col("id").alias("new")), "name").select("id", "new")
    a = edges.join(move.select(F.col("id").alias("src"), F.col("new").alias("s")), "src")
    return a.join(move.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def first_by_prefix(names: DataFrame, prefix: str) -> int:
    """The smallest id whose name begins with ``prefix``; an error if there is none."""
    found = names.filter(F.col("name").startswith(prefix)).agg(F.min("id")).first()[0]
    if found is None:
        raise KeyError(prefix)
    return found


def densify_groups(groups: DataFrame, degree: float, seed: int = 0) -> DataFrame:
    """Random pairs inside each group of ``groups`` (id, label), ``degree`` a vertex on average, for layouts.
    Each vertex draws its partners' ranks, so the work is by vertices and not by pairs."""
    ranked = groups.withColumns({"r": F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1, "n": F.count("*").over(Window.partitionBy("label"))})
    tries = F.transform(F.sequence(F.lit(1), F.lit(max(1, round(degree / 2)))), lambda k: F.pmod(F.xxhash64("id", k, F.lit(seed)), F.col("n")))
    drawn = ranked.filter("n > 1").select(F.col("id").alias("src"), "label", F.explode(F.array_distinct(tries)).alias("r"))
    return drawn.join(ranked.select("label", F.col("r").cast("long").alias("r"), F.col("id").alias("dst")), ["label", "r"]).filter("src <> dst").select("src", "dst", F.lit(1).alias("w"))


# ------------------------------------------------------------------- measures
def weighted_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("degree"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_stats(vertices: DataFrame, degrees: DataFrame) -> DataFrame:
    """max, mean and exact median over all vertices; one without edges has degree 0."""
    d = F.coalesce("degree", F.lit(0))
    return vertices.select("id").join(degrees, "id", "left").agg(F.max(d).alias("max_degree"), F.avg(d).alias("mean_degree"), F.median(d).alias("median_degree"))


def graph_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """n, edges (undirected, no loops), loops, volume, loop volume and degree statistics, simple and weighted."""
    loop = F.col("src") == F.col("dst")
    sums = edges.agg((F.count(F.when(~loop, 1)) / 2).cast("long").alias("edges"), F.count(F.when(loop, 1)).alias("loops"), F.coalesce(F.sum("w"), F.lit(0)).alias("volume"), F.coalesce(F.sum(F.when(loop, F.col("w"))), F.lit(0)).alias("loop_volume"))
    plain = degree_stats(vertices, degree(simple(edges)))
    heavy = degree_stats(vertices, weighted_degree(edges)).toDF("max_weighted", "mean_weighted", "median_weighted")
    n = vertices.agg(F.count("*").alias("n"))
    return n.join(sums).join(plain).join(heavy)  # one row each


def set_stats(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """For each label of ``sets`` (id, label): vol, edges (inside, both directions), cut, cond, ncut,
    scaled_ncut, sparsity and expansion, in one pass over the edges."""
    a = sets.select(F.col("id").alias("src"), F.col("label").alias("ls"))
    b = sets.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    total = edges.agg(F.sum("w").alias("total"))
    sizes = sets.groupBy("label").agg(F.count("*").alias("size"))
    n = sets.agg(F.count("*").alias("n"))
    by = edges.join(a, "src").join(b, "dst", "left").groupBy(F.col("ls").alias("label")).agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0)).alias("edges"))
    s = by.join(sizes, "label").join(F.broadcast(total)).join(F.broadcast(n)).withColumn("cut", F.col("vol") - F.col("edges"))  # one row each
    rest = F.col("total") - F.col("vol")
    safe = lambda x, y: F.when(y > 0, x / y)
    return s.select("label", "size", "vol", "edges", "cut", safe(F.col("cut"), F.least("vol", rest)).alias("cond"), (safe(F.col("cut"), F.col("vol")) + safe(F.col("cut"), rest)).alias("ncut"), safe(F.col("cut"), F.col("vol") * rest).alias("scaled_ncut"), safe(F.col("cut"), F.col("size") * (F.col("n") - F.col("size"))).alias("sparsity"), safe(F.col("cut"), F.least("size", F.col("n") - F.col("size"))).alias("expansion"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Sum over clusters (id, label) of inside / V - (vol / V)**2: sums only, never a matrix of all pairs."""
    total = edges.agg(F.sum("w").alias("v"))
    by = set_stats(edges, clusters).select("vol", "edges")
    return by.join(F.broadcast(total)).agg(F.sum(F.col("edges") / F.col("v") - F.pow(F.col("vol") / F.col("v"), F.lit(2))).alias("modularity"))


def min_scaled_ncut(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    return set_stats(edges, clusters).filter("scaled_ncut is not null").orderBy("scaled_ncut", "label").limit(1).select("label", "scaled_ncut")


def cut_edges(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges src < dst whose ends have different labels."""
    a = sets.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = sets.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return upper(edges).join(a, "src").join(b, "dst").filter("src_label <> dst_label").select("src", "dst", "w", "src_label", "dst_label")


def khop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """id, hop (least number of edges, up to k) of what ``seeds`` (id) reach; only the frontier is joined."""
    seen = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    frontier = seen
    for hop in range(1, k + 1):
        near = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(near.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
    return seen


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triangles of one triple of buckets: its edges (role 0: low to middle, 1: low to high, 2: middle to high), wedges in blocks."""
    t = pa.Table.from_batches(list(batches))
    role, u, v = (t[c].to_numpy() for c in ("role", "src", "dst"))
    (x1, y1), (x2, z2), (y3, z3) = ((u[role == k], v[role == k]) for k in range(3))
    ys, zs = np.unique(y3), np.unique(z3)
    if not len(ys):
        return
    known = lambda ids, x: ids[np.minimum(np.searchsorted(ids, x), len(ids) - 1)] == x
    x1, y1 = (c[known(ys, y1)] for c in (x1, y1))
    x2, z2 = (c[known(zs, z2)] for c in (x2, z2))
    x2, z2 = (c[np.argsort(x2, kind="stable")] for c in (x2, z2))
    first, last = np.searchsorted(x2, x1, "left"), np.searchsorted(x2, x1, "right")
    yi, zi, keys = np.searchsorted(ys, y1), np.searchsorted(zs, z2), np.searchsorted(ys, y3) * len(zs) + np.searchsorted(zs, z3)
    table = None
    if len(ys) * len(zs) <= 1 << 28:
        table = np.zeros(len(ys) * len(zs), bool)
        table[keys] = True
    else:
        keys.sort()
    ends = np.cumsum(last - first)
    at = 0
    while at < len(x1):  # as many edges as make about four million wedges
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), "right")))
        size = (last - first)[at:to]
        e = np.repeat(np.arange(at, to), size)
        w = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size) + first[e]
        k = yi[e] * len(zs) + zi[w]
        hit = table[k] if table is not None else keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k
        if hit.any():
            abc = np.sort(np.stack([x1[e[hit]], y1[e[hit]], z2[w[hit]]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in abc], ["a", "b", "c"])
        at = to


def triangles(edges: DataFrame, each: int = 4_000_000) -> DataFrame:
    """a, b, c of each triangle of a simple graph: wedges lead from the end of smaller (degree, id), so hubs don't square.

    No wedge is shuffled: vertices are dealt into buckets, each edge goes to the triples of buckets that it can close a triangle in, and
    a triple's wedges are made and tested where its edges (about ``each``) are. What is shuffled grows with edges to the power 1.5."""
    e = cut(simple(edges).select(F.col("src").cast("long"), F.col("dst").cast("long")))
    buckets = max(2, math.ceil(math.sqrt(3 * e.count() / 2 / each)))
    d = cut(degree(e))
    e = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    out = e.filter("ds < dd or (ds = dd and src < dst)").select("src", "dst")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    p, q = bucket("src"), bucket("dst")
    place = lambda role, x, y, z: F.struct(F.lit(role).cast("byte").alias("role"), ((x * buckets + y) * buckets + z).cast("int").alias("part"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    places = F.concat(F.transform(every, lambda o: place(0, p, q, o)), F.transform(every, lambda o: place(1, p, o, q)), F.transform(every, lambda o: place(2, o, p, q)))
    dealt = out.select("src", "dst", F.explode(places).alias("at")).select("at.part", "at.role", "src", "dst")
    kind = dict(edges.dtypes)["src"]
    found = dealt.repartition(buckets**3, "part").groupBy("part").applyInArrow(_closed, "a long, b long, c long")
    return found.select(*[F.col(c).cast(kind) for c in "abc"])


def bad_triangles(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """a, b, c of signed edges (src < dst, w): two positive sides and a negative one."""
    s = edges.filter("src < dst").select("src", "dst", F.signum("w").cast("int").alias("s"))
    x = s.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("s").alias("s1"))
    y = s.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("s").alias("s2"))
    z = s.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("s").alias("s3"))
    return x.join(y, "b").join(z, ["a", "c"]).filter("s1 + s2 + s3 = 1").select("a", "b", "c")


def triangle_violations(distance: DataFrame, eps: float = 1e-8) -> DataFrame:
    """i, j, k (i < j) with d(i,j) > d(i,k) + d(j,k) + eps of a symmetric table src, dst, d."""
    d = distance.select("src", "dst", "d").union(distance.select("dst", "src", "d")).distinct()
    a = d.select(F.col("src").alias("k"), F.col("dst").alias("i"), F.col("d").alias("x"))
    b = d.select(F.col("src").alias("k"), F.col("dst").alias("j"), F.col("d").alias("y"))
    c = d.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("d").alias("z"))
    return a.join(b, "k").filter("i < j").join(c, ["i", "j"]).filter(F.col("z") > F.col("x") + F.col("y") + eps).select("i", "j", "k")


def clusters_from_distances(vertices: DataFrame, distance: DataFrame) -> DataFrame:
    """Components of pairs closer than 0.01 as clusters."""
    return connected_components(vertices, distance.filter("d < 0.01")).select("id", F.col("component").alias("label"))


def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 50, tol: float | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """id, rank by power iteration: along edge weights, with a uniform (or seeded) restart, which dangling vertices follow too."""
    n = vertices.count()
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    flow = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    if seeds is None:
        base = cut(vertices.select("id", F.lit(1.0 / n).alias("v")))
    else:
        k = seeds.select("id").distinct().count()
        base = cut(vertices.select("id").join(seeds.select("id").distinct().withColumn("s", F.lit(1.0 / k)), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("v")))
    rank = base.select("id", F.col("v").alias("rank"))
    for turn in range(rounds):
        moved = flow.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("m"))
        joined = base.join(moved, "id", "left").select("id", "v", F.coalesce("m", F.lit(0.0)).alias("m"))
        total = joined.agg(F.sum("m").alias("t"))
        new = joined.join(F.broadcast(total)).select("id", (alpha * F.col("m") + F.col("v") * (1 - alpha * F.col("t"))).alias("rank"))  # one row
        if turn % 2 or turn == rounds - 1:
            new = cut(new)
            if tol and rank.join(new.withColumnRenamed("rank", "r"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("r")))).first()[0] < tol:
                return new
        rank = new
    if tol:
        raise RuntimeError(f"ranks still move after {rounds} rounds")
    return rank


def sweep_profile(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """rank, id, vol, cut, cond of each prefix of ``scores`` (id, score) from the top (ties by id).

    An edge is cut for the prefixes between its ends' ranks, so it adds at one and
    takes off at the other, and a running sum over ranks gives all cuts at once."""
    ranked = cut(global_rank(scores.select("id", "score"), [F.desc("score"), F.asc("id")]))
    total = edges.agg(F.sum("w")).first()[0]
    last = F.lit(1 << 62)
    r = edges.join(ranked.select(F.col("id").alias("src"), F.col("rank").alias("rs")), "src", "left").join(ranked.select(F.col("id").alias("dst"), F.col("rank").alias("rd")), "dst", "left")
    both = r.filter("src <> dst").select("w", F.coalesce("rs", last).alias("rs"), F.coalesce("rd", last).alias("rd"))
    one = both.filter("rs < rd")  # both directions are stored: count one of them
    events = one.select(F.col("rs").alias("rank"), F.col("w").alias("d")).union(one.filter(F.col("rd") < last).select("rd", -F.col("w"))).groupBy("rank").agg(F.sum("d").alias("d"))
    vol = edges.groupBy("src").agg(F.sum("w").alias("dv"))
    rows = ranked.join(events, "rank", "left").join(vol.withColumnRenamed("src", "id"), "id", "left")
    rows = running_sums(rows.select("rank", "id", F.coalesce("dv", F.lit(0)).alias("dv"), F.coalesce("d", F.lit(0)).alias("d")), {"vol": "dv", "cut": "d"}).select("rank", "id", "vol", "cut")
    least = F.least("vol", F.lit(total) - F.col("vol"))
    return rows.withColumn("cond", F.when(least > 0, F.col("cut") / least))


def best_sweep(profile: DataFrame, later_ties: bool = True) -> DataFrame:
    """The prefix of least conductance (the later of equals, as for graphs, or the earlier) as one row."""
    return profile.filter("cond is not null").orderBy("cond", F.desc("rank") if later_ties else "rank").limit(1)


def ranking(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Add ``rank`` by descending score, ties by id; or only the top ``k``, without a window over all."""
    if k is not None:
        return scores.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows
    return global_rank(scores, [F.desc("score"), F.asc("id")])
