"""Messages and graphs over days."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import symmetrise
from .iterate import cut


def deduplicate(msgs: DataFrame) -> DataFrame:
    """One message of each exact second, sender, list of recipients and list of cc (order counts): the first by thread and position."""
    key = [F.date_trunc("second", "ts").alias("_s"), "sender", "recipients", "cc"]
    first = msgs.groupBy(*key).agg(F.min(F.struct("thread", "pos", "msg_id")).alias("_f"))
    return msgs.join(first.select(F.col("_f.msg_id").alias("msg_id")).distinct(), "msg_id", "left_semi")


def duplicate_count(msgs: DataFrame) -> DataFrame:
    groups = msgs.groupBy(F.date_trunc("second", "ts"), "sender", "recipients", "cc").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def day_edges(msgs: DataFrame, keepcc: bool = True, fractional: bool = False, duplicates: bool = False, focal: int | None = None) -> DataFrame:
    """day, src, dst, w: directed, a slice for each day that has messages."""
    seen = msgs if duplicates else deduplicate(msgs)
    to = F.concat("recipients", "cc") if keepcc else F.col("recipients")
    w = F.lit(1.0) / F.size("_to") if fractional else F.lit(1)
    e = seen.select(F.to_date("ts").alias("day"), F.col("sender").alias("src"), to.alias("_to")).select("day", "src", F.explode("_to").alias("dst"), w.alias("w"))
    if focal is not None:
        e = e.filter((F.col("src") != focal) & (F.col("dst") != focal))
    return e.groupBy("day", "src", "dst").agg(F.sum("w").alias("w"))


def all_days(tedges: DataFrame) -> DataFrame:
    """Every calendar day from the first slice to the last, for those who keep empty ones."""
    return tedges.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))


def collapse(tedges: DataFrame, symmetric: bool = True) -> DataFrame:
    flat = tedges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return symmetrise(flat) if symmetric else flat


def first_last_active(tedges: DataFrame, linger: int = 7) -> DataFrame:
    """id, first_slice, last_slice (by number of the slice, from 0) and masked_from: where it counts as gone."""
    days = tedges.select("day").distinct().withColumn("slice", F.row_number().over(Window.orderBy("day")) - 1)  # a row a day
    seen = tedges.select("day", F.col("src").alias("id")).union(tedges.select("day", F.col("dst").alias("id"))).join(F.broadcast(days), "day")
    return seen.groupBy("id").agg(F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice")).withColumn("masked_from", F.col("last_slice") + linger)


def entries_per_node(tedges: DataFrame) -> DataFrame:
    """day, id, entries: stored entries of the day's symmetric matrix in a node's row."""
    both = tedges.select("day", "src", "dst").union(tedges.select("day", "dst", "src")).distinct()
    return both.groupBy("day", F.col("src").alias("id")).agg(F.count("*").alias("entries"))


def reachability(tedges: DataFrame, vertices: DataFrame, same_day: bool = False) -> DataFrame:
    """src, dst where a path of edges on strictly later and later days leads from src to dst (and src = dst).

    Days run backwards. On a day, who writes to j gains all that j could reach before that day; edges of
    one day don't chain, but with ``same_day`` a day's strongly connected components of more than two reach alike.
    A step joins only the day's edges, only new pairs are added, and history is cut, since each step reads the pairs twice."""
    days = [r.day for r in tedges.select("day").distinct().orderBy(F.desc("day")).collect()]  # a row a day
    reach = vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    tedges = cut(tedges.select("day", "src", "dst").distinct())
    parts = None
    if same_day:
        from .bounded import strong_components

        parts = strong_components(tedges)
        big = parts.groupBy("day", "component").agg(F.count("*").alias("n")).filter("n > 2")
        parts = cut(parts.join(big, ["day", "component"], "left_semi"))
    for day in days:
        e = tedges.filter(F.col("day") == F.lit(day)).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        gained = e.join(reach, e.b == reach.src).select(F.col("a").alias("src"), "dst").distinct()
        reach = cut(reach.union(gained.join(reach, ["src", "dst"], "left_anti")))
        if parts is not None:  # all of a component reach what one of them reaches
            own = parts.filter(F.col("day") == F.lit(day)).select("id", "component")
            theirs = reach.join(own, reach.src == own.id).select("component", "dst").distinct()
            alike = own.join(theirs, "component").select(F.col("id").alias("src"), "dst")
            reach = cut(reach.union(alike).distinct())
    return reach


def multislice(tedges: DataFrame, gamma: float = 1.0, omega: float = 0.5) -> DataFrame:
    """t1, i, t2, j, w of the multislice modularity matrix: symmetric slices less gamma * k k' / 2m, and omega to
    the same node in neighbouring slices. All pairs of a slice's active nodes: for small slices; kernels take the factors."""
    days = tedges.select("day").distinct().withColumn("t", F.row_number().over(Window.orderBy("day")) - 1)  # a row a day
    flat = tedges.join(F.broadcast(days), "day").select("t", "src", "dst", "w")
    swap = flat.select("t", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    s = flat.union(swap).groupBy("t", "src", "dst").agg(F.max("w").alias("w"))
    k = s.groupBy("t", F.col("src").alias("i")).agg(F.sum("w").alias("k"))
    m2 = k.groupBy("t").agg(F.sum("k").alias("m2"))
    null = k.join(k.select("t", F.col("i").alias("j"), F.col("k").alias("kj")), "t").join(m2, "t").select("t", "i", "j", (-gamma * F.col("k") * F.col("kj") / F.col("m2")).alias("w"))
    inside = s.select("t", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("w")).union(null).groupBy("t", "i", "j").agg(F.sum("w").alias("w"))
    nodes = tedges.select(F.col("src").alias("i")).union(tedges.select("dst")).distinct()
    span = days.select("t")
    near = span.select(F.col("t").alias("t1")).join(span.select(F.col("t").alias("t2"))).filter("abs(t1 - t2) = 1")
    link = nodes.join(F.broadcast(near)).select("t1", "i", "t2", F.col("i").alias("j"), F.lit(float(omega)).alias("w"))  # two rows a day
    return inside.select(F.col("t").alias("t1"), "i", F.col("t").alias("t2"), "j", "w").union(link)


def communicability(tedges: DataFrame, vertices: DataFrame, a: float = 0.02, tol: float = 1e-10, most: int = 500) -> DataFrame:
    """id, broadcast, receive: row and column sums of the product of (I - a A_t)^-1 over ascending days.

    Only vectors are carried, and all days move together: the value of a vertex at a day is 1 and what edges brought it on that
    day and those before (receive; for broadcast after, against the edges), so a round is one join and one running sum a vertex, and
    the number of rounds doesn't depend on that of days. Raises where a times a day's largest degree isn't under 1 (the
    inverses are no series then), or if ``most`` rounds leave a value that moves by more than ``tol`` of itself."""
    tedges = cut(tedges.select(F.datediff("day", F.lit("1970-01-01").cast("date")).alias("t"), "src", "dst", "w"))
    degrees = [tedges.groupBy("t", side).agg(F.sum("w").alias("d")).agg(F.max("d")).first()[0] or 0 for side in ("src", "dst")]
    if a * min(degrees) >= 1:
        raise ValueError(f"a = {a} times a day's largest degree, {min(degrees)}, isn't under 1")
    w = (F.col("w") * a).cast("double").alias("w")
    there = tedges.select(F.lit("broadcast").alias("way"), (-F.col("t")).alias("t"), F.col("dst").alias("at"), F.col("src").alias("to"), w)
    back = tedges.select(F.lit("receive").alias("way"), "t", F.col("src").alias("at"), F.col("dst").alias("to"), w)
    arcs = cut(there.union(back))
    asked = cut(arcs.select("way", "t", F.col("at").alias("id")).distinct())
    value = asked.withColumn("v", F.lit(1.0))
    gained = None
    for turn in range(most):
        gained = arcs.join(value.withColumnRenamed("id", "at"), ["way", "t", "at"]).groupBy("way", "t", F.col("to").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("m"))
        both = gained.withColumn("v", F.lit(None).cast("double")).unionByName(value.withColumn("m", F.lit(None).cast("double")))
        so_far = Window.partitionBy("way", "id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
        new = cut(both.withColumn("new", F.lit(1.0) + F.coalesce(F.sum("m").over(so_far), F.lit(0.0))).filter("v is not null").select("way", "t", "id", "v", "new"))
        moved = new.agg(F.max(F.abs(F.col("new") - F.col("v")) / F.col("new"))).first()[0] or 0.0
        value = new.select("way", "t", "id", F.col("new").alias("v"))
        if moved <= tol:
            break
    else:
        raise RuntimeError(f"values still move after {most} rounds")
    total = arcs.join(value.withColumnRenamed("id", "at"), ["way", "t", "at"]).groupBy(F.col("to").alias("id")).agg(*[F.sum(F.when(F.col("way") == x, F.col("w") * F.col("v"))).alias(x) for x in ("broadcast", "receive")])
    return vertices.select("id").join(total, "id", "left").select("id", *[(1.0 + F.coalesce(x, F.lit(0.0))).alias(x) for x in ("broadcast", "receive")])


def trailing_sum(values: DataFrame, keys: list[str], days: int = 7, decay: float | None = None) -> DataFrame:
    """keys, day, total: the sum of ``v`` over each day and the days - 1 before it, on every day of a key's reach;
    with ``decay``, a day's weight falls by that factor for each day that has passed."""
    spread = values.select(*keys, F.col("day").alias("_from"), "v", F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day"))
    w = F.col("v") if decay is None else F.col("v") * F.pow(F.lit(float(decay)), F.datediff("day", "_from"))
    last = values.agg(F.max("day").alias("_last"))
    return spread.join(F.broadcast(last)).filter("day <= _last").groupBy(*keys, "day").agg(F.sum(w).alias("total"))  # a single row


def _forgetful(gamma: float, tol: float):
    """A function over batches of (src, dst, t, w) sorted by them: f at each row, where what is at most ``tol`` after a slice is forgotten."""

    def fold(batches):
        pair, t0, f = None, 0, 0.0
        for pdf in batches:
            out = []
            for src, dst, t, w in zip(pdf["src"], pdf["dst"], pdf["t"], pdf["w"], strict=True):
                if (src, dst) != pair:
                    pair, f = (src, dst), 0.0
                elif t - t0 > 1 and abs(f := f * gamma ** (t - t0 - 1)) <= tol:
                    f = 0.0
                f = gamma * f + w
                f, t0 = (f if abs(f) > tol else 0.0), t
                out.append(f)
            yield pdf[["src", "dst", "t"]].assign(f=out)

    return fold


def fading_memory(tedges: DataFrame, gamma: float = 0.5, tol: float = 0.0, calendar: bool = False) -> DataFrame:
    """day, src, dst, f: memory f = gamma * f + w over consecutive slices (``calendar``: over all days from first to last), entries at
    most ``tol`` forgotten (0 < gamma < 1).

    Without forgetting, f at a pair's own slices is a running sum of w * gamma^-t, in spans of slices short enough for doubles; what
    an earlier span brought is added once. With it, rows sorted by pair and slice are folded one after the other. Between a
    pair's own slices f falls by gamma a slice, so rows in between are powers of it, as many as stay over ``tol``."""
    slices = all_days(tedges) if calendar else tedges.select("day").distinct()
    days = slices.withColumn("t", F.row_number().over(Window.orderBy("day")) - 1)  # a row a day
    last = days.agg(F.max("t").alias("last"))
    seen = tedges.join(F.broadcast(days), "day").groupBy("src", "dst", "t").agg(F.sum(F.col("w").cast("double")).alias("w"))
    g = F.lit(float(gamma))
    if tol > 0:
        kinds = dict(seen.dtypes)
        at = seen.repartition("src", "dst").sortWithinPartitions("src", "dst", "t").mapInPandas(_forgetful(gamma, tol), f"src {kinds['src']}, dst {kinds['dst']}, t int, f double")
    else:
        span = max(1, int(200 * math.log(2) / -math.log(gamma)))  # gamma^-span is 2^200
        scaled = seen.withColumn("_b", F.floor(F.col("t") / span)).withColumn("_s", F.col("w") * F.pow(1 / g, F.col("t") - F.col("_b") * span))
        run = scaled.withColumn("_r", F.sum("_s").over(Window.partitionBy("src", "dst", "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
        # a span's end at the base of the next one; what comes from further back is under the precision of doubles
        carried = run.groupBy("src", "dst", (F.col("_b") + 1).alias("_b")).agg((F.max_by("_r", "t") * F.pow(g, F.lit(span))).alias("_c"))
        at = run.join(carried, ["src", "dst", "_b"], "left").select("src", "dst", "t", ((F.coalesce("_c", F.lit(0.0)) + F.col("_r")) * F.pow(g, F.col("t") - F.col("_b") * span)).alias("f"))
    reach = at.withColumn("_next", F.lead("t").over(Window.partitionBy("src", "dst").orderBy("t"))).join(F.broadcast(last))  # a single row
    to = F.coalesce(F.col("_next") - 1, F.col("last"))
    if tol > 0:
        to = F.least(to, F.col("t") + F.greatest(F.ceil(F.log(F.lit(tol) / F.abs("f")) / math.log(gamma)), F.lit(0)).cast("int"))
    rows = reach.filter("f <> 0").withColumn("_d", F.explode(F.sequence(F.lit(0), (to - F.col("t")).cast("int"))))
    rows = rows.select("src", "dst", (F.col("t") + F.col("_d")).alias("t"), (F.col("f") * F.pow(g, F.col("_d"))).alias("f"))
    return rows.filter(F.abs("f") > tol).join(F.broadcast(days), "t").select("day", "src", "dst", "f")


def as_of(frames: DataFrame, slices: DataFrame) -> DataFrame:
    """frame, slice: the latest slice date at or before each frame date, by one union and a running maximum per month and over months."""
    u = frames.select(F.col("frame").alias("d"), F.lit(1).alias("is_frame")).union(slices.select("slice", F.lit(0)))
    u = u.withColumn("month", F.date_trunc("month", "d"))
    s = F.when(F.col("is_frame") == 0, F.col("d"))
    inside = F.max(s).over(Window.partitionBy("month").orderBy("d", "is_frame").rowsBetween(Window.unboundedPreceding, 0))
    months = u.groupBy("month").agg(F.max(s).alias("m"))
    before = months.select("month", F.max("m").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row a month
    return u.withColumn("own", inside).join(before, "month").filter("is_frame = 1").select(F.col("d").alias("frame"), F.coalesce("own", "carried").alias("slice"))


def person_days(msgs: DataFrame, person: int, start: str, end: str) -> DataFrame:
    """Messages of a person from ``start`` to midnight at the beginning of ``end``."""
    who = F.array_contains(F.concat(F.array("sender"), "recipients", "cc"), person)
    return msgs.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")) & who)


def drop_single_link(tedges: DataFrame, node: int, skip: int = 2) -> DataFrame:
    """Without persons whose collapsed link to ``node`` weighs exactly 1, and without the first ``skip`` slices."""
    flat = collapse(tedges)
    weak = flat.filter((F.col("src") == node) & (F.col("w") == 1)).select(F.col("dst").alias("id"))
    days = tedges.select("day").distinct().withColumn("t", F.row_number().over(Window.orderBy("day")))  # a row a day
    kept = tedges.join(F.broadcast(days.filter(F.col("t") > skip)), "day", "left_semi")
    return kept.join(weak.withColumnRenamed("id", "src"), "src", "left_anti").join(weak.withColumnRenamed("id", "dst"), "dst", "left_anti").select("day", "src", "dst", "w")
