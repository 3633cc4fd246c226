"""Roles, counts, rankings, votes and audits over messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import global_rank


def role_rows(msgs: DataFrame) -> DataFrame:
    """id, role: a row each time that someone sends, receives or is copied."""
    return (
        msgs.select(F.col("sender").alias("id"), F.lit("sent").alias("role"))
        .union(msgs.select(F.explode("recipients"), F.lit("received")))
        .union(msgs.select(F.explode("cc"), F.lit("copied")))
    )


def role_counts(msgs: DataFrame) -> DataFrame:
    """id, sent, received, copied. One aggregate with conditional counts instead of a pivot."""
    n = lambda r: F.count(F.when(F.col("role") == r, 1)).alias(r)
    return role_rows(msgs).groupBy("id").agg(n("sent"), n("received"), n("copied"))


def role_ranks(counts: DataFrame) -> DataFrame:
    """Rank by each role (ties by id); null where the count is 0."""
    out = counts
    for r in ("sent", "received", "copied"):
        out = global_rank(out, [F.desc(r), F.asc("id")], "_r").withColumn(f"{r}_rank", F.when(F.col(r) > 0, F.col("_r"))).drop("_r")
    return out.select("id", "sent_rank", "received_rank", "copied_rank")


def corpus_counts(msgs: DataFrame) -> DataFrame:
    return msgs.agg(F.countDistinct("thread").alias("threads"), F.count("*").alias("messages"))


def self_loops(msgs: DataFrame) -> DataFrame:
    return msgs.filter(F.array_contains("recipients", F.col("sender"))).select("msg_id", "thread", "pos")


def usable(msgs: DataFrame) -> DataFrame:
    """Messages with a time, a sender and someone they go to."""
    return msgs.filter(F.col("ts").isNotNull() & F.col("sender").isNotNull() & (F.size("recipients") > 0))


def org_vote(memberships: DataFrame, other: int) -> DataFrame:
    """id, org: the organisation that most rows of (id, org) name, the smallest of equals; ``other`` where none is named."""
    n = memberships.groupBy("id").agg(F.count("org").alias("named"))
    best = memberships.filter("org is not null").groupBy("id", "org").agg(F.count("*").alias("n")).groupBy("id").agg(F.min_by("org", F.struct(-F.col("n"), "org")).alias("org"))
    return n.join(best, "id", "left").select("id", F.coalesce("org", F.lit(other)).alias("org"))


def rank_compare(results: dict[str, DataFrame], k: int) -> DataFrame:
    """The top ``k`` of the first result (id, score) with everyone's rank in the others; null where absent."""
    out = None
    for name, scores in results.items():
        r = global_rank(scores.select("id", "score"), [F.desc("score"), F.asc("id")], f"{name}_rank").drop("score")
        out = r.filter(F.col(f"{name}_rank") <= k) if out is None else out.join(r, "id", "left")
    return out


def dictionary(values: DataFrame) -> DataFrame:
    """value, code: numbers from 0 by first appearance, of (seq, value)."""
    first = values.groupBy("value").agg(F.min("seq").alias("first"))
    return global_rank(first, ["first", "value"], "code").select("value", (F.col("code") - 1).alias("code"))


def overlay(base: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` with the non-null fields of ``fixes`` for the same keys."""
    own = [c for c in base.columns if c not in keys]
    fixed = fixes.select(*keys, *[F.col(c).alias(f"_{c}") for c in own if c in fixes.columns])
    return base.join(fixed, keys, "left").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in fixes.columns else F.col(c) for c in own])


def version_differences(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, left, right where two versions differ; a missing row differs in every field that isn't null."""
    x = a.select(*keys, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields])
    y = b.select(*keys, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields])
    both = x.join(y, keys, "full")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left"), F.col(f"r_{f}").alias("right")) for f in fields]))
    return both.select(*keys, rows.alias("x")).select(*keys, "x.*").filter(~F.col("left").eqNullSafe(F.col("right")))


def subject_audit(subjects: DataFrame) -> DataFrame:
    """Add ``kind``: empty, single, long (over one character and no reply or forward mark) or plain."""
    s = F.coalesce("subject", F.lit(""))
    kind = F.when(F.length(s) < 1, "empty").when(F.length(s) == 1, "single").when(~F.substring(s, 1, 2).isin("RE", "Re", "FW", "Fw"), "long").otherwise("plain")
    return subjects.withColumn("kind", kind)


def set_differences(sets: DataFrame) -> DataFrame:
    """a, b, n: members of set a that set b lacks, for all pairs of named sets (label, id): from sizes and overlaps."""
    size = sets.groupBy("label").agg(F.count("*").alias("size"))
    x, y = sets.select("id", F.col("label").alias("a")), sets.select("id", F.col("label").alias("b"))
    shared = x.join(y, "id").groupBy("a", "b").agg(F.count("*").alias("both"))
    if (n := size.count()) > 2_000:
        raise ValueError(f"{n} named sets have {n * n} pairs; the matrix is for 2000 sets at most")
    # a row a pair of set names
    pairs = size.select(F.col("label").alias("a"), "size").join(F.broadcast(size.select(F.col("label").alias("b"))))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", (F.col("size") - F.coalesce("both", F.lit(0))).alias("n"))


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall, f1 of id sets; 0 where a set is empty."""
    both = found.select("id", F.lit(1).alias("f")).join(truth.select("id", F.lit(1).alias("t")), "id", "full")
    c = both.agg(F.count(F.col("f") + F.col("t")).alias("hit"), F.count("f").alias("nf"), F.count("t").alias("nt"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return c.select(div(F.col("hit"), F.col("nf")).alias("precision"), div(F.col("hit"), F.col("nt")).alias("recall"), div(2 * F.col("hit"), F.col("nf") + F.col("nt")).alias("f1"))


def side_changes(sides: DataFrame) -> DataFrame:
    """id of those whose side (0 or 1) isn't the same for every value of the sweep: (id, sweep, side)."""
    return sides.groupBy("id").agg(F.sum("side").alias("s"), F.count("*").alias("n")).filter("s > 0 and s < n").select("id")
