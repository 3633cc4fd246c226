"""Composed graphs, ranking reports and small relational operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs
from .iterate import cut, global_rank
from .messages import rank_compare

#: The five graphs of a corpus: how edges are made, and whether copied people count.
FIVE = {"tofrom": ("tofrom", False), "tofrom_cc": ("tofrom", True), "repliedto": ("repliedto", True), "projection": ("projection", False), "projection_cc": ("projection", True)}


def build_graph(msgs: DataFrame, kind: str, keepcc: bool = False, maxset: int | None = 5, mindegree: int = 0, focal: int | None = None, fractional: bool = False) -> DataFrame:
    """Symmetric edges of a corpus: to-from, replied-to or projection; then the vertices of at least ``mindegree``
    entries in one pass, and of those the largest component."""
    if kind == "tofrom":
        e = graphs.to_from_edges(msgs, keepcc, maxset, focal, fractional)
    elif kind == "repliedto":
        e = graphs.replied_to_edges(msgs, focal)
    elif kind == "projection":
        e = graphs.projection_edges(msgs, ("sender", "recipients", "cc") if keepcc else ("sender", "recipients"), maxset, focal, fractional)
    else:
        raise ValueError(f"no such graph: {kind!r}")
    return graphs.min_degree_component(graphs.symmetrise(e), mindegree)


def five_graphs(msgs: DataFrame, maxset: int = 5, mindegree: int = 0, focal: int | None = None) -> dict[str, DataFrame]:
    """``build_graph`` of each of FIVE. Messages are made once, and each graph is read from where it was written, as reports read it several times."""
    msgs = cut(msgs.select("thread", "pos", "sender", "recipients", "cc"))
    return {name: cut(build_graph(msgs, kind, keepcc, maxset, mindegree, focal)) for name, (kind, keepcc) in FIVE.items()}


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


def summary_table(found: dict[str, DataFrame]) -> DataFrame:
    """A row a graph: name and ``graphs.graph_summary`` over the vertices that have edges."""
    out = None
    for name, e in found.items():
        row = graphs.graph_summary(vertices_of(e), e).select(F.lit(name).alias("graph"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def degree_ranking(found: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """The first graph's ``k`` people of largest weighted degree and their ranks in all graphs."""
    return rank_compare({name: graphs.weighted_degree(e).withColumnRenamed("degree", "score") for name, e in found.items()}, k)


def pagerank_ranking(found: dict[str, DataFrame], k: int = 10, rounds: int = 50, tol: float | None = 1e-9, digits: int = 9) -> DataFrame:
    """The same by PageRank; ranks that agree to ``digits`` places tie."""
    scores = {name: graphs.pagerank(vertices_of(e), e, rounds=rounds, tol=tol).select("id", F.round("rank", digits).alias("score")) for name, e in found.items()}
    return rank_compare(scores, k)


def betweenness_ranking(edges: DataFrame, k: int = 10) -> DataFrame:
    """rank, id, betweenness and community of the ``k`` vertices that most shortest paths lead through."""
    from . import bounded

    top = graphs.ranking(bounded.betweenness(edges).select("id", F.col("betweenness").alias("score")), k)
    return top.join(bounded.communities(edges).withColumnRenamed("label", "community"), "id").select("rank", "id", F.col("score").alias("betweenness"), "community")


def diffusion_ranking(edges: DataFrame, incidence: DataFrame, seed: int, k: int = 10) -> DataFrame:
    """Ranks under three diffusions from ``seed``: pushes on the graph, and two on the hypergraph over the same people; by score over degree."""
    from . import bounded
    from .hypergraphs import node_degree

    a = bounded.acl(edges, [seed]).filter("degree > 0").select("id", (F.col("score") / F.col("degree")).alias("score"))
    d = node_degree(incidence).withColumnRenamed("node_id", "id")
    hyper = {m: bounded.hypergraph_scores(incidence, [seed], m, **o).withColumnRenamed("node_id", "id") for m, o in (("lh", {"kappa": 0.01}), ("qdsfm", {"steps": 5000}))}
    scaled = {m: x.join(d, "id").select("id", (F.col("score") / F.col("degree")).alias("score")) if m == "qdsfm" else x.select("id", "score") for m, x in hyper.items()}
    return rank_compare({"acl": a} | scaled, k)


# ---------------------------------------------------------------- small operators
def label_rows(labels: DataFrame) -> DataFrame:
    """id, groups, last_label, row of (id, slice, label): distinct labels over slices, the label of the last slice, and the row from 0 in
    which a picture shows it: by both, ties by id."""
    by = labels.groupBy("id").agg(F.countDistinct("label").alias("groups"), F.max_by("label", "slice").alias("last_label"))
    return global_rank(by, ["groups", "last_label", "id"], "row").withColumn("row", F.col("row") - 1)


def all_argmax(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """All rows that hold their group's largest ``value``."""
    top = df.groupBy(*group).agg(F.max(value).alias("_top"))
    return df.join(top, group).filter(F.col(value) == F.col("_top")).drop("_top")


def is_monday(day: Column) -> Column:
    return F.weekday(day) == 0


def assert_present(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """id of each name of ``wanted`` (name) in ``names`` (id, name); an error that lists some, if one isn't there."""
    lost = [r.name for r in wanted.join(names, "name", "left_anti").limit(5).collect()]
    if lost:
        raise KeyError(f"no such names: {lost}")
    return wanted.join(names, "name").select("id")


def interval_join(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Points (p) inside spans (a, b; a <= p <= b) of whole numbers, as an equi-join on blocks of ``width``: a span is listed once for each block
    that it meets, a point is in one, and the condition settles the ends. Other columns of both sides stay."""
    s = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    return points.withColumn("_block", F.floor(F.col("p") / width)).join(s, "_block").filter((F.col("a") <= F.col("p")) & (F.col("p") <= F.col("b"))).drop("_block")


def set_scores_strict(found: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall and f1 of id sets, NaN where a set is empty or nothing is shared."""
    both = found.select("id", F.lit(1).alias("f")).join(truth.select("id", F.lit(1).alias("t")), "id", "full")
    c = both.agg(F.count(F.col("f") + F.col("t")).alias("hit"), F.count("f").alias("nf"), F.count("t").alias("nt"))
    nan = F.lit(float("nan"))
    p, r = F.when(F.col("nf") > 0, F.col("hit") / F.col("nf")).otherwise(nan), F.when(F.col("nt") > 0, F.col("hit") / F.col("nt")).otherwise(nan)
    return c.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(nan).alias("f1"))


def role_embeddings(msgs: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, block, dim, x: six blocks a person, the means of the subject's and the body's vectors (msg_id, subject, body: arrays) of the messages
    that they sent, received and were copied in; 0 for a role that they never have. Sums by position, no vectors gathered."""
    v = msgs.join(vectors, "msg_id")
    roles = v.select(F.col("sender").alias("id"), F.lit("sender").alias("role"), "subject", "body")
    for role in ("recipients", "cc"):
        roles = roles.unionByName(v.select(F.explode(role).alias("id"), F.lit(role).alias("role"), "subject", "body"))
    parts = roles.select("id", "role", F.explode(F.array(F.struct(F.lit("subject").alias("part"), F.col("subject").alias("e")), F.struct(F.lit("body").alias("part"), F.col("body").alias("e")))).alias("_s"))
    cells = parts.select("id", F.concat_ws("_", "_s.part", "role").alias("block"), F.posexplode("_s.e").alias("dim", "x")).groupBy("id", "block", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    names = [f"{p}_{r}" for r in ("sender", "recipients", "cc") for p in ("subject", "body")]
    every = cells.select("id").distinct().withColumn("block", F.explode(F.array(*map(F.lit, names))))
    dims = cells.select("dim").distinct()  # a row a dimension
    return every.join(F.broadcast(dims)).join(cells, ["id", "block", "dim"], "left").select("id", "block", "dim", F.coalesce("x", F.lit(0.0)).alias("x"))


# ------------------------------------------------------------------------- tables
def table_rows(df: DataFrame, columns: list[str], style: str = "markdown", form: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """line, n: the rows of a printed table in the order of ``n``, which ``df`` must have: n = -1 and 0 are the head and (Markdown) its rule.
    ``form`` says how a column becomes text. For reports: a row a line, and nothing is collected."""
    form = form or {}
    cells = [F.coalesce(form.get(c, lambda x: x.cast("string"))(F.col(c)), F.lit("--")) for c in columns]
    spark = df.sparkSession
    if style == "markdown":
        body = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        head = [(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))]
    elif style == "latex":
        safe = [F.regexp_replace(c, r"([&%$#_{}])", r"\\$1") for c in cells]
        body = F.concat(F.concat_ws(" & ", *safe), F.lit(r" \\"))
        head = [(-1, " & ".join(c.replace("_", r"\_") for c in columns) + r" \\ \midrule")]
    else:
        raise ValueError(f"no such style: {style!r}")
    return spark.createDataFrame(head, "n long, line string").union(df.select(F.col("n").cast("long"), body))
