"""Queries on composed graphs, ranking reports, tables and small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bounded, graphs, messages, reports
from . import views as v
from .graph_queries import MSG
from .registry import query

LEAST = 20
#: Each graph's directed pairs, before they are counted.
_PAIRS = {
    "tofrom": "SELECT sender AS src, unnest(recipients) AS dst FROM msg WHERE len(recipients) <= 5",
    "tofrom_cc": "SELECT sender AS src, unnest(list_concat(recipients, cc)) AS dst FROM msg WHERE len(list_concat(recipients, cc)) <= 5",
    "repliedto": "SELECT t.src, t.dst FROM (SELECT DISTINCT thread, pos AS new, sender AS dst, unnest(list_concat(recipients, cc)) AS src FROM msg) t JOIN msg o ON o.thread = t.thread AND o.sender = t.src AND o.pos > t.new",
    "projection": "SELECT src, dst FROM (SELECT x AS src, unnest(p) AS dst FROM (SELECT p, unnest(p) AS x FROM (SELECT list_distinct(list_concat([sender], recipients)) AS p FROM msg) WHERE len(p) BETWEEN 2 AND 5)) WHERE src > dst",
    "projection_cc": "SELECT src, dst FROM (SELECT x AS src, unnest(p) AS dst FROM (SELECT p, unnest(p) AS x FROM (SELECT list_distinct(list_concat([sender], list_concat(recipients, cc))) AS p FROM msg) WHERE len(p) BETWEEN 2 AND 5)) WHERE src > dst",
}


def _composed(n: str, pairs: str) -> str:
    """Counted, symmetric, vertices of at least LEAST entries, largest component: the edges {n}_g."""
    return f"""{n}_0 AS (SELECT src, dst, count(*)::BIGINT AS w FROM ({pairs}) GROUP BY ALL), {n}_s AS (SELECT src, dst, max(w)::BIGINT AS w FROM (SELECT src, dst, w FROM {n}_0 UNION ALL SELECT dst, src, w FROM {n}_0) GROUP BY ALL),
{n}_k AS (SELECT src AS id FROM {n}_s GROUP BY src HAVING count(*) >= {LEAST}), {n}_m AS (SELECT * FROM {n}_s WHERE src IN (SELECT id FROM {n}_k) AND dst IN (SELECT id FROM {n}_k)),
{n}_r AS (SELECT DISTINCT src AS id, src AS x FROM {n}_m UNION SELECT {n}_r.id, {n}_m.dst FROM {n}_r JOIN {n}_m ON {n}_m.src = {n}_r.x), {n}_c AS (SELECT id, min(x) AS comp FROM {n}_r GROUP BY id),
{n}_g AS (SELECT * FROM {n}_m WHERE src IN (SELECT id FROM {n}_c WHERE comp = (SELECT comp FROM {n}_c GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)))"""


FIVE = f"WITH RECURSIVE {MSG}, " + ", ".join(_composed(n, p) for n, p in _PAIRS.items())


def five(spark, d):
    return reports.five_graphs(v.messages(spark, d), mindegree=LEAST)


@query(f"{FIVE} " + " UNION ALL ".join(f"SELECT '{n}' AS graph, src, dst, w FROM {n}_g" for n in _PAIRS))
def five_graphs(spark, d):
    """To-from, replied-to and projected graphs, each symmetric, of people with enough neighbours, its largest component."""
    out = None
    for name, e in five(spark, d).items():
        e = e.select(F.lit(name).alias("graph"), "src", "dst", F.col("w").cast("long").alias("w"))
        out = e if out is None else out.union(e)
    return out


def _summary_sql(n: str) -> str:
    return f"""SELECT '{n}' AS graph, (SELECT count(DISTINCT src) FROM {n}_g) AS n, (count(*) FILTER (src <> dst) // 2)::BIGINT AS edges, count(*) FILTER (src = dst) AS loops, sum(w)::BIGINT AS volume,
coalesce(sum(w) FILTER (src = dst), 0)::BIGINT AS loop_volume, (SELECT max(k) FROM {n}_d)::BIGINT AS max_degree, (SELECT avg(k) FROM {n}_d)::DOUBLE AS mean_degree, (SELECT median(k) FROM {n}_d)::DOUBLE AS median_degree,
(SELECT max(h) FROM {n}_d)::BIGINT AS max_weighted, (SELECT avg(h) FROM {n}_d)::DOUBLE AS mean_weighted, (SELECT median(h) FROM {n}_d)::DOUBLE AS median_weighted FROM {n}_g"""


_DEGREES = ", ".join(f"{n}_d AS (SELECT src, count(*) FILTER (src <> dst) AS k, sum(w) AS h FROM {n}_g GROUP BY src)" for n in _PAIRS)


@query(f"{FIVE}, {_DEGREES} " + " UNION ALL ".join(map(_summary_sql, _PAIRS)))
def five_graph_summary(spark, d):
    return reports.summary_table(five(spark, d))


@query()
def five_graph_lambda2(spark, d):
    """Second eigenvalues of the five graphs, simple and weighted."""
    rows = [(name, *bounded.lambda2_of(e)) for name, e in five(spark, d).items()]
    return spark.createDataFrame(rows, "graph string, lambda2_simple double, lambda2_weighted double")


def _ranked_sql(scores: dict[str, str], k: int) -> str:
    """The first score's top k with ranks in all; ``scores``: SQL of (id, score)."""
    ctes = ", ".join(f"{n}_q AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS {n}_rank FROM ({sql}))" for n, sql in scores.items())
    first, *rest = scores
    return f"{ctes} SELECT id, {', '.join(f'{n}_rank' for n in scores)} FROM {first}_q " + " ".join(f"LEFT JOIN {n}_q USING (id)" for n in rest) + f" WHERE {first}_rank <= {k}"


@query(f"{FIVE}, " + _ranked_sql({n: f"SELECT dst AS id, sum(w) AS score FROM {n}_g GROUP BY dst" for n in _PAIRS}, 10))
def degree_ranking(spark, d):
    return reports.degree_ranking(five(spark, d))


def _pagerank_sql(n: str, rounds: int) -> str:
    out = [f"{n}_o AS (SELECT src, sum(w) AS o, count(*) AS e FROM {n}_g GROUP BY src), {n}_n AS (SELECT count(*)::DOUBLE AS n FROM {n}_o), {n}_x0 AS (SELECT src AS id, 1 / n AS r FROM {n}_o, {n}_n)"]
    for i in range(1, rounds + 1):
        out.append(f"{n}_x{i} AS (SELECT dst AS id, 0.85 * sum(g.w / o.o * r) + 0.15 / any_value(n) AS r FROM {n}_g g JOIN {n}_o o USING (src) JOIN {n}_x{i - 1} x ON x.id = g.src, {n}_n GROUP BY dst)")
    return ", ".join(out)


@query(f"{FIVE}, " + ", ".join(_pagerank_sql(n, 10) for n in _PAIRS) + ", " + _ranked_sql({n: f"SELECT id, round(r, 9) AS score FROM {n}_x10" for n in _PAIRS}, 10))
def pagerank_ranking(spark, d):
    return reports.pagerank_ranking(five(spark, d), rounds=10, tol=None)


@query()
def betweenness_ranking(spark, d):
    return reports.betweenness_ranking(reports.build_graph(v.messages(spark, d), "tofrom", mindegree=LEAST))


@query()
def diffusion_ranking(spark, d):
    """Ranks by pushes on the to-from graph, and by two hypergraph diffusions, from the busiest person."""
    e = reports.build_graph(v.messages(spark, d), "tofrom", mindegree=LEAST)
    inc = v.supplier_baskets(spark, d).join(reports.vertices_of(e).withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    seed = graphs.weighted_degree(e).orderBy(F.desc("degree"), "id").first().id
    return reports.diffusion_ranking(e, inc, seed)


# ------------------------------------------------------------- small operators
_LABELS = f"WITH {v.EVENT_SQL}, lb AS (SELECT src AS id, day AS slice, max(w)::BIGINT AS label FROM ev GROUP BY ALL)"


@query(f"{_LABELS}, b AS (SELECT id, count(DISTINCT label) AS groups, arg_max(label, slice) AS last_label FROM lb GROUP BY id) SELECT *, (row_number() OVER (ORDER BY groups, last_label, id) - 1)::INT AS row FROM b")
def label_rows(spark, d):
    labels = v.event_edges(spark, d).groupBy(F.col("src").alias("id"), F.col("day").alias("slice")).agg(F.max("w").alias("label"))
    return reports.label_rows(labels)


@query("SELECT s_nationkey AS org, s_suppkey AS id, round(s_acctbal, 2) AS s_acctbal FROM supplier s WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier t WHERE t.s_nationkey = s.s_nationkey)")
def all_argmax_balance(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), F.col("s_suppkey").alias("id"), "s_acctbal")
    return reports.all_argmax(s, ["org"], "s_acctbal").select("org", "id", F.round("s_acctbal", 2).alias("s_acctbal"))


@query(f"WITH {MSG} SELECT CAST(ts AS DATE) AS day, count(*)::BIGINT AS n FROM msg WHERE isodow(ts) = 1 GROUP BY ALL")
def monday_messages(spark, d):
    m = v.messages(spark, d).select(F.to_date("ts").alias("day"))
    return m.filter(reports.is_monday(F.col("day"))).groupBy("day").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT o_orderkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS p FROM orders), s AS (SELECT s_suppkey AS person, (s_suppkey * 37) % 2000 AS a, (s_suppkey * 37) % 2000 + 3 + s_suppkey % 10 AS b FROM supplier) SELECT person, count(*)::BIGINT AS n FROM p JOIN s ON p BETWEEN a AND b GROUP BY person")
def interval_counts(spark, d):
    """Orders inside each person's span of days."""
    p = v.table(spark, d, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("p"))
    a = (F.col("s_suppkey") * 37) % 2000
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("person"), a.alias("a"), (a + 3 + F.col("s_suppkey") % 10).alias("b"))
    return reports.interval_join(p, s, 16).groupBy("person").agg(F.count("*").alias("n"))


@query(f"WITH {MSG}, {v.PERSON_SQL}, e AS (SELECT p.org, sender, unnest(recipients) AS dst FROM msg JOIN person p ON p.id = sender) SELECT org, count(*)::BIGINT AS messages, count(DISTINCT dst)::BIGINT AS partners FROM e GROUP BY org")
def distinct_partners(spark, d):
    e = v.messages(spark, d).join(v.persons(spark, d).select(F.col("id").alias("sender"), "org"), "sender").select("org", F.explode("recipients").alias("dst"))
    return e.groupBy("org").agg(F.count("*").alias("messages"), F.countDistinct("dst").alias("partners"))


@query(f"WITH {MSG}, {v.PERSON_SQL} SELECT org, year(ts)::INT AS year, count(*)::BIGINT AS n, grouping_id(org, year(ts))::BIGINT AS level FROM msg JOIN person p ON p.id = sender GROUP BY ROLLUP (org, year(ts))")
def activity_rollup(spark, d):
    m = v.messages(spark, d).join(v.persons(spark, d).select(F.col("id").alias("sender"), "org"), "sender").select("org", F.year("ts").alias("year"))
    return m.rollup("org", "year").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"WITH {MSG}, {v.PERSON_SQL} SELECT org, year(ts)::INT AS year, count(*)::BIGINT AS n FROM msg JOIN person p ON p.id = sender GROUP BY CUBE (org, year(ts))")
def activity_cube(spark, d):
    m = v.messages(spark, d).join(v.persons(spark, d).select(F.col("id").alias("sender"), "org"), "sender").select("org", F.year("ts").alias("year"))
    return m.cube("org", "year").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MSG} SELECT msg_id, date_diff('day', lag(ts) OVER w, ts)::INT AS since_last, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS share,
count(*) OVER (PARTITION BY sender ORDER BY ts, msg_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)::BIGINT AS two_before FROM msg WINDOW w AS (PARTITION BY sender ORDER BY ts, msg_id)"""
)
def sender_rhythm(spark, d):
    """Days since a sender's message before, the quarter and share of their messages that it stands in, and how many of the last two there are."""
    w = Window.partitionBy("sender").orderBy("ts", "msg_id")
    since = F.datediff("ts", F.lag("ts").over(w)).alias("since_last")
    return v.messages(spark, d).select("msg_id", since, F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.count("*").over(w.rowsBetween(-2, -1)).alias("two_before"))


@query(
    f"""WITH {MSG}, ve AS (SELECT vec_id, embedding FROM embeddings), nv AS (SELECT count(*) AS n FROM ve), x AS (SELECT msg.*, s.embedding AS subject, b.embedding AS body FROM msg, nv JOIN ve s ON s.vec_id = msg_id % n JOIN ve b ON b.vec_id = (msg_id * 7 + 3) % n),
ro AS (SELECT sender AS id, 'sender' AS role, subject, body FROM x UNION ALL SELECT unnest(recipients), 'recipients', subject, body FROM x UNION ALL SELECT unnest(cc), 'cc', subject, body FROM x),
pa AS (SELECT id, 'subject_' || role AS block, subject AS e FROM ro UNION ALL SELECT id, 'body_' || role, body FROM ro), ce AS (SELECT id, block, unnest(range(len(e)))::INT AS dim, unnest(e)::DOUBLE AS x FROM pa),
me AS (SELECT id, block, dim, avg(x) AS x FROM ce GROUP BY ALL), al AS (SELECT id, block, dim FROM (SELECT DISTINCT id FROM me), (SELECT p || '_' || r AS block FROM (VALUES ('subject'), ('body')) a(p), (VALUES ('sender'), ('recipients'), ('cc')) b(r)), (SELECT DISTINCT dim FROM me))
SELECT id, block, dim, round(coalesce(me.x, 0), 6) AS x FROM al LEFT JOIN me USING (id, block, dim)"""
)
def role_embeddings(spark, d):
    """Six mean vectors a person; a message's subject and body take a vector of the table each."""
    e = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    m = v.messages(spark, d)
    vec = m.select("msg_id", (F.col("msg_id") % n).alias("s"), ((F.col("msg_id") * 7 + 3) % n).alias("b"))
    vec = vec.join(e.select(F.col("vec_id").alias("s"), F.col("embedding").alias("subject")), "s").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("body")), "b")
    return reports.role_embeddings(m, vec.select("msg_id", "subject", "body")).withColumn("x", F.round("x", 6))


_TABLE = f"WITH {MSG}, e AS (SELECT sender AS src, unnest(recipients) AS dst FROM msg WHERE len(recipients) <= 5), a0 AS (SELECT src, dst, count(*) AS w FROM e GROUP BY ALL), a AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM a0 UNION ALL SELECT dst, src, w FROM a0) GROUP BY ALL), {v.PERSON_SQL}, t AS (SELECT dst AS id, sum(w)::BIGINT AS degree FROM a GROUP BY dst ORDER BY degree DESC, dst LIMIT 10), q AS (SELECT row_number() OVER (ORDER BY degree DESC, id) AS n, name, degree FROM t JOIN person USING (id))"


def _top_table(spark, d):
    e = graphs.symmetrise(graphs.to_from_edges(v.messages(spark, d), maxset=5))
    top = graphs.ranking(graphs.weighted_degree(e).withColumnRenamed("degree", "score"), 10)
    return top.join(v.persons(spark, d), "id").select(F.col("rank").alias("n"), "name", F.col("score").alias("degree"))


@query(f"{_TABLE} SELECT n, '| ' || name || ' | ' || degree || ' |' AS line FROM q UNION ALL VALUES (-1, '| name | degree |'), (0, '|---|---|')")
def degree_table_markdown(spark, d):
    return reports.table_rows(_top_table(spark, d), ["name", "degree"])


@query(rf"{_TABLE} SELECT n, regexp_replace(name, '([&%$#_{{}}])', '\\\1', 'g') || ' & ' || degree || ' \\' AS line FROM q UNION ALL VALUES (-1, 'name & degree \\ \midrule')")
def degree_table_latex(spark, d):
    return reports.table_rows(_top_table(spark, d), ["name", "degree"], style="latex")


@query(f"WITH {MSG}, {v.PERSON_SQL}, w AS (SELECT DISTINCT name FROM person JOIN msg ON msg.sender = person.id WHERE len(recipients) = 0) SELECT person.id FROM w JOIN person USING (name)")
def present_senders(spark, d):
    """Senders to nobody, by their names, all of which must be known."""
    p = v.persons(spark, d)
    lone = v.messages(spark, d).filter(F.size("recipients") == 0).select(F.col("sender").alias("id")).distinct().join(p, "id").select("name")
    return reports.assert_present(lone, p)


@query(f"WITH {MSG}, f AS (SELECT DISTINCT sender AS id FROM msg WHERE len(cc) > 2), t AS (SELECT DISTINCT sender AS id FROM msg WHERE len(recipients) > 3), c AS (SELECT count(*) FILTER (f.id IS NOT NULL AND t.id IS NOT NULL) AS h, count(f.id) AS nf, count(t.id) AS nt FROM f FULL JOIN t ON f.id = t.id) SELECT round(h / nf, 9) AS precision, round(h / nt, 9) AS recall, round(2 * h / (nf + nt), 9) AS f1 FROM c")
def set_scores_strict(spark, d):
    m = v.messages(spark, d)
    pick = lambda c: m.filter(c).select(F.col("sender").alias("id")).distinct()
    s = reports.set_scores_strict(pick(F.size("cc") > 2), pick(F.size("recipients") > 3))
    return s.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query()
def communities_over_days(spark, d):
    """Rows of the picture of daily communities: distinct labels and the last one of each person."""
    c = bounded.multislice_communities(v.event_edges(spark, d))
    return reports.label_rows(c.select("id", "slice", "label"))


@query(f"WITH {MSG}, {v.PERSON_SQL} SELECT id, count(sender)::BIGINT AS sent FROM person LEFT JOIN msg ON sender = id GROUP BY id")
def sent_by_person(spark, d):
    """Everyone, also who sent nothing."""
    sent = messages.role_counts(v.messages(spark, d)).select("id", "sent")
    return v.persons(spark, d).select("id").join(sent, "id", "left").select("id", F.coalesce("sent", F.lit(0)).alias("sent"))
