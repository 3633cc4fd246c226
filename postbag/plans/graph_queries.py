"""Queries on messages and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounded, graphs, messages
from ..operators.iterate import connected_components, cut
from . import views as v
from .registry import query

MSG = v.msg_sql()
TO = "e AS (SELECT sender AS src, unnest(recipients) AS dst FROM {m} WHERE len(recipients) <= 5)"
A0 = "a0 AS (SELECT src, dst, count(*)::BIGINT AS w FROM e GROUP BY ALL)"
SYM = "a AS (SELECT src, dst, max(w)::BIGINT AS w FROM (SELECT src, dst, w FROM a0 UNION ALL SELECT dst, src, w FROM a0) GROUP BY ALL)"


def graph_sql(m: str = MSG) -> str:
    return f"WITH {m}, {TO.format(m='msg')}, {A0}, {SYM}, {v.PERSON_SQL}"


G = graph_sql()


def graph(spark, d):
    """To-from graph of at most five others, symmetric."""
    return graphs.symmetrise(graphs.to_from_edges(v.messages(spark, d), maxset=5))


@query(f"WITH {MSG} SELECT count(DISTINCT thread)::BIGINT AS threads, count(*)::BIGINT AS messages FROM msg")
def msg_counts(spark, d):
    return messages.corpus_counts(v.messages(spark, d))


ROLES = f"""WITH {MSG}, r AS (SELECT sender AS id, 's' AS role FROM msg UNION ALL SELECT unnest(recipients), 'r' FROM msg UNION ALL SELECT unnest(cc), 'c' FROM msg),
c AS (SELECT id, count(*) FILTER (role = 's') AS sent, count(*) FILTER (role = 'r') AS received, count(*) FILTER (role = 'c') AS copied FROM r GROUP BY id)"""


@query(f"{ROLES} SELECT * FROM c")
def role_counts(spark, d):
    return messages.role_counts(v.messages(spark, d))


@query(
    f"""{ROLES} SELECT id, CASE WHEN sent > 0 THEN row_number() OVER (ORDER BY sent DESC, id) END AS sent_rank,
CASE WHEN received > 0 THEN row_number() OVER (ORDER BY received DESC, id) END AS received_rank,
CASE WHEN copied > 0 THEN row_number() OVER (ORDER BY copied DESC, id) END AS copied_rank FROM c"""
)
def role_ranks(spark, d):
    return messages.role_ranks(messages.role_counts(v.messages(spark, d)))


@query(f"{G} SELECT * FROM a")
def tofrom_edges_max5(spark, d):
    return graph(spark, d)


@query(f"WITH {MSG}, e AS (SELECT sender AS src, unnest(list_concat(recipients, cc)) AS dst, 1.0::DOUBLE / len(list_concat(recipients, cc)) AS w FROM msg) SELECT src, dst, round(sum(w), 6) AS w FROM e GROUP BY ALL")
def tofrom_edges_fractional(spark, d):
    return graphs.to_from_edges(v.messages(spark, d), keepcc=True, fractional=True).withColumn("w", F.round("w", 6))


@query(f"WITH {MSG}, e AS (SELECT sender AS src, unnest(recipients) AS dst FROM msg) SELECT src, dst, count(*)::BIGINT AS w FROM e WHERE src <> 7 AND dst <> 7 GROUP BY ALL")
def tofrom_edges_without_focal(spark, d):
    return graphs.to_from_edges(v.messages(spark, d), focal=7)


@query(f"{G} SELECT id, name, org, degree FROM (SELECT dst AS id, sum(w)::BIGINT AS degree FROM a GROUP BY dst) JOIN person USING (id) ORDER BY degree DESC, id LIMIT 10")
def tofrom_degree_top10(spark, d):
    top = graphs.weighted_degree(graph(spark, d)).orderBy(F.desc("degree"), "id").limit(10)
    return top.join(v.persons(spark, d), "id").select("id", "name", "org", "degree")


@query(f"{G} SELECT src, dst, 1::BIGINT AS w FROM a WHERE src <> dst AND w <> 0")
def simple_graph_edges(spark, d):
    return graphs.simple(graph(spark, d)).withColumn("w", F.col("w").cast("long"))


@query(
    f"""{G}, g AS (SELECT src AS id, count(*) AS k FROM a WHERE src <> dst GROUP BY src), x AS (SELECT coalesce(k, 0) AS k FROM person LEFT JOIN g USING (id))
SELECT max(k)::BIGINT AS max_degree, avg(k)::DOUBLE AS mean_degree, median(k)::DOUBLE AS median_degree FROM x"""
)
def simple_graph_degree_stats(spark, d):
    return graphs.degree_stats(v.persons(spark, d), graphs.degree(graphs.simple(graph(spark, d))))


@query(
    f"""{G}, g AS (SELECT src AS id, count(*) AS k FROM a WHERE src <> dst GROUP BY src), h AS (SELECT dst AS id, sum(w) AS k FROM a GROUP BY dst),
x AS (SELECT max(coalesce(k, 0))::BIGINT AS max_degree, avg(coalesce(k, 0)) AS mean_degree, median(coalesce(k, 0))::DOUBLE AS median_degree FROM person LEFT JOIN g USING (id)),
y AS (SELECT max(coalesce(k, 0))::BIGINT AS max_weighted, avg(coalesce(k, 0))::DOUBLE AS mean_weighted, median(coalesce(k, 0))::DOUBLE AS median_weighted FROM person LEFT JOIN h USING (id))
SELECT (SELECT count(*) FROM person) AS n, (count(*) FILTER (src <> dst) // 2)::BIGINT AS edges, count(*) FILTER (src = dst) AS loops, sum(w)::BIGINT AS volume,
coalesce(sum(w) FILTER (src = dst), 0)::BIGINT AS loop_volume, any_value(x.max_degree) AS max_degree, any_value(x.mean_degree) AS mean_degree, any_value(x.median_degree) AS median_degree,
any_value(y.max_weighted) AS max_weighted, any_value(y.mean_weighted) AS mean_weighted, any_value(y.median_weighted) AS median_weighted FROM a, x, y"""
)
def graph_summary(spark, d):
    return graphs.graph_summary(v.persons(spark, d), graph(spark, d))


REPLY = "t AS (SELECT DISTINCT thread, pos AS new, sender AS dst, unnest(list_concat(recipients, cc)) AS src FROM msg), e AS (SELECT t.src, t.dst FROM t JOIN msg o ON o.thread = t.thread AND o.sender = t.src AND o.pos > t.new)"


@query(f"WITH {MSG}, {REPLY} SELECT src, dst, count(*)::BIGINT AS w FROM e GROUP BY ALL")
def repliedto_edges(spark, d):
    return graphs.replied_to_edges(v.messages(spark, d))


PROJ = "p AS (SELECT list_distinct(list_concat([sender], recipients)) AS p FROM msg), q AS (SELECT p, len(p) AS k FROM p WHERE len(p) BETWEEN 2 AND 6), e AS (SELECT x AS src, unnest(p) AS dst, k FROM (SELECT p, unnest(p) AS x, k FROM q))"


@query(f"WITH {MSG}, {PROJ} SELECT src, dst, count(*)::BIGINT AS w FROM e WHERE src > dst GROUP BY ALL")
def projection_edges(spark, d):
    return graphs.projection_edges(v.messages(spark, d), maxset=6)


@query(f"WITH {MSG}, {PROJ} SELECT src, dst, round(sum(2.0::DOUBLE / (k * (k - 1))), 6) AS w FROM e WHERE src > dst GROUP BY ALL")
def projection_edges_fractional(spark, d):
    return graphs.projection_edges(v.messages(spark, d), maxset=6, fractional=True).withColumn("w", F.round("w", 6))


@query(f"{G}, g AS (SELECT src AS id FROM a GROUP BY src HAVING count(*) >= 60) SELECT src, dst, w FROM a WHERE src IN (SELECT id FROM g) AND dst IN (SELECT id FROM g)")
def mindegree_one_pass(spark, d):
    return graphs.min_degree(graph(spark, d), 60)


@query(f"{G} SELECT x.src, x.dst, least(x.w, y.w) AS w FROM a0 x JOIN a0 y ON x.src = y.dst AND x.dst = y.src")
def mutual_edges(spark, d):
    return graphs.symmetrise(graphs.to_from_edges(v.messages(spark, d), maxset=5), "min")


@query(f"{G} SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT src, dst, w FROM a0 UNION ALL SELECT dst, src, w FROM a0) GROUP BY ALL")
def summed_edges(spark, d):
    return graphs.symmetrise(graphs.to_from_edges(v.messages(spark, d), maxset=5), "sum")


@query(f"{G}, {REPLY.replace(' e AS', ' f AS')}, b AS (SELECT src, dst, count(*) AS w FROM f GROUP BY ALL) SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT src, dst, w FROM a UNION ALL SELECT src, dst, -w FROM b) GROUP BY ALL HAVING sum(w) <> 0")
def graph_difference(spark, d):
    return graphs.graph_difference(graph(spark, d), graphs.replied_to_edges(v.messages(spark, d)))


@query(f"WITH {MSG} SELECT msg_id, thread, pos FROM msg WHERE list_contains(recipients, sender)")
def self_loops(spark, d):
    return messages.self_loops(v.messages(spark, d))


@query(f"WITH {MSG} SELECT msg_id, thread, pos FROM msg WHERE len(recipients) > 0 AND ts IS NOT NULL")
def usable_messages(spark, d):
    return messages.usable(v.messages(spark, d)).select("msg_id", "thread", "pos")


@query(f"WITH {MSG} SELECT msg_id, sender FROM msg WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-01-01' AND list_contains(list_concat([sender], list_concat(recipients, cc)), 7)")
def messages_of_person(spark, d):
    from ..operators.temporal import person_days

    return person_days(v.messages(spark, d), 7, "1996-01-01", "1997-01-01").select("msg_id", "sender")


SETS = "s AS (SELECT id, org AS label FROM person)"
STATS = f"""{G}, {SETS}, t AS (SELECT sum(w) AS total FROM a), z AS (SELECT label, count(*) AS size FROM s GROUP BY label),
b AS (SELECT x.label, sum(w) AS vol, coalesce(sum(w) FILTER (x.label = y.label), 0) AS inside FROM a JOIN s x ON x.id = src LEFT JOIN s y ON y.id = dst GROUP BY x.label),
q AS (SELECT label, size, vol::BIGINT AS vol, inside::BIGINT AS edges, (vol - inside)::BIGINT AS cut, (total - vol)::BIGINT AS rest, total::BIGINT AS total, (SELECT count(*) FROM s) AS n FROM b JOIN z USING (label), t)"""


def org_sets(spark, d):
    return v.persons(spark, d).select("id", F.col("org").alias("label"))


@query(
    f"""{STATS} SELECT label, size, vol, edges, cut, CASE WHEN least(vol, rest) > 0 THEN round(cut / least(vol, rest), 9) END AS cond,
CASE WHEN vol > 0 AND rest > 0 THEN round(cut / vol + cut / rest, 9) END AS ncut, CASE WHEN size < n THEN round(cut / (size * (n - size)), 9) END AS sparsity,
CASE WHEN size < n THEN round(cut / least(size, n - size), 9) END AS expansion FROM q"""
)
def set_stats_by_org(spark, d):
    s = graphs.set_stats(graph(spark, d), org_sets(spark, d))
    return s.select("label", "size", "vol", "edges", "cut", *[F.round(c, 9).alias(c) for c in ("cond", "ncut", "sparsity", "expansion")])


@query(f"{STATS} SELECT round(sum(edges / total - pow(vol / total, 2)), 9) AS modularity FROM q")
def modularity_by_org(spark, d):
    return graphs.modularity(graph(spark, d), org_sets(spark, d)).select(F.round("modularity", 9).alias("modularity"))


@query(f"{STATS} SELECT label, round(cut / (vol * rest), 12) AS scaled_ncut FROM q WHERE vol * rest > 0 ORDER BY cut / (vol * rest), label LIMIT 1")
def min_scaled_ncut_by_org(spark, d):
    return graphs.min_scaled_ncut(graph(spark, d), org_sets(spark, d)).select("label", F.round("scaled_ncut", 12).alias("scaled_ncut"))


@query(f"{G}, {SETS} SELECT src, dst, w, x.label AS src_label, y.label AS dst_label FROM a JOIN s x ON x.id = src JOIN s y ON y.id = dst WHERE src < dst AND x.label <> y.label")
def cut_edges_by_org(spark, d):
    return graphs.cut_edges(graph(spark, d), org_sets(spark, d))


@query(
    f"WITH {MSG}, {v.PERSON_SQL}, m AS (SELECT thread AS id, org FROM msg JOIN person ON person.id = sender), c AS (SELECT id, org, count(*) AS n FROM m GROUP BY ALL) SELECT id, org FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, org) AS r FROM c) WHERE r = 1"
)
def org_vote(spark, d):
    m = v.messages(spark, d).select(F.col("thread").alias("id"), "sender").join(v.persons(spark, d).select(F.col("id").alias("sender"), "org"), "sender")
    return messages.org_vote(m.select("id", "org"), -1)


@query(
    f"""{G}, {REPLY.replace(' e AS', ' f AS')}, r1 AS (SELECT dst AS id, row_number() OVER (ORDER BY sum(w) DESC, dst) AS tofrom_rank FROM a GROUP BY dst),
r2 AS (SELECT dst AS id, row_number() OVER (ORDER BY count(*) DESC, dst) AS reply_rank FROM f GROUP BY dst)
SELECT id, tofrom_rank, reply_rank FROM r1 LEFT JOIN r2 USING (id) WHERE tofrom_rank <= 15"""
)
def rank_compare(spark, d):
    one = graphs.weighted_degree(graph(spark, d)).withColumnRenamed("degree", "score")
    two = graphs.weighted_degree(graphs.replied_to_edges(v.messages(spark, d))).withColumnRenamed("degree", "score")
    return messages.rank_compare({"tofrom": one, "reply": two}, 15)


COMPONENTS = f"WITH RECURSIVE {MSG}, e AS (SELECT src, dst FROM (SELECT sender AS src, unnest(recipients) AS dst FROM msg WHERE len(recipients) <= 1) GROUP BY ALL HAVING count(*) >= 3), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS id, src AS x FROM u UNION SELECT r.id, u.dst FROM r JOIN u ON u.src = r.x), c AS (SELECT id, min(x) AS component FROM r GROUP BY id)"


def sparse(spark, d):
    """Of messages to one person, the pairs that have three or more."""
    return graphs.symmetrise(graphs.drop_small(graphs.to_from_edges(v.messages(spark, d), maxset=1), 2))


@query(f"{COMPONENTS} SELECT * FROM c")
def components(spark, d):
    e = sparse(spark, d)
    return connected_components(e.select(F.col("src").alias("id")), e)


@query(f"{COMPONENTS}, b AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT DISTINCT src, dst FROM u WHERE src IN (SELECT id FROM c JOIN b USING (component))")
def largest_component_edges(spark, d):
    return graphs.min_degree_component(sparse(spark, d), 0).select("src", "dst")


@query(f"{COMPONENTS}, b AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), {v.PERSON_SQL} SELECT id, name FROM person WHERE id NOT IN (SELECT id FROM c JOIN b USING (component))")
def outside_component(spark, d):
    return graphs.outside_component(v.persons(spark, d), sparse(spark, d)).select("id", "name")


@query(f"WITH RECURSIVE {MSG}, e AS (SELECT src, dst FROM (SELECT sender AS src, unnest(recipients) AS dst FROM msg WHERE len(recipients) <= 1) GROUP BY ALL HAVING count(*) >= 3), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT s_suppkey AS id, 0 AS hop FROM supplier WHERE s_suppkey % 10 = 1 UNION SELECT dst, hop + 1 FROM r JOIN u ON src = id WHERE hop < 3) SELECT id::BIGINT AS id, min(hop)::INT AS hop FROM r GROUP BY id")
def khop(spark, d):
    return graphs.khop(sparse(spark, d), v.persons(spark, d).filter("id % 10 = 1").select("id"), 3)


PR = [f"{G}, o AS (SELECT src, sum(w) AS o FROM a GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM person), x0 AS (SELECT id, 1 / n AS r FROM person, n)"]
for _i in range(1, 11):
    PR.append(
        f"m{_i} AS (SELECT person.id, coalesce(sum(a.w / o.o * r), 0) AS m FROM person LEFT JOIN (a JOIN o USING (src) JOIN x{_i - 1} ON x{_i - 1}.id = a.src) ON a.dst = person.id GROUP BY person.id), "
        f"x{_i} AS (SELECT id, 0.85 * m + (1 - 0.85 * (SELECT sum(m) FROM m{_i})) / n AS r FROM m{_i}, n)"
    )


@query(", ".join(PR) + " SELECT id, round(r, 9) AS rank FROM x10")
def pagerank_10iters(spark, d):
    return graphs.pagerank(v.persons(spark, d), graph(spark, d), rounds=10).select("id", F.round("rank", 9).alias("rank"))


@query(f"{G}, k AS (SELECT DISTINCT src, dst FROM a WHERE src < dst) SELECT x.src AS a, x.dst AS b, y.dst AS c FROM k x JOIN k y ON x.dst = y.src JOIN k z ON z.src = x.src AND z.dst = y.dst")
def triangles(spark, d):
    return graphs.triangles(graph(spark, d))


SWEEP = f"""{G}, sc AS (SELECT id, coalesce(sum(w), 0) AS score FROM person LEFT JOIN a ON dst = id GROUP BY id), k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc),
v AS (SELECT x.rank, x.id, (SELECT coalesce(sum(w), 0) FROM a JOIN k y ON y.id = a.src WHERE y.rank <= x.rank) AS vol,
(SELECT coalesce(sum(w), 0) FROM a JOIN k y ON y.id = a.src JOIN k z ON z.id = a.dst WHERE y.rank <= x.rank AND z.rank > x.rank) AS cut FROM k x)"""


@query(f"{SWEEP} SELECT rank, id, vol::BIGINT AS vol, cut::BIGINT AS cut, CASE WHEN least(vol, (SELECT sum(w) FROM a) - vol) > 0 THEN round((cut / least(vol, (SELECT sum(w) FROM a) - vol))::DOUBLE, 9) END AS cond FROM v")
def sweep_profile(spark, d):
    e = cut(graph(spark, d))  # read for degrees, totals and both ends
    s = v.persons(spark, d).select("id").join(graphs.weighted_degree(e), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("score"))
    return graphs.sweep_profile(e, s).withColumn("cond", F.round("cond", 9))


@query(f"WITH {v.PERSON_SQL}, s AS (SELECT org % 5 AS label, id FROM person UNION SELECT 9, id FROM person WHERE id % 3 = 0), z AS (SELECT label, count(*) AS k FROM s GROUP BY label) SELECT x.label AS a, y.label AS b, x.k - (SELECT count(*) FROM s p JOIN s q USING (id) WHERE p.label = x.label AND q.label = y.label) AS n FROM z x, z y")
def set_difference_sizes(spark, d):
    p = v.persons(spark, d)
    s = p.select((F.col("org") % 5).alias("label"), "id").union(p.filter("id % 3 = 0").select(F.lit(9), "id"))
    return messages.set_differences(s)


@query(f"WITH {MSG}, f AS (SELECT DISTINCT sender AS id FROM msg WHERE len(cc) > 2), t AS (SELECT DISTINCT sender AS id FROM msg WHERE len(recipients) > 8), c AS (SELECT count(*) FILTER (f.id IS NOT NULL AND t.id IS NOT NULL) AS h, count(f.id) AS nf, count(t.id) AS nt FROM f FULL JOIN t ON f.id = t.id) SELECT CASE WHEN nf > 0 THEN h / nf ELSE 0.0 END AS precision, CASE WHEN nt > 0 THEN h / nt ELSE 0.0 END AS recall, CASE WHEN nf + nt > 0 THEN 2 * h / (nf + nt) ELSE 0.0 END AS f1 FROM c")
def set_precision_recall(spark, d):
    m = v.messages(spark, d)
    pick = lambda c: m.filter(c).select(F.col("sender").alias("id")).distinct()
    return messages.precision_recall(pick(F.size("cc") > 2), pick(F.size("recipients") > 8))


@query("SELECT value, row_number() OVER (ORDER BY seq, value) - 1 AS code FROM (SELECT event_type AS value, min(event_id) AS seq FROM events GROUP BY event_type)")
def first_appearance_codes(spark, d):
    return messages.dictionary(v.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("value")))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'fixed ' || s_suppkey ELSE s_name END AS name, s_nationkey AS org FROM supplier")
def overlay_corrections(spark, d):
    p = v.persons(spark, d)
    fixes = p.filter("id % 3 = 0").select("id", F.concat(F.lit("fixed "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("int").alias("org"))
    return messages.overlay(p, fixes, ["id"])


@query("SELECT s_suppkey AS id, 'name' AS field, s_name AS \"left\", upper(s_name) AS \"right\" FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 5 <> 0 AND upper(s_name) <> s_name UNION ALL SELECT s_suppkey, f, v, NULL FROM (SELECT s_suppkey, unnest(['name', 'org']) AS f, unnest([s_name, s_nationkey::VARCHAR]) AS v FROM supplier WHERE s_suppkey % 5 = 0)")
def version_differences(spark, d):
    p = v.persons(spark, d)
    new = p.filter("id % 5 <> 0").withColumn("name", F.when(F.col("id") % 4 == 0, F.upper("name")).otherwise(F.col("name")))
    return messages.version_differences(p, new, ["id"], ["name", "org"])


@query(f"WITH {MSG}, e AS (SELECT sender AS src, unnest(recipients) AS dst FROM msg), a AS (SELECT src, dst, count(*)::BIGINT AS w FROM e GROUP BY ALL), {v.PERSON_SQL} SELECT x.id + 1000 AS src, y.id + 1000 AS dst, w FROM a JOIN person x ON x.id = src JOIN person y ON y.id = dst WHERE x.org < 12 AND y.org < 12")
def realigned_edges(spark, d):
    p = v.persons(spark, d)
    onto = p.filter("org < 12").select((F.col("id") + 1000).alias("id"), "name")
    return graphs.realign(graphs.to_from_edges(v.messages(spark, d)), p, onto)


# walks of each length from each vertex; at the least length they are the shortest paths
BETWEEN = f"""WITH RECURSIVE {MSG}, {TO.format(m='msg')}, u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst), vx AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
k AS (SELECT id AS s, id AS v, 0 AS d, 1.0::DOUBLE AS c FROM vx UNION ALL SELECT k.s, u.dst, k.d + 1, sum(k.c) FROM k JOIN u ON u.src = k.v WHERE k.d < 6 GROUP BY k.s, u.dst, k.d + 1),
q AS (SELECT s, v, min(d) AS d, arg_min(c, d) AS c FROM k GROUP BY s, v),
b AS (SELECT x.v AS id, sum(x.c * y.c / z.c) / 2 AS b FROM q x JOIN q y ON y.s = x.v JOIN q z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND y.v <> x.v AND y.v <> x.s GROUP BY x.v)"""


@query(f"{BETWEEN} SELECT vx.id, round(coalesce(b, 0), 6) AS betweenness FROM vx LEFT JOIN b ON b.id = vx.id")
def betweenness(spark, d):
    return bounded.betweenness(graph(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


# rows only: kernels, held against brute force and known values in tests
@query()
def all_pairs_cuts(spark, d):
    return bounded.all_cuts(graph(spark, d))


@query()
def stcut(spark, d):
    e = graph(spark, d)
    top = [r.id for r in graphs.weighted_degree(e).orderBy(F.desc("degree"), "id").limit(2).collect()]
    value, side = bounded.st_cut(e, *top)
    return side.withColumn("value", F.lit(value))


@query()
def spectral_cut(spark, d):
    lam, side, cond = bounded.spectral(graph(spark, d))
    return side.withColumns({"lambda2": F.lit(lam), "cond": F.lit(cond)})


@query()
def louvain(spark, d):
    return bounded.communities(graph(spark, d))


@query()
def clustering_products(spark, d):
    return bounded.products(graph(spark, d))


@query()
def flowseed(spark, d):
    e = graph(spark, d)
    seeds = [r.id for r in graphs.weighted_degree(e).orderBy(F.desc("degree"), "id").limit(8).collect()]
    score, side = bounded.flow_seed(e, seeds)
    return side.withColumn("score", F.lit(score))


@query()
def acl_scores(spark, d):
    e = graph(spark, d)
    return bounded.acl(e, [e.agg(F.min("src")).first()[0]])


@query()
def densified_groups(spark, d):
    return graphs.densify_groups(v.persons(spark, d).select("id", F.col("org").alias("label")), 4.0)
