"""Queries on hypergraphs: orders over parts, or over suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounded, hypergraphs, messages
from ..operators.iterate import cut, two_hop_aggregate
from . import views as v
from .registry import query

B = f"WITH {v.BASKET_SQL}"
M = f"{B}, h AS (SELECT edge_id, list_sort(list(node_id)) AS members, len(list(node_id)) AS k FROM basket GROUP BY edge_id)"
S = f"WITH {v.SUPPLIER_BASKET_SQL}, h AS (SELECT edge_id, list_sort(list(node_id)) AS members FROM basket GROUP BY edge_id), g AS (SELECT min(edge_id) AS edge_id, members, count(*)::BIGINT AS weight, len(members) AS k FROM h GROUP BY members)"


def basket(spark, d):
    return v.baskets(spark, d)


def weighted(spark, d):
    """Suppliers of an order as a hyperedge, equal ones merged."""
    h = hypergraphs.members(v.supplier_baskets(spark, d)).withColumn("weight", F.lit(1).cast("long"))
    return hypergraphs.merge(h)


@query(f"{S} SELECT edge_id, array_to_string(members, ',') AS members, weight FROM g")
def hyperedge_merge(spark, d):
    return weighted(spark, d).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(f"{S}, x AS (SELECT unnest(members) AS node_id, weight * (k - 1) AS x FROM g) SELECT node_id, sum(x)::BIGINT AS degree FROM x GROUP BY node_id")
def clique_degree(spark, d):
    return hypergraphs.clique_degree(weighted(spark, d))


@query(f"{B} SELECT edge_id, count(*)::BIGINT AS \"order\" FROM basket GROUP BY edge_id")
def hyperedge_order(spark, d):
    return hypergraphs.order(basket(spark, d))


@query(f"{B} SELECT node_id, count(*)::BIGINT AS degree FROM basket GROUP BY node_id")
def hyper_node_degree(spark, d):
    return hypergraphs.node_degree(basket(spark, d))


@query(f"{S} SELECT edge_id, array_to_string(members, ',') AS members, unnest(generate_series(1, weight))::INT AS copy FROM g")
def unrolled_hyperedges(spark, d):
    return hypergraphs.unroll(weighted(spark, d)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


PAIRS = f"{S}, p AS (SELECT unnest(members) AS src, members, weight, k FROM g WHERE k > 1), q AS (SELECT src, unnest(members) AS dst, weight, k FROM p)"


@query(f"{PAIRS} SELECT src, dst, sum(weight)::BIGINT AS w FROM q WHERE src <> dst GROUP BY ALL")
def clique_projection(spark, d):
    return hypergraphs.clique_projection(weighted(spark, d))


@query(f"{PAIRS} SELECT src, dst, round(sum(weight * 2.0::DOUBLE / (k * (k - 1))), 6) AS w FROM q WHERE src <> dst GROUP BY ALL")
def clique_projection_distributed(spark, d):
    return hypergraphs.clique_projection(weighted(spark, d), "pair").withColumn("w", F.round("w", 6))


@query(f"{PAIRS} SELECT src, dst, round(sum(weight / k::DOUBLE), 6) AS w FROM q WHERE src <> dst AND k <= 6 GROUP BY ALL")
def clique_projection_by_order(spark, d):
    return hypergraphs.clique_projection(weighted(spark, d), "order", 6).withColumn("w", F.round("w", 6))


@query(f"{PAIRS} SELECT DISTINCT src, dst, 1 AS w FROM q WHERE src <> dst")
def clique_projection_binary(spark, d):
    return hypergraphs.clique_projection(weighted(spark, d), "binary")


@query(f"{B} SELECT node_id AS src, -edge_id - 1 AS dst, 1 AS w FROM basket UNION ALL SELECT -edge_id - 1, node_id, 1 FROM basket")
def star_expansion(spark, d):
    return hypergraphs.star_expansion(basket(spark, d))


GADGET = f"""{M}, s AS (SELECT members, CASE WHEN k = 2 THEN 1.0::DOUBLE ELSE 0.5 END AS w FROM h WHERE k BETWEEN 2 AND 3),
l AS (SELECT members, 1000000 + 2 * (row_number() OVER (ORDER BY edge_id) - 1) AS aux FROM h WHERE k > 3),
x AS (SELECT src, dst, w FROM (SELECT src, unnest(members) AS dst, w FROM (SELECT unnest(members) AS src, members, w FROM s)) WHERE src <> dst
UNION ALL SELECT unnest(members), aux, 1.0 FROM l UNION ALL SELECT aux + 1, unnest(members), 1.0 FROM l UNION ALL SELECT aux, aux + 1, 2.0 FROM l)"""


@query(f"{GADGET} SELECT src, dst, sum(w)::DOUBLE AS w FROM x GROUP BY ALL")
def tl_gadget_edges(spark, d):
    h = hypergraphs.members(basket(spark, d)).withColumn("weight", F.lit(1))
    return hypergraphs.gadget_edges(h, 1_000_000, 2.0)


@query(
    f"""{B}, o AS (SELECT edge_id, count(*) AS o FROM basket GROUP BY edge_id), i AS (SELECT node_id % 7 AS label, edge_id, count(*) AS k FROM basket GROUP BY ALL),
t AS (SELECT count(*) AS total FROM basket), b AS (SELECT label, sum(least(k, o - k, 2.0::DOUBLE)) AS cut, sum(k)::BIGINT AS vol FROM i JOIN o USING (edge_id) GROUP BY label)
SELECT label, cut, vol, round(cut / least(vol, total - vol), 9) AS cond, round(cut / vol + cut / (total - vol), 9) AS ncut FROM b, t"""
)
def tl_cut_by_class(spark, d):
    inc = basket(spark, d)
    sets = inc.select("node_id").distinct().withColumn("label", F.col("node_id") % 7)
    c = hypergraphs.tl_cut(inc, sets, 2.0)
    return c.withColumns({"cond": F.round("cond", 9), "ncut": F.round("ncut", 9)})


SEEDS = "sd AS (SELECT DISTINCT node_id FROM basket WHERE node_id % 50 = 0)"


def seeds(inc):
    return inc.filter("node_id % 50 = 0").select("node_id").distinct()


@query(f"{B}, {SEEDS}, t AS (SELECT DISTINCT edge_id FROM basket JOIN sd USING (node_id)) SELECT DISTINCT node_id FROM basket JOIN t USING (edge_id) WHERE node_id NOT IN (SELECT node_id FROM sd)")
def hyper_neighbours(spark, d):
    inc = basket(spark, d)
    return hypergraphs.neighbours(inc, seeds(inc))


@query(f"{B}, {SEEDS}, o AS (SELECT edge_id FROM basket GROUP BY edge_id HAVING count(*) <= 4), t AS (SELECT DISTINCT edge_id FROM basket JOIN sd USING (node_id) JOIN o USING (edge_id)) SELECT DISTINCT node_id FROM basket JOIN t USING (edge_id)")
def hyper_neighbours_small_edges(spark, d):
    inc = basket(spark, d)
    return hypergraphs.neighbours(inc, seeds(inc), 4, with_seeds=True)


@query(f"{B} SELECT a.node_id, array_to_string(list_sort(list(DISTINCT b.node_id)), ',') AS neighbours FROM basket a JOIN basket b USING (edge_id) WHERE a.node_id <> b.node_id GROUP BY a.node_id")
def neighbour_lists(spark, d):
    return hypergraphs.neighbour_lists(basket(spark, d)).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


GROW = f"{B}, {SEEDS}, t AS (SELECT DISTINCT edge_id FROM basket JOIN sd USING (node_id)), hit AS (SELECT node_id, count(*) AS hits FROM basket JOIN t USING (edge_id) GROUP BY node_id), dg AS (SELECT node_id, count(*) AS deg FROM basket GROUP BY node_id), top AS (SELECT node_id FROM hit JOIN dg USING (node_id) WHERE node_id NOT IN (SELECT node_id FROM sd) ORDER BY SCORE DESC, node_id LIMIT 20) SELECT node_id FROM sd UNION ALL SELECT node_id FROM top"


@query(GROW.replace("SCORE", "hits"))
def top_neighbours(spark, d):
    inc = basket(spark, d)
    return hypergraphs.grow(inc, seeds(inc), 20)


@query(GROW.replace("SCORE", "hits / deg"))
def best_neighbours(spark, d):
    inc = basket(spark, d)
    return hypergraphs.grow(inc, seeds(inc), 20, best=True)


@query(f"{B} SELECT a.node_id AS node, sum(CASE WHEN a.node_id <> b.node_id THEN (b.node_id % 10)::DOUBLE ELSE 0 END) AS y FROM basket a JOIN basket b USING (edge_id) GROUP BY a.node_id")
def two_hop(spark, d):
    inc = basket(spark, d)
    x = inc.select(F.col("node_id").alias("node")).distinct().withColumn("value", (F.col("node") % 10).cast("double"))
    return two_hop_aggregate(inc, x)


@query(
    f"""{B}, o AS (SELECT edge_id, count(*) AS o FROM basket GROUP BY edge_id), sc AS (SELECT node_id, count(*) AS score FROM basket GROUP BY node_id), k AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM sc),
ar AS (SELECT rank, edge_id, o, row_number() OVER (PARTITION BY edge_id ORDER BY rank) AS j FROM basket JOIN k USING (node_id) JOIN o USING (edge_id)),
st AS (SELECT rank, sum(least(j, o - j, 1.0::DOUBLE) - least(j - 1, o - j + 1, 1.0::DOUBLE)) AS d, count(*) AS dv FROM ar GROUP BY rank), t AS (SELECT count(*) AS total FROM basket),
r AS (SELECT rank, node_id, sum(dv) OVER (ORDER BY rank)::BIGINT AS vol, sum(d) OVER (ORDER BY rank) AS cut FROM k JOIN st USING (rank))
SELECT rank, node_id, vol, cut, CASE WHEN least(vol, total - vol) > 0 THEN round(cut / least(vol, total - vol), 9) END AS cond FROM r, t"""
)
def hyper_sweep(spark, d):
    inc = cut(basket(spark, d))  # read for degrees, totals and arrivals
    s = hypergraphs.node_degree(inc).withColumnRenamed("degree", "score")
    return hypergraphs.sweep_profile(inc, s, 1.0).withColumn("cond", F.round("cond", 9))


@query(f"{B}, {SEEDS}, dg AS (SELECT node_id, count(*) AS deg FROM basket GROUP BY node_id) SELECT CASE WHEN sd.node_id IS NULL THEN dg.node_id ELSE -1 END::BIGINT AS src, CASE WHEN sd.node_id IS NULL THEN -2 ELSE dg.node_id END::BIGINT AS dst, deg * 0.25::DOUBLE AS w FROM dg LEFT JOIN sd USING (node_id)")
def terminal_edges(spark, d):
    inc = basket(spark, d)
    e = hypergraphs.terminal_edges(hypergraphs.node_degree(inc), seeds(inc), 0.25, -1, -2)
    return e.select(F.col("src").cast("long"), F.col("dst").cast("long"), "w")


# sets of at most six, merged; people of clique degree under 40 go, sets that are left with one person stay, and equal ones merge again
FROM_MSG = f"""WITH RECURSIVE {v.msg_sql()}, p AS (SELECT msg_id, list_sort(list_distinct(list_concat([sender], recipients))) AS m FROM msg),
h1 AS (SELECT min(msg_id) AS e, m, count(*)::BIGINT AS w FROM p WHERE len(m) BETWEEN 2 AND 6 GROUP BY m), cd AS (SELECT x AS id FROM (SELECT unnest(m) AS x, w * (len(m) - 1) AS d FROM h1) GROUP BY x HAVING sum(d) >= 40),
h2 AS (SELECT e, any_value(w) AS w, list_sort(list(x)) AS m FROM (SELECT e, w, unnest(m) AS x FROM h1) WHERE x IN (SELECT id FROM cd) GROUP BY e),
h3 AS (SELECT min(e) AS e, m, sum(w)::BIGINT AS w FROM h2 GROUP BY m), u AS (SELECT e, unnest(m) AS x FROM h3), pr AS (SELECT DISTINCT a.x AS a, b.x AS b FROM u a JOIN u b USING (e)),
r AS (SELECT a AS id, a AS x FROM pr UNION SELECT r.id, pr.b FROM r JOIN pr ON pr.a = r.x), c AS (SELECT id, min(x) AS comp FROM r GROUP BY id), sz AS (SELECT comp FROM c UNION ALL SELECT comp FROM h3 JOIN c ON c.id = m[1]), big AS (SELECT comp FROM sz GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)"""


@query(f"{FROM_MSG} SELECT e AS edge_id, array_to_string(m, ',') AS members, w AS weight FROM h3 WHERE m[1] IN (SELECT id FROM c JOIN big USING (comp))")
def hypergraph_from_messages(spark, d):
    h = hypergraphs.from_messages(v.messages(spark, d), maxset=6, mindegree=40)
    return h.select("edge_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.col("weight").cast("long"))


def _ends(inc):
    return [r.node_id for r in hypergraphs.node_degree(inc).orderBy(F.desc("degree"), "node_id").limit(2).collect()]


DELTAS = [round(1 + k / 10, 1) for k in range(41)]


def _delta_cuts(spark, d):
    h = weighted(spark, d).withColumn("weight", F.col("weight") / F.greatest(F.size("members") - 1, F.lit(1)))
    return bounded.hyper_st_cuts(h, *_ends(v.supplier_baskets(spark, d)), DELTAS)


@query()
def hyper_stcut_delta_sweep(spark, d):
    """Sides of the cut between the two busiest suppliers for delta from 1 to 5 by tenths."""
    return _delta_cuts(spark, d)


@query()
def delta_side_changes(spark, d):
    """Who isn't always on the same side."""
    return messages.side_changes(_delta_cuts(spark, d).select("id", F.col("delta").alias("sweep"), "side"))


@query()
def hypergraph_cut_comparison(spark, d):
    """Graph and hypergraph cuts between the two busiest suppliers, by the largest order of hyperedges."""
    return bounded.cut_comparison(weighted(spark, d), *_ends(v.supplier_baskets(spark, d)), [5, 10, 15, 25, 100])


def _seed(inc):
    return [hypergraphs.node_degree(inc).orderBy(F.desc("degree"), "node_id").first().node_id]


@query()
def lh_pagerank(spark, d):
    inc = basket(spark, d)
    return bounded.hypergraph_scores(inc, _seed(inc), "lh", kappa=0.01)


@query()
def qdsfm_pagerank(spark, d):
    inc = basket(spark, d)
    return bounded.hypergraph_scores(inc, _seed(inc), "qdsfm", steps=5000)


@query()
def capacity_releasing(spark, d):
    inc = basket(spark, d)
    return bounded.hypergraph_scores(inc, _seed(inc), "crd")


@query()
def hyperlocal(spark, d):
    inc = basket(spark, d)
    score, side = bounded.hyper_local(inc, [r.node_id for r in seeds(inc).collect()])
    return side.withColumn("score", F.lit(score))


@query()
def cluster_recovery(spark, d):
    inc = v.supplier_baskets(spark, d)
    truth = v.persons(spark, d).select(F.col("id").alias("node_id"), F.col("org").alias("label"))
    return bounded.trial_summary(bounded.recovery_trials(inc, truth, 2, 0.3, methods=("grow", "best", "acl_star", "qdsfm")))
