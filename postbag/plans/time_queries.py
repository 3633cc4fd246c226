"""Queries on days, tensors, windows, text and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bounded, messages, temporal, tensors
from . import views as v
from .graph_queries import MSG
from .registry import query

EV = f"WITH {v.EVENT_SQL}"


@query(f"WITH {MSG} SELECT msg_id, thread, pos FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ts), sender, recipients, cc ORDER BY thread, pos) AS r FROM msg) WHERE r = 1")
def dedup_messages(spark, d):
    return temporal.deduplicate(v.messages(spark, d)).select("msg_id", "thread", "pos")


@query(f"WITH {MSG} SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM msg GROUP BY date_trunc('second', ts), sender, recipients, cc)")
def duplicate_count(spark, d):
    return temporal.duplicate_count(v.messages(spark, d))


@query(
    f"WITH {MSG}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ts), sender, recipients, cc ORDER BY thread, pos) AS r FROM msg) WHERE r = 1), e AS (SELECT CAST(ts AS DATE) AS day, sender AS src, unnest(list_concat(recipients, cc)) AS dst FROM u) SELECT day, src, dst, count(*)::BIGINT AS w FROM e GROUP BY ALL"
)
def day_edges(spark, d):
    return temporal.day_edges(v.messages(spark, d))


@query(f"{EV} SELECT src, dst, max(w)::BIGINT AS w FROM (SELECT src, dst, sum(w) AS w FROM ev GROUP BY ALL UNION ALL SELECT dst, src, sum(w) FROM ev GROUP BY ALL) GROUP BY ALL")
def collapsed_edges(spark, d):
    return temporal.collapse(v.event_edges(spark, d))


@query(f"{EV}, dy AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS s FROM (SELECT DISTINCT day FROM ev)), x AS (SELECT day, src AS id FROM ev UNION ALL SELECT day, dst FROM ev) SELECT id, min(s)::INT AS first_slice, max(s)::INT AS last_slice, (max(s) + 7)::INT AS masked_from FROM x JOIN dy USING (day) GROUP BY id")
def first_last_active(spark, d):
    return temporal.first_last_active(v.event_edges(spark, d))


@query(f"{EV}, u AS (SELECT day, src, dst FROM ev UNION SELECT day, dst, src FROM ev) SELECT day, src AS id, count(*)::BIGINT AS entries FROM u GROUP BY ALL")
def entries_per_node(spark, d):
    return temporal.entries_per_node(v.event_edges(spark, d))


@query(f"{EV}, b AS (SELECT min(day) AS a, max(day) AS b FROM ev) SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM b")
def all_days(spark, d):
    return temporal.all_days(v.event_edges(spark, d))


_TS = "x AS (SELECT src, day, sum(w) AS v FROM ev GROUP BY ALL), l AS (SELECT max(day) AS last FROM x), y AS (SELECT src, day AS f, v, CAST(unnest(generate_series(day, day + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM x)"


def _by_src(spark, d):
    return v.event_edges(spark, d).groupBy("src", "day").agg(F.sum("w").alias("v"))


@query(f"{EV}, {_TS} SELECT src, day, sum(v)::BIGINT AS total FROM y, l WHERE day <= last GROUP BY ALL")
def trailing7(spark, d):
    return temporal.trailing_sum(_by_src(spark, d), ["src"])


@query(f"{EV}, {_TS} SELECT src, day, round(sum(v * pow(0.5, date_diff('day', f, day))), 6) AS total FROM y, l WHERE day <= last GROUP BY ALL")
def trailing7_decay(spark, d):
    return temporal.trailing_sum(_by_src(spark, d), ["src"], decay=0.5).withColumn("total", F.round("total", 6))


@query(f"{EV}, dy AS (SELECT day, row_number() OVER (ORDER BY day) AS t FROM (SELECT DISTINCT day FROM ev)) SELECT x.day, e.src, e.dst, round(sum(e.w * pow(0.5, x.t - y.t)), 6) AS f FROM ev e JOIN dy y ON y.day = e.day JOIN dy x ON x.t >= y.t GROUP BY x.day, e.src, e.dst")
def fading_memory(spark, d):
    return temporal.fading_memory(v.event_edges(spark, d)).withColumn("f", F.round("f", 6))


@query("WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS slice FROM orders WHERE o_custkey % 40 = 0), f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS frame FROM orders) SELECT frame, (SELECT max(slice) FROM s WHERE slice <= frame) AS slice FROM f WHERE EXISTS (SELECT 1 FROM s WHERE slice <= frame)")
def as_of_slices(spark, d):
    o = v.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey")
    return temporal.as_of(o.select(F.col("day").alias("frame")).distinct(), o.filter("o_custkey % 40 = 0").select(F.col("day").alias("slice")).distinct()).filter("slice is not null")


_REACH = """WITH RECURSIVE {ev}, mn AS (SELECT min(day) AS m, max(day) AS x FROM ev), e AS (SELECT DISTINCT date_diff('day', m, day) AS n, src, dst FROM ev, mn), us AS (SELECT DISTINCT user_id AS id FROM events),
r AS (SELECT date_diff('day', m, x) + 1 AS n, id AS src, id AS dst FROM us, mn UNION ALL
  SELECT DISTINCT n - 1 AS n, src, dst FROM (SELECT n, src, dst FROM r UNION ALL SELECT r.n, e.src, r.dst FROM r JOIN e ON e.dst = r.src AND e.n = r.n - 1) WHERE n > 0)""".format(ev=v.EVENT_SQL)


def users(spark, d):
    return v.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()


@query(f"{_REACH} SELECT src, dst FROM r WHERE n = 0")
def temporal_reach(spark, d):
    return temporal.reachability(v.event_edges(spark, d), users(spark, d))


@query(f"{_REACH} SELECT src, count(*)::BIGINT AS reached FROM r WHERE n = 0 GROUP BY src ORDER BY reached DESC, src LIMIT 15")
def temporal_reach_top15(spark, d):
    r = temporal.reachability(v.event_edges(spark, d), users(spark, d))
    return r.groupBy("src").agg(F.count("*").alias("reached")).orderBy(F.desc("reached"), "src").limit(15)


@query()
def temporal_reach_same_day(spark, d):
    """A day's strong components of more than two reach alike."""
    return temporal.reachability(v.event_edges(spark, d), users(spark, d), same_day=True)


@query()
def temporal_strong_component(spark, d):
    found, proven = bounded.temporal_strong_component(temporal.reachability(v.event_edges(spark, d), users(spark, d)))
    return found.withColumn("proven", F.lit(proven))


# a day's inverse is 40 terms of its series, then the next day begins from it
_COMM = """{name}(n, k, id, x, y) AS (SELECT 1, 0, id, 1.0::DOUBLE, 1.0::DOUBLE FROM us UNION ALL
  SELECT CASE WHEN k = 39 THEN n + 1 ELSE n END, CASE WHEN k = 39 THEN 0 ELSE k + 1 END, id, CASE WHEN k = 39 THEN z ELSE x END, z FROM (
    SELECT b.n, b.k, b.id, b.x, b.x + 0.02 * coalesce(sum(e.w * c.y), 0) AS z FROM {name} b LEFT JOIN e ON {clock} = b.n AND {to} = b.id LEFT JOIN {name} c ON c.id = {at} GROUP BY b.n, b.k, b.id, b.x) WHERE n <= (SELECT max(up) FROM e))"""
_COMMUNICABILITY = (
    f"WITH RECURSIVE {v.EVENT_SQL}, us AS (SELECT DISTINCT user_id AS id FROM events), e AS (SELECT src, dst, w, dense_rank() OVER (ORDER BY day) AS up, dense_rank() OVER (ORDER BY day DESC) AS down FROM ev), "
    + _COMM.format(name="bc", clock="e.down", to="e.src", at="e.dst") + ", " + _COMM.format(name="rc", clock="e.up", to="e.dst", at="e.src")
    + ", cm AS (SELECT bc.id, bc.x AS broadcast, rc.x AS receive FROM bc JOIN rc ON rc.id = bc.id AND rc.n = bc.n AND rc.k = bc.k WHERE bc.k = 0 AND bc.n = (SELECT max(up) + 1 FROM e))"
)


@query(f"{_COMMUNICABILITY} SELECT id, round(broadcast, 6) AS broadcast, round(receive, 6) AS receive FROM cm")
def communicability(spark, d):
    c = temporal.communicability(v.event_edges(spark, d), users(spark, d))
    return c.select("id", F.round("broadcast", 6).alias("broadcast"), F.round("receive", 6).alias("receive"))


@query(
    f"""{_COMMUNICABILITY}, s AS (SELECT id, round(broadcast, 6) AS broadcast, round(receive, 6) AS receive FROM cm),
q AS (SELECT id, broadcast, row_number() OVER (ORDER BY broadcast DESC, id) AS broadcast_rank, row_number() OVER (ORDER BY receive DESC, id) AS receive_rank FROM s)
SELECT id, broadcast_rank, receive_rank FROM q WHERE broadcast_rank <= 15"""
)
def communicability_ranking(spark, d):
    """The fifteen best broadcasters and where they stand as receivers."""
    c = communicability(spark, d)
    return messages.rank_compare({x: c.select("id", F.col(x).alias("score")) for x in ("broadcast", "receive")}, 15)


@query(
    f"""WITH RECURSIVE {v.EVENT_SQL}, vx AS (SELECT day, src AS id FROM ev UNION SELECT day, dst FROM ev), r AS (SELECT day, id AS a, id AS b FROM vx UNION SELECT r.day, r.a, ev.dst FROM r JOIN ev ON ev.day = r.day AND ev.src = r.b)
SELECT x.day, x.a AS id, min(x.b) AS component FROM r x JOIN r y ON y.day = x.day AND y.a = x.b AND y.b = x.a GROUP BY x.day, x.a"""
)
def day_strong_components(spark, d):
    return bounded.strong_components(v.event_edges(spark, d))


@query()
def multislice_communities(spark, d):
    return bounded.multislice_communities(v.event_edges(spark, d))


# -------------------------------------------------------------------- tensors
_PRUNE = f"""WITH {MSG}, k0 AS (SELECT sender AS id FROM msg UNION SELECT unnest(recipients) FROM msg UNION SELECT unnest(cc) FROM msg),
rr AS (SELECT msg_id, unnest(recipients) AS id FROM msg), cr AS (SELECT msg_id, unnest(cc) AS id FROM msg)"""
for _n in range(1, 7):
    _PRUNE += f""", s{_n} AS (SELECT msg_id, sender FROM msg WHERE sender IN (SELECT id FROM k{_n - 1}) AND msg_id IN (SELECT msg_id FROM rr WHERE id IN (SELECT id FROM k{_n - 1})) AND msg_id IN (SELECT msg_id FROM cr WHERE id IN (SELECT id FROM k{_n - 1}))),
k{_n} AS (SELECT sender AS id FROM s{_n} INTERSECT SELECT id FROM rr WHERE msg_id IN (SELECT msg_id FROM s{_n}) AND id IN (SELECT id FROM k{_n - 1}) INTERSECT SELECT id FROM cr WHERE msg_id IN (SELECT msg_id FROM s{_n}) AND id IN (SELECT id FROM k{_n - 1}))"""
_TENSOR = f"""{_PRUNE}, fr AS (SELECT msg_id, id AS r FROM rr WHERE id IN (SELECT id FROM k6)), fc AS (SELECT msg_id, id AS c FROM cr WHERE id IN (SELECT id FROM k6)),
nr AS (SELECT msg_id, count(*) AS n FROM fr GROUP BY 1), nc AS (SELECT msg_id, count(*) AS n FROM fc GROUP BY 1),
tn AS (SELECT c, r, sender AS s, sum(1.0::DOUBLE / (nr.n * nc.n)) AS v FROM msg JOIN fr USING (msg_id) JOIN fc USING (msg_id) JOIN nr USING (msg_id) JOIN nc USING (msg_id) WHERE sender IN (SELECT id FROM k6) GROUP BY c, r, sender)"""


@query(f"{_PRUNE} SELECT id FROM k6")
def tensor_prune(spark, d):
    return tensors.pruned_people(v.messages(spark, d))


@query(f"{_TENSOR} SELECT c, r, s, round(v, 6) AS v FROM tn")
def message_tensor(spark, d):
    m = v.messages(spark, d)
    return tensors.message_tensor(m, tensors.pruned_people(m)).withColumn("v", F.round("v", 6))


_H = [f"{_TENSOR}, x0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM k6) AS x FROM k6)"]
for _n in range(1, 6):
    _H.append(f"y{_n} AS (SELECT c AS id, sqrt(sum(v * a.x * b.x)) AS y FROM tn JOIN x{_n - 1} a ON a.id = r JOIN x{_n - 1} b ON b.id = s GROUP BY c), x{_n} AS (SELECT k6.id, coalesce(y / (SELECT sum(y) FROM y{_n}), 0) AS x FROM k6 LEFT JOIN y{_n} ON y{_n}.id = k6.id)")


@query(", ".join(_H) + " SELECT id, round(x, 6) AS x FROM x5")
def h_eigen_5iters(spark, d):
    m = v.messages(spark, d)
    keep = tensors.pruned_people(m)
    return tensors.eigenvector_centrality(tensors.message_tensor(m, keep), keep, rounds=5, tol=None).withColumn("x", F.round("x", 6))


@query(
    f"WITH {MSG}, e AS (SELECT sender AS i, unnest(recipients) AS j, date_diff('day', DATE '1996-01-01', CAST(ts AS DATE)) AS day, 'w' || (thread % 7) AS word, 1.0::DOUBLE / len(recipients) AS v FROM msg WHERE CAST(ts AS DATE) >= DATE '1996-01-01') SELECT i, j, day::INT AS day, word, round(sum(v), 6) AS v FROM e GROUP BY ALL"
)
def word_tensor(spark, d):
    m = v.messages(spark, d)
    words = m.select("msg_id", F.concat(F.lit("w"), (F.col("thread") % 7).cast("string")).alias("word"))
    return tensors.word_tensor(m, words, "1996-01-01").withColumn("v", F.round("v", 6))


@query("SELECT l_suppkey AS i, l_partkey % 20 AS j, arg_max(l_quantity, l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_quantity::BIGINT * 100) AS v FROM lineitem GROUP BY ALL")
def densified_last_write(spark, d):
    line = v.table(spark, d, "lineitem")
    seq = F.col("l_orderkey") * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_quantity").cast("long") * 100
    return tensors.last_write(line.select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 20).alias("j"), F.col("l_quantity").alias("v"), seq.alias("seq")), ["i", "j"])


@query(f"WITH {MSG}, e AS (SELECT sender AS i, unnest(recipients) AS j, 1.0::DOUBLE / len(recipients) AS v FROM msg) SELECT i, round(sum(v), 6) AS v FROM e GROUP BY i")
def tensor_marginal(spark, d):
    e = v.messages(spark, d).select(F.col("sender").alias("i"), F.explode("recipients").alias("j"), (F.lit(1.0) / F.size("recipients")).alias("v"))
    return tensors.marginal(e, "i").withColumn("v", F.round("v", 6))


# ------------------------------------------------------------ text and vectors
@query("WITH t AS (SELECT unnest(string_split_regex(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '<[^>]*>', ' ', 'g'), '[^\\p{L}\\s]+|\\d+', ' ', 'g')), '\\s+')) AS word FROM documents) SELECT word, count(*)::BIGINT AS n FROM t WHERE length(word) >= 3 GROUP BY word HAVING count(*) >= 12")
def vocabulary(spark, d):
    w = v.table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 12")


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS dim FROM embeddings) SELECT label, dim, round(avg(x), 6) AS mean FROM x GROUP BY ALL")
def mean_embedding_by_label(spark, d):
    return text.mean_embedding(v.table(spark, d, "embeddings").select("label", "embedding"), "label").withColumn("mean", F.round("mean", 6))


@query(
    """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e1 FROM embeddings), c AS (SELECT label, unnest(e1) AS x, unnest(range(len(e1))) AS dim FROM x), m AS (SELECT label, dim, avg(x) AS x FROM c GROUP BY ALL),
w AS (SELECT 'w' || label AS word, list(x ORDER BY dim) AS e2 FROM m GROUP BY label),
s AS (SELECT vec_id, word, round(list_dot_product(e1, e2) / (sqrt(list_dot_product(e1, e1)) * sqrt(list_dot_product(e2, e2))), 9) AS cos FROM x, w)
SELECT vec_id, arg_min(word, (-cos, word)) AS word FROM s GROUP BY vec_id"""
)
def nearest_word(spark, d):
    """The label whose mean vector is nearest to each vector."""
    e = v.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    mean = text.mean_embedding(e, "label").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("embedding"))
    return text.nearest_word(e, mean.select(F.concat(F.lit("w"), F.col("label").cast("string")).alias("word"), "embedding")).select("vec_id", "word")


@query()
def word2vec(spark, d):
    """Vectors of words that 12 documents' tokens or more hold."""
    from pyspark.ml.feature import Word2Vec

    docs = v.table(spark, d, "documents").select(text.tokens(F.col("text")).alias("words"))
    model = Word2Vec(vectorSize=32, minCount=12, maxIter=8, seed=1, inputCol="words", outputCol="v").fit(docs)
    return model.getVectors().select("word", F.col("vector").cast("string").alias("vector"))


@query()
def cp_factors(spark, d):
    """Three-term CP decomposition of the tensor: factor rows by mode."""
    m = v.messages(spark, d)
    f = tensors.cp_als(tensors.message_tensor(m, tensors.pruned_people(m)), ["c", "r", "s"], 3, rounds=2)
    out = None
    for mode, table in f.items():
        rows = table.select(F.lit(mode).alias("mode"), F.col("id").cast("long"), F.posexplode("f").alias("k", "x"))
        out = rows if out is None else out.union(rows)
    return out
