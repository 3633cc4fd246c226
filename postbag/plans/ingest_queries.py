"""Queries on ingest, names, times, text rules, and on what is written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graphs, hypergraphs, ingest, messages, temporal
from ..operators.iterate import shared
from ..sources import files
from . import views as v
from .graph_queries import MSG, G, graph
from .hypergraph_queries import weighted
from .registry import query


def _folder(spark, name):
    """A new folder beside the checkpoints, which driver and executors share."""
    shared(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------ written and read
@query(f"{G} SELECT src::INT AS src, dst::INT AS dst, w::DOUBLE AS w FROM a")
def graph_file(spark, d):
    """The to-from graph as a file of the exchange format, read back."""
    at = _folder(spark, "graph")
    files.write_graph(v.persons(spark, d), graph(spark, d), at)
    return files.read_graph(spark, at)[1]


@query(f"{G} SELECT id::INT AS id, name, org::INT AS org FROM person")
def graph_file_people(spark, d):
    at = _folder(spark, "graph")
    files.write_graph(v.persons(spark, d), graph(spark, d), at)
    return files.read_graph(spark, at)[0]


@query(f"WITH {v.SUPPLIER_BASKET_SQL}, h AS (SELECT edge_id, list_sort(list(node_id)) AS members FROM basket GROUP BY edge_id), g AS (SELECT row_number() OVER (ORDER BY min(edge_id)) - 1 AS e, members FROM h GROUP BY members) SELECT e::INT AS edge_id, unnest(members)::INT AS node_id FROM g")
def hypergraph_file(spark, d):
    """The merged hypergraph, its edges numbered, as a file read back."""
    from ..operators.iterate import global_rank

    h = global_rank(weighted(spark, d), ["edge_id"], "e").select((F.col("e") - 1).cast("int").alias("edge_id"), "members", "weight")
    at = _folder(spark, "hypergraph")
    files.write_hypergraph(v.persons(spark, d), hypergraphs.to_incidence(h), h.select("edge_id", "weight"), at)
    return files.read_hypergraph(spark, at)[1].select("edge_id", "node_id")


@query(f"WITH {v.EVENT_SQL} SELECT day, src::INT AS src, dst::INT AS dst, w::DOUBLE AS w FROM ev")
def sequence_file(spark, d):
    """Daily graphs of users as a file of slices and dates, read back."""
    e = v.event_edges(spark, d)
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().select("id", F.col("id").cast("string").alias("name"), F.lit(0).alias("org"))
    at = _folder(spark, "sequence")
    files.write_sequence(ids, e, at)
    return files.read_sequence(spark, at)[1].select("day", F.col("src").cast("int"), F.col("dst").cast("int"), F.col("w").cast("double"))


@query(f"WITH {v.EVENT_SQL} SELECT day, count(*)::BIGINT AS edges FROM ev GROUP BY day")
def days_written(spark, d):
    """Edges a day of the partitioned form, read back."""
    at = _folder(spark, "days")
    files.write_days(v.event_edges(spark, d), at)
    return spark.read.parquet(at).groupBy(F.col("day").cast("date").alias("day")).agg(F.count("*").alias("edges"))


@query(f"{G} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM a WHERE src < dst")
def edge_list_written(spark, d):
    at = _folder(spark, "edges")
    files.write_edge_list(graph(spark, d), at)
    return spark.read.csv(at, sep="\t", schema="src string, dst string")


@query("SELECT DISTINCT s_name AS value FROM supplier")
def vocabulary_written(spark, d):
    at = _folder(spark, "words")
    files.write_vocabulary(v.persons(spark, d).select(F.col("name").alias("word")), at)
    return spark.read.text(at)


# ------------------------------------------------------------- pages of text
_SHAPES = 4


def pages(spark, d):
    """(file, line_no, page, line): each order as a mail on pages of text, threads as files, newest first; times in four of the accepted shapes,
    letters of headers apart, a blank From before every third of the older ones."""
    m = v.messages(spark, d)
    who = lambda c: F.array_join(F.transform(c, lambda i: F.concat(F.lit("P"), i.cast("string"), F.lit("x Person"))), "; ")
    ts = F.col("ts").cast("timestamp_ntz")
    shape = [F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" -0500")), F.date_format(ts, "EEEE, MMMM d, yyyy h:mm:ss a"), F.date_format(ts, "EEEE, d MMMM yyyy HH:mm"), F.date_format(ts, "dd MMMM yyyy HH : mm")]
    sent = F.element_at(F.array(*shape), (F.col("msg_id") % _SHAPES + 1).cast("int"))
    blank = F.when((F.col("msg_id") % 3 == 0) & (F.col("pos") > 1), F.array(F.lit("From:"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(blank, F.array(F.concat(F.lit("F r o m: "), who(F.array("sender"))), F.concat(F.lit("Sent: "), sent), F.concat(F.lit("T o: "), who(F.col("recipients"))), F.concat(F.lit("Cc: "), who(F.col("cc"))), F.concat(F.lit("Subject: order "), F.col("msg_id").cast("string")), F.lit("body of it")))
    exploded = m.select(F.col("thread").cast("string").alias("file"), "pos", F.posexplode(lines).alias("k", "line"))
    return exploded.select("file", (F.col("pos").cast("long") * 10 + F.col("k")).alias("line_no"), F.lit(0).alias("page"), "line")


def parsed(spark, d):
    return ingest.split_messages(ingest.split_threads(pages(spark, d), "person"))


@query(f"WITH {MSG} SELECT thread::VARCHAR AS file, pos::BIGINT AS pos, 'P' || sender || 'x Person' AS sender, 'order ' || msg_id AS subject, CASE WHEN msg_id % 4 < 2 THEN ts ELSE date_trunc('minute', ts) END AS ts FROM msg")
def ingest_messages(spark, d):
    """Mails found again in pages of text: thread, place, sender, subject and time."""
    return parsed(spark, d).select("file", F.col("pos").cast("long").alias("pos"), "sender", "subject", text.parse_time(F.col("sent")).alias("ts"))


@query(f"WITH {MSG}, r AS (SELECT thread, pos, 'to' AS role, unnest(recipients) AS p FROM msg UNION ALL SELECT thread, pos, 'cc', unnest(cc) FROM msg UNION ALL SELECT thread, pos, 'sender', sender FROM msg) SELECT thread::VARCHAR AS file, pos::BIGINT AS pos, role, 'person, p' || p || 'x' AS name FROM r")
def ingest_people(spark, d):
    """Everyone on each mail under canonical names: normalised, then last name first."""
    p = parsed(spark, d)
    raw = p.select(F.explode(F.split(F.concat_ws(";", "sender", "to", "cc"), ";")).alias("raw")).select(F.lower(F.trim("raw")).alias("raw")).filter("raw <> ''")
    names = text.canonical_names(raw, [], [], spark.createDataFrame([], "raw string, names array<string>"))
    return ingest.people_of(p, names).select("file", F.col("pos").cast("long").alias("pos"), "role", "name")


@query(f"WITH {MSG} SELECT count(*)::BIGINT AS messages, (SELECT count(DISTINCT x) FROM (SELECT sender AS x FROM msg UNION ALL SELECT unnest(recipients) FROM msg UNION ALL SELECT unnest(cc) FROM msg))::BIGINT AS people, sum(len(recipients))::BIGINT AS recipients, sum(len(cc))::BIGINT AS copied FROM msg")
def ingest_encoded(spark, d):
    """Counts after integer encoding: each person one number, recipients and copies as they were."""
    p = parsed(spark, d)
    raw = p.select(F.explode(F.split(F.concat_ws(";", "sender", "to", "cc"), ";")).alias("raw")).select(F.lower(F.trim("raw")).alias("raw")).filter("raw <> ''")
    names = text.canonical_names(raw, [], [], spark.createDataFrame([], "raw string, names array<string>"))
    m, people = ingest.encode_people(p, ingest.people_of(p, names))
    n = m.agg(F.count("*").alias("messages"), F.sum(F.size("recipients")).alias("recipients"), F.sum(F.size("cc")).alias("copied"))
    return n.join(people.agg(F.count("*").alias("people")))  # one row each


# --------------------------------------------------------------- small rules
@query("WITH s AS (SELECT trim(substr(coalesce(text, ''), 1, doc_id::INT % 4)) AS subject FROM documents), k AS (SELECT CASE WHEN length(subject) < 1 THEN 'empty' WHEN length(subject) = 1 THEN 'single' WHEN substr(subject, 1, 2) NOT IN ('RE', 'Re', 'FW', 'Fw') THEN 'long' ELSE 'plain' END AS kind FROM s) SELECT kind, count(*)::BIGINT AS n FROM k GROUP BY kind")
def subject_kinds(spark, d):
    """Beginnings of documents, of no to three letters, as subjects."""
    s = v.table(spark, d, "documents").select(F.trim(F.substring(F.coalesce("text", F.lit("")), F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("subject"))
    return messages.subject_audit(s).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT min(s_suppkey)::BIGINT AS id FROM supplier WHERE s_name LIKE 'Supplier#00%'")
def first_of_prefix(spark, d):
    return spark.createDataFrame([(int(graphs.first_by_prefix(v.persons(spark, d), "Supplier#00")),)], "id long")


@query(
    f"""WITH {v.EVENT_SQL}, f AS (SELECT src, dst, sum(w) AS w FROM ev GROUP BY ALL), g AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM f UNION ALL SELECT dst, src, w FROM f) GROUP BY ALL), k AS (SELECT dst AS id FROM g WHERE src = 0 AND w = 1),
dy AS (SELECT day, row_number() OVER (ORDER BY day) AS t FROM (SELECT DISTINCT day FROM ev)) SELECT ev.day, src, dst, w::BIGINT AS w FROM ev JOIN dy USING (day) WHERE t > 2 AND src NOT IN (SELECT id FROM k) AND dst NOT IN (SELECT id FROM k)"""
)
def without_single_links(spark, d):
    return temporal.drop_single_link(v.event_edges(spark, d), 0)


@query("SELECT s_suppkey AS id, round(sin(least(s_suppkey / 20.0::DOUBLE, 1.0) * 3.141592653589793 / 2), 9) AS eased, CASE WHEN s_name LIKE '%,%' THEN split_part(s_name, ',', 1) WHEN s_name LIKE '% %' THEN replace(s_name, ' ', chr(10)) END AS short, round(sqrt(pow(sqrt(s_suppkey * s_suppkey + 4.0::DOUBLE), 0.5) ** 2), 6) AS far FROM supplier")
def display_values(spark, d):
    """Easing, short names and the distance that a fisheye leaves."""
    p = v.persons(spark, d)
    eye = text.fisheye(F.col("id").cast("double"), F.lit(2.0))
    return p.select("id", F.round(text.ease(F.col("id").cast("double"), 20), 9).alias("eased"), text.short_name(F.col("name")).alias("short"), F.round(F.sqrt(eye["x"] ** 2 + eye["y"] ** 2), 6).alias("far"))


@query(
    """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS k, (l_quantity / 50.0)::DOUBLE AS t FROM lineitem)
SELECT id, k, round(t * t / 2, 9) AS plain, round(CASE WHEN t < 0.5 THEN pow(0.5, -0.5) * t * t / 2 ELSE pow(t, 1.5) / 1.5 - (pow(0.5, 1.5) / 1.5 - pow(0.5, 1.5) / 2) END, 9) AS huber, round(CASE WHEN t < 0.5 THEN t * pow(0.5, -0.5) ELSE pow(t, 0.5) END, 9) AS slope FROM x"""
)
def loss_values(spark, d):
    t = (F.col("l_quantity") / 50.0).cast("double")
    x = v.table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.round(text.loss_value(t), 9).alias("plain"), F.round(text.loss_value(t, 1.5, 0.5), 9).alias("huber"), F.round(text.loss_gradient(t, 1.5, 0.5), 9).alias("slope"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'customer, ann' || (c_custkey % 7) ELSE lower(replace(c_name, '#', ' no ')) END AS name FROM customer")
def normal_names(spark, d):
    """Names with brackets, capitals, suffixes again and again and words the other way round, set right."""
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    number = (F.col("id") % 7).cast("string")
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("ANN"), number, F.lit(" Customer MD PhD MD (e) <x>"))).otherwise(F.concat(F.col("c_name"), F.lit(" phd [B6]")))
    named = c.withColumn("name", text.reorder_name(text.normalise_name(raw, [("(e)", ""), ("#", " no ")], [" md", " phd"])))
    return named.select("id", "name")


@query("SELECT label AS org, count(*)::BIGINT AS size FROM (SELECT s_nationkey AS label FROM supplier) GROUP BY label")
def label_sizes(spark, d):
    return v.persons(spark, d).groupBy("org").agg(F.count("*").alias("size"))


@query(f"{G} SELECT dst AS id, sum(w)::BIGINT AS score, row_number() OVER (ORDER BY sum(w) DESC, dst)::BIGINT AS rank FROM a GROUP BY dst")
def full_ranking(spark, d):
    """Everyone's place by weighted degree."""
    return graphs.ranking(graphs.weighted_degree(graph(spark, d)).withColumnRenamed("degree", "score"))


@query("WITH s AS (SELECT s_suppkey AS id, k AS sweep, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN 1 ELSE k % 2 END AS side FROM supplier, range(3) t(k)) SELECT id FROM s GROUP BY id HAVING sum(side) > 0 AND sum(side) < count(*)")
def side_changes(spark, d):
    p = v.persons(spark, d).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sweep"))
    side = F.when(F.col("id") % 4 == 0, 0).when(F.col("id") % 4 == 1, 1).otherwise(F.col("sweep") % 2)
    return messages.side_changes(p.withColumn("side", side))
