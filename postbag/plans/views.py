"""Communication views of the driver's tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINE_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages from the first line's supplier to those of the other lines (returned lines: copied), threads by customer, newest first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    # the least line sends, so sides need one aggregate and no window: the sorted lines are a row's own array
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_LINE_ORDER).alias("line"))
    sides = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    rest = F.slice("lines", F.lit(2), F.size("lines"))
    pick = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(rest, c), lambda x: x["l_suppkey"])))
    sides = sides.select("l_orderkey", F.col("lines")[0]["l_suppkey"].alias("sender"), pick(lambda x: x["l_returnflag"] != "R").alias("recipients"), pick(lambda x: x["l_returnflag"] == "R").alias("cc"))
    joined = orders.join(sides, orders.o_orderkey == sides.l_orderkey)
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return joined.select(F.col("o_orderkey").alias("msg_id"), F.col("o_custkey").alias("thread"), pos.alias("pos"), F.col("o_orderdate").alias("ts"), "sender", "recipients", "cc")


def msg_sql() -> str:
    return f"""
lin AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) AS rn FROM lineitem),
sid AS (SELECT l_orderkey, max(l_suppkey) FILTER (rn = 1) AS sender,
  coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (rn > 1 AND l_returnflag <> 'R')), []) AS recipients,
  coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (rn > 1 AND l_returnflag = 'R')), []) AS cc FROM lin GROUP BY l_orderkey),
msg AS (SELECT o_orderkey AS msg_id, o_custkey AS thread, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos,
  o_orderdate AS ts, sender, recipients, cc FROM orders JOIN sid ON l_orderkey = o_orderkey)"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("org"))


PERSON_SQL = "person AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS org FROM supplier)"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hyperedges over parts: distinct (edge_id, node_id)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id")).distinct()


BASKET_SQL = "basket AS (SELECT DISTINCT l_orderkey AS edge_id, l_partkey AS node_id FROM lineitem)"


def supplier_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as hyperedges over suppliers."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_suppkey").alias("node_id")).distinct()


SUPPLIER_BASKET_SQL = "basket AS (SELECT DISTINCT l_orderkey AS edge_id, l_suppkey AS node_id FROM lineitem)"


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, src, dst, w: consecutive events of equal k on a day link their users."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    w = Window.partitionBy(F.to_date("ts"), "k").orderBy("ts", "event_id")
    linked = e.select(F.to_date("ts").alias("day"), F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).filter("dst is not null")
    return linked.groupBy("day", "src", "dst").agg(F.count("*").alias("w"))


EVENT_SQL = """
evs AS (SELECT CAST(ts AS DATE) AS day, user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE), CAST(json_extract_string(props, '$.k') AS INT) ORDER BY ts, event_id) AS dst FROM events),
ev AS (SELECT day, src, dst, count(*) AS w FROM evs WHERE dst IS NOT NULL GROUP BY ALL)"""
