"""Readers and writers of the exchange formats: digests, graphs, hypergraphs, day sequences, tensors, pages of text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.iterate import cut

MESSAGE = "struct<sender:int,recipients:array<int>,cc:array<int>,subject:string,body:string,time:string>"
DIGEST = f"emails array<array<{MESSAGE}>>, names array<string>, clusters array<int>, cluster_names array<string>"
GRAPH = "vertices int, edges int, edgedata array<double>, labels array<string>, orgs array<int>"
HYPERGRAPH = "vertices int, hyperedges int, incidences int, hyperedgedata array<int>, weights array<double>, labels array<string>, orgs array<int>"
SEQUENCE = "vertices int, graphs int, sequencedata array<struct<edges:int,edgedata:array<double>>>, dates array<string>, labels array<string>, orgs array<int>"
TENSOR = "dimensions array<array<int>>, num_entries array<int>, entries array<array<double>>, names array<string>, clusters array<int>"
TENSOR4 = "indices array<array<int>>, values array<double>, names array<string>, words array<string>, dates array<string>, description string"
PRODUCTS = "modularity array<int>, ncut array<int>, cond array<int>, spectral array<int>, xy array<array<double>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_digest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages (thread, pos from 1 = newest, sender, recipients, cc, subject, body, ts) and people (id, name, org)."""
    d = _json(spark, path, DIGEST)
    threads = d.select(F.posexplode("emails").alias("thread", "mails"))
    m = threads.select("thread", F.posexplode("mails").alias("pos", "m")).select("thread", (F.col("pos") + 1).alias("pos"), "m.*")
    m = m.withColumn("ts", F.substring("time", 1, 19).cast("timestamp_ntz")).withColumn("msg_id", F.col("thread").cast("long") * 1_000_000 + F.col("pos"))
    return m, _people(d, "names", "clusters")


def _people(d: DataFrame, names: str, orgs: str) -> DataFrame:
    return d.select(F.posexplode(F.arrays_zip(F.col(names).alias("name"), F.col(orgs).alias("org"))).alias("id", "p")).select("id", F.col("p")["name"].alias("name"), F.col("p")["org"].alias("org"))


def _chunks(column: str, width: int):
    """Rows of ``width`` numbers from a flat array."""
    n = (F.size(column) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(column), i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<double>>"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (id, name, org) and edges (src, dst, w); repeated entries add up."""
    d = _json(spark, path, GRAPH)
    e = d.select(F.explode(_chunks("edgedata", 3)).alias("x")).select(F.col("x")[0].cast("int").alias("src"), F.col("x")[1].cast("int").alias("dst"), F.col("x")[2].alias("w"))
    return _people(d, "labels", "orgs"), e.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """id, modularity, ncut, cond, spectral of each node."""
    d = _json(spark, path, PRODUCTS)
    names = ("modularity", "ncut", "cond", "spectral")
    return d.select(F.posexplode(F.arrays_zip(*names)).alias("id", "p")).select("id", *[F.col("p")[n].alias(n) for n in names])


def read_graph_with_products(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A graph and, by the naming convention beside it, its simple and weighted products."""
    stem = path.removesuffix(".json")
    return (*read_graph(spark, path), read_products(spark, f"{stem}-products-simple.json"), read_products(spark, f"{stem}-products-weighted.json"))


def read_sequence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices and tedges (day, src, dst, w), directed."""
    d = _json(spark, path, SEQUENCE)
    s = d.select(F.explode(F.arrays_zip("dates", "sequencedata")).alias("z")).select(F.to_date("z.dates").alias("day"), F.col("z.sequencedata.edgedata").alias("edgedata"))
    e = s.select("day", F.explode(_chunks("edgedata", 3)).alias("x")).select("day", F.col("x")[0].cast("int").alias("src"), F.col("x")[1].cast("int").alias("dst"), F.col("x")[2].alias("w"))
    return _people(d, "labels", "orgs"), e


def read_hypergraph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices, incidence (edge_id, node_id) and weights (edge_id, weight)."""
    d = _json(spark, path, HYPERGRAPH)
    pairs = d.select(F.col("hyperedgedata").cast("array<double>").alias("hyperedgedata"), "weights", "labels", "orgs")
    inc = pairs.select(F.explode(_chunks("hyperedgedata", 2)).alias("x")).select(F.col("x")[0].cast("int").alias("edge_id"), F.col("x")[1].cast("int").alias("node_id")).distinct()
    first = F.when((F.col("vertices") == 0) & (F.size("hyperedgedata") > 0), F.col("hyperedgedata")[0]).otherwise(0)  # of an object that is a range
    weights = d.select(first.alias("_first"), F.posexplode("weights").alias("_at", "weight")).select((F.col("_first") + F.col("_at")).alias("edge_id"), "weight")
    return _people(d, "labels", "orgs"), inc, weights


def read_tensor3(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    d = _json(spark, path, TENSOR)
    e = d.select(F.explode("entries").alias("x")).select(*[F.col("x")[i].cast("int").alias(c) for i, c in enumerate("crs")], F.col("x")[3].alias("v"))
    return _people(d, "names", "clusters"), e


def read_tensor4(spark: SparkSession, path: str) -> DataFrame:
    """i, j, day, word, v and seq (order of writing: repeated indices are legal)."""
    d = _json(spark, path, TENSOR4)
    z = d.select(F.posexplode(F.arrays_zip("indices", "values")).alias("seq", "z"))
    return z.select("seq", *[F.col("z.indices")[i].alias(c) for i, c in enumerate(("i", "j", "day", "word"))], F.col("z.values").alias("v"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, page, line of text files; a form feed begins a page.

    A file is split where it was read; order inside it comes from positions in the row, not from partitions."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page", F.sum(F.col("line").startswith("\f").cast("int")).over(w)).withColumn("line", F.regexp_replace("line", "^\f", ""))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """thread, pos (from a folder named thread-position) and the text of each correction file."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    at = r"/(\d+)-(\d+)/([^/]+)$"
    return t.select(F.regexp_extract("file", at, 1).cast("int").alias("thread"), F.regexp_extract("file", at, 2).cast("int").alias("pos"), F.regexp_extract("file", at, 3).alias("name"), F.col("value").alias("text")).filter("name <> ''")


def read_labelled_hypergraph(spark: SparkSession, incidence: str, labels: str, least: int = 0, most: int | None = None, most_cond: float | None = None, delta: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Parquet incidence and labels (node_id, label) of the clusters of ``least`` to ``most`` nodes, and of a threshold-linear
    conductance of at most ``most_cond``."""
    from ..operators.hypergraphs import tl_cut

    inc, lab = spark.read.parquet(incidence), spark.read.parquet(labels)
    size = lab.groupBy("label").count().filter(F.col("count") >= least)
    if most is not None:
        size = size.filter(F.col("count") <= most)
    kept = lab.join(size, "label", "left_semi")
    if most_cond is not None:
        kept = kept.join(tl_cut(inc, kept.select("node_id", "label"), delta).filter(F.col("cond") <= most_cond), "label", "left_semi")
    return inc, kept


def read_word_model(spark: SparkSession, path: str) -> DataFrame:
    """word, vector (array of floats) of a saved Word2Vec model."""
    from pyspark.ml.feature import Word2VecModel
    from pyspark.ml.functions import vector_to_array

    return Word2VecModel.load(path).getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class TooLarge(ValueError):
    """A single-file export of more rows than a driver should hold."""


def _small(df: DataFrame, most: int = 2_000_000) -> list:
    if df.count() > most:
        raise TooLarge(f"over {most} rows: write Parquet instead")
    return df.collect()


def _parts(rows: DataFrame, order: list[str], schema: str, one: Callable[[pd.DataFrame], tuple], each: int) -> DataFrame:
    """An object for each range of about ``each`` rows in ``order``; equal values of the first column stay together."""
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches):
        held = [b for b in batches if len(b)]
        if held:
            yield pd.DataFrame([one(pd.concat(held, ignore_index=True))], columns=names)

    return rows.repartitionByRange(max(1, -(-rows.count() // each)), order[0]).sortWithinPartitions(*order).mapInPandas(pack, schema)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, most: int = 2_000_000) -> None:
    """One JSON object in ``path``, entries sorted by (dst, src). Ids must be dense. Over ``most`` entries the folder has an object with the
    vertices, and one for each range of entries (its ``vertices`` is 0); readers put them together."""
    people = sorted(_small(vertices), key=lambda r: r.id)
    names, orgs = [p.name for p in people], [p.org for p in people]
    edges = cut(edges.select("src", "dst", F.col("w").cast("double")))
    if edges.count() > most:
        _write_object(edges.sparkSession, path, GRAPH, (len(people), 0, [], names, orgs))
        _parts(edges, ["dst", "src"], GRAPH, lambda x: (0, len(x), x[["src", "dst", "w"]].to_numpy(float).ravel(), [], []), min(most, 250_000)).write.mode("append").json(path)
        return
    rows = sorted(_small(edges, most), key=lambda r: (r.dst, r.src))
    flat = [float(x) for r in rows for x in (r.src, r.dst, r.w)]
    _write_object(edges.sparkSession, path, GRAPH, (len(people), len(rows), flat, names, orgs))


def write_hypergraph(vertices: DataFrame, incidence: DataFrame, weights: DataFrame, path: str, most: int = 2_000_000) -> None:
    """As ``write_graph``; a range has whole hyperedges (each with a node), and weights from its first one on."""
    people = sorted(_small(vertices), key=lambda r: r.id)
    names, orgs = [p.name for p in people], [p.org for p in people]
    incidence = cut(incidence.select("edge_id", "node_id"))
    if incidence.count() > most:
        _write_object(incidence.sparkSession, path, HYPERGRAPH, (len(people), 0, 0, [], [], names, orgs))

        def one(x):
            w = x.drop_duplicates("edge_id")["weight"].to_numpy(float)
            return 0, len(w), len(x), x[["edge_id", "node_id"]].to_numpy(np.int32).ravel(), w, [], []

        both = incidence.join(weights.select("edge_id", "weight"), "edge_id")
        _parts(both, ["edge_id", "node_id"], HYPERGRAPH, one, min(most, 250_000)).write.mode("append").json(path)
        return
    w = sorted(_small(weights), key=lambda r: r.edge_id)
    rows = sorted(_small(incidence, most), key=lambda r: (r.edge_id, r.node_id))
    _write_object(incidence.sparkSession, path, HYPERGRAPH, (len(people), len(w), len(rows), [x for r in rows for x in (r.edge_id, r.node_id)], [float(r.weight) for r in w], names, orgs))


def write_sequence(vertices: DataFrame, tedges: DataFrame, path: str) -> None:
    people = sorted(_small(vertices), key=lambda r: r.id)
    days: dict = {}
    for r in sorted(_small(tedges), key=lambda r: (r.day, r.dst, r.src)):
        days.setdefault(r.day, []).extend((float(r.src), float(r.dst), float(r.w)))
    data = [(len(v) // 3, v) for v in days.values()]
    _write_object(tedges.sparkSession, path, SEQUENCE, (len(people), len(days), data, [d.isoformat() for d in days], [p.name for p in people], [p.org for p in people]))


def write_tensor3(vertices: DataFrame, tensor: DataFrame, path: str) -> None:
    people = sorted(_small(vertices), key=lambda r: r.id)
    rows = sorted(_small(tensor), key=lambda r: (r.c, r.r, r.s))
    n = len(people)
    _write_object(tensor.sparkSession, path, TENSOR, ([[n, n, n]], [len(rows)], [[float(r.c), float(r.r), float(r.s), float(r.v)] for r in rows], [p.name for p in people], [p.org for p in people]))


def write_tensor4(entries: DataFrame, path: str) -> None:
    rows = sorted(_small(entries), key=lambda r: r.seq)
    _write_object(entries.sparkSession, path, TENSOR4, ([[r.i, r.j, r.day, r.word] for r in rows], [float(r.v) for r in rows], [], [], [], ""))


def write_products(products: DataFrame, path: str) -> None:
    rows = sorted(_small(products), key=lambda r: r.id)
    _write_object(products.sparkSession, path, PRODUCTS, (*[[int(r[n]) for r in rows] for n in ("modularity", "ncut", "cond", "spectral")], []))


def _write_object(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def write_days(tedges: DataFrame, path: str) -> None:
    """The scalable form: Parquet by day."""
    tedges.repartition("day").sortWithinPartitions("dst", "src").write.mode("overwrite").partitionBy("day").parquet(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    clusters.write.mode("overwrite").parquet(path)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """src < dst, tab-separated."""
    edges.filter("src < dst").select("src", "dst").write.mode("overwrite").csv(path, sep="\t")


def write_vocabulary(words: DataFrame, path: str) -> None:
    words.select("word").distinct().orderBy("word").write.mode("overwrite").text(path)


def write_audit(records: DataFrame, path: str) -> None:
    """One text a record under thread=.../pos=..."""
    records.select("thread", "pos", F.col("text").alias("value")).write.mode("overwrite").partitionBy("thread", "pos").text(path)
