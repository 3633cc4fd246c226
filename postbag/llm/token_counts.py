"""Token counts of flat, unindexed token files by a scan for the end-of-document id.

Files are read in blocks of fixed size, each by itself: one vectorised search
finds the separators in a block. A document that runs over block or file ends
is stitched by prefix scans over the block table: a prefix sum of ids gives a
block's place, a running maximum of the last separator gives where the document
that is open at its start began, and a prefix sum of separators numbers documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, keep

_SCAN = "file_rank long, block long, n long, seps array<int>"


def scan_blocks(files: DataFrame, end_id: int, block_ids: int = 1 << 21) -> DataFrame:
    """One row a block of ``files`` (file_rank, path, width, n_tokens): its ids ``n`` and
    the places ``seps`` of the separators in it."""
    blocks = files.select("file_rank", "path", "width", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / block_ids))).alias("block")).filter("n_tokens > 0")
    count = files.agg(F.sum(F.ceil(F.col("n_tokens") / block_ids))).first()[0] or 1
    schema = pa.schema([("file_rank", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("seps", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = file_system(row["path"])
                at, width = row["block"] * block_ids, row["width"]
                with fs.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(min(block_ids, row["n_tokens"] - at) * width, at * width), dtype=f"<u{width}")
                seps = np.flatnonzero(ids == end_id).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["file_rank"]]), pa.array([row["block"]]), pa.array([len(ids)], pa.int64()), pa.array([seps], pa.list_(pa.int32()))], schema=schema)

    return blocks.repartition(int(count)).mapInArrow(scan, _SCAN)


def count_tokens(files: DataFrame, end_id: int, block_ids: int = 1 << 21) -> DataFrame:
    """Documents of flat token files, in file order, from their separators alone.

    ``files``: file_rank long (their order, distinct), path string, width int
    (bytes an id) and n_tokens long. Returns for each document: ordinal (from
    0), start (ids before it), n_tokens (with its separator), file_rank and
    ix (which of the documents that end in that file), and ended. Ids after
    the last separator are one document with ended false. Documents without
    ids but for the separator count 1. No files or empty files: no rows. A
    null path or rank isn't allowed."""
    scan = keep(scan_blocks(files, end_id, block_ids), "scan")
    by_file, so_far = Window.partitionBy("file_rank").orderBy("block"), (Window.unboundedPreceding, -1)
    # within a file, then over files: no window holds all blocks
    local = scan.select("file_rank", "block", "n", "seps", F.size("seps").alias("k"), F.coalesce(F.sum("n").over(by_file.rowsBetween(*so_far)), F.lit(0)).alias("at"), F.coalesce(F.sum(F.size("seps")).over(by_file.rowsBetween(*so_far)), F.lit(0)).alias("ix0"))
    local = local.withColumn("last", F.when(F.col("k") > 0, F.col("at") + F.element_at("seps", -1) + 1))
    local = local.withColumn("open", F.max("last").over(by_file.rowsBetween(*so_far)))
    totals = local.groupBy("file_rank").agg(F.sum("n").alias("n_ids"), F.sum("k").alias("n_seps"), F.max("last").alias("file_last"))
    over = Window.orderBy("file_rank").rowsBetween(*so_far)  # a row a file
    totals = totals.withColumns({"base": F.coalesce(F.sum("n_ids").over(over), F.lit(0)), "doc_base": F.coalesce(F.sum("n_seps").over(over), F.lit(0))})
    totals = totals.withColumn("file_open", F.coalesce(F.max(F.col("base") + F.col("file_last")).over(over), F.lit(0)))
    bases = totals.select("file_rank", "base", "doc_base", "file_open")
    placed = local.join(bases, "file_rank").withColumn("from", F.coalesce(F.col("base") + F.col("open"), F.col("file_open")))
    docs = placed.select("file_rank", "base", "at", "seps", "from", "ix0", "doc_base", F.posexplode("seps").alias("j", "sep"))
    docs = docs.withColumn("start", F.when(F.col("j") == 0, F.col("from")).otherwise(F.col("base") + F.col("at") + F.element_at("seps", F.greatest(F.col("j"), F.lit(1))) + 1))
    ended = docs.select((F.col("doc_base") + F.col("ix0") + F.col("j")).alias("ordinal"), "start", (F.col("base") + F.col("at") + F.col("sep") + 1 - F.col("start")).alias("n_tokens"), "file_rank", (F.col("ix0") + F.col("j")).alias("ix"), F.lit(True).alias("ended"))
    end = totals.agg(F.sum("n_ids").alias("n"), F.sum("n_seps").alias("ordinal"), F.coalesce(F.max(F.col("base") + F.col("file_last")), F.lit(0)).alias("start"), F.max("file_rank").alias("file_rank"))
    rest = end.filter(F.col("n") > F.col("start")).select("ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), "file_rank", F.lit(None).cast("long").alias("ix"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)
