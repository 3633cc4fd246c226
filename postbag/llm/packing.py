"""Best-fit packing of documents into fixed-length sequences by bulk-synchronous supersteps.

Documents and gaps stand on one axis, sorted by size. A superstep sweeps it and
gives each gap the largest document that isn't matched yet and fits (so each
document gets its successor among the gaps); where many documents or gaps have
the same size, the k-th of one takes the k-th of the other by rank. All gaps
shrink at once and the next superstep begins. Sequences open for documents of
more than half a sequence first, later for as many of the largest left over as
the tokens left over fill.

Sizes are whole numbers up to the capacity and equal sizes are interchangeable,
so the sweep needs only runs of equal sizes: the supersteps work on a table
whose size is bounded by the capacity (thousands of rows), however many documents
there are, and the ranks that turn runs into documents are made in parallel."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches, word_encoder
from .ranks import hash_bucket, running_base

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of each document's ids (then ``end_id``): only those over ``capacity`` are cut, at its multiples."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.rows(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    for column, value in zip(out, (doc_id, k, a, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def superstep(left: dict[int, list[list[int]]], gaps: dict[int, list[list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """One sweep. ``left``: by length, runs [first rank, count]; ``gaps``: by room, runs
    [first sequence, count]. Matched runs leave both; returns (length, first rank, count, first sequence, room)."""
    matched, stack = [], []
    for size in sorted({*left, *gaps}):
        stack += [(size, run) for run in reversed(left.get(size, []))]
        for gap in gaps.get(size, []):
            while gap[1] and stack:
                length, run = stack[-1]
                n = min(gap[1], run[1])
                matched.append((length, run[0], n, gap[0], size))
                run[0], run[1], gap[0], gap[1] = run[0] + n, run[1] - n, gap[0] + n, gap[1] - n
                if not run[1]:
                    stack.pop()
    for table in (left, gaps):
        for size in list(table):
            table[size] = [r for r in table[size] if r[1]]
            if not table[size]:
                del table[size]
    return matched


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece."""
    left = {size: [[0, n]] for size, n in counts.items() if n}
    gaps: dict[int, list[list[int]]] = {}
    placed, opened = [], 0

    def join(runs) -> None:
        fresh = defaultdict(list)
        for length, rank, n, seq, room in runs:
            placed.append((length, rank, n, seq, capacity - room))
            if room > length:
                fresh[room - length].append([seq, n])
        for room, more in fresh.items():  # neighbours become one run again
            runs = sorted(gaps.get(room, []) + more)
            whole = [runs[0]]
            for r in runs[1:]:
                if whole[-1][0] + whole[-1][1] == r[0]:
                    whole[-1][1] += r[1]
                else:
                    whole.append(r)
            gaps[room] = whole

    def open_for(length: int, most: int) -> int:
        nonlocal opened
        took = 0
        while took < most and left.get(length):
            run = left[length][0]
            n = min(run[1], most - took)
            join([(length, run[0], n, opened, capacity)])
            opened, took = opened + n, took + n
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                left[length].pop(0)
        if not left.get(length):
            left.pop(length, None)
        return took

    for length in [x for x in left if 2 * x > capacity]:
        open_for(length, counts[length])
    while left:
        while runs := superstep(left, gaps):
            join(runs)
        need = -(-sum(size * r[1] for size, rs in left.items() for r in rs) // capacity)
        for length in sorted(left, reverse=True):
            if need <= 0:
                break
            need -= open_for(length, need)
    return placed


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (length from 1 to ``capacity``, and
    doc_id and piece to order equal lengths by). Gapless in each sequence; other
    columns stay. ``pieces`` must give the same rows each time it is read. Repeated
    rows are pieces of their own; an empty table stays empty."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = defaultdict(list)
    for length, rank, n, seq, offset in plan(counts, capacity):
        runs[length].append((rank, rank + n, seq, offset))
    table = spark.createDataFrame([(k, sorted(v)) for k, v in runs.items()], "_length long, _runs array<struct<a:long,b:long,seq:long,offset:long>>")
    ranked = running_base(pieces, ["length"], hash_bucket(["doc_id", "piece"], sum(counts.values())), ["doc_id", "piece"], F.lit(1), "_rank")
    at = F.element_at(F.filter("_runs", lambda r: (r["a"] <= F.col("_rank")) & (F.col("_rank") < r["b"])), 1)
    found = ranked.join(F.broadcast(table), F.col("length") == F.col("_length")).withColumn("_at", at)
    return found.withColumns({"sequence_id": F.col("_at.seq") + F.col("_rank") - F.col("_at.a"), "offset": F.col("_at.offset")}).drop("_rank", "_at", "_runs", "_length")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack ``doc_id, text`` into sequences of at most ``capacity`` ids: a row a piece with
    doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null or
    empty text is its end id alone; repeated rows and null doc_ids are packed
    like any other; other columns are not read."""
    return pack(keep(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
