"""Mixing sources to target weights with DataFrame functions alone.

Each source lies end to end in a seeded random order of its documents and is
cut into blocks; a pass takes a source's blocks at most once. A source's exact
quota of blocks (whole passes first) is split among output shards by a tree: at
each node a multivariate hypergeometric draw says how much of every source's
quota goes to the left half. Shards then own disjoint ranges of the permuted
blocks and order their own draws by a seeded key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WORD, keep
from .ranks import running_base


#: Sources that the tree on the driver takes (a number a shard and source), and blocks in all.
MOST_SOURCES, MOST_BLOCKS = 1_000_000, 1 << 29


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size and target of each source of ``source, size``.

    Sources by code point (null last) weigh ``weights`` in turn and share the sum
    of all sizes; a target above ``most`` times its source is held there and the
    excess shared again by weight until none is above. That end state is one
    level: each target is min(most x size, level x weight), so sources sorted by
    size / weight fill up in order and running sums give the level."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = Window.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))  # a row a source
    turn = F.row_number().over(w) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    full = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.asc_nulls_last(F.col("source").cast("binary")))
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    capped = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    level = weighed.withColumn("_level", (total - capped) / F.sum("weight").over(after))
    # the level of the first source that isn't filled up holds for it and all after it
    free = F.col("source_size") * most > F.col("_level") * F.col("weight")
    level = level.withColumn("_level", F.first(F.when(free, F.col("_level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("source_size") * F.lit(float(most)), F.col("_level") * F.col("weight")), F.col("source_size") * F.lit(float(most)))
    return level.select("source", "source_size", target.alias("target"))


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Per shard, blocks of each source: a binary tree of multivariate hypergeometric
    splits. Rows sum to equal shares (up to one block), columns to ``quotas`` exactly. The generator's draws are
    exact up to 10^9 blocks and refused beyond."""
    rng = np.random.default_rng(seed)

    def down(left: list[int], n: int) -> list[list[int]]:
        if n == 1:
            return [left]
        total, half = sum(left), n // 2
        draw, rest, out = total * half // n, total, []
        for q in left:  # one source after the other: hypergeometric given what is still to draw
            rest -= q
            x = int(rng.hypergeometric(q, rest, draw))
            out.append(x)
            draw -= x
        return down(out, half) + down([a - b for a, b in zip(left, out, strict=True)], n - half)

    return down(list(quotas), shards)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 16, block_words: int = 1024, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mix ``doc_id, source, text``. Returns the documents (doc_id, source,
    size, source_size, target, taken) and the draws: doc_id, source, pass,
    first_word and words (the span of the document's words), shard and place.

    A source's passes lie end to end and are cut into blocks of ``block_words`` words (or as many more as make
    2^29 blocks in all, since draws are exact below 10^9); the last block ends
    with the quota, the target to the nearest whole number. Each shard owns a range of
    a source's blocks, as many as the splitting tree gives it, and draws the words in them:
    a document across the end of a range is cut there and goes to both shards.
    ``taken`` is how many words all draws of a document have, at most ``most`` times its size.
    The order is by a hash of seed and doc_id: reruns agree, whatever the partitions.
    A null text has no words and takes 0; a null source is a source of its own,
    last. Repeated rows count each. Sources without words get target 0. An empty
    table gives empty results. Draws of docs that have row keys (``with_row_keys``) have them too.
    Other columns are not read."""
    spark = docs.sparkSession
    row = [ROW] if ROW in docs.columns else []
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = keep(docs.select(*row, F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), key.alias("_key"), F.xxhash64("text").alias("_text_key")), "sizes")
    targets = keep(source_targets(sized, weights, most).withColumn("_quota", F.round("target").cast("long")), "targets")
    rows = sized.count()
    digits = 0
    while 16**digits * 4000 < rows:
        digits += 1
    laid = running_base(sized, ["source"], F.substring("_key", 1, digits), ["_key", "doc_id", "size", "_text_key", *row], F.col("size"), "_start")
    order = F.asc_nulls_last(F.col("source").cast("binary"))
    n_sources, words = targets.agg(F.count("*"), F.coalesce(F.sum("_quota"), F.lit(0))).first()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources; at most {MOST_SOURCES} fit the tree on the driver")
    block_words = max(block_words, -(-words // MOST_BLOCKS))
    sources = targets.orderBy(order).collect()  # a row a source
    blocks = np.cumsum(np.array(split_quotas([-(-r["_quota"] // block_words) for r in sources], shards, seed), dtype=np.int64).reshape(shards, len(sources)), axis=0)
    # the words at which the ranges of shards end
    ends = [(r["source"], r["source_size"], r["target"], [0, *(min(int(b) * block_words, r["_quota"]) for b in blocks[:, i])]) for i, r in enumerate(sources)]
    ranges = spark.createDataFrame(ends, "source string, source_size long, target double, _ends array<long>").alias("b")
    placed = laid.alias("a").join(F.broadcast(ranges) if len(sources) <= 10_000 else ranges, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target", "b._ends")

    def spans(p: int) -> Column:
        begin = F.col("source_size") * p + F.col("_start")

        def span(s: int) -> Column:
            a = F.greatest(F.element_at("_ends", s + 1), begin)
            b = F.least(F.element_at("_ends", s + 2), begin + F.col("size"))
            return F.struct(F.lit(p).alias("pass"), (a - begin).alias("first_word"), (b - a).alias("words"), F.lit(s).alias("shard"))

        return F.filter(F.array(*map(span, range(shards))), lambda x: x["words"] > 0)

    taken = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    done = placed.withColumn("_spans", F.concat(*map(spans, range(most)))).withColumn("taken", taken)
    draws = done.select(*row, "doc_id", "source", "_key", "_text_key", F.explode("_spans").alias("_s"))
    place = F.xxhash64("_key", "_text_key", "_s.pass", "_s.first_word", F.lit(seed))
    draws = draws.select(*row, "doc_id", "source", "_s.pass", "_s.first_word", "_s.words", "_s.shard", place.alias("place"))
    return done.drop("_spans", "_key", "_text_key", "_start", "_ends", *row), draws


def shuffle_locally(draws: DataFrame) -> DataFrame:
    """The draws with each shard's rows together, in the shard's own random order."""
    return draws.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
