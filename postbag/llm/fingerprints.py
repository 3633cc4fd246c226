"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions alone.

Each paragraph hashes to a wide vector and a text's vector is the sum of them
modulo 2**32 in every lane. So the order of paragraphs doesn't matter, and a
paragraph is put in or taken out by adding or subtracting its own vector. The
lanes: the count of paragraphs; ``DENSE`` lanes that every paragraph adds to,
which settle equality; and strata of ``CELLS`` cells, for likeness: a paragraph adds to one cell of
stratum s with probability 2**-(s+1). The difference of two vectors is the
vector of the symmetric difference, and the share of cells that are not zero from
the first stratum on that isn't crowded gives its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

DENSE = 8
#: Cells of each stratum, powers of two from eight on: many where the difference of texts of common lengths falls.
CELLS = (64, 64, 32, 32, 32, 16, 16, 16, 16, 16)
MASK = (1 << 32) - 1
#: A paragraph ends at a line end or, so that a likeness can tell parts of long paragraphs apart, at a sentence end.
PARAGRAPH_END = r"[\n\r]+|(?<=[.!?])[ \t]+"


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def _bit(s: int, value: int):
    return lambda x: F.shiftright(x, s).bitwiseAND(F.lit(1)) == value


def _paragraphs(text: Column, separator: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda p: p != "")


def _cell_sums(hashes: Column, n: int, total) -> Column:
    """The sums of the high halves of hashes in each of ``n`` cells: an eighth of the cells first, so that each cell looks through an eighth."""
    each = (n // 8).bit_length() - 1
    cell = lambda x: F.shiftrightunsigned(x, 12).bitwiseAND(F.lit(n - 1))
    placed = F.transform(hashes, lambda x: F.shiftleft(cell(x), 32).bitwiseOR(F.shiftrightunsigned(x, 32)))  # cell above, value below
    eighths = lambda xs: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.filter(xs, lambda x: F.shiftrightunsigned(x, 32 + each) == k))
    none = lambda m: F.array_repeat(F.lit(0).cast("bigint"), m)  # noqa: E731  most are empty
    sums = lambda xs, k: F.transform(F.sequence(k * (1 << each), k * (1 << each) + F.lit((1 << each) - 1)), lambda c: total(F.filter(xs, lambda x: F.shiftrightunsigned(x, 32) == c), _low))
    inside = lambda xs, k: F.when(F.size(xs) == 0, none(1 << each)).otherwise(sums(xs, k))
    whole = lambda xs: F.when(F.size(xs) == 0, none(n)).otherwise(F.flatten(F.transform(eighths(xs), inside)))
    return F.flatten(F.transform(F.array(placed), whole))


def fingerprint(text: Column, separator: str = PARAGRAPH_END) -> Column:
    """The lanes (array<bigint>, each from 0 to 2**32 - 1) of a text; a null is like an empty text: all zero.
    Empty paragraphs count nothing."""
    # a paragraph is hashed anew for each pair of dense lanes, with another seed before it: no 64-bit state is common to all lanes
    wide = F.transform(_paragraphs(text, separator), lambda p: F.array(F.xxhash64(p), *[F.xxhash64(F.lit(i), p) for i in range(DENSE // 2)]))

    def of(rows: Column) -> Column:
        def total(xs: Column, value) -> Column:
            return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: _low(a + value(x)))

        dense = []
        for i in range(1, DENSE // 2 + 1):
            dense.append(F.array(total(rows, lambda w, i=i: _low(w[i])), total(rows, lambda w, i=i: F.shiftrightunsigned(w[i], 32))))
        # stratum: trailing one bits; cell: the next bits; value: the high half
        cells = []
        rest = F.transform(rows, lambda w: w[0])
        for s, n in enumerate(CELLS):
            own, rest = (F.filter(rest, _bit(s, 0)), F.filter(rest, _bit(s, 1))) if s < len(CELLS) - 1 else (rest, rest)
            cells.append(_cell_sums(own, n, total))
        return F.concat(F.array(F.size(rows).cast("bigint")), *dense, *cells)

    return F.transform(F.array(wide), of).getItem(0)


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: _low(x + y))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` with the paragraphs of ``b`` taken out."""
    return F.zip_with(a, b, lambda x, y: _low(x - y + F.lit(1 << 32)))


def as_text(lanes: Column) -> Column:
    """Eight hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two texts' paragraph multisets, 0 to 1; exactly 1 if and
    (but for collisions of the dense lanes) only if they are equal."""
    first = 1 + DENSE
    used, at = [], first + 1
    for n in CELLS:
        used.append(F.size(F.filter(F.zip_with(F.slice(a, at, n), F.slice(b, at, n), lambda x, y: x != y), lambda x: x)).cast("double"))
        at += n
    sizes = F.array(*[F.lit(float(n)) for n in CELLS])

    def estimate(used: Column) -> Column:
        # strata from the first that is at most two thirds full: all that they hold, scaled by their share
        start = F.coalesce(F.element_at(F.filter(F.sequence(F.lit(0), F.lit(len(CELLS) - 1)), lambda s: F.get(used, s) * 3 <= F.get(sizes, s) * 2), 1), F.lit(len(CELLS) - 1))
        each = F.zip_with(used, sizes, lambda u, n: n * F.log((n + 0.5) / (n + 0.5 - u)))
        return F.aggregate(F.slice(each, start + 1, len(CELLS)), F.lit(0.0), lambda t, x: t + x) * F.pow(F.lit(2.0), start.cast("double"))

    both = (F.get(a, F.lit(0)) + F.get(b, F.lit(0))).cast("double")
    apart = F.least(F.transform(F.array(F.array(*used)), estimate).getItem(0), both)
    raw = (both - apart) / (both + apart)
    same = F.slice(a, 1, first) == F.slice(b, 1, first)
    return F.when(same, F.lit(1.0)).otherwise(F.least(F.coalesce(F.greatest(raw, F.lit(0.0)), F.lit(0.0)), F.lit(0.999999)))


def with_next(docs: DataFrame, each: int = 2000) -> DataFrame:
    """Add ``next_text``: of the next row in ascending doc_id (nulls first, ties by text), after the last the first.

    Rows are dealt into ranges of doc_id by quantiles; a window looks ahead in
    each range, and the first text of each later range closes the gap, so that
    no window holds the table and texts are shuffled once."""
    seen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = seen.count()
    parts = min(65_536, max(1, -(-rows // each)))
    ids = seen.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), max(10_000, 4 * parts))).first()[0] if parts > 1 else []
    bounds = sorted(set(ids or []))
    step = max(1, int(len(bounds) ** 0.5))
    rough = [bounds[i] for i in range(step, len(bounds), step)]
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    upto = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    as_array = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(upto(as_array(rough)) * step + upto(F.get(F.array(*map(as_array, fine)), upto(as_array(rough)))))
    dealt = seen.withColumn("_b", bucket)
    by = (F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ahead = dealt.withColumns({"_n": F.lead(F.struct("text")).over(Window.partitionBy("_b").orderBy(*by))})
    heads = keep(dealt.groupBy("_b").agg(F.min_by("text", F.struct(F.col("doc_id").isNotNull(), "doc_id", F.col("text").isNotNull(), "text")).alias("_head")), "range-heads")
    ring = Window.orderBy("_b")  # a number a range, no texts
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("_b", F.coalesce(F.lead("_b").over(ring), F.first("_b").over(whole)).alias("_after"))
    follow = after.join(heads.select(F.col("_b").alias("_after"), F.col("_head").alias("_follow")), "_after").drop("_after")
    return ahead.join(follow, "_b").select("doc_id", "text", F.when(F.col("_n").isNull(), F.col("_follow")).otherwise(F.col("_n.text")).alias("next_text"))


def fingerprint_edits(docs: DataFrame, separator: str = PARAGRAPH_END) -> DataFrame:
    """For each row of ``doc_id, text``: its fingerprint, that of its edited text, and likenesses.

    Edited: the last floor(n_chars / 2) code points give way to the first as many (or
    all) of the next document. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty; empty texts are alike (1.0). A table of one row is its own next. Repeated
    rows are rows of their own. Other columns are not read."""
    pairs = with_next(docs)
    text, follow = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    a = pairs.select("doc_id", text.alias("text"), follow.alias("next_text"), F.length(text).alias("n_chars"))
    b = a.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    c = b.select("doc_id", F.col("n_chars").cast("long"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text"), separator).alias("_own"), fingerprint(F.col("edited"), separator).alias("_edited"), fingerprint(F.col("next_text"), separator).alias("_next"))
    return c.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"))
