"""N-gram Jaccard join as a grouped prefix join, with the classes that its links make.

1. Shingles are 64-bit hashes of word runs. A global order puts shingles of many
   documents last (classes of document counts, in a table of bounded size), the
   rest by hash. Two sets that are similar enough share a shingle in their
   prefixes under any such order.
2. Documents with identical sets are one member; members with identical prefixes
   and size collapse into one group. Only shingles in the prefixes of two
   groups or more make blocks, and of blocks with the same groups only the first in the order stays.
3. Pairs of groups in a block pass the size and position filters and a parity filter (1024 bits a set: the
   bits in which two differ bound their symmetric difference from below), all inside the join's
   condition; then they expand to pairs of members and are verified on whole sets.
4. A dense block would give every pair of its members. So each block first pairs
   all of it with one hub, then a large one with about MANY_HUBS of its groups; whatever the verified links already connect
   needs no further test, since it can't change a class. Blocks that still hold
   more than one class then pair across classes, large ones in tiles, and a pair comes out of the
   first block that both are in. No link that joins two classes is lost and no cap is used.
5. Links lie inside classes, so each member's links are counted there, on whole sets: a class that is large is cut
   into tiles, and a task multiplies the 0/1 matrices of a tile's two sides and sends on a count a member, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, lean, lean_group, mix, release, scratch, settle, shingle_sets, small_batches
from .components import min_label_components

#: Shingles of at least this many documents may be ordered last; the table of them holds at most HOT_LIMIT.
HOT_LEAST, HOT_LIMIT = 8, 1 << 18
#: Text bytes that one bucket of the count of shingles stands for.
BUCKET_BYTES = 24 << 20
#: Groups on a side of a tile of a block; shingles and sets on a side of a tile of a class.
TILE_GROUPS, TILE_SHINGLES, TILE_SETS = 4000, 250_000, 1000
#: A block of more groups than LARGE pairs with up to so many hubs, before it pairs across classes.
LARGE, MANY_HUBS = 1024, 128
#: So many of a group's earlier blocks go with each of its rows, so that a pair that meets in several comes out of one.
EARLIER = 32


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, bytes of equal weight together, which shuffle compression shrinks."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _bucketed(values: np.ndarray, counts: np.ndarray, span: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted values and their counts by bucket: equal ranges of [0, span)."""
    bounds = np.searchsorted(values, np.array([span * b // buckets for b in range(1, buckets)], np.uint64))
    for b, (v, c) in enumerate(zip(np.split(values, bounds), np.split(counts, bounds), strict=True)):
        if len(v):
            yield b, _pack(v), c.astype("<u4").tobytes()


def _count_map(arrays, span: int, buckets: int):
    """mapInArrow: pre-aggregated counts of the values that ``arrays(batch)`` yields, by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("vals", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            rows = list(_bucketed(v, c, span, buckets))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        held, n = [], 0
        for batch in batches:
            for s in arrays(batch):
                held.append(s)
                n += len(s)
                if n >= 1_500_000:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return lean(run)


def _counts(packed: DataFrame, least: int) -> DataFrame:
    """value, n of all values counted at least ``least`` times over all buckets."""

    def total(table: pa.Table) -> pa.Table:
        v = np.concatenate([_unpack(x.as_py()) for x in table["vals"]])
        c = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["counts"]]).astype(np.int64)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        n = np.add.reduceat(c, first)
        often = n >= least
        return pa.table({"value": v[first][often].view(np.int64), "n": n[often]})

    return packed.groupBy("bucket").applyInArrow(total, "value long, n long")


def shingle_order(docs: DataFrame, k: int, text_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many documents have, and for each the class (log2) of how many.

    Counted over all documents, for the lower half of all hashes (prefixes take
    low hashes first). The least class that still fits HOT_LIMIT in all is chosen, so the
    table that every task gets has a fixed bound. The order only steers how
    many candidates there are, never which links are found."""
    buckets = max(4, -(-text_bytes // BUCKET_BYTES))

    def arrays(batch):
        for _, s in shingle_sets(batch.column(0), k):
            yield s[: np.searchsorted(s, np.uint64(1 << 63))]

    packed = docs.select(F.col("text").cast("string")).mapInArrow(_count_map(arrays, 1 << 63, buckets), "bucket int, vals binary, counts binary")
    hot = keep(_counts(packed, HOT_LEAST), "hot-shingles").withColumn("c", F.floor(F.log2("n")))
    sizes = {int(r["c"]): r["count"] for r in hot.groupBy("c").count().collect()}  # a row a class
    total, least = 0, None
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > HOT_LIMIT:
            break
        least = c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    rows = hot.filter(F.col("c") >= least).select("value", F.col("c").cast("int")).toPandas()  # at most HOT_LIMIT rows
    v = rows["value"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(v)
    return v[order], rows["c"].to_numpy().astype(np.uint8)[order]


BITS = tuple(f"b{i}" for i in range(16))
_SETS = f"doc_id long, n long, sig1 long, sig2 long, prefix_sig long, {', '.join(f'{x} long' for x in BITS)}, prefix array<long>"


def sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set, with its size."""
    if not len(s):
        return 0, 0
    return tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (s, s ^ np.uint64(0x5851F42D4C957F2D)))


def parity(s: np.ndarray) -> np.ndarray:
    """Sixteen 64-bit words: for each of 1024 hash classes, whether a set has an odd number of its members."""
    odd = np.bincount((s & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(docs: DataFrame, k: int, percent: int, hot: np.ndarray, classes: np.ndarray) -> DataFrame:
    """Size, identity (two 64-bit sums) and ordered prefix of each document's set."""
    schema = pa.schema([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n", "sig1", "sig2", "prefix_sig", *BITS)], ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sig1, sig2, psig, out, ends, bits = [], [], [], [], [], [0], []
            for _, s in shingle_sets(batch.column(1), k):
                n = len(s)
                p = n - -(-percent * n // 100) + 1 if n else 0
                head = s[:p]
                if n and len(hot):
                    at = np.searchsorted(hot, s)
                    at[at == len(hot)] = 0
                    often = hot[at] == s
                    if often[:p].any():
                        rank = np.where(often, classes[at], 0)
                        head = s[np.argsort(rank, kind="stable")][:p]
                size.append(n)
                one, two = sums(s)
                sig1.append(one)
                sig2.append(two)
                psig.append(int(mix(head).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                bits.append(parity(s))
                out.append(head)
                ends.append(ends[-1] + len(head))
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (size, sig1, sig2, psig)], *[pa.array([b[i] for b in bits], pa.int64()) for i in range(len(BITS))], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), _SETS)


def _compatible(a: str, b: str, percent: int):
    """Filters on columns {x}n, {x}pos and {x}BITS of two sides: like sizes, as many shingles
    from the shared one on as a link needs, and no more parities apart than it allows."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    need = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))
    differ = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in BITS), F.lit(0))
    near = F.coalesce(differ <= na + nb - 2 * need, F.lit(True))  # null: a group of several members
    return near & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos")) >= need)


def _first_blocks(rows: DataFrame) -> DataFrame:
    """token: of blocks (``rows``: g, pos, token) with the same groups the first in the order, in which every pair of the others meets earlier."""
    blocks = rows.groupBy("token").agg(F.count("*").alias("_m"), F.bit_xor(F.xxhash64("g")).alias("_x"), F.bit_xor(F.xxhash64("g", F.lit(7))).alias("_y"), F.min("pos").alias("_pos"))
    return blocks.groupBy("_m", "_x", "_y").agg(F.min_by("token", "_pos").alias("token")).select("token")


def _with_earlier(live: DataFrame) -> DataFrame:
    """``live`` and ``early``: tokens of the group's blocks before this one, EARLIER of them at most."""
    first = live.groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, EARLIER).alias("_e"))
    before = F.transform(F.filter("_e", lambda e: e["pos"] < F.col("pos")), lambda e: e["token"])
    return live.join(first, "g", "left").withColumn("early", F.coalesce(before, F.array().cast("array<long>"))).drop("_e")


def _with_hubs(live: DataFrame, percent: int, turn: int) -> DataFrame:
    """ga, gb: pairs of ``_across`` of blocks over LARGE, one side being a hub: a group whose hash (another one each turn) takes it among half of MANY_HUBS to MANY_HUBS of its block."""
    cut = F.pow(F.lit(2), F.ceil(F.log2(F.col("_size") / MANY_HUBS))).cast("long")
    own = _with_earlier(live.filter(F.col("_size") > LARGE)).withColumn("_hub", F.pmod(F.xxhash64("g", F.lit(11 + turn)), F.greatest(cut, F.lit(1))) == 0)
    cols = ("g", "n", "pos", "lo", "hi", "early", "_hub", *BITS)
    parts = F.ceil(F.col("_size") / TILE_GROUPS).cast("long")  # hubs go to each part of their block
    sides = own.filter("_hub").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), own.withColumn("_p", F.pmod(F.xxhash64("g", F.lit(3)), parts))
    x, y = (side.select("token", "_p", *[F.col(c).alias(f"{s}{c}") for c in cols]) for s, side in zip("ab", sides, strict=True))
    once = ~(F.col("b_hub") & (F.col("ag") >= F.col("bg")))
    apart = once & ((F.col("alo") != F.col("blo")) | (F.col("alo") != F.col("ahi")) | (F.col("blo") != F.col("bhi")))
    return x.join(y, ["token", "_p"]).filter(apart & _compatible("a", "b", percent) & ~F.arrays_overlap("aearly", "bearly")).select(F.least("ag", "bg").alias("ga"), F.greatest("ag", "bg").alias("gb"))


def _across(live: DataFrame, percent: int) -> DataFrame:
    """ga, gb: pairs of groups in blocks of ``live`` (token, _size, g, pos, n, lo, hi, BITS) that may hold links between classes. A pair comes out
    where both first meet; more often only if that is behind EARLIER other blocks. A block of many groups is cut into tiles (parts i <= j), so that no task has all its pairs."""
    parts = F.ceil(F.col("_size") / TILE_GROUPS).cast("long")
    own = _with_earlier(live).withColumn("_k", parts).withColumn("_p", F.pmod(F.xxhash64("g", F.lit(3)), F.col("_k")))
    cols = ("g", "n", "pos", "lo", "hi", "early", *BITS)
    x = own.withColumn("_o", F.explode(F.sequence("_p", F.col("_k") - 1))).select("token", F.col("_p").alias("_i"), F.col("_o").alias("_j"), *[F.col(c).alias(f"a{c}") for c in cols])
    y = own.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), "_p"))).select("token", F.col("_o").alias("_i"), F.col("_p").alias("_j"), *[F.col(c).alias(f"b{c}") for c in cols])
    once = F.when(F.col("_i") == F.col("_j"), F.col("ag") < F.col("bg")).otherwise(F.lit(True))
    apart = once & ((F.col("alo") != F.col("blo")) | (F.col("alo") != F.col("ahi")) | (F.col("blo") != F.col("bhi")))
    return x.join(y, ["token", "_i", "_j"]).filter(apart & _compatible("a", "b", percent) & ~F.arrays_overlap("aearly", "bearly")).select(F.least("ag", "bg").alias("ga"), F.greatest("ag", "bg").alias("gb"))


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a 64-bit hash in a filter, from its two halves."""
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [(low + np.uint64(i) * high) % np.uint64(bits) for i in range(4)]


def id_filter(ids: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the 64-bit hashes of ``ids`` (id): bytes of sixteen bits an id, 8 MB at most. Beyond that more strangers pass, and nothing is lost."""
    bits = 1 << min(26, max(16, (16 * rows).bit_length()))
    h = F.xxhash64("id")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    places = ids.select(F.explode(F.array(*[F.pmod(low + i * high, F.lit(bits)) for i in range(4)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 31))")).alias("v")).toPandas()  # at most 2^21 rows
    out = np.zeros(bits // 32, "<u4")
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out


def _sets_of(wanted: DataFrame, docs: DataFrame, k: int, name: str, rows: int) -> DataFrame:
    """member, items: the whole sets of ``wanted`` (member, rep, sig1, sig2), kept. Texts stay where they are: a filter of bounded size goes to them and
    lets the wanted ids (and a few strangers) through; the join with the wanted follows on the sets. A doc_id may have several texts, so the
    sums tell which of them is meant."""
    schema = pa.schema([("rep", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("items", pa.binary())])
    held = id_filter(wanted.select(F.col("rep").alias("id")), rows)
    bits = 32 * len(held)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            through = np.ones(len(h), bool)
            for p in _places(h, bits):
                through &= (held[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
            batch = batch.filter(pa.array(through))
            found = [s for _, s in shingle_sets(batch.column(1), k)]
            one, two = zip(*map(sums, found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], schema=schema)

    hashed = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("_h"))
    found = hashed.mapInArrow(lean(sets), "rep long, sig1 long, sig2 long, items binary").dropDuplicates(["rep", "sig1", "sig2"])
    return keep(found.join(wanted, ["rep", "sig1", "sig2"]).select("member", "items"), name, 5 * rows)  # wide rows


def _verify(pairs: DataFrame, held: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b) of members whose whole sets (``held``: member, items) are similar enough."""
    left = pairs.join(held.select(F.col("member").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(held.select(F.col("member").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((s, t)))
                o = int((both[1:] == both[:-1]).sum())
                good.append(100 * o >= percent * (len(s) + len(t) - o))
            yield pa.RecordBatch.from_pydict({"a": [i for i, g in zip(a, good, strict=True) if g], "b": [i for i, g in zip(b, good, strict=True) if g]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return keep(both.mapInArrow(lean(test), "a long, b long"), "links", rows)


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which of ``left`` and ``right`` (none: of ``left`` with itself) sorted sets are similar enough, as a matrix of booleans.

    Overlaps are products of 0/1 matrices over the shingles that two sets or more have, a slice of columns at a time."""
    both = left if right is None else left + right
    size = np.fromiter(map(len, both), np.int64, len(both))
    row = np.repeat(np.arange(len(both)), size)
    flat = np.concatenate(both)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1 if len(column) else column
    n, m = len(left), len(both) if right is None else len(right)
    over = np.zeros((n, m), np.float32)
    width = max(256, (2 << 20) // len(both))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        ones = np.zeros((len(both), min(width, int(column[-1]) + 1 - a)), np.float32)
        ones[row[i:j], column[i:j] - a] = 1
        over += ones[:n] @ (ones if right is None else ones[n:]).T
    other = size if right is None else size[n:]
    out = np.empty((n, m), bool)
    for a in range(0, n, 256):
        part = over[a : a + 256].astype(np.int64)
        out[a : a + 256] = (100 + percent) * part >= percent * (size[a : a + 256, None][: len(part)] + other[None, :])
    return out


def link_counts(members: DataFrame, held: DataFrame, percent: int, rows: int) -> DataFrame:
    """member, links: with how many documents of other sets a member links, of ``members`` (member, comp, n, copies) in classes of two
    sets or more. Classes go to tasks whole, many small ones together, or, if they are large, in tiles: pairs of hash parts."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    sizes = sizes.withColumn("k", F.ceil(F.least(F.greatest(F.col("total") / TILE_SHINGLES, F.col("m") / TILE_SETS), F.col("m") / 2)).cast("long"))
    some = keep(members.join(sizes.select("comp", "k"), "comp"), "classes", rows)
    whole = some.filter("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lots = max(1, -(-whole // (4 * TILE_SHINGLES)))
    part = F.pmod(F.xxhash64("member", F.lit(5)), F.col("k"))
    # a tile (i, j), i <= j, has part i on its first side and part j on its second
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda o: F.struct(F.least("_p", o).alias("i"), F.greatest("_p", o).alias("j"), (F.col("_p") > o).cast("int").alias("side")))
    tiled = some.withColumn("_p", part).withColumn("_t", F.explode(ends))
    unit = F.when(F.col("k") == 1, F.pmod(F.xxhash64("comp"), F.lit(lots))).otherwise(F.xxhash64("comp", "_t.i", "_t.j"))
    parts = tiled.select(unit.alias("unit"), "comp", F.col("_t.i").alias("i"), F.col("_t.j").alias("j"), F.col("_t.side").alias("side"), "member", "copies").join(held, "member")

    def count(table: pa.Table) -> pa.Table:
        comp, i, j, side, member, copies = [table[c].to_numpy() for c in ("comp", "i", "j", "side", "member", "copies")]
        items = table["items"]
        order = np.lexsort((side, j, i, comp))
        key = np.stack([comp[order], i[order], j[order]])
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        out: tuple[list, list] = ([], [])
        for own in np.split(order, starts[1:]):
            sets = [np.frombuffer(items[int(x)].as_buffer(), np.uint64) for x in own]
            if i[own[0]] == j[own[0]]:
                found = linked(sets, None, percent)
                np.fill_diagonal(found, False)
                sums = found @ copies[own]
            else:
                cut = int((side[own] == 0).sum())
                if not 0 < cut < len(own):
                    continue
                found = linked(sets[:cut], sets[cut:], percent)
                sums = np.concatenate((found @ copies[own[cut:]], copies[own[:cut]] @ found))
            out[0].append(member[own])
            out[1].append(sums.astype(np.int64))
        return pa.table({"member": np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64), "links": np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)})

    return parts.groupBy("unit").applyInArrow(lean_group(count), "member long, links long").groupBy("member").agg(F.sum("links").alias("links"))


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, hub_rounds: int = 2, count_links: bool = True) -> DataFrame:
    """Classes of documents under links of Jaccard similarity ``percent`` / 100 or more of ``k``-word shingle sets.

    A-Z are lower-cased, words are runs of anything but ASCII white space; a text of
    fewer than ``k`` words has one shingle of all of them. Returns one row for each
    row of ``doc_id, text``: doc_id, n_shingles, component_id, the smallest
    doc_id that links reach, and (with ``count_links``) n_links, the number of other rows that it links with, copies
    counted each. Null or word-free texts have no shingles and no links.
    Rows with a null doc_id are left out of links and come back with a null component_id and 0 links.
    Each row is a document of its own, also where doc_ids repeat: rows of one doc_id with different texts may be in different
    classes. An empty table gives no rows; other columns aren't read. The result is a table
    of its own in the shared folder; all else that was written on the way is removed."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        out = _classes(docs, k, percent, hub_rounds, count_links)
        return settle(out, "jaccard-classes")


def _classes(docs: DataFrame, k: int, percent: int, hub_rounds: int, count_links: bool) -> DataFrame:
    spark = docs.sparkSession
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    heads = keep(prefixes(docs, k, percent, *shingle_order(docs, k, text_bytes)), "prefixes")
    n_docs = heads.count()
    release(spark)
    sets = keep(heads.select("doc_id", "n", "sig1", "sig2", "prefix_sig"), "set-sums", n_docs)
    # members: identical sets; groups: identical prefix and size
    known = sets.filter("n > 0 and doc_id is not null")
    members = keep(known.groupBy("n", "prefix_sig", "sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).withColumn("member", F.monotonically_increasing_id()), "members", n_docs)
    n_members = members.count()
    by_group = members.groupBy("n", "prefix_sig").agg(F.min("member").alias("g"), F.min_by("rep", "member").alias("rep"), F.count("*").alias("size"))
    lead = heads.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("rep"), "n", "prefix_sig", "prefix", *BITS)
    groups = by_group.join(lead, ["rep", "n", "prefix_sig"]).dropDuplicates(["g"])
    groups = keep(groups.select("g", "n", "prefix_sig", "size", "prefix", *[F.when(F.col("size") == 1, F.col(x)).alias(x) for x in BITS]), "groups", n_members)
    discard(spark, heads)
    in_group = keep(members.join(groups.select("n", "prefix_sig", "g", "size"), ["n", "prefix_sig"]).select("member", "g", "size"), "in-group", n_members)

    # shingles in the prefixes of two groups or more, by the packed count; groups of several members pair inside themselves
    def own(batch):
        column = batch.column(0)
        if len(column):
            yield np.sort(column.flatten().to_numpy().view(np.uint64))

    buckets = max(4, -(-text_bytes // (2 * BUCKET_BYTES)))
    shared = keep(_counts(groups.select("prefix").mapInArrow(_count_map(own, 1 << 64, buckets), "bucket int, vals binary, counts binary"), 2), "shared-shingles")
    tokens = groups.select("g", F.posexplode("prefix").alias("pos", "token"))
    every = keep(tokens.join(shared.select(F.col("value").alias("token")), "token"), "blocks")
    n_every = every.count()
    rows = keep(every.join(_first_blocks(every), "token"), "first-blocks", n_every)
    n_rows = rows.count()
    discard(spark, every)
    facts = keep(groups.select("g", "n", *BITS), "group-facts", n_members)
    discard(spark, shared)
    discard(spark, groups)
    release(spark)
    inner = in_group.filter((F.col("size") > 1) & (F.col("member") != F.col("g"))).select(F.col("g").alias("a"), F.col("member").alias("b"))

    mixed = not in_group.filter("size > 1").isEmpty()
    comp = members.select(F.col("member").alias("node"), F.col("member").alias("comp"))
    links = tried = held = live = None
    for turn in range(hub_rounds + 1):
        if live is None:
            # classes that a group's members are in
            spread = in_group.join(comp.withColumnRenamed("node", "member"), "member").groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            labelled = rows.join(spread, "g")
            open_blocks = labelled.groupBy("token").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.count("*").alias("_size")).filter("_lo < _hi").select("token", "_size")
            live = keep(labelled.join(open_blocks, "token").join(facts, "g"), f"live{turn}", n_rows)
        if live.isEmpty() and not mixed:
            break
        if turn == 0 < hub_rounds:
            # the hub of a block: the group with the fewest rare shingles before this one
            pick = live.groupBy("token").agg(F.min(F.struct("pos", "n", "g", "lo", *BITS)).alias("h"))
            sides = live.join(pick, "token").select(F.col("g").alias("bg"), F.col("n").alias("bn"), F.col("pos").alias("bpos"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), *[F.col(x).alias(f"b{x}") for x in BITS], F.col("h.g").alias("ag"), F.col("h.n").alias("an"), F.col("h.pos").alias("apos"), F.col("h.lo").alias("alo"), *[F.col(f"h.{x}").alias(f"a{x}") for x in BITS])
            apart = (F.col("ag") != F.col("bg")) & ((F.col("alo") != F.col("blo")) | (F.col("blo") != F.col("bhi")))
            found = sides.filter(apart & _compatible("a", "b", percent)).select(F.least("ag", "bg").alias("ga"), F.greatest("ag", "bg").alias("gb")).distinct()
        elif turn < hub_rounds:
            if live.filter(F.col("_size") > LARGE).isEmpty():
                continue
            found = _with_hubs(live, percent, turn).distinct()
        else:
            found = _across(live, percent).distinct()
        # expand groups to members
        one, two = (in_group.select(F.col("g").alias(c), F.col("member").alias(m)) for c, m in (("ga", "a"), ("gb", "b")))
        pairs = found.join(one, "ga").join(two, "gb").select("a", "b")
        if turn == 0:
            pairs = pairs.unionByName(inner)
        if turn == hub_rounds:
            same = in_group.filter("size > 1").join(comp.withColumnRenamed("node", "member"), "member").select("g", F.col("member").alias("a"), F.col("comp").alias("ca"))
            other = same.select("g", F.col("a").alias("b"), F.col("ca").alias("cb"))
            pairs = pairs.unionByName(same.join(other, "g").filter("a < b and ca <> cb").select("a", "b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
            at = comp.select(F.col("node").alias("a"), F.col("comp").alias("_ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("_cb"))
            pairs = pairs.join(at[0], "a").join(at[1], "b").filter("_ca <> _cb").select("a", "b")
        pairs = keep(pairs.distinct() if turn == 0 and hub_rounds == 0 else pairs, f"pairs{turn}")
        release(spark)
        n_pairs = pairs.count()
        if not n_pairs:
            continue
        discard(spark, live)
        live = None
        wanted = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct().join(members.select("member", "rep", "sig1", "sig2"), "member")
        if held is not None:  # sets that an earlier turn read already
            wanted = wanted.join(held.select("member"), "member", "left_anti")
        more = _sets_of(wanted, docs, k, f"sets{turn}", min(2 * n_pairs, n_members))
        release(spark)
        held = more if held is None else held.unionByName(more)
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = _verify(pairs, held, percent, n_pairs)
        links = good if links is None else links.unionByName(good)
        comp = min_label_components(members.select(F.col("member").alias("node")), links, rows=n_members)
        release(spark)
    of = members.join(comp.withColumnRenamed("node", "member"), "member")
    least = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "comp")
    own_links = F.col("copies") - 1
    if count_links and held is not None:
        counted = link_counts(of.select("member", "comp", "n", "copies"), held, percent, n_members)
        of = of.join(counted, "member", "left")
        own_links = own_links + F.coalesce("links", F.lit(0))
    of = of.select("n", "prefix_sig", "sig1", "sig2", "component_id", own_links.alias("n_links"))
    whole = sets.join(of, ["n", "prefix_sig", "sig1", "sig2"], "left")
    in_class = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(in_class, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(in_class, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return out if count_links else out.drop("n_links")
