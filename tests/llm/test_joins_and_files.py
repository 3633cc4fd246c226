"""N-gram Jaccard join, token files and counts, packing: against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postbag.llm import ngram_jaccard, packing, token_counts, token_files
from postbag.llm.common import WordEncoder
from postbag.llm.queries import WORDS, vocabulary

from .helpers import SCHEMA, classes, documents, frame, link_counts, prose


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(vocabulary(WORDS))


def ids_of(encoder, text):
    return encoder.tok.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_are_the_tokenizers(encoder):
    import pyarrow as pa

    texts = [r[1] for r in documents()] + ["a.", "A", "A. b?", "<a. B", "don't. it's!", "x<|ENDOFTEXT|>.", "b́. é́.", "ŉ. ǅ", "1234.5", "\x85 a b", None, ""]
    found = [x.tolist() for x in encoder.rows(pa.array(texts))]
    assert found == [ids_of(encoder, t) for t in texts]


def test_small_cache_gives_the_same_ids(encoder):
    import pyarrow as pa

    texts = [r[1] for r in documents()]
    small = WordEncoder(vocabulary(WORDS), limit=50)
    assert [x.tolist() for x in small.rows(pa.array(texts))] == [x.tolist() for x in encoder.rows(pa.array(texts))]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_classes(spark, k, percent):
    rows = documents()
    got = ngram_jaccard.jaccard_classes(frame(spark, rows), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows, k, percent)
    assert {r.doc_id: r.n_links for r in got} == link_counts(rows, k, percent)


def test_jaccard_classes_of_dense_and_chained_copies(spark, monkeypatch):
    """Copies that differ by degrees, many sharing a passage, with the hot table in use."""
    monkeypatch.setattr(ngram_jaccard, "HOT_LEAST", 2)
    rng = random.Random(5)
    rows, passage = [], prose(rng, 60)
    for c in range(4):
        w = prose(rng, 90).split(" ")
        for i in range(25):
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
            rows.append((len(rows), " ".join(w) + (" " + passage if c % 2 else ""), None, None, 0, 0, 0.0, 0))
    for _ in range(60):
        rows.append((len(rows), prose(rng, rng.randrange(1, 30)) + " " + passage, None, None, 0, 0, 0.0, 0))
    rows += [(1000 + r[0], r[1], *r[2:]) for r in rows[:30]]  # exact copies
    for hubs, tile in ((0, 1500), (2, 7)):  # whole classes and blocks, or many tiles of each
        monkeypatch.setattr(ngram_jaccard, "TILE_SETS", tile)
        monkeypatch.setattr(ngram_jaccard, "TILE_GROUPS", tile)
        got = ngram_jaccard.jaccard_classes(frame(spark, rows), 4, 85, hub_rounds=hubs).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows, 4, 85)
        assert {r.doc_id: r.n_links for r in got} == link_counts(rows, 4, 85)


def test_pairs_of_groups_come_out_of_one_block(spark, monkeypatch):
    """Groups that meet in many blocks: one row for each pair, where both first meet, and blocks of the same groups are one."""
    rng = random.Random(3)
    held = {g: sorted(rng.sample(range(12), 9)) for g in range(40)}
    held |= {100: list(range(20, 60)), 101: list(range(20, 60)), 102: list(range(40, 60))}
    rows = spark.createDataFrame([(g, p, t) for g, ts in held.items() for p, t in enumerate(ts)], "g long, pos int, token long")
    kept = {r.token for r in ngram_jaccard._first_blocks(rows).collect()}
    assert kept == {*range(12), 20, 40}
    size = rows.groupBy("token").agg(F.count("*").alias("_size"))
    facts = {"n": F.lit(1000).cast("long"), "lo": F.col("g"), "hi": F.col("g")} | {x: F.lit(0).cast("long") for x in ngram_jaccard.BITS}
    live = rows.join(size, "token").withColumns(facts).filter(F.col("token").isin(kept))
    pairs = {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])}
    for tile, earlier in ((4000, 32), (7, 32), (4000, 2)):
        monkeypatch.setattr(ngram_jaccard, "TILE_GROUPS", tile)
        monkeypatch.setattr(ngram_jaccard, "EARLIER", earlier)
        got = [(r.ga, r.gb) for r in ngram_jaccard._across(live, 85).collect()]
        assert set(got) == pairs
        assert earlier < 32 or len(got) == len(pairs)


def test_large_blocks_pair_with_many_hubs_first(spark, monkeypatch):
    """Near copies of one text: links with a few hubs join most classes, so fewer pairs across classes are left, and the classes are right."""
    rng = random.Random(6)
    base, rows = prose(rng, 130).split(" "), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(60)] = f"edit{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(w), *[None] * 6))
    across, hubs = ngram_jaccard._across, ngram_jaccard._with_hubs
    made = []

    def counted(of):
        def run(*arguments):
            found = of(*arguments)
            made.append(found.count())
            return found

        return run

    monkeypatch.setattr(ngram_jaccard, "_across", counted(across))
    monkeypatch.setattr(ngram_jaccard, "_with_hubs", counted(hubs))
    monkeypatch.setattr(ngram_jaccard, "LARGE", 16)
    monkeypatch.setattr(ngram_jaccard, "MANY_HUBS", 16)
    monkeypatch.setattr(ngram_jaccard, "TILE_GROUPS", 40)
    expected, total = classes(rows, 4, 85), []
    for rounds in (1, 2):
        made.clear()
        got = ngram_jaccard.jaccard_classes(frame(spark, rows), 4, 85, hub_rounds=rounds).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
        assert {r.doc_id: r.n_links for r in got} == link_counts(rows, 4, 85)
        assert len(made) == rounds
        total.append(sum(made))
    assert 3 * total[1] < 2 * total[0], total


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (9, b), (2, a), (7, c), (None, c), (11, None), (11, "")]
    got = ngram_jaccard.jaccard_classes(spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA), 4, 85).collect()
    found = sorted((r.doc_id or 0, r.n_shingles > 0, r.component_id or 0, r.n_links) for r in got)
    assert found == sorted([(5, True, 2, 1), (5, True, 5, 2), (5, True, 5, 2), (9, True, 5, 2), (2, True, 2, 1), (7, True, 7, 0), (0, True, 0, 0), (11, False, 11, 0), (11, False, 11, 0)])


def test_functions_for_workers_can_be_pickled():
    from pyspark.cloudpickle import dumps

    from postbag.llm import chat, fertility, token_counts, warc  # noqa: F401  every module of the subpackage is loaded
    from postbag.llm.common import lean, lean_group

    for wrap in (lean, lean_group):
        dumps(wrap(lambda x: x))


def test_jaccard_classes_of_odd_tables(spark):
    assert ngram_jaccard.jaccard_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", *[None] * 6), (3, "a b c d e f", *[None] * 6), (2, "A b\tc d e f", *[None] * 6), (5, None, *[None] * 6)]
    found = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in ngram_jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(0, 0, 2), (2, 2, 2), (3, 2, 2), (5, 5, 0)]


def test_token_files_read_back(spark, encoder):
    rows = documents()
    manifest = token_files.write_token_files(frame(spark, rows), vocabulary(WORDS), end_id=2)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()}
    want, start = {}, 0
    for r in sorted(rows):
        ids = [*ids_of(encoder, r[1]), 2]
        want[r[0]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == want


def test_token_files_of_odd_tables(spark):
    assert token_files.read_token_files(token_files.write_token_files(spark.createDataFrame([], SCHEMA), vocabulary(WORDS), 2)).collect() == []
    rows = [(None, "a b", *[None] * 6), (7, None, *[None] * 6), (7, "c", *[None] * 6), (7, "c", *[None] * 6)]
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(token_files.write_token_files(spark.createDataFrame(rows, SCHEMA), vocabulary(WORDS), 2)).collect())
    assert found == [(0, None, 3), (3, 7, 1), (4, 7, 2), (6, 7, 2)]


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_separator_scan_over_blocks_and_files(spark, tmp_path, block):
    """Documents of all lengths over block and file ends, files without a separator, an open end."""
    rng = random.Random(block)
    ids = [rng.choice([9, 1, 2, 3, 4]) for _ in range(60)] + [1] * 25 + [9, 9] + [2] * 5
    cuts = [0, 4, 5, 33, 70, 80, len(ids)]
    files = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        path = tmp_path / f"{i}.bin"
        path.write_bytes(np.array(ids[a:b], "<u2").tobytes())
        files.append((i, f"file://{path}", 2, b - a))
    table = spark.createDataFrame(files, "file_rank long, path string, width int, n_tokens long")
    found = sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in token_counts.count_tokens(table, 9, block).collect())
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 9:
            want.append((len(want), start, i + 1 - start, True))
            start = i + 1
    want.append((len(want), start, len(ids) - start, False))
    assert found == want


def test_unordered_token_counts_name_their_documents(spark):
    """A text that spells the separator is ordinary text here."""
    rows = documents()
    manifest = token_files.write_token_files(frame(spark, rows), vocabulary(WORDS), 49407, ordered=False, plain=True)
    files = manifest.select(F.col("doc_base").alias("file_rank"), F.concat("path", F.lit(".bin")).alias("path"), "width", "n_tokens")
    found = {r.ordinal: r.n_tokens for r in token_counts.count_tokens(files, 49407, block_ids=100).collect()}
    names = {r.doc_id: r.ordinal for r in token_files.read_document_ids(manifest).collect()}
    plain = WordEncoder(vocabulary(WORDS), plain=True)
    assert {d: found[o] for d, o in names.items()} == {x[0]: len(ids_of(plain, x[1])) + 1 for x in rows}


def check_packing(pieces, capacity):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_best_fit_packing(spark, encoder):
    rows = documents()
    pieces = packing.best_fit_packing(frame(spark, rows), vocabulary(WORDS), 0, capacity=256).collect()
    check_packing(pieces, 256)
    found = {(p.doc_id, p.piece): (p.start, p.length, p.ids_crc32) for p in pieces}
    want = {}
    for r in rows:
        ids = [*ids_of(encoder, r[1]), 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[r[0], k // 256] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert found == want and len(pieces) == len(want)
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA), vocabulary(WORDS)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_all_within_one_percent_of_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 2048])
    shape = rng.choice([lambda: rng.randint(1, capacity), lambda: min(capacity, 1 + int(rng.expovariate(5 / capacity))), lambda: rng.choice([capacity // 3, capacity // 2 + 1, capacity])])
    lengths = [max(1, shape()) for _ in range(3000)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    placed = packing.plan(counts, capacity)
    ranks = {x: set() for x in counts}
    room = {}
    for length, rank, n, seq, offset in placed:
        for i in range(n):
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
            room.setdefault(seq + i, []).append((offset, length))
    assert {x: len(r) for x, r in ranks.items()} == counts
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    import bisect

    gaps: list[int] = []
    bins = 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            bisect.insort(gaps, gaps.pop(i) - x)
        else:
            bins += 1
            bisect.insort(gaps, capacity - x)
    assert len(room) <= bins * 1.01 + 1
