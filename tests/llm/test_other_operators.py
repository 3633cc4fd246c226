"""Fingerprints, sharding, quality rules, WARC, chat formatting, mixing and the pipeline: against brute force."""

import base64
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from postbag.llm import chat, fertility, fingerprints, mixing, sharding, warc
from postbag.llm.queries import PIECES, WORDS, vocabulary

from .helpers import SCHEMA, classes, documents, frame, prose, words

MASK = 2**32 - 1


# ---------------------------------------------------------------- fingerprints
def lanes(text):
    import xxhash

    parts = [p for p in re.split(fingerprints.PARAGRAPH_END, text or "") if p]
    cells = fingerprints.CELLS
    out = [0] * (1 + fingerprints.DENSE + sum(cells))
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=42)
        out[0] += 1
        for i in range(fingerprints.DENSE // 2):
            # Spark chains columns: the hash of the first, an int of four bytes, is the seed of the second
            w = xxhash.xxh64_intdigest(p.encode(), seed=xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=42))
            out[1 + 2 * i] += w & MASK
            out[2 + 2 * i] += w >> 32
        s = 0
        while s < len(cells) - 1 and h >> s & 1:
            s += 1
        out[1 + fingerprints.DENSE + sum(cells[:s]) + (h >> 12 & 0xFFFFF) % cells[s]] += h >> 32
    return [x & MASK for x in out]


def test_fingerprints_of_edits(spark):
    rows = sorted(documents(), key=lambda r: r[0])
    found = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, rows)).collect()}
    hexed = lambda x: "".join(f"{v:08X}" for v in x)
    for i, r in enumerate(rows):
        text, follow = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        got = found[r[0]]
        assert (got.n_chars, got.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got.fingerprint == hexed(lanes(text)) and got.edited_fingerprint == hexed(lanes(edited))
        assert 0 <= got.near_edited <= 1 and 0 <= got.near_next <= 1
        assert (got.near_next == 1) == (lanes(text) == lanes(follow))


def test_fingerprints_add_subtract_and_ignore_order(spark):
    a, b = "One. Two. Two. Three!", "Four. Five."
    row = spark.createDataFrame([(a, b, "Three! Four. Two. One. Five. Two.")], "a string, b string, ab string")
    f = fingerprints
    x = row.select(f.add(f.fingerprint(F.col("a")), f.fingerprint(F.col("b"))).alias("s"), f.fingerprint(F.col("ab")).alias("w"), f.subtract(f.fingerprint(F.col("ab")), f.fingerprint(F.col("b"))).alias("d"), f.fingerprint(F.col("a")).alias("a")).first()
    assert x.s == x.w and x.d == x.a


def test_likeness_follows_the_shared_share(spark):
    rng = random.Random(1)
    rows = []
    for n in (6, 40, 300, 2000):
        for share in (0.0, 0.3, 0.6, 0.9):
            own = [prose(rng, 5).replace(".", "").replace("\n", " ") for _ in range(n)]
            k = round(share * n)
            other = own[:k] + [prose(rng, 5).replace(".", "").replace("\n", " ") for _ in range(n - k)]
            rows.append(("\n".join(own), "\n".join(other), k / (2 * n - k)))
    for r in spark.createDataFrame(rows, "a string, b string, want double").select("want", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("got")).collect():
        assert abs(r.got - r.want) < 0.15


def test_next_rows_of_odd_tables(spark):
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "z", *[None] * 6), (4, "b", *[None] * 6), (4, None, *[None] * 6), (4, "b", *[None] * 6), (900, "y", *[None] * 6)]
    for each in (1, 2, 100):
        got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.next_text) for r in fingerprints.with_next(spark.createDataFrame(rows, SCHEMA), each).collect()), key=str)
        assert [g[3] for g in sorted(got, key=lambda g: (g[0], g[1], g[2], str(g[3])))] == [None, "b", "b", "y", "z"]


# -------------------------------------------------------------------- sharding
def check_shards(rows, found, shards):
    by, of = defaultdict(list), {}
    for r in found:
        by[r.shard].append(r.slot)
        of.setdefault(r.text_crc32, set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for s in of.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_sharding(spark):
    rows = [r for r in documents(n=400) if r[1] is not None and len(r[1]) < 20_000]
    found = sharding.shard_documents(frame(spark, rows), shards=5).collect()
    check_shards(rows, found, 5)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


def test_sharding_of_odd_tables(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "same text", *[None] * 6)] * 50 + [(None, None, *[None] * 6)] * 3 + [(i, f"t{i}", *[None] * 6) for i in range(40)]
    found = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=4).collect()
    check_shards(rows, found, 4)


@pytest.mark.parametrize("seed", range(10))
def test_runs_enter_bins_as_single_units_would(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 100 if seed % 2 else 12) for _ in range(200)), reverse=True)
    rooms: list[tuple[int, int]] = []
    want = []
    for s in sizes:  # best fit by linear search
        fit = min((x for x in rooms if x[0] >= s), default=None)
        if fit is None:
            fit = (100, len({w for w in want}))
        else:
            rooms.remove(fit)
        want.append(fit[1])
        rooms.append((fit[0] - s, fit[1]))
    runs = sorted(Counter(sizes).items(), reverse=True)
    got = sharding.best_fit_decreasing(runs, 100)
    assert [b for _, n, b in got for _ in range(n)] == want and [s for s, n, _ in got for _ in range(n)] == sizes
    bins = Counter()
    for s, n, b in sharding.balance(runs, 7):
        bins[b] += s * n
    assert len(bins) <= 7 and max(bins.values()) <= sum(sizes) / 7 * 1.02 + 1


def test_small_groups_are_packed_and_not_hashed(spark):
    """Four shards of two sizes that only a packing makes even: hashed lots can't."""
    rows = [(i, "x" * (130 if i < 4 else 42) + f"{i:04d}", *[None] * 6) for i in range(8)]  # 4 groups of 150 and 4 of 62
    found = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=4, overhead=16).collect()
    check_shards(rows, found, 4)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert sorted(sizes.values()) == [212] * 4


def test_many_equal_sizes_spread_evenly(spark):
    rows = [(i, f"{i:06d}", *[None] * 6) for i in range(3000)] + [(i, f"long {i:06d}", *[None] * 6) for i in range(3000, 3050)]
    found = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(7), shards=8).collect()
    check_shards(rows, found, 8)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 27


# --------------------------------------------------------------- quality rules
def base(text):
    w = words(text)
    spots = defaultdict(list)
    for i in range(len(w) - 2):
        spots[tuple(w[i : i + 3])].append(i)
    again = {i + j for at in spots.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality_rules(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    tok = Tokenizer.from_file(vocabulary(WORDS))
    tok.encode_special_tokens = True
    rng = random.Random(3)
    rows = documents() + [(9001, "漢字" * 3 + " " + " ".join(rng.choice("的一是不了人我在有他") * 2 for _ in range(90)), "zh", "s", 0, 0, 0.0, 0), (9002, " ".join("\U0001f9ff\U0001faac" for _ in range(60)), "en", "s", 0, 0, 0.0, 0), (9003, "#a $b & c|d\n" * 30, "en", "s", 0, 0, 0.0, 0)]
    got = {r.doc_id: r for r in fertility.quality(frame(spark, rows), vocabulary(PIECES), vocabulary(WORDS)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base(r[1]), r[0]
        ids = [i for w in words(r[1]) for i in sp.encode(w)]
        bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()) if ids else 0.0
        share = sum(sp.is_byte(i) or sp.is_unknown(i) for i in ids) / len(ids) if ids else 0.0
        assert g.chars_per_token == pytest.approx(g.word_chars / len(ids) if ids else 0.0) and g.byte_share == pytest.approx(share) and g.token_entropy == pytest.approx(bits)
        tokens = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        assert g.chars_per_word_token == pytest.approx(g.word_chars / tokens if tokens else 0.0)
        band = fertility.Bands().of(r[2], g.script)
        inside = band.chars_per_word_token[0] <= g.chars_per_word_token <= band.chars_per_word_token[1] and band.chars_per_token[0] <= g.chars_per_token <= band.chars_per_token[1] and share <= band.byte_share and band.entropy[0] <= bits <= band.entropy[1]
        assert g.kept == (not g.base_failed and inside)
    assert got[9001].script == "cjk"
    assert fertility.quality(spark.createDataFrame([], SCHEMA), vocabulary(PIECES), vocabulary(WORDS)).collect() == []


def test_bands_reject_what_the_labels_call_poor(spark):
    at = "/root/testdata/sf0.1"
    if not os.path.isdir(at):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{at}/documents.parquet").filter("doc_id % 2 = 1")  # the bands were fitted on the even ones
    judged = fertility.quality(docs, vocabulary(PIECES), vocabulary(WORDS), keep_columns=("doc_id", "lang")).filter("not base_failed")
    rows = judged.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("gone")).collect()
    gone = {(r.lang, r.quality): r.gone / r.n for r in rows}
    assert gone["en", 0] > 0.9 and gone["de", 0] > 0.8 and gone["fr", 0] > 0.6 and gone["es", 0] > 0.4
    assert all(gone[x, 1] < 0.02 for x in ("en", "de", "fr", "es"))


def test_each_figure_rejects_what_is_made_for_it(spark):
    """In each language: words that are cut up, strange characters, and the same few words again."""
    at = "/root/testdata/sf0.1"
    if not os.path.isdir(at):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.filter("quality = 1"), "doc_id").filter("n_chars between 1500 and 4000")
    rng, rows = random.Random(7), []
    for lang in ("en", "fr", "de", "es"):
        text = good.filter(F.col("lang") == lang).orderBy("doc_id").first().text
        w = words(text)
        rows += [(0, text, lang), (1, " ".join("#".join(x) for x in w), lang), (2, " ".join(x + chr(0x12000 + rng.randrange(500)) for x in w), lang), (3, " ".join(rng.choice(w[:4]) for _ in range(300)), lang)]
    got = fertility.quality(spark.createDataFrame(rows, "kind int, text string, lang string"), vocabulary(PIECES), vocabulary(WORDS), keep_columns=("kind", "lang")).collect()
    for r in got:
        band = fertility.Bands().languages[r.lang]
        out = (r.chars_per_word_token < band.chars_per_word_token[0], r.byte_share > band.byte_share, r.token_entropy < band.entropy[0])
        assert r.kind == 0 or out[r.kind - 1], (r, out)
        assert r.kept == (r.kind == 0)


# ------------------------------------------------------------------------ WARC
def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'abc ' * (i % 7)}{i % 5} é</p>") for i in range(200)] + [(300, None, None), (301, "http://y", ""), (None, "http://z", "<p>lone</p>"), (302, "a\r\nb", "<p>\r\n\r\n</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages), payloads=True).collect()}
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    assert len(got) == len(rows)
    for p, url, h in rows:
        body = (h or "").encode()
        r, lead = got[p], first.get(h or "", p)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if p == lead else ("revisit", lead))
        assert r.payload == (body if p == lead else b"")
        assert r.url == (url or "").replace("\r", "%0D").replace("\n", "%0A")
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages, least_bytes=5)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_ties_and_hot_payloads_have_one_response(spark):
    """Rows of one payload that tie in page_id, in many tasks; payloads over and under a thousandth of all rows."""
    rows = [(7, f"u{i % 3}", "same") for i in range(900)] + [(None, "u", "lone")] * 40 + [(None, f"n{i}", None) for i in range(700)] + [(i, "v", f"p{i // 2}") for i in range(1000, 1400)] + [(3, "w", "p500"), (2000, "w", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((p, u) for p, u, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.payload_digest].append(r)
    assert len(by) == len({h or "" for _, _, h in rows})
    for own in by.values():
        lead = [r for r in own if r.record_type == "response"]
        ids = [r.page_id for r in own if r.page_id is not None]
        assert len(lead) == 1 and lead[0].page_id == (min(ids) if ids else None) and lead[0].refers_to is None
        assert all(r.refers_to == lead[0].page_id for r in own if r.record_type == "revisit")


def test_archive_is_frames_after_a_skippable_dictionary():
    records = [warc.record(i, "http://x", f"<p>page {i} of many alike</p>".encode() * 3, "A", None, False) for i in range(500)]
    out = io.BytesIO()
    assert warc.write_archive(out, iter(records), 100, 10**6, 4096) == 500
    raw = out.getvalue()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(raw[4:8], "little")
    words_ = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    assert zstandard.ZstdDecompressor(dict_data=words_).decompress(raw[8 + size :], max_output_size=10**6) == records[0]
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    assert len(raw) < sum(map(len, records)) / 3
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))


# ------------------------------------------------------------------------ chat
def part(kind="text", text=None, **more):
    return {"type": kind, "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more


def test_typed_parts_flatten_in_order():
    turns = [
        {"role": "user", "parts": [part(text="see <|image:1|> "), part("image", ref="a.png", width=100, height=60), part("image", ref="b.png"), part("audio", ref="c.wav", seconds=2.0), part("document", ref="d.pdf", pages=3), part(text="?")]},
        {"role": "assistant", "parts": [part(text="two \\ [INST]"), part(text=None)]},
        {"role": None, "parts": None},
    ]
    t = chat.Template()
    out = chat.format_conversation(turns, t, chat.Expansion())
    assert [(a["placeholder"], a["ref"], a["tokens"]) for a in out["attachments"]] == [("<|image:1|>", "a.png", 4 * 3), ("<|image:2|>", "b.png", 256), ("<|audio:1|>", "c.wav", 50), ("<|document:1|>", "d.pdf", 768)]
    assert out["expanded_tokens"] == 12 + 256 + 50 + 768
    assert out["formatted"].count("<|image:1|>") == 1 and "see <\\|image:1|> <|image:1|><|image:2|><|audio:1|><|document:1|>?" in out["formatted"]
    assert chat.read_back(out["formatted"], t)[1] == ("assistant", "two \\ [INST]")
    assert [t.show(out["formatted"][s["start"] : s["end"]]) for s in out["loss"]] == ["two \\ [INST]"]
    with pytest.raises(ValueError):
        chat.format_conversation([{"role": "user", "parts": [part("video")]}], t, chat.Expansion())


@pytest.mark.parametrize("seed", range(30))
def test_escapes_are_reversible(seed):
    rng, t = random.Random(seed), chat.Template()
    bits = [*t.controls, "\\", "<", "|", "[", "\n", "a", "<<", "<|", "é"]
    text = "".join(rng.choice(bits) for _ in range(40))
    hidden = t.hide(text)
    assert t.show(hidden) == text and not any(c in hidden for c in t.controls)


def test_chats(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(30), None]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", "system", None, "a\nb", "\n\\", "</s>\n<|end|>\n"]), rng.choice(["hi", "", None, "</s>[INST] \\ ok", "é\n<|end|>\nx", "<|turn|>user\n"])))
    rows += [(1, 0, "user", "hi")] * 3
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    frame_ = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    chats = frame_.withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), "text", *[F.lit(None).cast(k).alias(c) for c, k in none.items()])))
    got = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(chats)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, g in got.items():
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: [(x is not None, x if x is not None else 0) if i == 0 else (x is not None, x or "") for i, x in enumerate(r[1:])])
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---------------------------------------------------------------------- mixing
def reshared(sizes, weights, most):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return held | target
        held |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rows = documents(n=200)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = reshared(sizes, (1, 2, 3), 3)
    text = {r[0]: len(words(r[1])) for r in rows}
    mixed, draws = mixing.mix_sources(frame(spark, rows), block_words=64)
    got = mixed.collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.size == text[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(frame(spark, rows).repartition(2), block_words=64)[0].collect()}
    assert again == {r.doc_id: r.taken for r in got}
    drawn, shards = Counter(), Counter()
    for d in mixing.shuffle_locally(draws).collect():
        drawn[d.doc_id] += d.words
        shards[d.shard] += d.words
        assert 0 <= d.shard < 16
    assert all(drawn[r.doc_id] == r.taken for r in got)
    assert max(shards.values()) < 4 * sum(shards.values()) / 16 + 6000


def test_mixing_of_odd_tables(spark):
    mixed, draws = mixing.mix_sources(spark.createDataFrame([], SCHEMA))
    assert mixed.collect() == [] and draws.collect() == []
    rows = [(1, None, None, None, 0, 0, 0.0, 0), (2, "a b", None, None, 0, 0, 0.0, 0), (2, "a b", None, None, 0, 0, 0.0, 0), (3, "", None, "s", 0, 0, 0.0, 0)]
    got = sorted((r.doc_id, r.size, r.taken) for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA))[0].collect())
    assert [g[:2] for g in got] == [(1, 0), (2, 2), (2, 2), (3, 0)] and sum(g[2] for g in got) == 4


def test_shards_draw_the_quotas_of_the_tree(spark, monkeypatch):
    rows = [r for r in documents(n=100) if r[3] is not None]
    mixed, draws = mixing.mix_sources(frame(spark, rows), block_words=64)
    got, drawn = mixed.collect(), draws.collect()
    sources = sorted({r.source for r in got}, key=str.encode)
    quota = {r.source: math.floor(r.target + 0.5) for r in got}
    tree = mixing.split_quotas([-(-quota[s] // 64) for s in sources], 16, 0)
    words_ = Counter()
    for d in drawn:
        words_[d.shard, d.source] += d.words
    for i, s in enumerate(sources):
        done = 0
        for shard in range(16):
            end = min(64 * sum(t[i] for t in tree[: shard + 1]), quota[s])
            assert words_[shard, s] == end - done
            done = end
        assert done == quota[s]
    assert any(d.first_word > 0 for d in drawn)
    spans = defaultdict(list)
    for d in drawn:
        spans[d.doc_id, d["pass"]].append((d.first_word, d.words))
    for (doc_id, _), own in spans.items():  # one after the other, from the first word
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))], doc_id
    # other quotas of the same shape give other results
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: [[0] * len(quotas)] * (shards - 1) + [[q // 2 for q in quotas]])
    less = {r.doc_id: r.taken for r in mixing.mix_sources(frame(spark, rows), block_words=64)[0].collect()}
    assert sum(less.values()) < 0.7 * sum(r.taken for r in got)


def test_quotas_split_exactly_and_evenly():
    for seed in range(5):
        quotas = [13, 5, 0, 220, 7]
        parts = np.array(mixing.split_quotas(quotas, 16, seed))
        assert parts.sum(axis=0).tolist() == quotas and parts.min() >= 0
        assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 1
    mean = np.mean([mixing.split_quotas([40, 60], 2, s)[0] for s in range(400)], axis=0)
    assert abs(mean[0] - 20) < 0.6


# -------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([20, 70, 150, 400])), "en", rng.choice("abc"), 0, 0, 0.0, 0) for i in range(80)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "a", 0, 0, 0.0, 0) for i in range(12)]
    docs = frame(spark, rows).select(*p.COLUMNS)
    kept = p.quality_stage(spark, docs, "").collect()
    judged = {r.doc_id for r in fertility.quality(docs, vocabulary(PIECES), vocabulary(WORDS)).collect() if r.kept}
    assert {r.doc_id for r in kept} == judged and len(kept) == len(judged) > 50
    left = spark.createDataFrame(kept, docs.schema)
    singles = p.near_duplicate_stage(spark, left, "").collect()
    assert {r.doc_id for r in singles} == {c for _, c in classes([tuple(r) for r in kept], 5, 80).values()}
    assert len(singles) < len(kept)
    mixed = p.mixing_stage(spark, spark.createDataFrame(singles, docs.schema), "").collect()
    drawn = Counter()
    for r in mixed:
        drawn[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text) or r.n_chars == 0
    want = reshared(Counter({s: sum(len(words(r.text)) for r in singles if r.source == s) for s in "abc"}), (1, 2, 3), 3)
    assert all(abs(drawn[s] - want[s]) <= 1 for s in want)
    pieces = p.packing_stage(spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    assert len({(x.sequence_id, x.offset) for x in pieces}) == len(pieces) >= len(mixed)
    assert [f.name for f in left.schema] == list(p.COLUMNS) and p.STAGES[-1][1] is p.packing_stage


def test_pipeline_stages_keep_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    a, b, c, d, e = (prose(rng, 400) for _ in range(5))
    rows = [(i, t, "en", s, len(t)) for i, t, s in [(None, a, "x"), (None, b, "x"), (7, c, "x"), (7, c, "x"), (7, c, "x"), (7, d, "y"), (None, c, "y"), (9, e, None), (9, e, None)]]
    docs = spark.createDataFrame(rows, frame(spark, []).select(*p.COLUMNS).schema).repartition(3)
    kept = p.quality_stage(spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter(rows)
    singles = p.near_duplicate_stage(spark, docs, "").collect()
    assert Counter(map(tuple, singles)) == Counter([rows[0], rows[1], rows[2], rows[5], rows[7]])
    # all rows, so that ids repeat
    mixed = p.mixing_stage(spark, docs, "").collect()
    sizes, drawn = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    for r in mixed:
        drawn[r.source] += len(words(r.text))
    want = reshared(sizes, (1, 2, 3), 3)
    assert all(abs(drawn[s] - want[s]) <= 1 for s in sizes)
    of = Counter((r[0], r[3], t) for r in rows for t in [r[1]])
    for (i, s, t), n in of.items():
        got = sum(len(words(r.text)) for r in mixed if (r.doc_id, r.source) == (i, s) and " ".join(words(r.text)) in " ".join(words(t)))
        assert got <= 3 * n * len(words(t))
    pieces = p.packing_stage(spark, docs, "").collect()
    whole = Counter()
    for x in pieces:
        whole[x.doc_id] += x.start == 0
    assert whole == Counter(r[0] for r in rows)


def test_whole_pipeline_runs(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
    want = Counter(r.ids_crc32 for r in p.packing_stage(spark, docs, data).collect())
    assert Counter(r.ids_crc32 for r in p.run(spark, data).collect()) == want


def test_whole_pipeline_is_its_brute_force(spark, tmp_path):
    """run() over a table against plain Python of all four stages; only the seeded tree of quotas is taken from the library."""
    import sentencepiece
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    rng = random.Random(12)
    rows = []
    for i in range(90):
        rows.append((i, prose(rng, rng.choice([20, 60, 120, 300, 900])), rng.choice(["en", None, "xx"]), rng.choice(["a", "b", "b", "b", None])))
    for i in range(100, 130):  # near and exact copies of long ones, junk, repetition, nothing
        w = rows[i - 100][1].split(" ")
        w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w) if i % 3 else rows[i - 100][1], rows[i - 100][2], "b"))
    rows += [(200, "#".join("abc def " * 60), "en", "a"), (201, "one two three " * 40, None, "a"), (202, None, None, "a"), (203, "", "en", "b"), (204, "\n\n" + prose(rng, 2500), None, "b")]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    plain, tok = Tokenizer.from_file(vocabulary(WORDS)), Tokenizer.from_file(vocabulary(WORDS))
    plain.encode_special_tokens = True
    kept = []
    for r in rows:  # quality rules
        if base(r[1])[-1]:
            continue
        ids = [i for w in words(r[1]) for i in sp.encode(w)]
        chars, tokens = sum(map(len, words(r[1]))), plain.encode(r[1], add_special_tokens=False).ids
        bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
        share = sum(sp.is_byte(i) or sp.is_unknown(i) for i in ids) / len(ids)
        band = fertility.Bands().of(r[2], "latin")
        if band.chars_per_token[0] <= chars / len(ids) <= band.chars_per_token[1] and share <= band.byte_share and band.entropy[0] <= bits <= band.entropy[1] and band.chars_per_word_token[0] <= chars / len(tokens) <= band.chars_per_word_token[1]:
            kept.append(r)
    assert 30 < len(kept) < len(rows) - 10
    firsts = {c for _, c in classes(kept, 5, 80).values()}  # near duplicates
    single = [r for r in kept if r[0] in firsts]
    assert len(single) < len(kept) - 5
    size = {r[0]: len(words(r[1])) for r in single}  # mixing
    sizes = Counter()
    for r in single:
        sizes[r[3]] += size[r[0]]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = reshared(sizes, (1, 2, 3), 3)
    quota = {s: math.floor(target[s] + 0.5) for s in order}
    tree = mixing.split_quotas([-(-quota[s] // 1024) for s in order], 16, 0)
    drawn = []
    for i, s in enumerate(order):
        ends = [0]
        for shard in range(16):
            ends.append(min(quota[s], 1024 * sum(t[i] for t in tree[: shard + 1])))
        at = 0
        own = sorted((r for r in single if r[3] == s), key=lambda r: hashlib.md5(f"0:{r[0]}".encode()).hexdigest())
        for _ in range(3):
            for r in own:
                pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])
                for a, b in zip(ends, ends[1:], strict=False):
                    x, y = max(a, at), min(b, at + len(pieces))
                    if x < y:
                        drawn.append((r[0], r[1] if y - x == len(pieces) else "".join(pieces[x - at : y - at])))
                at += len(pieces)
    want = Counter()  # packing
    for doc_id, t in drawn:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    got = p.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for own in spans.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(spans) <= 1.02 * sum(n for own in spans.values() for _, n in own) / 2048 + 2
