"""Shared pieces of the training-data operators: the shared folder, fixed-width
hashing of words and shingles over Arrow buffers, and the cached word encoder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import unicodedata
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java, RE2 and Python regular expressions all read it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are hashed at once in a Python worker.
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would lose data, so that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file:///tmp/checkpoints/" + os.path.basename(tempfile.mkdtemp(dir=_made("/tmp/checkpoints")))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def _made(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back. Inside ``scratch`` the table goes when that ends.
    ``rows``: about how many narrow rows there are at most, for as many files as they need (50,000 a file, twelve at least)."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(12, rows // 50_000))
    at = fresh_dir(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(at)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables kept inside are removed at the end, and shuffle files that nothing reads any more are let go. ``settle`` gives the result."""
    mine: list[str] = []
    _SCRATCH.append(mine)
    try:
        yield
    finally:
        _SCRATCH.remove(mine)
        for at in mine:
            _delete(spark, at)
        release(spark)


def settle(df: DataFrame, name: str) -> DataFrame:
    """``keep`` for a result: inside ``scratch`` it outlives that, and only an outer one, if there is one, removes it."""
    inner = _SCRATCH.pop() if _SCRATCH else None
    try:
        return keep(df, name)
    finally:
        if inner is not None:
            _SCRATCH.append(inner)


def small_batches(spark: SparkSession) -> None:
    """Batches of at most 8 MB between Spark and Python workers: texts and sets are wide rows, and both sides hold a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing holds any more; it learns of them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Name of the column that tells rows apart, whatever their doc_id.
ROW = "_row_key"


def with_row_keys(df: DataFrame, name: str) -> DataFrame:
    """``df`` and a distinct number for each row, kept so that every reading gives the same ones."""
    return keep(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table made by ``keep`` that nothing reads any more."""
    for at in {os.path.dirname(x) for x in df.inputFiles()}:
        _delete(spark, at)


def file_system(uri: str):
    """The file system of a URI, and the path in it, for use in executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def salt_count(rows: int, each: int, least: int = 1) -> int:
    """Parts that ``rows`` make at about ``each`` rows a part."""
    return max(least, -(-rows // each))


# -------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a public bijection of 64-bit words)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _multipliers(n: int, seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, row offsets, bytes) of runs of rows with about ``limit`` bytes; a null is empty.
    Only a run at a time is copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = max(1, limit // 4096)
    for first in range(0, len(column), rows):
        part = column.slice(first, rows).cast(pa.large_string()).fill_null("")
        _, offsets, data = part.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield first + i, off[i : j + 1] - off[i], raw[off[i] : off[j]]
            i = j


def word_spans(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and for each row the index of its first word."""
    n = len(data)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit multilinear hashes of words, mixed with their lengths."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    longest = int(size.max())
    table = _multipliers(1 << max(6, (min(longest, 1 << 16) - 1).bit_length()))
    run = np.diff(starts, append=len(data))
    pos = np.arange(starts[0], len(data)) - np.repeat(starts, run)
    value = data[starts[0] :].astype(np.uint64) + np.uint64(1)
    value[_SPACE[data[starts[0] :]]] = 0
    value *= table[pos & (len(table) - 1)]
    if longest > len(table):
        value *= _multipliers(1 << (longest // len(table)).bit_length(), 7)[pos // len(table)]
    return mix(np.add.reduceat(value, starts - starts[0]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (len(words) - k + 1 of them), in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = _multipliers(64, 3)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * m[j]
    return mix(total + np.uint64(k))


def shingle_sets(column: pa.Array, k: int, lower: bool = True):
    """For each row: its row number and the sorted distinct hashes of its ``k``-word
    shingles; fewer words make one shingle of them all, none make an empty set."""
    for row, off, data in text_slices(column):
        if lower:
            data = _LOWER[data]
        starts, ends, bounds = word_spans(off, data)
        words = word_hashes(data, starts, ends)
        runs = window_hashes(words, k)
        for i in range(len(off) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                s = np.sort(runs[a : b - k + 1])
                yield row + i, s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                yield row + i, window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


# ------------------------------------------------------------- worker memory
_CACHES: list = []


def cached_in_worker(function):
    """A cache of one vocabulary in a worker process: another kind's goes before this one is loaded."""
    kept = functools.lru_cache(maxsize=1)(function)
    _CACHES.append(kept)

    @functools.wraps(function)
    def only(*args, **options):
        others = [x for x in _CACHES if x is not kept and x.cache_info().currsize]
        for x in others:
            x.cache_clear()
        if others:
            _trim()
        return kept(*args, **options)

    return only


def lean(run):
    """For functions over batches that need no vocabulary: drop those that earlier work left in a reused
    worker, and give freed memory back to the system before and after."""

    @functools.wraps(run)
    def leaner(batches):
        _drop_vocabularies()
        yield from run(batches)
        _trim()

    return leaner


def lean_group(run):
    """``lean`` for a function of a group's whole table."""

    @functools.wraps(run)
    def leaner(table: pa.Table) -> pa.Table:
        _drop_vocabularies()
        out = run(table)
        _trim()
        return out

    return leaner


def _drop_vocabularies() -> None:
    # a function of the module, as the caches themselves can't be sent to workers
    for kept in _CACHES:
        kept.cache_clear()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ------------------------------------------------------------- word encoding
@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write each byte as one letter: printable Latin-1 bytes as themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkCache:
    """Token ids of texts, each distinct blank-free chunk encoded once.

    Chunks are found, hashed (64 bits) and looked up with numpy over slices of
    text, and the ids of a slice are gathered from one flat array. At most
    ``limit`` chunks are kept and then dropped together, so memory is bounded.
    Subclasses say how to encode a list of new chunks."""

    folded = False  # ASCII capitals fold, and a letter's final mark stands alone

    def __init__(self, limit: int = 600_000):
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.rank = np.zeros(0, np.int64)  # of a key: which chunk
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _look_up(self, keys: np.ndarray, chunk) -> np.ndarray:
        """Which chunk each of the distinct sorted ``keys`` is; ``chunk(i)`` has the bytes of the i-th."""
        if len(self.rank) + len(keys) > self.limit and len(self.rank):
            self._reset()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        which = np.empty(len(keys), np.int64)
        which[known] = self.rank[at[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            ids = self.encode_chunks([chunk(i).decode("utf-8", "replace") for i in new.tolist()])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            which[new] = len(self.rank) + np.arange(len(new))
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.rank = np.insert(self.rank, at[new], which[new])
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))))
        return which

    def slices(self, column: pa.Array):
        """(first row, ids, offsets of the rows in ids) of runs of rows."""
        for row, off, data in text_slices(column, 4 * SLICE_BYTES):
            starts, ends, bounds = word_spans(off, data)
            if not len(starts):
                yield row, np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
                continue
            if self.folded:
                odd = np.logical_or.reduceat((data == 60) | (data == 39), starts)  # < and ' begin longer units
                last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
                cut = _MARK[last] & _LETTER[before] & ~odd
                hashed = _LOWER[data]
                if odd.any():
                    own = np.repeat(odd, np.diff(starts, append=len(data)))
                    hashed[starts[0] :] = np.where(own, data[starts[0] :], hashed[starts[0] :])
                marks = ends[cut] - 1
                at = np.searchsorted(starts, marks)
                bounds = bounds + np.concatenate(([0], np.cumsum(cut)))[bounds]
                starts, ends = np.insert(starts, at, marks), np.insert(np.where(cut, ends - 1, ends), at, marks + 1)
            else:
                hashed = data
            keys, first, inverse = np.unique(_span_hashes(hashed, starts, ends), return_index=True, return_inverse=True)
            which = self._look_up(keys, lambda i, d=data, a=starts, b=ends, f=first: d[a[f[i]] : b[f[i]]].tobytes())[inverse]
            begin = self.start[which]
            size = self.start[which + 1] - begin
            out = np.concatenate(([0], np.cumsum(size)))
            ids = self.flat[np.repeat(begin - out[:-1], size) + np.arange(out[-1])]
            yield row, ids, out[bounds]


_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(x) for x in ".,;:!?"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, which may touch each other."""
    size = ends - starts
    total = np.concatenate(([0], np.cumsum(size)))
    pos = np.arange(total[-1]) - np.repeat(total[:-1], size)
    table = _multipliers(1 << max(6, (min(int(size.max()), 1 << 16) - 1).bit_length()))
    value = data[pos + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    value *= table[pos & (len(table) - 1)]
    if int(size.max()) > len(table):
        value *= _multipliers(1 << (int(size.max()) // len(table)).bit_length(), 7)[pos // len(table)]
    return mix(np.add.reduceat(value, total[:-1]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class WordEncoder(ChunkCache):
    """Ids under a file of the ``tokenizers`` library, without special tokens of a template.

    A tokenizer that lower-cases and splits letters from the rest never merges
    across white space, so its chunks are cached; any other gets whole texts.
    A chunk of Latin letters goes straight to the library's BPE model, which
    skips only the normaliser and splitter (both leave it one lower-case run).
    ``plain``: the strings of special tokens are ordinary text, so no text holds a special id."""

    def __init__(self, path: str, limit: int = 600_000, plain: bool = False):
        super().__init__(limit)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        shape = str(self.tok.normalizer) + str(self.tok.pre_tokenizer)
        self.folded = "NFC" in shape and "Lowercase" in shape and "p{L}" in shape and "ByteLevel" in shape

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        model, letters = self.tok.model.tokenize, _byte_letters()
        out: list = [None] * len(chunks)
        rest = []
        for i, c in enumerate(chunks):
            if self.folded and c.isalpha():
                if c.isascii():
                    out[i] = [t.id for t in model(c.lower())]
                    continue
                low = unicodedata.normalize("NFC", c).lower()
                if max(low) < "ɐ" and low.isalpha():  # a letter may lower to a letter and a mark
                    out[i] = [t.id for t in model("".join(map(letters.__getitem__, low.encode())))]
                    continue
            rest.append(i)
        for i, e in zip(rest, self.tok.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def rows(self, column: pa.Array):
        """Ids of each row as an array of unsigned 32-bit numbers, in order; a null has none."""
        if self.folded:
            for _, ids, off in self.slices(column):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    yield ids[a:b]
        else:
            for text in column:
                yield np.array(self.tok.encode(text.as_py() or "", add_special_tokens=False).ids, np.uint32)


@cached_in_worker
def word_encoder(path: str, plain: bool = False) -> WordEncoder:
    """One encoder a worker process and vocabulary; Spark reuses its workers."""
    return WordEncoder(path, plain=plain)
