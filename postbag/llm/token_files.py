"""Flat token files: unsigned little-endian ids, with 64-bit document offsets beside them.

A part is three files: ``.bin`` (ids, 2 bytes each if the vocabulary fits in 16
bits, else 4), ``.idx`` (signed 64-bit offsets in ids, one more than documents)
and ``.ids`` (signed 64-bit document ids, the least number for a null). Parts
are written by the tasks that hold the documents; the manifest lists only what
finished tasks wrote, so a lost executor or a repeated attempt leaves at most
files that nothing names. Where a part begins among all ids is a prefix sum
over the manifest."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, fresh_dir, keep, small_batches, word_encoder

NULL_ID = -(2**63)
MANIFEST = "path string, width int, first_id long, n_docs long, n_tokens long"


def _parts(at: str, tokenizer: str, end_id: int, plain: bool):
    schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer, plain)
        width = 2 if max(enc.tok.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        kind = np.dtype(f"<u{width}")
        fs, root = file_system(at)
        fs.create_dir(root, recursive=True)
        name, first, docs, tokens = f"part-{uuid.uuid4().hex}", None, 0, 0
        files: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                files = [fs.open_output_stream(f"{root}/{name}.{x}") for x in ("bin", "idx", "ids")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8")
            first = int(ids[0]) if first is None else first
            sizes, out = [], []
            for row in enc.rows(batch.column(1)):
                out += [row.astype(kind), np.array([end_id], kind)]
                sizes.append(len(row) + 1)
                if len(out) > 2000:
                    files[0].write(np.concatenate(out).tobytes())
                    out = []
            if out:
                files[0].write(np.concatenate(out).tobytes())
            ends = tokens + np.cumsum(sizes)
            files[1].write(ends.astype("<i8").tobytes())
            files[2].write(ids.tobytes())
            docs, tokens = docs + len(ids), int(ends[-1])
        for f in files:
            f.close()
        if files:
            yield pa.RecordBatch.from_pylist([{"path": f"{at}/{name}", "width": width, "first_id": first, "n_docs": docs, "n_tokens": tokens}], schema=schema)

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, ordered: bool = True, plain: bool = False, at: str | None = None) -> DataFrame:
    """Encode ``doc_id, text`` into parts under ``at`` (a new shared folder if not given);
    returns the manifest: path, width, first_id, n_docs, n_tokens, and per part
    ``base`` (ids before it) and ``doc_base`` (documents before it).

    Each document's ids are those of the tokenizer with nothing added, and then
    ``end_id``. ``ordered``: ids ascend over all parts (nulls first, ties by
    text); otherwise documents stay where they are and are never shuffled.
    ``plain``: the strings of special tokens in a text are ordinary text, so that a
    special end id stands at document ends alone. A
    null text is empty (only the end id); an empty table gives no parts. Other
    columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    at = at or fresh_dir(spark, "tokens")
    seen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if ordered:
        # ranges by the beginning of the text part the rows of a frequent doc_id; whole texts as keys would go to the driver in its samples
        seen = seen.repartitionByRange(F.asc_nulls_first("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    parts = keep(seen.mapInArrow(_parts(at, tokenizer, end_id, plain), MANIFEST), "manifest")
    before = Window.orderBy("first_id", "path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return parts.withColumns({"base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "doc_base": F.coalesce(F.sum("n_docs").over(before), F.lit(0))})


def _mapped(path: str):
    """A part's file as a read-only buffer: memory-mapped where the file system is local."""
    fs, inner = file_system(path)
    if fs.type_name == "local":
        source = pa.memory_map(inner)
        return source.read_buffer() if source.size() else pa.py_buffer(b"")
    with fs.open_input_file(inner) as f:
        return f.read_buffer()


class TokenPart:
    """Random access to the documents of one part."""

    def __init__(self, path: str, width: int):
        self.ids = np.frombuffer(_mapped(f"{path}.bin"), dtype=f"<u{width}")
        self.offsets = np.frombuffer(_mapped(f"{path}.idx"), dtype="<i8")
        self.doc_ids = np.frombuffer(_mapped(f"{path}.ids"), dtype="<i8")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document, over all parts), n_tokens and ids_crc32
    (of the ids as little-endian unsigned 32-bit numbers) of every document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = TokenPart(row["path"], row["width"])
                for a in range(0, len(part), 10_000):
                    some = range(a, min(a + 10_000, len(part)))
                    crc = [zlib.crc32(part[i].astype("<u4").tobytes()) for i in some]
                    ids = part.doc_ids[a : some.stop]
                    off = part.offsets[a : some.stop + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(row["base"] + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], schema=schema)

    files = manifest.select("path", "width", "base")
    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document_ids(manifest: DataFrame) -> DataFrame:
    """doc_id and ordinal (from 0 over all parts) of every document, from the parts' id files."""
    schema = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(_mapped(f"{row['path']}.ids"), dtype="<i8")
                for a in range(0, len(ids), 100_000):
                    some = ids[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, mask=some == NULL_ID), pa.array(row["doc_base"] + a + np.arange(len(some)))], schema=schema)

    return manifest.select("path", "doc_base").repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, ordinal long")
