"""WARC archives compressed record by record with a dictionary of their own.

An archive begins with a skippable Zstandard frame (magic 0x184D2A5D) that
holds the dictionary, trained on records of the archive; then each record is a
frame of its own. So one record can be read without the others, and an archive
needs nothing beside it."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, file_system, fresh_dir, keep, small_batches, with_row_keys

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{sha}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says: type, page_id, refers_to, digest, payload_bytes and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    said = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(said["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: None if x in ("<urn:page:null>", None) else int(x[len("<urn:page:") : -1])
    return {"page_id": number(said["WARC-Record-ID"]), "url": said["WARC-Target-URI"], "record_type": said["WARC-Type"], "refers_to": number(said.get("WARC-Refers-To")), "payload_digest": said["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size, "payload": payload}


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from samples; their plain end where they are too few to train on; none without any."""
    samples = [s for s in samples if s]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, k=200, d=8)
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-size:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def write_archive(out, records: Iterator[bytes], sample_records: int, sample_bytes: int, dict_bytes: int, level: int = 3) -> int:
    """Write records after the dictionary of the first of them (``sample_records`` records, ``sample_bytes`` bytes at most)."""
    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if len(first) >= sample_records or held >= sample_bytes:
            break
    words = train(first, dict_bytes)
    blob = words.as_bytes() if words else b""
    out.write(struct.pack("<II", SKIPPABLE, len(blob)) + blob)
    packer = zstandard.ZstdCompressor(level=level, **({"dict_data": words} if words else {}), write_content_size=True, write_checksum=True)
    n = 0
    for group in (first, records):
        for r in group:
            out.write(packer.compress(r))
            n += 1
    return n


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    blob = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if blob[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpack = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(blob, dict_type=kind)} if blob else {}))
    rest = b""
    while True:
        one = unpack.decompressobj()
        out = []
        while not one.eof:
            chunk = rest or stream.read(1 << 20)
            rest = b""
            if not chunk:
                if out:
                    raise ValueError("a record is cut off")
                return
            out.append(one.decompress(chunk))
            rest = one.unused_data if one.eof else b""
        yield b"".join(out)


def write_archives(pages: DataFrame, at: str | None = None, least_bytes: int = 0, sample_records: int = 1000, sample_bytes: int = 2_000_000, dict_bytes: int = 65_536) -> DataFrame:
    """Write ``page_id, url, html`` as archives under ``at`` (a new shared folder if not
    given), one a task; returns the manifest: path and n_records.

    Of records with equal payloads of at least ``least_bytes`` bytes that with the
    smallest page_id is the response (null ids last; of rows that tie in it, one) and the others revisit it;
    smaller ones are all responses. A null html is an empty payload, a null url an
    empty one. Repeated rows are records of their own. An empty table gives no archives. Other columns
    aren't read. Attempts that fail leave files that the manifest doesn't name."""
    spark = pages.sparkSession
    small_batches(spark)
    at = at or fresh_dir(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    seen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    keyed = seen.withColumn("_sha", F.unhex(F.sha1("html")))
    by_id = keyed.filter(F.octet_length("html") >= least_bytes).groupBy("_sha", "page_id").agg(F.count("*").alias("c"))
    firsts = by_id.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.sum("c").alias("_n"), F.min_by("c", F.struct(F.col("page_id").isNull(), "page_id")).alias("_c")).filter("_n > 1")
    firsts = keep(firsts, "repeated-payloads")
    one = F.lit(None).cast("long")
    if not firsts.filter("_c > 1").isEmpty():  # several rows of one payload have its smallest page_id: one of them is chosen by a row key
        keyed = with_row_keys(keyed, "warc-rows")
        tied = keyed.join(firsts.filter("_c > 1").select("_sha", "_first"), "_sha").filter(F.col("page_id").eqNullSafe(F.col("_first")))
        firsts = keep(firsts.join(tied.groupBy("_sha").agg(F.min(ROW).alias("_row")), "_sha", "left"), "tied-payloads")
        one = F.col(ROW)
    else:
        firsts = firsts.withColumn("_row", F.lit(None).cast("long"))
    # a payload of at least a thousandth of all rows is looked up in a broadcast table (there are a thousand at most), so no key of the join is hot
    least = max(2, firsts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] // 1000)
    facts = ("_first", "_n", "_row")
    hot = firsts.filter(F.col("_n") >= least).select(F.col("_sha").alias("_h"), *[F.col(x).alias(f"_h{x}") for x in facts])
    wide = keyed.withColumn("_one", one).join(F.broadcast(hot), F.col("_sha") == F.col("_h"), "left")
    key = F.when(F.col("_h").isNull(), F.col("_sha")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("page_id", "url")), 16, "0")))  # eight bytes meet no digest
    joined = wide.withColumn("_k", key).join(firsts.filter(F.col("_n") < least).select(F.col("_sha").alias("_k"), *facts), "_k", "left")
    first, n, row = [F.coalesce(f"_h{x}", x) for x in facts]
    lead = F.col("page_id").eqNullSafe(first) & (row.isNull() | row.eqNullSafe(F.col("_one")))
    marked = joined.select("page_id", "url", "html", "_sha", first.alias("_first"), ((F.coalesce(n, F.lit(1)) > 1) & ~lead).alias("_revisit"))
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, body, sha, first, revisit in zip(*[batch.column(i) for i in range(6)], strict=True):
                    yield record(page_id.as_py(), url.as_py(), body.as_py(), base64.b32encode(sha.as_py()).decode(), first.as_py(), revisit.as_py())

        fs, root = file_system(at)
        stream = records()
        if (head := next(stream, None)) is None:
            return
        fs.create_dir(root, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.zst"

        def all_records() -> Iterator[bytes]:
            yield head
            yield from stream

        with fs.open_output_stream(f"{root}/{name}") as out:
            n = write_archive(out, all_records(), sample_records, sample_bytes, dict_bytes)
        yield pa.RecordBatch.from_pylist([{"path": f"{at}/{name}", "n_records": n}], schema=schema)

    return keep(marked.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Read archives back: page_id, url, payload_bytes, payload_digest, record_type and
    refers_to of each record (and payload, if asked). The digest of each response is made anew and must be the one it states."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(inner) as stream:
                    for data in read_archive(stream):
                        row = parse(data)
                        if row["record_type"] == "response" and digest(row["payload"]) != row["payload_digest"]:
                            raise ValueError(f"a payload in {path} isn't what its record states")
                        held += len(data) * payloads
                        rows.append({k: row[k] for k, _ in fields})
                        if len(rows) >= 5000 or held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spec = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, spec)
