"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame (operator 8).

An archive file is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame for each
record, which can be decoded alone once the dictionary is loaded. A record is a version line, headers, an empty line, a block
of Content-Length bytes, and two line ends. Equal payloads are written once: later ones are revisit records that name the first.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nextrail.sources.tables import own_folder

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads smaller than this are always written.
SMALLEST_REVISIT = 100
#: Bytes of records in an archive, about, after which a task begins a new one; bytes to train its dictionary on, and its size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 4 << 20, 64 << 10
#: Bytes given to the decoder at once.
STEP = 64 << 10

RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, archive string, place long, error string"


def with_revisits(pages: DataFrame, id_col: str, payload: str) -> DataFrame:
    """``pages`` with ``_digest`` and ``_first``: the smallest id of an equal earlier payload, null for first ones.

    Rows with the smallest id themselves, payloads under ``SMALLEST_REVISIT`` bytes, and payloads whose rows all have null ids are
    first ones. Digests are counted before they are joined, and only those that repeat are.
    """
    rows = pages.withColumn("_digest", F.sha2(F.col(payload), 256))
    large = rows.where(F.octet_length(payload) >= SMALLEST_REVISIT)
    repeated = large.groupBy("_digest").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    repeated = repeated.where((F.col("_rows") > 1) & F.col("_least").isNotNull()).drop("_rows")
    rows = rows.join(repeated, "_digest", "left")
    first = F.when(~F.col(id_col).eqNullSafe(F.col("_least")), F.col("_least"))
    return rows.withColumn("_first", first).drop("_least")


def _header(text: str | None) -> str:
    """A value that fits on a header line: what isn't printable ASCII is written as %XX."""
    return "".join(c if " " < c < "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def _unheader(text: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()


def _urn(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else _header(str(page_id))}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, first: object = None) -> bytes:
    """One record: a response with the payload, or a revisit of ``first`` without it. A null url is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    lines = [
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A whole archive file. Too few or too uniform records to train on give one with an empty dictionary frame."""
    samples, used = [], 0
    for r in records:
        samples.append(r[: 16 << 10])
        used += len(samples[-1])
        if used > SAMPLE_BYTES:
            break
    trained = b""
    if len(samples) >= 16:
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, used // 8), samples, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    coder = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
    held = zstandard.ZstdCompressor(level=3).compress(trained) if trained else b""
    return struct.pack("<II", SKIPPABLE, len(held)) + held + b"".join(map(coder.compress, records))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and content of each record's frame. Raises ValueError at the first that can't be decoded."""
    view, at, known = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        held = bytes(view[8 : 8 + size])
        if len(held) < size:
            raise ValueError("the dictionary frame is cut off")
        if held.startswith(FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        if held and not held.startswith(DICTIONARY):
            raise ValueError("the leading skippable frame holds no dictionary")
        known = zstandard.ZstdCompressionDict(held) if held else None
        at = 8 + size
    coder = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(view):
        start, parts, frame = at, [], coder.decompressobj()
        while not frame.eof:
            if at >= len(view):
                raise ValueError(f"the frame at {start} is cut off")
            step = view[at : at + STEP]
            try:
                parts.append(frame.decompress(step))
            except zstandard.ZstdError as e:
                raise ValueError(f"the frame at {start}: {e}") from e
            at += len(step)
        at -= len(frame.unused_data)
        yield start, b"".join(parts)


def parse(data: bytes) -> dict:
    """The fields of a record. Raises ValueError if a header is missing or a length or digest doesn't fit."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no version line or no end of the headers")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad or repeated header {name!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"no header {name}")
    length = _length(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block isn't as long as its header says")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("the block is no response")
    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise ValueError("the response has no length")
    size = _length(sizes[0].decode().strip())
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload doesn't fit its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError("no response and no proper revisit")
    return {
        "page_id": _of_urn(fields["warc-record-id"]),
        "url": _unheader(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
        "record_type": kind,
        "refers_to": _of_urn(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _length(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text):
        raise ValueError(f"bad length {text!r}")
    return int(text)


def _of_urn(text: str) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", text)
    if not found:
        raise ValueError(f"bad record id {text!r}")
    return _unheader(found[1]) or None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes every row of ``pages`` as one record to ``folder``, a new folder that all executors reach (file, hdfs or s3).

    A null html is an empty payload, null ids and urls are allowed, other columns are left out. A task writes its archives
    under a name of its attempt and then renames them, so that tasks that ran twice leave each archive once.
    """
    rows = pages.select(
        pages[id_col].alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = with_revisits(rows, "page_id", "payload").select("page_id", "url", "payload", "_digest", "_first")
    store, top = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, done = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        store, top = pa.fs.FileSystem.from_uri(folder)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{top}/pages-{part:06}-{done:04}"
            with store.open_output_stream(f"{name}.{attempt}.tmp", compression=None) as out:
                out.write(archive(records))
            store.move(f"{name}.{attempt}.tmp", f"{name}.warc.zst")
            return pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.zst"], "records": pa.array([len(records)], pa.int64())})

        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, payload, digest, first))
                size += len(held[-1])
                if size > ARCHIVE_BYTES:
                    yield flush(held)
                    held, size, done = [], 0, done + 1
        if held:
            yield flush(held)

    rows.mapInArrow(run, "archive string, records long").write.format("noop").mode("overwrite").save()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the ``*.warc.zst`` files in ``folder``, with the archive's name and the frame's place.

    Headers, lengths and digests are checked. A record that fails gives a row with ``error`` and no other field, and
    a frame that can't be decoded one that ends its archive. An empty folder gives no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    schema = T._parse_datatype_string(RECORD)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], shape)

        for batch in batches:
            for row in range(batch.num_rows):
                path, found, size = batch.column("path")[row].as_py(), [], 0
                records, at = frames(batch.column("content")[row].as_py()), None
                while True:
                    try:
                        at, data = next(records)
                        found.append(parse(data) | {"archive": path, "place": at})
                        size += len(data)
                    except StopIteration:
                        break
                    except ValueError as e:
                        found.append({"archive": path, "place": at, "error": str(e)})
                    if size > 8 << 20:
                        yield packed(found)
                        found, size = [], 0
                if found:
                    yield packed(found)

    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of ``pages`` written to a new folder beside the session's checkpoints and read back."""
    spark = pages.sparkSession
    folder = own_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write_archives(pages, folder, id_col, url_col, html_col)
    return read_archives(spark, folder)


ORACLE = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT *, strlen(html) AS size, min(page_id) OVER (PARTITION BY html) AS least FROM payloads)
SELECT page_id, size AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN size >= {SMALLEST_REVISIT} AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= {SMALLEST_REVISIT} AND page_id <> least THEN least END AS refers_to
FROM firsts
"""
