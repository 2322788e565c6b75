"""WARC archives: writing, normalising monolithic gzip, reading back by offset.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such a file once, as a
stream, and writes every record as a gzip member of its own, with a sidecar index of where each begins; a reader then
takes any record by its offset. Files go through a temporary name and are moved into place when they are whole, so a
task that runs again after a lost executor leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, shared_dir

#: Inflated bytes after which an archive is closed and another begun.
ARCHIVE_BYTES = 32 << 20
#: Effort of compression: moderate, as archives are written twice here.
LEVEL = 5
#: Bytes handled at once when a stream is inflated.
CHUNK = 1 << 18
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


def _write(path: str, pieces: Iterator[bytes]) -> None:
    fs, at = _fs(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        for x in pieces:
            f.write(x)
    fs.move(part, at)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response holds the payload after an HTTP header, a revisit only that header. The page's id and the
    full payload's length are in extension fields. A null id or url leaves its fields out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes | bytearray) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) and where the block begins; raises on what is no record."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in bytes(data[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def _inflate(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file, be it one member or several, as a stream."""
    fs, at = _fs(path)
    with fs.open_input_stream(at, compression=None) as f:
        z = zlib.decompressobj(31)
        while data := f.read(CHUNK):
            while data:
                yield z.decompress(data)
                data = z.unused_data
                if z.eof:
                    z = zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of inflated bytes; memory for one record and a chunk."""
    held = bytearray()
    for c in chunks:
        held += c
        while (end := held.find(b"\r\n\r\n")) >= 0:
            fields, start = parse_head(held)
            whole = start + int(fields["content-length"]) + 4
            if len(held) < whole:
                break
            yield bytes(held[:whole])
            del held[:whole]
    if held.strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def normalise(source: str, target: str, index: str) -> int:
    """Rewrite ``source`` so that each record is a gzip member; ``index`` gets a line ``offset length`` each. Returns their
    number. The source is inflated once."""
    lines: list[str] = []

    def members() -> Iterator[bytes]:
        offset = 0
        for r in records(_inflate(source)):
            z = zlib.compressobj(LEVEL, wbits=31)
            m = z.compress(r) + z.flush()
            lines.append(f"{offset} {len(m)}\n")
            offset += len(m)
            yield m

    _write(target, members())
    _write(index, iter(["".join(lines).encode()]))
    return len(lines)


def read_indexed(target: str, index: str) -> Iterator[bytes]:
    """Records of a normalised archive, each taken by its offset."""
    fs, at = _fs(target)
    ifs, iat = _fs(index)
    with ifs.open_input_stream(iat, compression=None) as f:
        places = [tuple(map(int, line.split())) for line in f.read().decode().splitlines()]
    with fs.open_input_file(at) as f:
        for offset, length in places:
            f.seek(offset)
            yield zlib.decompress(f.read(length), 31)


def with_references(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 0) -> DataFrame:
    """id, url, html (null: empty), record_type and refers_to of ``pages``. Of pages with equal payloads of at least ``least`` bytes
    that of the greatest id is the response, the others are revisits of it; shorter ones are all responses. A page
    without id is a response and is never referred to; rows that repeat an id and payload are alike. Other columns,
    whatever their names, are not read. Only ids and digests are grouped, so a payload that many pages share costs no more
    than others; payloads meet their decision by a join on the page's id, which is spread evenly."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    slim = rows.where(F.col("id").isNotNull() & (F.length(body) >= least)).select("id", F.sha2(body, 256).alias("sha"))
    shared = slim.groupBy("sha").agg(F.max("id").alias("refers_to"), F.min("id").alias("first")).where("first < refers_to").select("sha", "refers_to")
    again = slim.join(shared, "sha").where("id < refers_to").distinct()
    joined = rows.withColumn("sha", F.sha2(body, 256)).join(again, ["id", "sha"], "left")
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    return joined.select("id", "url", "html", kind.alias("record_type"), "refers_to")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``rows`` (of ``with_references``) as WARC files in ``folder``, each one gzip stream: (path, n_records), materialised."""
    rows = rows.select("id", "url", "html", "record_type", "refers_to")

    def write(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        source = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5))))
        held = next(source, None)
        while held is not None:
            count = 0

            def stream():
                nonlocal held, count
                z, size = zlib.compressobj(LEVEL, wbits=31), 0
                while held is not None and size < archive_bytes:
                    page_id, url, text, kind, to = held
                    payload = text.encode()
                    r = record(kind, page_id, url, payload, payload_digest(payload), to)
                    size, count = size + len(r), count + 1
                    yield z.compress(r)
                    held = next(source, None)
                yield z.flush()

            path = f"{folder}/raw-{part:06d}-{n:05d}.warc.gz"
            _write(path, stream())
            n += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count]})

    return cut(rows.mapInArrow(write, "path string, n_records long"))


def normalise_archives(archives: DataFrame, tasks: int) -> DataFrame:
    """Normalise every archive of ``archives(path, ...)`` beside itself: (path, index, n_records), materialised."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                target = re.sub(r"raw-([^/]*)\.warc\.gz$", r"records-\1.warc.gz", path)
                n = normalise(path, target, target + ".idx")
                yield pa.RecordBatch.from_pydict({"path": [target], "index": [target + ".idx"], "n_records": [n]})

    return cut(archives.select("path").repartition(tasks, "path").mapInArrow(run, "path string, index string, n_records long"))


def read_archives(archives: DataFrame, tasks: int) -> DataFrame:
    """One row a record of ``archives(path, index)``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload
    (null for revisits). A response whose payload does not have the digest in its header is an error."""

    def run(batches):
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist()):
                rows: list[tuple] = []
                size = 0
                for r in read_indexed(path, index):
                    h, start = parse_head(r)
                    kind = h["warc-type"]
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    payload = None
                    if kind == "response":
                        payload = r[r.index(b"\r\n\r\n", start) + 4 : -4]
                        if payload_digest(payload) != digest or len(payload) != int(h["x-payload-length"]):
                            raise ValueError(f"{path}: a payload differs from its digest")
                    to = h.get("warc-refers-to")
                    rows.append((int(h["x-page-id"]) if "x-page-id" in h else None, int(h["x-payload-length"]), digest, kind, int(to[len("<urn:page:") : -1]) if to else None, h.get("warc-target-uri"), payload))
                    size += len(r)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return archives.select("path", "index").repartition(tasks, "path").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, **cols) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (a new one in the shared folder by default), normalise them, read them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    raw = write_archives(with_references(pages, least=least, **cols), folder)
    tasks = max(2, min(raw.count(), 4 * spark.sparkContext.defaultParallelism))
    return read_archives(normalise_archives(raw, tasks), tasks)
