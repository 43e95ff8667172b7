"""WARC archives, index first: write, index, and read back by coalesced byte ranges.

Writing: each task writes its rows as gzip members, one per record, into archive
files of its own in the shared folder, and returns an index row per record: file,
offset, length, URL and digest. A repeated task writes files with new names; the
index, a written table, names only those of the attempt that counted.

Reading: index rows are dealt out in ranges of (file, offset), so that a large archive
is read by many tasks. A task sorts its selection, joins ranges with small gaps
between them into one read, and inflates each record by itself.

Files are opened through pyarrow's file systems, so the folder may be on HDFS or in
an object store as well as on a shared disk.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.llm.batches import text_steps
from moundworks.sources.store import durable, open_folder, qualified, scratch_path, ship_package

#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT_BYTES = 100
#: Archive size at which a task starts the next file; gap and size up to which ranges become one read.
ARCHIVE_BYTES, MAX_GAP, MAX_READ = 256 << 20, 64 << 10, 8 << 20
#: Fixed date of all records: the input has no fetch time, and equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"

_INDEX = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("page_id", pa.string()), ("record_type", pa.string()),
])
_PAGES = ["page_id", "url", "html", "digest", "bytes", "refers_to"]


def urn(page_id: str | None) -> str:
    """A page's id as a header value, whatever is in it; a null id and an empty one differ."""
    return "<urn:nopage>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def id_of(value: str | None) -> str | None:
    return None if value is None or value == "<urn:nopage>" else unquote(value[len("<urn:page:"):-1])


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the digest and size of the full payload, and no body."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        *([f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
          if refers_to is not None else []),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
    return fields, rest[:size]


def _quoted(column: str) -> Column:
    """Header values hold no line breaks: in a URL they are written as URLs write them."""
    return F.replace(F.replace(F.col(column), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def with_first_seen(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """_PAGES: digest and size of each payload, and the page that a repeated one refers to.

    Only payloads that occur again are joined, and only their digest and smallest key
    travel to the pages.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).alias("page_id"), _quoted(url).alias("url"), payload.alias("html"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"),
    )
    again = (
        rows.filter(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(again, "digest", "left").select("page_id", "url", "html", "digest", "bytes", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write _PAGES rows as records below ``folder``; returns the index, as a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for part in text_steps(batch, "html"):
                    rows = []
                    for page in part.to_pylist():
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{root}/{name}", compression=None)
                        page_id = None if page["page_id"] is None else str(page["page_id"])
                        refers = None if page["refers_to"] is None else str(page["refers_to"])
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = packer.compress(record(page_id, page["url"], page["html"], page["digest"], page["bytes"], refers)) + packer.flush()
                        out.write(member)
                        rows.append((name, at, len(member), page["url"], page["digest"], page_id, "response" if refers is None else "revisit"))
                        at += len(member)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    index = "file string, offset bigint, length bigint, url string, digest string, page_id string, record_type string"
    return durable(pages.select(*_PAGES).mapInArrow(write, index))


def coalesced(ranges: list[tuple[int, int]], max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges, in groups that are read at once."""
    groups: list[list[tuple[int, int]]] = []
    for offset, length in ranges:
        if groups:
            first, last = groups[-1][0], groups[-1][-1]
            if offset - sum(last) <= max_gap and offset + length - first[0] <= max_read:
                groups[-1].append((offset, length))
                continue
        groups.append([(offset, length)])
    return groups


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and body of the
    records that the index rows select. A body that does not match its digest is an error."""
    out_schema = pa.schema([
        ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("body", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            wanted: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                wanted.setdefault(file, []).append((offset, length))
            for file, ranges in wanted.items():
                with store.open_input_file(f"{root}/{file}") as f:
                    for group in coalesced(sorted(ranges)):
                        start = group[0][0]
                        raw = memoryview(f.read_at(sum(group[-1]) - start, start))
                        rows = []
                        for offset, length in group:
                            fields, body = parse(zlib.decompress(raw[offset - start:offset - start + length], 31))
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                            response = fields["WARC-Type"] == "response"
                            if response and hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                            refers = fields.get("WARC-Refers-To")
                            rows.append((
                                id_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                                id_of(refers), digest, int(fields["WARC-Payload-Length"]), body,
                            ))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out_schema)], schema=out_schema)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, body binary")


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page to an archive in the shared folder and read all records back.

    Returns ``key``, payload_bytes, payload_digest, record_type, refers_to and body
    (empty for a revisit). Of equal payloads of at least MIN_REVISIT_BYTES bytes, the
    smallest key's is the response and the others revisit it; rows that repeat the
    smallest key are responses too. A null html is an empty payload; a null key is
    never referred to; a null URL gives no URI header. Ids may be of any type and hold
    anything, as they are percent-encoded. Long payloads are written and read whole.
    Every input row is a record; an empty table gives no rows. Other columns, whatever
    they are called, are not read.
    """
    ship_package(pages.sparkSession)
    folder = qualified(pages.sparkSession, scratch_path(pages.sparkSession, "warc"))
    index = write_archives(with_first_seen(pages, key, url, html), folder)
    found = read_records(index, folder)
    id_type = pages.schema[key].dataType.simpleString()
    return found.select(
        F.col("page_id").cast(id_type).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"), "body",
    )
