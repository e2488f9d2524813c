"""Web archives of pages: written with an index, read back by coalesced byte ranges.

Writing: each task puts records of its pages, one compressed member each, into archives of
bounded size and returns the index: archive, offset, length, URL, digest and kind of every
record. The index is what Spark commits, so archives of a task that was lost are never named
by it. Reading starts from the index: the selected records are dealt out by archive and offset
range, sorted, and ranges that lie close together are fetched by one read.

Pages with equal payloads of some size are stored once: the row of the largest id is a response and
the others are revisits that refer to it.

Cases: a null page is an empty payload; a null URL is an empty field; a null id is larger than
none, so it responds only where no other id has the payload; rows that repeat the responding
id are responses too; line breaks in a URL are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.session import scratch_path, ship

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 1000
ARCHIVE_BYTES = 256 << 20
#: Reads over a gap of unwanted bytes up to this are joined, up to the whole size below.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Width of the offset ranges by which reads are dealt out.
STRETCH_BYTES = 16 << 20

INDEX = ("archive string, offset long, length long, url string, digest string, payload_bytes long, "
         "record_type string, page_id long, refers_to long")
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_DATE = "2000-01-01T00:00:00Z"  # records of equal pages are equal


def _record(kind: str, page: int | None, url: str, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    """One record: named fields, then a block with the HTTP header and, for a response, the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    encoded = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [
        ("WARC-Type", kind), ("WARC-Target-URI", url), ("WARC-Date", _DATE),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Payload-Digest", f"sha1:{encoded}"), ("X-Payload-Length", str(size)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(field: str | None) -> int | None:
    number = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= most:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (html or "").encode()
                    url = "".join((url or "").split("\r")).replace("\n", "")
                    digest = hashlib.sha1(payload).hexdigest()
                    kind = "response" if refers is None else "revisit"
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    body = payload if kind == "response" else b""
                    member = pack.compress(_record(kind, page, url, digest, len(payload), refers, body)) + pack.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, len(payload), kind, page, refers))
                    at += len(member)
                if rows:
                    columns = list(zip(*rows))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()
    return run


def revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the responding page of a page that is stored elsewhere."""
    if not isinstance(pages.schema["page_id"].dataType, T.IntegralType):
        raise TypeError("page_id must be a whole number")
    spark, scratch = ship(pages.sparkSession), scratch_path(pages.sparkSession, "warc-payloads")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    html = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("key", F.when(F.octet_length(html) >= least, F.unhex(F.sha2(html, 256))))
    # only payloads that occur again are looked up, by digests alone
    shared = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("responds"), F.count("*").alias("n"))
    shared.where("n > 1").select("key", "responds").write.parquet(scratch)
    # an absent key is spread out: it meets nothing
    rows = rows.withColumn("key", F.coalesce("key", F.unhex(F.sha2(F.concat_ws("-", F.lit("small"), "page_id", "url"), 256))))
    found = rows.join(spark.read.parquet(scratch), "key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("responds")), F.col("responds"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives below ``folder`` and return the index, which is stored there as well."""
    index = revisits(pages, least).mapInArrow(_write(f"{folder}/archives", archive_bytes), INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def _fetch(folder: str, gap: int, most: int):
    def ranges(rows: list[tuple]) -> Iterator[tuple[str, int, int, list[tuple]]]:
        """Sorted records joined into reads."""
        group: list[tuple] = []
        for row in rows:
            if group and (row[0] != group[0][0] or row[1] - (group[-1][1] + group[-1][2]) > gap
                          or row[1] + row[2] - group[0][1] > most):
                yield group[0][0], group[0][1], group[-1][1] + group[-1][2], group
                group = []
            group.append(row)
        if group:
            yield group[0][0], group[0][1], group[-1][1] + group[-1][2], group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, archive = None, None
        for batch in batches:
            for wanted, low, high, group in ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if wanted != name:
                    if archive is not None:
                        archive.close()
                    name, archive = wanted, store.open_input_file(f"{root}/{wanted}")
                data, rows = archive.read_at(high - low, low), []
                for _, offset, length in group:
                    fields, payload = _parse(zlib.decompress(data[offset - low:offset - low + length], 31))
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"a damaged record in {wanted} at {offset}")
                    rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, size, digest,
                                 _page(fields.get("WARC-Refers-To")), payload if kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in RECORDS.split(", ")])
        if archive is not None:
            archive.close()
    return run


def read_archives(selected: DataFrame, folder: str, gap_bytes: int = GAP_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records that rows of an index select; the payload of a revisit is null."""
    spark: SparkSession = ship(selected.sparkSession)
    places = selected.select("archive", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / STRETCH_BYTES))
    dealt = places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive", "stretch")
    return (
        dealt.sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
        .mapInArrow(_fetch(f"{folder}/archives", gap_bytes, read_bytes), RECORDS)
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}" if folder.startswith("/") else folder
    index = write_archives(pages, folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
