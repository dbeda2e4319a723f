"""Operator 8, ARC to WARC conversion, WARC files and their reader.

``parse_arc`` reads version 1 and version 2 archives: the version block names the fields, each
record has one header line and as many bytes as it declares.  ``to_warc`` synthesises the WARC
identifier, date, type and digests.  Files are written by Spark's text writer, one record a row
and gzip-compressed, so commits, retries and remote stores are Spark's; they are read by its
binary-file source and parsed by declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import table

#: The field names of the two ARC versions and the profile of a WARC revisit.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"
WARC_SCHEMA = "record_id string, page_id long, record_type string, uri string, date string, payload_bytes long, payload_digest string, payload binary, refers_to long"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes


def arc_header(name: str, version: int) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 quillgraph\n{' '.join(FIELDS[version])}\n\n".encode()
    tail = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 19960923142103 text/plain {tail}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, mime: str = "text/html", ip: str = "0.0.0.0", status: int = 200, offset: int = 0, name: str = "pages.arc") -> bytes:
    """One archive record of that version; white space in the URL is escaped, as the header is space-separated."""
    url = "".join(f"%{ord(c):02X}" if c.isspace() else c for c in url) or "about:blank"
    head = [url, ip, date, mime]
    if version == 2:
        head += [str(status), base64.b32encode(hashlib.sha1(content).digest()).decode(), "-", str(offset), name]
    return " ".join([*head, str(len(content))]).encode() + b"\n" + content + b"\n"


def parse_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """Records of an archive in order, without its version block; raises on a wrong header or a short record."""
    names: list[str] | None = None
    version = 1
    while True:
        line = stream.readline()
        while line == b"\n":
            line = stream.readline()
        if not line:
            return
        text = line.rstrip(b"\n").decode("utf-8")
        if names is None:
            parts = text.rsplit(" ", 4 if text.count(" ") == 4 else 9)
            body = stream.read(int(parts[-1]))
            version = int(body.split(b" ", 1)[0])
            if not parts[0].startswith("filedesc://") or version not in FIELDS:
                raise ValueError(f"not an archive header: {text[:80]}")
            names = body.split(b"\n")[1].decode().split(" ")
            continue
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields in a header line of version {version}: {text[:80]}")
        fields = dict(zip(names, parts, strict=True))
        content = stream.read(int(fields["Archive-length"]))
        if len(content) != int(fields["Archive-length"]):
            raise ValueError("the archive ends within a record")
        yield ArcRecord(version, fields, content)


def record_uuid(page_id: int | None, content: bytes) -> uuid.UUID:
    """A version 8 identifier: 46 bits of a digest, a bit for a null id, and the 64 bits of the id."""
    digest = int.from_bytes(hashlib.sha1(content).digest()[:6], "big") >> 2
    number = (digest << 1 | (page_id is None)) << 64 | ((page_id or 0) & (1 << 64) - 1)
    return uuid.UUID(int=(number >> 74 & (1 << 48) - 1) << 80 | 8 << 76 | (number >> 62 & 0xFFF) << 64 | 2 << 62 | number & (1 << 62) - 1)


def page_of(record: uuid.UUID) -> int | None:
    """The id in ``record_uuid``'s result."""
    number = (record.int >> 80) << 74 | (record.int >> 64 & 0xFFF) << 62 | record.int & (1 << 62) - 1
    if number >> 64 & 1:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def to_warc(arc: ArcRecord, record: uuid.UUID, refers_to: uuid.UUID | None = None) -> bytes:
    """The WARC record (without the blank lines that end it): a response, or a revisit of another record."""
    date = datetime.strptime(arc.fields["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(arc.content).digest()).decode()
    http = f"HTTP/1.1 {arc.fields.get('Result-code', '200')} OK\r\nContent-Type: {arc.fields['Content-type']}; charset=utf-8\r\nContent-Length: {len(arc.content)}\r\n\r\n".encode()
    block = http + (arc.content if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record.urn}>", f"WARC-Date: {date}", f"WARC-Target-URI: {arc.fields['URL']}", f"WARC-IP-Address: {arc.fields['IP-address']}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to.urn}>"]
    head += [f"WARC-Payload-Digest: {digest}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; raises on a wrong version line, length or block digest."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip()] = value.strip()
        block = stream.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]):
            raise ValueError("the file ends within a record")
        want = fields.get("WARC-Block-Digest", "")
        if want.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != want[5:]:
            raise ValueError(f"wrong digest in {fields.get('WARC-Record-ID')}")
        yield fields, block


def convert_rows(batches, versions: tuple[int, ...]):
    """Arrow work: pages as archives, the versions in turn by id, through the converter, to WARC text."""
    import pyarrow as pa

    for batch, version in ((b, v) for b in batches for v in versions):
        name = f"pages-v{version}.arc"
        rows = [r for r in batch.to_pylist() if versions[(r["page_id"] or 0) % len(versions)] == version]
        archive = io.BytesIO()
        archive.write(arc_header(name, version))
        for r in rows:
            date = (datetime(2000, 1, 1) + timedelta(seconds=(r["page_id"] or 0) % 315_360_000)).strftime("%Y%m%d%H%M%S")
            archive.write(arc_record(version, r["url"] or "", date, (r["html"] or "").encode(), offset=archive.tell(), name=name))
        archive.seek(0)
        out = []
        for r, arc in zip(rows, parse_arc(archive), strict=True):
            # a record is a revisit if a larger id has the same payload
            other = record_uuid(r["top"], arc.content) if r["revisit"] else None
            out.append(to_warc(arc, record_uuid(r["page_id"], arc.content), other).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


#: Payload bytes up to which records share a file, and how many then do: a file holds 256 MB or one record.
SHARED = ((64 << 10, 4000), (4 << 20, 64))


def write_warc(pages: DataFrame, path: str, least: int = 1000, arc_versions: tuple[int, ...] = (1, 2), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row: of equal payloads of ``least`` bytes or more the largest id's is the response.

    A null payload is an empty one, a null URL ``about:blank``.  Rows that repeat the largest id
    with the same payload are responses too; a null id is smaller than any other and is a
    response only where all ids of the payload are null.  An empty table gives files without
    records.  Equal payloads are found by SHA-1: largest ids are combined before the shuffle, and
    payloads below ``least`` bytes take no part in it.  Pages pass through the archive versions in
    turn by id.  A file holds 4000 records of at most 64 KB, 64 of at most 4 MB, or one.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sized = base.withColumn("size", F.octet_length("html"))
    keyed = sized.where(F.col("size") >= least).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    tops = keyed.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top")
    linked = keyed.join(tops, "digest", "left").select("page_id", "url", "html", "size", "top", F.expr("top is not null and not (page_id <=> top)").alias("revisit"))
    alone = sized.where(F.col("size") < least).select("page_id", "url", "html", "size", F.lit(None).cast("long").alias("top"), F.lit(False).alias("revisit"))

    def work(batches):
        yield from convert_rows(batches, arc_versions)

    scratch.ship(spark)
    most = sized.agg(F.max("size")).first()[0] or 0
    low, mode = -1, "overwrite"
    for high, records in (*SHARED, (None, 1)):
        if low < 0 or most > low:
            inside = F.col("size") > low if high is None else (F.col("size") > low) & (F.col("size") <= high)
            rows = alone.where(inside).unionByName(linked.where(inside)).drop("size")
            rows.mapInArrow(work, "value string").write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        low, mode = high, "append"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the files at ``path``: ``WARC_SCHEMA``; a revisit has no payload but its length and digest."""

    def work(batches):
        import gzip

        import pyarrow as pa

        def rows(raw):
            stream = gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
            for fields, block in parse_warc(stream):
                if fields["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(END)
                size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                response = fields["WARC-Type"] == "response"
                if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"wrong payload in {fields['WARC-Record-ID']}")
                record = uuid.UUID(fields["WARC-Record-ID"][1:-1])
                other = fields.get("WARC-Refers-To")
                yield (record.urn, page_of(record), fields["WARC-Type"], fields["WARC-Target-URI"], fields["WARC-Date"], size, digest, payload if response and with_payload else None, page_of(uuid.UUID(other[1:-1])) if other else None)

        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
        names = [x.strip().split(" ")[0] for x in WARC_SCHEMA.split(",")]
        for batch in batches:
            for raw in batch.column("content"):
                held = []
                for row in rows(raw.as_buffer().to_pybytes()):
                    held.append(row)
                    if len(held) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    scratch.ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, WARC_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
