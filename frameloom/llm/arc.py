"""Legacy web archives: ARC records of versions 1 and 2 are parsed and converted to WARC 1.1 records.

Header lines are split by their version's fields, bodies are cut by the declared lengths; WARC identifiers, timestamps,
types and digests are synthesised from them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow, scratch_path, slices

#: The fields of a record's header line by version.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
EPOCH = "20240101000000"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    version: int
    extra: dict = field(default_factory=dict)


def write_arc(records: list[ArcRecord], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file: its version block, then each record's header line, body and a line feed."""
    names = " ".join({1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), 2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}[version])
    about = f"{version} 0 frameloom\n{names}\n".encode()
    lead = {1: "", 2: "200 - - 0 - "}[version]
    out = [f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain {lead}{len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        mid = "" if version == 1 else f"{r.extra.get('result_code', '-')} {r.extra.get('checksum', '-')} {r.extra.get('location', '-')} {at} {r.extra.get('filename', name)} "
        out.append(f"{r.url} {r.ip} {r.date} {r.content_type} {mid}{len(r.body)}\n".encode() + r.body + b"\n")
        at += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records in order, the version block first. URLs may hold spaces: fields are counted from the line's end."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if version is None:
            length = int(line.rsplit(" ", 1)[1])
            first = data[end + 1 : end + 1 + length].split(b"\n", 1)[0].split(b" ")[0]
            version = int(first)
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            # the block's own line may be of version 1 in either version
            n = len(FIELDS[2]) if version == 2 and len(line.split(" ")) >= len(FIELDS[2]) else len(FIELDS[1])
        else:
            n = len(FIELDS[version])
        parts = line.rsplit(" ", n - 1)
        if len(parts) != n:
            raise ValueError(f"an ARC header line with {len(parts)} of {n} fields: {line[:200]!r}")
        named = dict(zip(FIELDS[2 if n == len(FIELDS[2]) else 1], parts, strict=True))
        length = int(named.pop("length"))
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError("an ARC record is shorter than declared")
        yield ArcRecord(*(named.pop(k) for k in FIELDS[1][:-1]), body, version, named)
        at = end + 1 + length


def timestamp(date: str) -> str:
    """14 digits (fewer are filled up with the earliest) to ISO 8601 in UTC; anything else to the epoch's."""
    digits = (re.match(r"\d{4,14}", date) or ["19700101000000"])[0]
    digits += "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and payload; no header if the body doesn't start with one."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (at := body.find(mark)) >= 0:
            return body[: at + len(mark)], body[at + len(mark) :]
    return body, b""


def record_id(url: str, date: str, digest: str, key: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def to_warc(r: ArcRecord, key: str = "", refers_to: tuple[str, str, str, str] | None = None, more: dict | None = None) -> bytes:
    """The WARC record without its closing line breaks. refers_to: url, date, digest and key of the earlier response."""
    head, payload = split_http(r.body)
    sha1 = hashlib.sha1(payload).hexdigest()
    kind = "warcinfo" if r.url.startswith("filedesc:") else "revisit" if refers_to else "response" if head else "resource"
    block = head if kind == "revisit" else r.body
    b32 = lambda hexed: base64.b32encode(bytes.fromhex(hexed)).decode()
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id(r.url, r.date, sha1, key), "WARC-Date": timestamp(r.date)}
    if kind != "warcinfo":
        lines |= {"WARC-Target-URI": r.url, "WARC-IP-Address": r.ip, "WARC-Payload-Digest": "sha1:" + b32(sha1)}
    if refers_to:
        lines |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(*refers_to), "WARC-Refers-To-Target-URI": refers_to[0], "WARC-Refers-To-Date": timestamp(refers_to[1])}
    lines |= {"WARC-Block-Digest": "sha1:" + b32(hashlib.sha1(block).hexdigest()), **(more or {})}
    lines |= {"Content-Type": "application/http; msgtype=response" if head else r.content_type or "application/octet-stream", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block


def parse_warc(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, cut by Content-Length; block digests are verified. source: bytes, or a
    binary stream, of which only one record is held at a time."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record but {line[:100]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, value = line.decode().rstrip("\r\n").split(": ", 1)
            fields[name] = value
        n = int(fields["Content-Length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError(f"{fields['WARC-Record-ID']} is shorter than declared")
        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
            raise ValueError(f"the block digest of {fields['WARC-Record-ID']} doesn't hold")
        yield fields, block
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record isn't closed by two line breaks")


def clean_url(url: str | None) -> str:
    """White space and control characters percent-encoded, so that a header line stays one line."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")


def write_warcs(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 1000, salts: int = 16, records_per_file: int = 2000) -> None:
    """Write pages as ARC files in memory, convert them, and store the WARC records under path (gzip).

    Of records with equal payloads of least_revisit bytes or more, the one with the largest id is the response. Digests
    are counted with map-side sums; only those that repeat are joined back, over `salts` salts.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.when(F.octet_length("html") >= least_revisit, F.sha1(F.col("html").cast("binary"))))
    repeats = p.where("sha IS NOT NULL").groupBy("sha").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = repeats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # rows without a repeat candidate's digest keep to themselves: no null key is dealt to one task
    dealt = p.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")).withColumn("sha", F.coalesce("sha", F.hex(F.xxhash64("id", "url"))))
    joined = dealt.join(repeats, ["sha", "salt"], "left").select("id", "url", "html", F.col("first.id").alias("to"), F.col("first.url").alias("to_url"))
    schema = pa.schema([("record", pa.string())])

    def run(batches):
        for b in slices(batches, "html"):
            rows = list(zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "to", "to_url")), strict=True))
            for version in (1, 2):  # both kinds of legacy file
                own = [r for r in rows if (r[0] or 0) % 2 == version - 1]
                if not own:
                    continue
                records = []
                for i, url, html, _, _ in own:
                    payload = html.encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    records.append(ArcRecord(clean_url(url), "0.0.0.0", EPOCH, "text/html", head + payload, version))
                _, *parsed = parse_arc(write_arc(records, version))
                out = []
                for (i, _, _, to, to_url), r in zip(own, parsed, strict=True):
                    refers, more = None, {} if i is None else {"Page-ID": str(i)}
                    if to is not None and to != i:
                        refers = (clean_url(to_url), EPOCH, hashlib.sha1(split_http(r.body)[1]).hexdigest(), str(to))
                        more["Refers-To-Page-ID"] = str(to)
                    out.append(to_warc(r, str(i), refers, more).decode())
                yield batch_of(schema, out)

    map_arrow(joined, run, "record string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_warcs(spark, path: str) -> DataFrame:
    """One row for each record: page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to.

    A task holds a file as it is stored, compressed, and one record of it.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                out = []
                raw = data.as_py()
                source = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else raw
                for f, block in parse_warc(source):
                    head, payload = split_http(block)
                    digest = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
                    if f["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload digest doesn't hold")
                    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", head)[1])
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    out.append((number("Page-ID"), f["WARC-Target-URI"], size, digest, f["WARC-Type"], number("Refers-To-Page-ID")))
                if out:
                    yield batch_of(schema, *zip(*out, strict=True))

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Convert pages to WARC archives in the shared folder and read these back.

    Edge cases: a null html is the empty payload, a null url about:blank; pages without id have a record without
    Page-ID; of rows that repeat the largest id with its payload all are responses; an empty table gives no rows.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warcs(pages, path, id_col, url_col, html_col)
    return read_warcs(pages.sparkSession, path)
