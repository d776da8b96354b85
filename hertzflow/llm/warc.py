"""WARC archives: writing, and reading back with segment reassembly.

Writing turns each page into a response record with chunked transfer framing, or into a
revisit record where a larger page_id has the same payload. Blocks beyond
``segment_bytes`` are cut into a first record and continuation records. Every task
writes one gzip-compressed archive into a shared folder.

Reading parses each archive by its lengths, record by record. Records in one piece are
decoded at once; segments are grouped by their origin record, put in order of their
number, and their total length is verified before the transfer framing is decoded and
the payload digest compared. What cannot be verified is returned with a ``problem``
instead of being dropped.

Payloads are never shuffled when writing: groups of equal payloads are found on digests,
pre-aggregated, and only groups of two or more are joined back, broadcast if their table
has at most ``BROADCAST_ROWS`` rows. When reading, only segments are shuffled. Null and
empty payloads are records without a body; null URLs get a name made of the page id; a
null page_id is left out of the record and read back as null. Rows that repeat a page_id
are records of their own. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage
from .words import runs

SEGMENT_BYTES = 32_768
ARCHIVE_BYTES = 1 << 30
CHUNK_BYTES = 8_192
REVISIT_BYTES = 1_000
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile of records that revisit an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = (
    "record_id string, record_type string, page_id string, uri string, refers_to string, payload_digest string, "
    "payload_bytes bigint, payload binary, problem string, segment int, total_length bigint, block binary"
)


# ---- writing ---------------------------------------------------------------------


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def _record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_records(page, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page; ``name`` makes its record ids unique."""
    identity = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>"
    payload = page.payload or b""
    page_id = page.page_id if isinstance(page.page_id, str) else None
    uri = page.url if isinstance(page.url, str) and page.url else f"urn:page:{page_id}"
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": identity(1),
        "WARC-Date": DATE,
        "WARC-Target-URI": uri.replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(page.digest)).decode(),
        "X-Page-ID": page_id,
    }
    if isinstance(page.refers_to, str):
        headers |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "X-Refers-To-Page-ID": page.refers_to}
        yield _record(headers, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % page.n_bytes)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    count = -(-len(block) // segment_bytes)
    if count == 1:
        yield _record(headers, block)
        return
    yield _record(headers | {"WARC-Segment-Number": "1"}, block[:segment_bytes])
    for k in range(1, count):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": identity(k + 1),
            "WARC-Date": DATE,
            "WARC-Target-URI": headers["WARC-Target-URI"],
            "WARC-Segment-Origin-ID": identity(1),
            "WARC-Segment-Number": str(k + 1),
            "WARC-Segment-Total-Length": str(len(block)) if k == count - 1 else None,
        }
        yield _record(more, block[k * segment_bytes : (k + 1) * segment_bytes])


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write ``pages`` as archives into the folder ``path``."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("bigint")})
    large = rows.where(F.col("n_bytes") >= revisit_bytes).groupBy("digest")
    groups = large.agg(F.max("page_id").alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = stage(groups, "payload-groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    refers_to = F.when((F.col("n_bytes") >= revisit_bytes) & (F.col("page_id") < F.col("origin")), F.col("origin"))
    marked = rows.join(groups, "digest", "left").withColumn("refers_to", refers_to)
    # A page that is revisited need not carry its payload along.
    marked = marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    # Ids travel as text: pandas would turn a batch's integers into floats beside a null.
    marked = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})

    def records(batches):
        task, k = TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for page in pdf.itertuples(index=False):
                k += 1
                # The text sink ends every row with the last byte of a record.
                out += [r[:-1] for r in page_records(page, f"{page.page_id}/{page.digest}/{task}/{k}", segment_bytes)]
            yield pd.DataFrame({"record": out})

    lines = marked.mapInPandas(records, "record binary").select(F.col("record").cast("string").alias("value"))
    # Archives roll over before they could reach the size that one row of a reader can have.
    most = max(1, ARCHIVE_BYTES // segment_bytes)
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


# ---- reading ---------------------------------------------------------------------


class _Stream:
    """Reads from gzip-compressed or plain bytes piece by piece."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer = raw, 0, bytearray()
        self.gzip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + 65_536]
        self.at += len(piece)
        if self.gzip is None:
            self.buffer += piece
            return True
        self.buffer += self.gzip.decompress(piece)
        while self.gzip.eof and self.gzip.unused_data:
            rest, self.gzip = self.gzip.unused_data, zlib.decompressobj(31)
            self.buffer += self.gzip.decompress(rest)
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        return self.take(end + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.take(int(headers.get("content-length", 0)))
        stream.take(4)
        yield headers, block


def decode_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an HTTP message, with the chunked framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, _, value in pairs}
    if headers.get("transfer-encoding", "").lower() != "chunked":
        return headers, body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return headers, b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(part)
        at = end + 4 + size


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _row(headers: dict[str, str], block: bytes | None, keep: bool) -> dict:
    row = dict.fromkeys(("payload_digest", "payload_bytes", "payload", "problem", "segment", "total_length", "block"))
    row |= {
        "record_id": headers.get("warc-record-id"),
        "record_type": headers.get("warc-type"),
        "page_id": headers.get("x-page-id"),
        "uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("x-refers-to-page-id"),
    }
    claimed = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if claimed:
        row["payload_digest"] = base64.b32decode(claimed).hex()
    if block is not None:
        row |= _decoded(row["record_type"], row["payload_digest"], block, keep)
    return row


def _decoded(kind: str, claimed: str | None, block: bytes, keep: bool) -> dict:
    try:
        headers, body = decode_http(block)
    except ValueError as fault:
        return {"problem": f"transfer framing: {fault}"}
    if kind == "revisit":
        return {"payload_bytes": _number(headers.get("content-length"))}
    digest = hashlib.sha1(body).hexdigest()
    out = {"payload_bytes": len(body), "payload_digest": digest, "payload": body if keep else None}
    return out | ({"problem": "payload digest"} if claimed and claimed != digest else {})


def _frame(rows: list[dict]) -> pd.DataFrame:
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    pdf = pd.DataFrame(rows, columns=columns)
    for c in ("payload_bytes", "segment", "total_length"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def _parsed(keep: bool):
    def rows(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                out, size = [], 0
                for headers, block in parse_archive(raw):
                    number = _number(headers.get("warc-segment-number"))
                    row = _row(headers, block if number is None else None, keep)
                    if number is not None:
                        row |= {"segment": number, "block": block, "total_length": _number(headers.get("warc-segment-total-length"))}
                        row["record_id"] = headers.get("warc-segment-origin-id", row["record_id"])
                    out.append(row)
                    size += len(block)
                    if size > 1 << 23 or len(out) >= 5000:
                        yield _frame(out)
                        out, size = [], 0
                yield _frame(out)

    return rows


def _reassembled(keep: bool):
    def rows(batches):
        for run in runs(batches, ["record_id"]):
            first = run.iloc[0]
            row = {c: (None if pd.isna(v) else v) for c, v in first.drop(["block", "payload"]).items()}
            row |= {"payload": None, "block": None, "segment": None}
            length = sum(map(len, run["block"]))
            total = run["total_length"].dropna()
            if run["segment"].tolist() != list(range(1, len(run) + 1)) or not len(total):
                row["problem"] = "segments are missing"
            elif int(total.iloc[-1]) != length:
                row["problem"] = "total length"
            else:
                row |= _decoded(row["record_type"], row["payload_digest"], b"".join(run["block"]), keep)
            row["total_length"] = None
            yield _frame([row])

    return rows


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Per record: record_id, record_type, page_id, uri, refers_to (page_id), payload_digest
    (hex SHA-1), payload_bytes, payload (null without ``keep_payload``) and problem."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = stage(files.mapInPandas(_parsed(keep_payload), _SCHEMA), "records")
    parts = parsed.where("segment IS NOT NULL").repartition("record_id").sortWithinPartitions("record_id", "segment")
    whole = parsed.where("segment IS NULL").unionByName(parts.mapInPandas(_reassembled(keep_payload), _SCHEMA))
    # Ids are text until here, since pandas has no integers beside a null.
    ids = {c: F.expr(f"try_cast({c} AS bigint)") for c in ("page_id", "refers_to")}
    return whole.drop("segment", "total_length", "block").withColumns(ids)
