"""WARC archives: a writer with one member per record, and a reader that goes on behind damage."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from havenlens.llm.common import slices, stored
from havenlens.session import scratch_path

VERSION = b"WARC/1.1"
LEAST_REVISIT = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:havenlens:page:{}>"
#: A gzip member without content stands between records, as the separator that the text writer puts after each row.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MAGIC = b"\x1f\x8b\x08"


# --- writing -------------------------------------------------------------------------------------
def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
             least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, first): first is the smallest page_id with the same payload, where that is another row.

    Only payloads of at least `least_bytes` are looked at. Digests are counted with map-side combining. Those that more
    than a thousandth of all pages share are fewer than a thousand and are broadcast; the rest is joined by digest.
    """
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col], F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = stored(
        rows.where(F.octet_length("html") >= least_bytes).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1"), "payloads")
    share = rows.agg(F.count("*") / 1000).scalar()
    hot = repeated.where(F.col("n") > share).select(F.col("digest"), F.col("first").alias("hot_first"))
    cold = repeated.where(F.col("n") <= share).select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    # a row that the broadcast side has settled gets a key of its own, so that its copies do not meet in one task
    settled = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(
        F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.lit("page "), F.col("page_id").cast("string"))))
    first = F.coalesce("hot_first", "cold_first")
    return settled.join(cold, "key", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") > first, first).alias("first"))


def record(page_id, url: str | None, payload: bytes, digest: str, first, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that has the response's HTTP headers only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", RECORD_ID.format(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", None if first is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if first is None else RECORD_ID.format(first)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_pages(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 10_000,
                id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> None:
    """Archives below `path`, one gzip member per row of pages, written by Spark so that any of its file stores will do.

    Of rows with equal payloads of at least 100 bytes those with the smallest page_id are responses, the others revisits
    of it. A null html is an empty payload, a null url leaves its field out, a row without an id is a response. An empty
    table writes no archive. Other columns are ignored.
    """
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first")]
            made = [gzip.compress(record(i, url, html.encode(), digest, first, date), 6, mtime=0)
                    for i, url, html, digest, first in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    rows = revisits(pages, id_col, html_col, url_col).mapInArrow(members, "member binary")
    (rows.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(path))


# --- reading -------------------------------------------------------------------------------------
class Damaged(Exception):
    pass


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The body of an HTTP message, any other block whole."""
        if self.fields.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    @property
    def http_length(self) -> int | None:
        """Content-Length of the HTTP headers: the size of the payload, also where a revisit leaves it out."""
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value)
        return None


def parse_record(data: bytes, start: int) -> tuple[Record, int]:
    """The record that starts there, and where it ends. Damaged if a check fails."""
    if data[start:start + 5] != b"WARC/":
        raise Damaged("no version line")
    following = data.find(b"\nWARC/", start)  # a header ends before the next version line
    head_end = data.find(b"\r\n\r\n", start, len(data) if following < 0 else following + 1)
    if head_end < 0:
        raise Damaged("header does not end")
    lines = data[start:head_end].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in " \t" and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        name = name.strip().lower()
        fields[name] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise Damaged("a field is missing")
    begin = head_end + 4
    end = begin + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where it should")
    block = data[begin:end]
    _verify(fields.get("warc-block-digest"), block)
    return Record(fields, block), end + 4


def _verify(expected: str | None, content: bytes) -> None:
    algorithm, _, value = (expected or "").partition(":")
    if algorithm.lower() in ("sha256", "sha-256") and len(value) == 64:
        if hashlib.sha256(content).hexdigest() != value.lower():
            raise Damaged("digest differs")


def inflate(data: bytes, start: int) -> tuple[bytes, int]:
    """The content of the gzip member that starts there, and where it ends. Damaged if it is cut or its sum differs."""
    stream, out, at = zlib.decompressobj(31), [], start
    try:
        while not stream.eof and at < len(data):
            out.append(stream.decompress(data[at:at + 65536]))
            at += 65536
    except zlib.error as why:
        raise Damaged(f"member: {why}") from None
    if not stream.eof:
        raise Damaged("member is cut off")
    return b"".join(out), min(at, len(data)) - len(stream.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(first, last, record or reason): every record that passes its checks, and the gaps that hold none.

    At a member or version line the record there is read. If a check fails, the next place is sought where a member
    inflates or a line starts a record that is whole; the bytes up to it are one gap.
    """
    at, bad_from, why = 0, None, ""
    while at < len(data):
        try:
            found, end = _at(data, at)
        except Damaged as reason:
            if bad_from is None:
                bad_from, why = at, str(reason)
            at = _next_start(data, at + 1)
            continue
        if bad_from is not None:
            yield bad_from, at, why
            bad_from = None
        for item in found:
            yield at, end, item
        at = end
    if bad_from is not None:
        yield bad_from, len(data), why


def _at(data: bytes, at: int) -> tuple[list[Record | str], int]:
    if data.startswith(MAGIC, at):
        content, end = inflate(data, at)
        return [item for _, _, item in salvage(content)], end  # damage inside a sound member is a gap as long as the member
    if data.startswith((b"\r\n", b"\n"), at) and not data[at:at + 4].strip():
        end = at
        while data[end:end + 1] in (b"\r", b"\n"):
            end += 1
        return [], end
    record_, end = parse_record(data, at)
    return [record_], end


def _next_start(data: bytes, at: int) -> int:
    """The next place that looks like a member or a version line at a line's start; the end if there is none."""
    member = data.find(MAGIC, at)
    line = data.find(b"WARC/", at)
    while line > 0 and data[line - 1:line] != b"\n":
        line = data.find(b"WARC/", line + 1)
    return min([x for x in (member, line) if x >= 0], default=len(data))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, first, last, reason, type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload), one row
    per record that could be read, and one per gap, whose reason is set and whose other columns are null.

    Files are read whole by Spark, a task at a time for each, so an archive should stay well below an executor's memory
    (the writer's hold a bounded number of records); members and plain records may mix in one file. payload_bytes and
    payload_digest are those of the full payload, also for a revisit, whose own payload is empty.
    """
    names = ["path", "first", "last", "reason", "type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, held = [], 0
                for row in _rows(name, content.as_py()):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 1 << 22 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows):
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, first bigint, last bigint, reason string, type string, record_id string, "
                                 "target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def _rows(name: str, data: bytes) -> Iterator[tuple]:
    for first, last, item in salvage(data):
        if isinstance(item, str):
            yield (name, first, last, item, *[None] * 7)
            continue
        fields, payload = item.fields, item.payload
        kind = fields["warc-type"]
        whole = kind != "revisit"
        digest = hashlib.sha256(payload).hexdigest() if whole else fields.get("warc-payload-digest", "").partition(":")[2].lower() or None
        yield (name, first, last, None, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
               digest, len(payload) if whole else item.http_length, payload)


def page_number(column: str, kind: str = "bigint"):
    """The page_id in a record's id; null if it has none."""
    return F.regexp_extract(column, r"^<urn:havenlens:page:(.*)>$", 1).try_cast(kind)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The archives' rows after `pages` were written to a fresh folder, or to `path`."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_archives(pages.sparkSession, path)
