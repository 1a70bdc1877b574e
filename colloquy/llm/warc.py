"""WARC records, and revisits answered "not modified" resolved to the full responses that they stand for."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import in_batches, without, written

#: Headers of a 304 answer that may replace those of the stored response; all others stay as stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Bytes of a record's own header at most, and of bodies that a task hands on at once.
HEADER, AT_ONCE = 1 << 20, 4 << 20
RECORD = "record_id string, kind string, url string, captured long, status int, headers map<string,string>, payload binary, payload_sha256 string, error string"
_COLUMNS = [f.split()[0] for f in RECORD.split(", ")]
_ARROW = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.string()]


def write_record(kind: str, record_id: str, url: str, date: str, status: str, headers: dict[str, str], body: bytes) -> bytes:
    """A WARC/1.1 response or revisit record with an HTTP message as its block."""
    block = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
    top = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{record_id}>", "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if kind == "revisit":
        top["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in top.items()) + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    """Names in lower case; folded lines are joined, of repeated names the values."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = f"{out[last]}, {v.strip()}" if last in out else v.strip()
    return out


def _seconds(date: str) -> int | None:
    from datetime import UTC, datetime

    try:
        return int(datetime.strptime(date[:19], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=UTC).timestamp())
    except ValueError:
        return None


def read_records(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file, plain or of gzip members, one after another; a broken one ends it with a row that says
    so. Only the record at hand is held, besides the file itself."""
    broken = (None,) * 8 + ("broken record",)
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := f.readline(HEADER):
            if line in (b"\r\n", b"\n"):
                continue
            lines = []
            while line.startswith(b"WARC/") and (more := f.readline(HEADER)) not in (b"", b"\r\n"):
                lines.append(more)
                if sum(map(len, lines)) > HEADER:
                    break
            top = _headers(b"".join(lines))
            size = top.get("content-length", "")
            known = lines and re.fullmatch(r"[0-9]{1,15}", size)
            block = f.read(int(size)) if known else b""
            if not known or len(block) < int(size):
                yield broken
                return
            head, _, body = block.partition(b"\r\n\r\n")
            status = re.match(rb"HTTP/\S+ (\d{3})", head)
            inner = _headers(head.partition(b"\r\n")[2])
            yield (top.get("warc-record-id", "").strip("<>") or None, top.get("warc-type"), top.get("warc-target-uri"), _seconds(top.get("warc-date", "")), int(status[1]) if status else None, list(inner.items()), body, hashlib.sha256(body).hexdigest(), None)
    except (EOFError, OSError, OverflowError, ValueError, zlib.error):
        yield broken


def read_warc(files: DataFrame, data_col: str = "data") -> DataFrame:
    """One row of RECORD for each record of a binary column of WARC files; null and empty files have none."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for x in b.column(0):
                for row in read_records(x.as_py() or b""):
                    rows.append(row)
                    held += 200 + len(row[6] or b"")
                    if held > AT_ONCE:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return in_batches(files.select(files[data_col].alias("data"))).mapInArrow(run, RECORD)


def warc_index(files: DataFrame, data_col: str = "data") -> DataFrame:
    """The records of WARC files without their bodies, as a table in the shared folder: files are parsed once, however
    often the index is read."""
    return written(read_warc(files, data_col).drop("payload"), "warc-index")


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters and a trailing slash don't count; the host's case neither.

    Null stays null, so such records match nothing."""
    u = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^www\.|:(?:80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^[^?]*\??", ""), r"(?:^|&)(?:utm_[^=&]*|ref)(?:=[^&]*)?", ""), "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Records with canonical_url, refers_to, outcome and merged_headers.

    A revisit with status 304 refers to the latest full response (200 with kind response) of its canonical URL captured
    before it, or at the same second with a smaller record id. It is resolved if its ETag, or without one its Last-Modified,
    equals that response's; W/ before an ETag doesn't count, as a 304 needs no more than weak equality; with neither it
    can't be checked. outcome is full, resolved, validator_mismatch, no_validator,
    no_earlier or other (any other record). merged_headers are the stored ones with those of PERMITTED that the 304 has.

    The as-of join goes by (URL, time bucket): the last response of each bucket is aggregated first and carried over
    from earlier buckets, and only records of one bucket are ordered among each other, so no URL meets in one task.
    Bodies don't take part. Records without URL or time match nothing and are not moved; records that repeat are all kept
    and alike; an empty table gives an empty result. Other columns stay, but the four that are added are replaced.
    """
    r = without(records, "canonical_url", "refers_to", "outcome", "merged_headers").withColumn("canonical_url", canonical_url(F.col("url")))
    kept = [c for c in r.columns if c != "canonical_url"]
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("captured").isNotNull() & F.col("canonical_url").isNotNull(), F.lit(False))
    revisit = F.coalesce((F.col("kind") == "revisit") & (F.col("status") == 304), F.lit(False))
    r = r.withColumn("__full", full).withColumn("__bucket", F.floor(F.col("captured") / bucket_seconds))
    stored = F.struct(F.col("captured").alias("captured"), F.col("record_id").alias("id"), F.to_json("headers").alias("headers"))
    r = r.withColumn("__stored", F.when(F.col("__full"), stored))
    # Each bucket with records gets what the buckets before it left.
    marks = r.where(F.col("canonical_url").isNotNull() & F.col("__bucket").isNotNull()).groupBy("canonical_url", "__bucket").agg(F.max("__stored").alias("__last"))
    before = Window.partitionBy("canonical_url").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("canonical_url", "__bucket", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    within = Window.partitionBy("canonical_url", "__bucket").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = F.col("canonical_url").isNotNull() & F.col("__bucket").isNotNull()
    inside = r.where(placed).withColumn("__inside", F.last("__stored", ignorenulls=True).over(within))
    inside = inside.join(marks, ["canonical_url", "__bucket"], "left").withColumn("__found", F.when(revisit, F.coalesce("__inside", "__carried"))).drop("__inside", "__carried")
    r = inside.unionByName(r.where(~placed).withColumn("__found", F.lit(None).cast(inside.schema["__found"].dataType)))
    old = F.from_json(F.col("__found.headers"), "map<string,string>")
    new = F.col("headers")
    r = r.withColumn("__old", old)
    etag, modified = new["etag"], new["last-modified"]
    strong = lambda tag: F.regexp_replace(tag, "^W/", "")
    checked = F.when(etag.isNotNull(), F.coalesce(strong(etag) == strong(F.col("__old")["etag"]), F.lit(False))).when(modified.isNotNull(), F.coalesce(modified == F.col("__old")["last-modified"], F.lit(False)))
    outcome = F.when(F.col("__full"), "full").when(~revisit, "other").when(F.col("__found").isNull(), "no_earlier").when(checked.isNull(), "no_validator").when(checked, "resolved").otherwise("validator_mismatch")
    r = r.withColumn("outcome", outcome)
    allowed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("__old"), lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return r.select(*[F.col(f"`{c}`") for c in kept], "canonical_url", F.when(F.col("outcome") == "resolved", F.col("__found.id")).alias("refers_to"), "outcome", F.when(F.col("outcome") == "resolved", merged).when(F.col("__full"), new).alias("merged_headers"))


def _stamp(seconds: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def other_spelling(url: str) -> str:
    """The same resource as another crawl could have it."""
    parts = urlsplit(url)
    return f"{'http' if parts.scheme == 'https' else 'https'}://{parts.netloc.upper()}{parts.path}{'?' + parts.query if parts.query else ''}#again"


def pages_as_warc(pages: DataFrame, start: int = 1_700_000_000, step: int = 60) -> DataFrame:
    """(data) with a WARC file for each page: a full response at start + step * page_id, and a revisit 300 steps after
    (for every seventh page before) it under another spelling of the URL. Every fifth revisit has a Last-Modified alone,
    every eleventh no validator. Null html is an empty body, pages without id or URL have no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body, t = (html or "").encode(), start + step * i
                tag, day = f'"{hashlib.md5(body).hexdigest()}"', _stamp(t - t % 86400)
                first = write_record("response", f"r{i:012d}", url, _stamp(t), "200 OK", {"Content-Type": "text/html", "Content-Length": str(len(body)), "ETag": tag, "Last-Modified": day, "Date": _stamp(t), "Cache-Control": "max-age=60"}, body)
                t += step * (300 if i % 7 else -300) + 1
                check = {} if i % 11 == 0 else {"Last-Modified": day} if i % 5 == 0 else {"ETag": tag}
                again = write_record("revisit", f"v{i:012d}", other_spelling(url), _stamp(t), "304 Not Modified", check | {"Date": _stamp(t), "Cache-Control": "max-age=90", "Content-Length": "0", "Server": "x"}, b"")
                out.append(first + again)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])

    return pages.where(F.col("page_id").isNotNull() & F.col("url").isNotNull()).select("page_id", "url", "html").transform(in_batches).mapInArrow(run, "data binary")
