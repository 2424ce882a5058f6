"""WARC archives written by Spark and read back as a chunked record table.

A record whose payload is longer than a segment is written as WARC segments (one
``response`` and its ``continuation`` records), so no reader ever needs a whole payload.
Archives are text files of lines that end in CR LF, written through Spark's own file
commit; gzip keeps a file in one task, whose rows then come in order. The reader is a
streaming state machine over those rows: it carries the digest from chunk to chunk and
holds one row at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.session import materialize, scratch_path

CRLF = "\r\n"
SEGMENT = 1 << 20
CHUNKS = ("record long, page_id long, url string, record_type string, refers_to long, chunk int, chunk_bytes long, "
          "offset long, sha1 string, last boolean, payload_digest string, payload_bytes long, payload binary")


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), ``size``, ``digest``, ``refers_to``.

    Equal payloads of ``least`` bytes or more share one response, that of the largest
    page_id. Only keys that occur twice are joined back; a payload repeated by a third of
    all pages is combined before the shuffle, and the join splits its rows.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    heads = (rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "size", "head"))
    heads = materialize(heads, "warc-repeats")
    return rows.join(heads, ["digest", "size"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))).drop("head")


def _header(name: str, value: Column | str) -> Column:
    """A header line, nothing where the value is NULL."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _page(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(records: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write records (see ``plan_records``) as gzip WARC files under ``path``."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / segment))
    revisit = F.col("refers_to").isNotNull()
    cut = records.withColumn("parts", F.when(revisit, 1).otherwise(parts)).withColumn(
        "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))
    body = F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", ((F.col("n") - 1) * segment + 1).cast("int"), F.lit(segment)))
    first, last = F.col("n") == 1, F.col("n") == F.col("parts")
    split = (F.col("parts") > 1)
    block = F.when(first, F.concat(http.cast("binary"), body)).otherwise(body)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.when(first, ">").otherwise(F.concat(F.lit(":"), F.col("n").cast("string"), F.lit(">"))))),
        _header("WARC-Date", "1970-01-01T00:00:00Z"),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _header("WARC-Refers-To", F.when(revisit, _page(F.col("refers_to")))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Segment-Number", F.when(split, F.col("n"))),
        _header("WARC-Segment-Origin-ID", F.when(split & ~first, _page(F.col("page_id")))),
        _header("WARC-Segment-Total-Length", F.when(split & last, F.when(first, F.col("size")).otherwise(F.col("size") + F.octet_length(http)))),
        _header("X-Payload-Length", F.when(first, F.col("size"))),
        F.when(first, F.lit(f"Content-Type: application/http; msgtype=response{CRLF}")).otherwise(F.lit("")),
        _header("Content-Length", F.octet_length("block")))
    lines = cut.withColumn("block", block).select(F.concat(head.cast("binary"), F.lit(CRLF.encode()), F.col("block"), F.lit(CRLF.encode())).cast("string").alias("value"))
    lines.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


_PAGE_ID = re.compile(r"<urn:page:(-?\d+|null)")


def _long(value: str | None) -> int | None:
    got = _PAGE_ID.match(value or "")
    return int(got[1]) if got and got[1] != "null" else None


class _Reader:
    """Turns the CR LF separated rows of one archive after another into chunk rows."""

    def __init__(self, with_payload: bool):
        self.with_payload, self.record, self.rows = with_payload, -1, []
        self.state, self.fields = "between", {}
        self.page: dict | None = None

    def feed(self, row: bytes) -> None:
        if self.state == "between":
            if row.startswith(b"WARC/"):
                self.state, self.fields = "header", {}
            elif row:
                raise ValueError("an archive record was expected")
        elif self.state == "header":
            if row:
                name, _, value = row.decode("utf-8", "replace").partition(":")
                self.fields[name.strip().lower()] = value.strip()
            else:
                self._begin()
        else:
            self._block(row)

    def _begin(self) -> None:
        f = self.fields
        self.left, self.joined = int(f["content-length"]), False
        self.http = f["warc-type"] in ("response", "revisit") and f.get("content-type", "").startswith("application/http")
        if f["warc-type"] != "continuation":
            self.record += 1
            self.page = {"url": f.get("warc-target-uri"), "type": f["warc-type"], "id": _long(f.get("warc-record-id")), "to": _long(f.get("warc-refers-to")),
                         "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "size": int(f["x-payload-length"]) if "x-payload-length" in f else None,
                         "hash": hashlib.sha1(), "offset": 0, "chunk": 0}
        self.last = "warc-segment-number" not in f or "warc-segment-total-length" in f
        self.state = "block" if self.left else "between"
        if not self.left:
            self._emit(b"", self.last)

    def _block(self, row: bytes) -> None:
        """A row of the block; rows after the first stand behind a CR LF of the block."""
        data = (b"\r\n" + row) if self.joined else row
        self.joined = True
        self.left -= len(data)
        if self.left < 0 and data[self.left:] != b"\r\n"[:-self.left]:
            raise ValueError("a record is longer than its Content-Length")
        if self.left < 0:
            data = data[:self.left]
        done = self.left <= 0
        if self.http:
            if row == b"":
                self.http, self.joined = False, False
                self.left -= 2  # the CR LF that ends the HTTP header
                done = self.left <= 0
                if not done:
                    return
                data = b""
            elif not done:
                return
            else:
                data = b""
        self._emit(data, done and self.last)
        if done:
            self.state = "between"

    def _emit(self, data: bytes, last: bool) -> None:
        p = self.page
        if not data and not last:
            return
        p["hash"].update(data)
        p["offset"] += len(data)
        digest = p["hash"].hexdigest() if last else None
        self.rows.append((self.record, p["id"], p["url"], p["type"], p["to"], p["chunk"], len(data), p["offset"] - len(data), digest, last,
                          p["digest"], p["size"] if p["type"] == "revisit" else (p["offset"] if last else None), data if self.with_payload else None))
        p["chunk"] += 1


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The chunk table: a row per record and chunk, in order within its file.

    ``record`` numbers the records of a task, ``chunk`` those of a record; ``offset`` and
    ``chunk_bytes`` place the chunk in the payload; ``sha1`` is the payload's digest,
    carried through all chunks and given with the ``last``. A chunk is a row of the
    archive, so never longer than a segment; without ``with_payload`` only digests and
    lengths leave the reader.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(with_payload)
        for b in batches:
            for row in b.column(0):
                reader.feed(row.as_py())
                if len(reader.rows) >= 256:
                    yield _batch(reader)
            if reader.rows:
                yield _batch(reader)
        if reader.state != "between":
            raise ValueError("an archive ends within a record")

    def _batch(reader: _Reader) -> pa.RecordBatch:
        rows, reader.rows = reader.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    lines = spark.read.option("lineSep", CRLF).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


def roundtrip(pages: DataFrame, least: int = 1000, segment: int = SEGMENT, path: str | None = None) -> DataFrame:
    """Write a record per page, read the archives back, and describe each page.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest`` (hex SHA-1),
    ``record_type``, ``refers_to``, ``chunks`` and ``digest_ok`` (the bytes read have the
    digest the header states). A NULL payload is empty. Pages with equal payloads and
    equal largest id are all responses; a NULL page_id is written as such and revisits the
    others, or is a response if all are NULL. Line breaks in a URL become ``%0A``. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(plan_records(pages, least), path, segment)
    return read_archives(spark, path, with_payload=False).where("last").select(
        "page_id", "payload_bytes", F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("sha1")).alias("payload_digest"),
        "record_type", "refers_to", (F.col("chunk") + 1).alias("chunks"),
        ((F.col("record_type") == "revisit") | (F.col("sha1") == F.col("payload_digest"))).alias("digest_ok"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
             max(page_id) OVER (PARTITION BY payload) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM q
"""
