"""WARC archives of pages, with revisit records, and their verified reading.

Writing: a record per page through the engine's own text writer, whose line
separator is the end of a record, so archives land in whatever store the path names.
Of pages with equal payloads of at least `least` bytes the one with the largest id
is written as a response; the others revisit it and have no payload of their own.

Reading trusts no magic, and fails on an archive whose chain ends early. Tasks list all candidate records of each block of an
archive with the offset that each one's length points to, and follow those pointers
to the end of the block. Pointer jumping over the blocks from the start of each file
(rounds grow with the logarithm of the blocks) finds where the true chain enters
every block; only records on the chain are kept, so a magic inside a payload is not
taken for a record.

Nulls, ties, empties: a null html is an empty payload; a null url is empty; pages
that tie for the largest id (repeated rows) are all responses; a null id loses to
any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import load, materialised, shared_dir

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
BLOCK = 2 << 20
RECORDS_A_FILE = 20_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four characters."""
    hexes = F.sha1(payload.cast("binary"))
    out = []
    for i in range(8):
        n = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, and refers_to of those that revisit. Only groups of two and more join the pages."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html"))})
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1").select("payload_digest", "payload_bytes", "largest")
    out = rows.join(groups.hint("shuffle_hash"), ["payload_digest", "payload_bytes"], "left")
    revisits = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", revisits.alias("revisits"), F.when(revisits, F.col("largest")).alias("refers_to"))


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def records(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The text of each record, without its closing line ends."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(F.col("revisits"), http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.when(F.col("revisits"), F.concat(line("WARC-Refers-To", _urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    return rows.select(F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    records(decided(pages, least)).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _header(raw: bytes, at: int):
    """Named lines of the header at `at` and where its block begins; None if it isn't one."""
    fields, at = {}, at + len(MAGIC)
    while True:  # line by line: headers have any length, and text that isn't one ends the search at once
        stop = raw.find(b"\r\n", at)
        if stop < 0:
            return None
        if stop == at:
            return fields, at + 2
        colon = raw.find(b":", at, stop)
        if colon < 0:
            return None
        fields[raw[at:colon].strip().lower()] = raw[colon + 1 : stop].strip()
        at = stop + 2


def candidates(raw: bytes, lo: int, hi: int):
    """Every place in raw[lo:hi] that reads like a record, with its successor and content."""
    out, at = [], raw.find(MAGIC, lo, hi + len(MAGIC) - 1)
    while at >= 0:
        found = _header(raw, at)
        if found is not None and found[0].get(b"content-length", b"").isdigit():
            fields, block = found
            size = int(fields[b"content-length"])
            succ = block + size + len(END)
            if succ <= len(raw) and raw[succ - len(END) : succ] == END:
                out.append((at, succ, *_content(raw[block : block + size], fields)))
        at = raw.find(MAGIC, at + 1, hi + len(MAGIC) - 1)
    return out


def _id(urn: bytes | None) -> int | None:
    tail = (urn or b"").removeprefix(b"<urn:x-page:").removesuffix(b">")
    return int(tail) if tail.lstrip(b"-").isdigit() else None


def _content(block: bytes, fields: dict):
    """page id, payload bytes, digest, type, id referred to."""
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    http, _, payload = block.partition(END)
    if kind == "revisit":
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else -1
        digest = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _id(fields.get(b"warc-record-id")), size, digest, kind, _id(fields.get(b"warc-refers-to"))


_RECORDS = "array<struct<at: long, succ: long, exit: long, page_id: long, payload_bytes: long, payload_digest: string, record_type: string, refers_to: long>>"
_FIELDS = ("at", "succ", "exit", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
_KIND = pa.list_(pa.struct([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in _FIELDS]))


def plain(raw: bytes) -> bytes:
    """raw without its compression: all gzip members, one after the other, such as one for each record. A torn last member is an error."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out, rest = [], raw
    while rest:
        member = zlib.decompressobj(31)
        out.append(member.decompress(rest))
        if not member.eof:
            raise ValueError("a gzip member of an archive is cut off")
        rest = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _listed(batches):
    """A row for each block of each archive, with the archive's size."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = plain(content.as_buffer().to_pybytes())
            for n, lo in enumerate(range(0, len(raw), BLOCK)):
                found, exits = candidates(raw, lo, min(lo + BLOCK, len(raw))), {}
                for r in reversed(found):  # where each one's chain leaves the block
                    exits[r[0]] = r[1] if r[1] >= lo + BLOCK else exits.get(r[1], r[1])
                rows = [dict(zip(_FIELDS, (r[0], r[1], exits[r[0]], *r[2:]), strict=True)) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([rows], _KIND)], names=["file", "block", "size", "records"])


def _entries(blocks: DataFrame) -> DataFrame:
    """file, at: where the chain from the start of each file enters its blocks."""
    links = blocks.select("file", F.explode("records").alias("r")).select("file", F.col("r.at").alias("at"), F.col("r.exit").alias("to"))
    # a chain that goes through a block's middle leaves at the same place as one that enters before it
    links = materialised(links)
    reach = materialised(links.filter("at = 0").select("file", "at"))
    n = reach.count()
    while n:
        more = reach.join(links, ["file", "at"]).select("file", F.col("to").alias("at"))
        grown = materialised(reach.union(more).distinct())
        now = grown.count()
        reach = grown
        if now == n:
            break
        n = now
        # jumps twice as long
        nxt = links.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        links = materialised(links.join(nxt, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")))
    return reach


def _chained(batches):
    """Records of each block that lie on the chain from where it enters."""
    for b in batches:
        out = []
        for entries, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by = {r["at"]: r for r in rows}
            at = min(entries)
            while at in by:
                out.append(by[at])
                at = by[at]["succ"]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in _FIELDS[3:]], names=list(_FIELDS[3:]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record on the chains of the archives; an error if a chain ends before its archive does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    blocks = materialised(files.mapInArrow(_listed, f"file string, block long, size long, records {_RECORDS}"))
    reach = _entries(blocks)
    broken = blocks.select("file", F.col("size").alias("at")).distinct().join(reach, ["file", "at"], "left_anti").first()
    if broken is not None:
        raise ValueError(f"the chain of records in {broken['file']} does not reach its end at byte {broken['at']}")
    enters = reach.groupBy("file", F.expr(f"at div {BLOCK}").alias("block")).agg(F.collect_set("at").alias("entries"))
    return blocks.join(enters, ["file", "block"]).select("entries", "records").mapInArrow(_chained, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_chained_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives"
    write_archives(load(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP7_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p
), c AS (
  SELECT page_id, payload_bytes, h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * g + 1, 5))::INT) >> s) & 31) + 1, 1), '' ORDER BY g, s DESC) AS payload_digest
  FROM d, range(8) AS a(g), (VALUES (15), (10), (5), (0)) AS b(s) GROUP BY page_id, payload_bytes, h
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS largest FROM c
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM m
"""
