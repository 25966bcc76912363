"""WARC archives: one gzip member per record, and a splittable reader.

Writing: each page becomes a response record; of pages with equal payloads of at
least ``MIN_REVISIT`` bytes the one with the largest id holds the payload and
the others are revisit records that refer to it. Members go out through Spark's
text sink, byte for byte: a member shorter than 16 MB ends in a zero byte (the
top byte of its length field), which serves as line separator; a longer record
is followed by an empty member, which also ends in one.

Reading: Spark's text source scans byte ranges for the gzip magic, given as line
separator, so every range is read by its own task, owns the candidates that
start inside it and reads the last one to its end. A candidate is a record only
if its gzip header decodes and the data starts with a WARC header; a false magic
inside compressed data is joined back to the member it belongs to. If that
member lies across a range's border, the two pieces meet in a second step over
such leftovers only. At the start of a range, a candidate whose header decodes
but has given no data yet stays tentative: if a later piece does not continue it,
or a record follows, it was a false magic and its pieces are leftovers too.

Defined results: null html is an empty payload, a null url leaves the field
out, a null page id comes back as null; repeated rows of the response's id are
all responses; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import arrow_map, staged, table

MIN_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"     # crawl date of records whose pages carry none
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, " \
          "payload_bytes long, payload binary"


def record(page_id, url, kind: str, refers_to, digest: str, payload: bytes) -> bytes:
    """One WARC record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as gzip members that end in a zero byte."""
    def one(x):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()
    return one(data) if len(data) < 1 << 24 else one(data) + one(b"")


def parse(data: bytes) -> dict:
    """Fields of one record; a response's digest is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {field['WARC-Record-ID']}")
    ident = lambda x: int(v) if (v := x[len("<urn:page:"):-1]) else None
    return {"page_id": ident(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"), "record_type": kind,
            "refers_to": ident(field["WARC-Refers-To"]) if kind == "revisit" else None, "payload_digest": digest,
            "payload_bytes": size, "payload": payload if kind == "response" else None}


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives of ``pages(page_id, url, html)`` under ``path``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1("html"))
    same = staged(p.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest")
                  .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1 AND holder IS NOT NULL").select("digest", "holder"), "same")
    p = p.join(same, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))

    def members(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "digest", "html")), strict=True)
            yield {"m": [member(record(i, u, "response" if r is None else "revisit", r, d, h.encode()))[:-1]
                         for i, u, r, d, h in rows]}

    out = arrow_map(p, members, "m binary").select(F.col("m").cast("string").alias("value"))
    out.write.option("lineSep", "\x00").mode("errorifexists").text(path)


class _Member:
    """A candidate member that grows until its end is decoded."""

    def __init__(self, raw: bytes):
        self.raw, self.data, self.decoder = [], b"", zlib.decompressobj(31)
        self.add(raw)

    def add(self, raw: bytes) -> None:
        self.raw.append(raw)
        self.data += self.decoder.decompress(raw)

    @property
    def done(self) -> bool:
        return self.decoder.eof

    @property
    def confirmed(self) -> bool:
        return self.data[:5] == b"WARC/"

    def continued(self, raw: bytes) -> bool:
        """Adds ``raw``, unless that shows that this was no record."""
        try:
            self.add(raw)
        except zlib.error:
            return False
        return self.confirmed or (not self.done and b"WARC/".startswith(self.data[:5]))


def candidate(raw: bytes) -> _Member | None:
    """The member that starts with ``raw``, if it can be a WARC record's."""
    try:
        m = _Member(raw)
    except zlib.error:
        return None
    return m if m.confirmed or (not m.done and b"WARC/".startswith(m.data[:5])) else None


def _records(rows: list[dict]) -> dict:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    return {n: [r.get(n) for r in rows] for n in names}


def _scan(batches):
    """Records that end in their own range, and the leftovers at its borders
    (``kind`` 1: a member not yet ended, 2: pieces before the first record)."""
    place, open_, tentative, leading, seq = None, None, [], False, 0

    def left(kind, raw, at=0):
        return {"kind": kind, "file": place[0], "range": place[1], "seq": at, "raw": raw}

    def end_of_range():
        if tentative:
            return [left(2, raw, at) for at, raw in tentative]
        return [left(1, b"".join(open_.raw))] if open_ and not open_.done else []

    for b in batches:
        rows = []
        for f, start, chunk in zip(*(b.column(c).to_pylist() for c in ("file", "start", "chunk")), strict=True):
            if (f, start) != place:
                rows += end_of_range()
                place, open_, tentative, leading, seq = (f, start), None, [], True, 0
                if start == 0:
                    leading = False
                    if chunk == b"":
                        continue                               # what stands before a file's first magic
            raw, seq = MAGIC + chunk, seq + 1
            if tentative:
                fresh = candidate(raw)
                if (fresh is not None and fresh.confirmed) or not open_.continued(raw):
                    rows += [left(2, t, at) for at, t in tentative]
                    open_, tentative = None, []
                else:
                    tentative.append((seq, raw))
            elif open_ and not open_.done:
                if not open_.continued(raw):
                    raise ValueError(f"damaged record in {f}")
                fresh = None
            if open_ is None or (open_.done and not open_.data):
                open_ = candidate(raw)
                if open_ is None:
                    if leading:
                        rows.append(left(2, raw, seq))         # else padding between records
                    continue
                tentative = [(seq, raw)] if leading and not open_.confirmed else []
            if open_.confirmed:
                leading, tentative = False, []
            if open_.done and open_.data:
                rows.append({"kind": 0} | parse(open_.data))
                open_.data = b""
        if rows:
            yield _columns(rows)
    if rows := end_of_range():
        yield _columns(rows)


def _columns(rows):
    return _records(rows) | {n: [r.get(n) for r in rows] for n in ("kind", "file", "range", "seq", "raw")}


def _join_borders(batches):
    """Leftovers of a file in order: a member and the pieces that complete it. A
    piece that no member waits for may start one itself."""
    place, open_ = None, None
    for b in batches:
        rows = []
        for f, kind, raw in zip(*(b.column(c).to_pylist() for c in ("file", "kind", "raw")), strict=True):
            if f != place:
                place, open_ = f, None
            waits = open_ is not None and not open_.done
            if waits and open_.confirmed and (kind == 1 or not open_.continued(raw)):
                raise ValueError(f"damaged record in {f}")
            if kind == 1:
                open_ = _Member(raw)
            elif not (waits and (open_.confirmed or open_.continued(raw))):
                open_ = candidate(raw)
            if open_ is not None and open_.done and open_.data:
                rows.append(parse(open_.data))
                open_.data = b""
        if rows:
            yield _records(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: ``page_id, url, record_type,
    refers_to, payload_digest, payload_bytes, payload`` (null for revisits)."""
    chunks = (spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
              .select(F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("start")))
    names = [x.split()[0] for x in _RECORD.split(", ")]
    rows = staged(arrow_map(chunks, _scan, _RECORD + ", kind int, file string, range long, seq long, raw binary"), "warc")
    rest = rows.where("kind > 0").select("file", "range", "seq", "kind", "raw")
    rest = rest.repartition("file").sortWithinPartitions("file", "range", F.col("kind").desc(), "seq")
    return rows.where("kind = 0").select(*names).unionByName(arrow_map(rest, _join_borders, _RECORD))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS holder FROM p WHERE n >= {MIN_REVISIT} GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN g USING (h)
"""
