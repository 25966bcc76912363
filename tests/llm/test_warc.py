import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from passagekit.llm import warc
from passagekit.session import scratch_path

PAGES = "page_id long, url string, html string, chunk string, file string"


def case():
    rng = random.Random(2)
    big = "".join(rng.choice("abcdef<>&é\n") for _ in range(3000))
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", big), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (8, "u", "x" * 1000), (9, "u", "x" * 1000), (9, "u", "x" * 1000),
            (10, "u", "x" * 999), (11, "u", "x" * 999), (None, "u", big), (None, "u", "alone" * 300),
            (12, "u", "".join(chr(rng.randint(32, 0x2FF)) for _ in range(200_000)))]
    return [(*r, "c", "f") for r in rows]


def expected(rows):
    out, holder = [], {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            holder[b] = max(holder.get(b, i), i)
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        ref = holder.get(b) if holder.get(b) != i else None
        ref = ref if sum((r[2] or "").encode() == b for r in rows) > 1 else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def read(spark, path):
    rows = warc.read_warc(spark, path).collect()
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str)


@pytest.mark.parametrize("split", ["128m", "997b"])
def test_round_trip_at_any_split(spark, split):
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(case(), PAGES).coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split != "128m" else "4m")
    try:
        assert read(spark, path) == expected(case())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archives_are_plain_gzip_members(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(case()[:4], PAGES).coalesce(1), path)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4


def test_false_magic_inside_a_member_and_across_a_border():
    """A stored (uncompressed) member whose data holds the magic."""
    inner = b"x" * 1200 + warc.MAGIC + b"y" * 50 + warc.MAGIC + b"\x00" * 9
    digest = hashlib.sha1(inner).hexdigest()
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = c.compress(warc.record(5, "u", "response", None, digest, inner)) + c.flush()
    chunks = raw.split(warc.MAGIC)[1:]
    assert len(chunks) == 3

    def batch(rows):
        import pyarrow as pa
        return pa.RecordBatch.from_pydict({"file": [r[0] for r in rows], "start": [r[1] for r in rows], "chunk": [r[2] for r in rows]})

    whole = list(warc._scan(iter([batch([("f", 0, b""), *[("f", 0, x) for x in chunks]])])))
    assert whole[0]["page_id"] == [5] and whole[0]["kind"] == [0]
    parts = [r for cols in warc._scan(iter([batch([("f", 0, b""), ("f", 0, chunks[0]), ("f", 900, chunks[1]), ("f", 900, chunks[2])])]))
             for r in zip(cols["file"], cols["range"], cols["kind"], cols["seq"], cols["raw"], strict=True)]
    parts.sort(key=lambda r: (r[0], r[1], -r[2], r[3]))
    import pyarrow as pa
    rest = pa.RecordBatch.from_pydict({"file": [r[0] for r in parts], "kind": [r[2] for r in parts], "raw": [r[4] for r in parts]})
    done = list(warc._join_borders(iter([rest])))
    assert done[0]["page_id"] == [5] and done[0]["payload_digest"] == [digest]


def in_ranges(ranges):
    """Page ids that the two steps of the reader find in pieces dealt by range."""
    def batch(rows, names):
        return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})

    found, rest = [], []
    for start, pieces in ranges:
        rows = [("f", start, x) for x in ([b""] if start == 0 else []) + pieces]
        for cols in warc._scan(iter([batch(rows, ["file", "start", "chunk"])])):
            for i, kind in enumerate(cols["kind"]):
                if kind == 0:
                    found.append(cols["page_id"][i])
                else:
                    rest.append((cols["file"][i], cols["range"][i], -kind, cols["seq"][i], cols["raw"][i]))
    rest = [(r[0], -r[2], r[4]) for r in sorted(rest, key=lambda r: r[:4])]
    for cols in warc._join_borders(iter([batch(rest, ["file", "kind", "raw"])])) if rest else []:
        found += cols["page_id"]
    return sorted(found)


@pytest.mark.parametrize("false", [b"\x04\x00\x00\x00\x00\x00\x03\xff\xff" + b"z" * 60,     # an extra field that does not end
                                   b"\x08\x00\x00\x00\x00\x00\x03" + b"n" * 60,               # a name that does not end
                                   b"\x00\x00"])                                               # less than a header
def test_false_magic_with_a_decodable_header_at_the_start_of_a_range(false):
    def stored(page, payload):
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        return c.compress(warc.record(page, "u", "response", None, hashlib.sha1(payload).hexdigest(), payload)) + c.flush()

    first = stored(1, b"x" * 900 + warc.MAGIC + false + b"q" * 30)
    a, b = first.split(warc.MAGIC)[1:]
    c, d = (stored(i, b"p" * 400)[3:] for i in (2, 3))
    want = [1, 2, 3]
    assert in_ranges([(0, [a, b, c, d])]) == want
    assert in_ranges([(0, [a]), (900, [b, c, d])]) == want           # the next record in the same range
    assert in_ranges([(0, [a]), (900, [b]), (1800, [c, d])]) == want  # and beyond it
    assert in_ranges([(0, [a]), (900, [b, c]), (1800, [d])]) == want
    assert in_ranges([(0, [d]), (900, [a]), (1800, [b]), (2700, [c])]) == want


def test_archive_inside_a_payload():
    inner = warc.member(warc.record(9, "u", "response", None, hashlib.sha1(b"n").hexdigest(), b"n"))
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    payload = b"x" * 50 + inner + b"y" * 50
    raw = c.compress(warc.record(1, "u", "response", None, hashlib.sha1(payload).hexdigest(), payload)) + c.flush()
    assert in_ranges([(0, raw.split(warc.MAGIC)[1:])]) == [1]


def test_damaged_archive_is_an_error():
    raw = warc.member(warc.record(1, "u", "response", None, hashlib.sha1(b"ab" * 500).hexdigest(), b"ab" * 500))
    with pytest.raises(ValueError):
        in_ranges([(0, [raw[3:60], raw[3:]])])


def test_empty(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_warc(spark, path).collect() == []
