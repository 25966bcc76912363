"""Multi-line CSV in byte ranges against the reader that takes a whole file."""

import os
import random

import pytest
from pyspark.sql import functions as F

from passagekit.sources import csv_ranges, readers


def whole(spark, path):
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
          .select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_m")))
    return [tuple(r)[:-2] for r in sorted(df.collect(), key=lambda r: (r["_f"], r["_m"]))]


def ranged(spark, path, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = csv_ranges.read_csv(spark, path)
        rows = sorted(df.collect(), key=lambda r: r.position)
        n = csv_ranges.text_lines(spark, path).select("file", "start").distinct().count()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert [r.position for r in rows] == list(range(len(rows)))
    return [tuple(r)[1:] for r in rows], n


def field(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return ""
    if kind == 1:
        return '""'
    if kind == 2:
        return '"' + "".join(rng.choice(['a', ' ', ',', '\n', '""', '\r\n', 'é']) for _ in range(rng.randrange(60))) + '"'
    return "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 12))).strip() or "x"


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_equal_to_the_whole_reader_at_any_range(spark, tmp_path, seed, end):
    rng = random.Random(seed)
    for f in range(2):
        rows = [",".join(["id", '"two\nlines"' if seed == 3 else "b", "c"])]
        rows += [",".join([str(i), field(rng), field(rng)]) for i in range(25)]
        rows.insert(20, "")                                       # an empty line
        text = end.join(rows) + (end if seed == 1 else "")
        (tmp_path / f"part-{f}.csv").write_bytes(text.encode())
    path = str(tmp_path)
    want = whole(spark, path)
    assert len(want) == 50
    # that reader rewrites CRLF inside quotes where a file's lines end so; ours, as pandas, does not
    plain = lambda rows: [tuple(v.replace("\r\n", "\n") if v and end == "\r\n" else v for v in r) for r in rows]
    for size in (61, 1 << 20):
        got, n = ranged(spark, path, size)
        assert plain(got) == plain(want)
        assert n > 15 or size > 61


def test_one_record_over_many_ranges_and_open_quotes(spark, tmp_path):
    long = "\n".join(["line of a long field"] * 40)
    (tmp_path / "a.csv").write_text(f'x,y\n1,"{long}"\n2,z\n')
    (tmp_path / "b.csv").write_text('x,y\n3,"open at the\nend')
    (tmp_path / "c.csv").write_text("x,y\n")
    got, n = ranged(spark, str(tmp_path), 64)
    assert got == [("1", long), ("2", "z"), ("3", "open at the\nend")] and n > 10


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert csv_ranges.read_csv(spark, str(tmp_path)).count() == 0


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    rows = "".join(f'{i},"text {i}\nnext","{"w" * 50}"\n' for i in range(20_000))
    (tmp_path / "q.csv").write_text("id,prompt,answer\n" + rows)
    assert os.path.getsize(tmp_path / "q.csv") > 1_000_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        q = readers.read_questions_csv(spark, str(tmp_path))
        assert csv_ranges.text_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 15
        got = q.agg(F.count(F.lit(1)), F.countDistinct("prompt_id"), F.max("prompt_id")).first()
        assert tuple(got) == (20_000, 20_000, 19_999)
        assert q.where(F.col("prompt") != F.concat(F.lit("text "), F.col("prompt_id").cast("string"), F.lit("\nnext"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
