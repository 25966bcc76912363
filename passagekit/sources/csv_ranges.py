"""Multi-line CSV read in byte ranges.

Spark's own multi-line reader gives a whole file to one task, because a line
feed may lie inside quotes. Here every range of a file is read by its own task,
in two passes over Spark's text source, whose lines belong to one range each:

1. Per range, under both assumptions (it starts outside or inside quotes): the
   parity of its quotes and how many records end in it. The prefix sum of the
   parities over a file's ranges tells which assumption holds; the prefix sum of
   the ended records numbers them. One row per range reaches the driver, at most
   ``MAX_RANGES``.
2. Each range cuts its lines at the true record ends. A record that crosses
   ranges leaves a fragment in each; fragments carry the range their record
   began in, meet by it and are put together. Only they are shuffled.

A record's position (file name order, then file order, header rows not counted)
comes from the ranges' numbers, so numbering needs no shuffle either.

The form is that of RFC 4180: quotes inside a quoted field are doubled, and a
field with a quote is quoted. Empty lines outside quotes are skipped. Quotes that
are still open at the end of a file end with it.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

MAX_RANGES = 1 << 20
_RANGE = "file string, start long, parity int, ends0 long, ends1 long"
_PIECE = "position long, file string, origin long, start long, text string"


def text_lines(spark: SparkSession, path) -> DataFrame:
    """``(line, file, start)``: lines cut at line feeds, with their range."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("start")))


def _parts(batch):
    """Stretches of a batch that lie in one range, in order."""
    file, start = batch.column("file"), batch.column("start").to_numpy(zero_copy_only=False)
    code = file.dictionary_encode()
    code = code.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(start)], strict=True):
        if b > a:
            yield file[int(a)].as_py(), int(start[a]), batch.column("line").slice(a, b - a)


def _quotes(lines: pa.Array) -> np.ndarray:
    """Quotes up to and including each line."""
    return np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64))


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _ended(total: np.ndarray, blank: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines end a record, and which are empty lines between records, if
    ``before`` quotes precede the first line."""
    outside = (total + before) % 2 == 0
    free = np.r_[before % 2 == 0, outside[:-1]] & blank
    return outside & ~free, free


def _measure(batches):
    place, quotes, ends = None, 0, [0, 0]

    def row():
        return pa.RecordBatch.from_pydict({"file": [place[0]], "start": [place[1]], "parity": pa.array([quotes % 2], pa.int32()),
                                           "ends0": [ends[0]], "ends1": [ends[1]]})

    for b in batches:
        for file, start, lines in _parts(b):
            if (file, start) != place:
                if place:
                    yield row()
                place, quotes, ends = (file, start), 0, [0, 0]
            total, blank = _quotes(lines), _blank(lines)
            for s in (0, 1):
                ends[s] += int(_ended(total, blank, quotes + s)[0].sum())
            quotes += int(total[-1])
    if place:
        yield row()


def _layout(ranges: list) -> tuple[dict, int]:
    """Per range: quotes open before it (0 or 1), number of the first record that
    ends in it, the range that its first fragment's record began in, whether the
    header is still to come, and whether the file ends in it. Header rows have no number."""
    out, position = {}, 0
    ranges = sorted(ranges)
    for i, (file, start, parity, ends0, ends1) in enumerate(ranges):
        if i == 0 or ranges[i - 1][0] != file:
            inside, origin, header = 0, start, True
        last = i + 1 == len(ranges) or ranges[i + 1][0] != file
        ends = ends1 if inside else ends0
        after = (inside + parity) % 2
        out[file, start] = (inside, position, origin, header, last)
        done = ends + (1 if last and after else 0)
        position += done - (1 if header and done else 0)
        header = header and not done
        if ends or not inside:
            origin = start                       # what is open at its end began in it
        inside = after
    return out, position


def _cut(layout):
    def run(batches):
        place, state = None, None

        def begin(file, start):
            inside, position, origin, header, last = layout.value[file, start]
            return {"quotes": inside, "at": position, "lead": origin if inside else None, "header": header, "last": last, "open": []}

        def finish(rows):
            """What is open at the end of a range."""
            if not state["open"]:
                return
            file, start = place
            origin = state["lead"] if state["lead"] is not None else start
            position = state["at"] if state["last"] and not state["header"] else None
            if not (state["last"] and state["header"]):
                rows.append((position, file, origin, start, "\n".join(state["open"])))

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["position", "file", "origin", "start", "text"])

        for b in batches:
            rows: list[tuple] = []
            for file, start, lines in _parts(b):
                if (file, start) != place:
                    if place:
                        finish(rows)
                    place, state = (file, start), begin(file, start)
                total = _quotes(lines)
                ends, free = _ended(total, _blank(lines), state["quotes"])
                state["quotes"] += int(total[-1])
                text, a = lines.to_pylist(), 0
                for e in np.flatnonzero(ends | free).tolist():
                    if free[e]:
                        a = e + 1
                        continue
                    record = "\n".join([*state["open"], *text[a:e + 1]])
                    state["open"], a = [], e + 1
                    if state["header"]:
                        state["header"] = False
                        if state["lead"] is not None:          # its fragments meet, and go
                            rows.append((-1, file, state["lead"], start, record))
                    elif state["lead"] is not None:
                        rows.append((state["at"], file, state["lead"], start, record))
                        state["at"] += 1
                    else:
                        rows.append((state["at"], None, None, None, record))
                        state["at"] += 1
                    state["lead"] = None
                state["open"] += text[a:]
            if rows:
                yield emit(rows)
        if place:
            rows = []
            finish(rows)
            if rows:
                yield emit(rows)
    return run


def csv_records(spark: SparkSession, path) -> DataFrame:
    """``(position, text)``: the records of all CSV files under ``path`` in order,
    header rows left out."""
    ship_package(spark)
    lines = text_lines(spark, path)
    ranges = lines.mapInArrow(_measure, _RANGE)
    n = ranges.limit(MAX_RANGES + 1).collect()
    if len(n) > MAX_RANGES:
        raise ValueError("too many ranges: raise spark.sql.files.maxPartitionBytes")
    layout, _ = _layout([tuple(r) for r in n])
    shared = spark.sparkContext.broadcast(layout)
    out = scratch_path(spark, "csv-pieces")
    lines.mapInArrow(_cut(shared), _PIECE).write.mode("errorifexists").parquet(out)
    pieces = spark.read.schema(_PIECE).parquet(out)
    whole = pieces.where(F.col("file").isNull()).select("position", "text")
    joined = (pieces.where(F.col("file").isNotNull()).groupBy("file", "origin")
              .agg(F.max("position").alias("position"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
              .where("position >= 0").select("position", F.array_join("p.text", "\n").alias("text")))
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))


def csv_header(spark: SparkSession, path) -> list[str]:
    """Column names: the first record of the first file (in name order)."""
    lines = text_lines(spark, path)
    first = lines.agg(F.min("file")).first()[0]
    if first is None:
        return []
    text = ""
    # a header that spans many lines is read until its quotes close
    for r in lines.where((F.col("file") == first) & (F.col("start") == 0)).select("line").toLocalIterator():
        text += r.line + "\n"
        if text.strip() and text.count('"') % 2 == 0:
            break
    row = next(csv.reader([text.strip("\r\n").removeprefix("﻿")]), [])
    return [c or f"_c{i}" for i, c in enumerate(row)]


def read_csv(spark: SparkSession, path, position: str = "position") -> DataFrame:
    """All columns as strings, with the row's ``position``."""
    columns = csv_header(spark, path)
    if not columns:
        return spark.createDataFrame([], f"{position} long")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    row = F.from_csv("text", F.lit(schema), {"escape": '"', "maxCharsPerColumn": "-1"})
    return csv_records(spark, path).select(F.col("position").alias(position), row.alias("r")).select(position, "r.*")
