"""Shared stages of the two exact-substring operators.

Both find repeated windows of a fixed number of symbols (bytes or words) in
four map-only scans of the texts, joined only by slim key tables:

1. anchor hashes, counted; the repeated ones fill a fixed-size bitmap;
2. runs whose anchor is in the bitmap, grouped by whole-run digest: runs with
   equal digests are equal in every window, so a group of copies of any size
   collapses to one representative before anything is compared;
3. for anchors with several distinct runs, the representatives are compared
   (by the operator's own method);
4. removed spans meet the texts again.

The bitmaps only spare work; every decision is made on exact joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Runs, chunks, mix, spread_runs
from .common import arrow_map, bits_of, has_bits, staged

LAST = (1 << 63) - 1         # stands for a null document id inside the jobs

SLICE_BYTES = 1 << 20        # text bytes decoded at once


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Texts with the key of their rows: document id (null: ``LAST``) and text
    digest, so that rows that share an id but not a text are kept apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"),
                       F.xxhash64("text").alias("th"), "text", *[F.col(c).cast("long").alias(c) for c in more])


def slices(batch):
    """The rows of an Arrow batch in slices of bounded text size."""
    size = batch.column("text").cast("binary").nbytes
    step = max(1, batch.num_rows * SLICE_BYTES // max(1, size))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def run_key(did, th, start):
    """Digest of a run's place (document, text, first window)."""
    x = mix(did.astype(np.uint64) ^ mix(th.astype(np.uint64)))
    return mix(x + start.astype(np.uint64)).astype(np.int64)


def each_run(read: Callable, width: int, k: int):
    """``scan(batches)`` yields, per vectorised pass, the runs with their
    document ids, text digests and first windows (in the document), and a
    function giving the pass's symbols.

    ``read(slice)`` returns ``(lengths, symbols)``; ``symbols(i, a, b)`` gives
    the two hash arrays of symbols a to b of the slice's document i.
    """
    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                did = part.column("did").to_numpy(zero_copy_only=False)
                th = part.column("th").to_numpy(zero_copy_only=False)
                lengths, symbols = read(part)
                for group in chunks(lengths, width):
                    which, a, b = (np.array(x) for x in zip(*group, strict=True))
                    pieces = [symbols(*g) for g in group]
                    ends = np.cumsum(b - a)
                    runs = Runs(np.concatenate([p[0] for p in pieces]),
                                np.concatenate([p[1] for p in pieces]), ends, width, k)
                    if not len(runs.start):
                        continue
                    runs.part, runs.row = part, which[runs.doc]
                    runs.did, runs.th = did[runs.row], th[runs.row]
                    runs.at = runs.start + (a - (ends - (b - a)))[runs.doc]
                    runs.key = run_key(runs.did, runs.th, runs.at)
                    yield runs
    return scan


def repeated_runs(texts: DataFrame, read: Callable, width: int, k: int) -> DataFrame:
    """Runs whose anchor occurs more than once in the corpus, staged:
    anchor ``a``, digest ``f1, f2``, place ``did, th, s``, windows ``c``, ``key``."""
    scan = each_run(read, width, k)

    def anchors(batches):
        for runs in scan(batches):
            yield {"a": runs.anchor}

    counts = arrow_map(texts, anchors, "a long").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = bits_of(staged(counts.select("a"), "anchors"), "a")

    def candidates(batches):
        for r in scan(batches):
            ok = has_bits(seen.value, r.anchor)
            if ok.any():
                yield {"a": r.anchor[ok], "f1": r.f1[ok], "f2": r.f2[ok], "did": r.did[ok], "th": r.th[ok],
                       "s": r.at[ok], "c": r.count[ok], "key": r.key[ok]}

    return staged(arrow_map(texts, candidates,
                            "a long, f1 long, f2 long, did long, th long, s long, c long, key long"), "runs")


def windows_of(texts: DataFrame, read: Callable, width: int, k: int, keys: DataFrame) -> DataFrame:
    """Digests of all windows of the runs named by ``keys`` (a few more runs may
    slip through the bitmap; they are true occurrences like the others):
    ``w1, w2, did, th, s``."""
    keys = staged(keys.select("key"), "keys")
    if keys.isEmpty():
        return keys.sparkSession.createDataFrame([], "w1 long, w2 long, did long, th long, s long")
    scan, wanted = each_run(read, width, k), bits_of(keys, "key")

    def windows(batches):
        for r in scan(batches):
            ok = np.flatnonzero(has_bits(wanted.value, r.key))
            if len(ok):
                at, which = spread_runs(r.start[ok], r.count[ok])
                run = ok[which]
                w1, w2 = r.windows(at)
                yield {"w1": w1, "w2": w2, "did": r.did[run], "th": r.th[run],
                       "s": at - r.start[run] + r.at[run]}

    return arrow_map(texts, windows, "w1 long, w2 long, did long, th long, s long")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text`` with the arrays ``starts`` and ``ends`` of their spans
    (``did, th, b, e``); null where a row has none."""
    per_doc = staged(spans.groupBy("did", "th").agg(F.collect_list(F.struct("b", "e")).alias("x"))
                     .select("did", "th", F.col("x.b").alias("starts"), F.col("x.e").alias("ends")), "spans")
    return keyed(docs, "doc_id").join(per_doc, ["did", "th"], "left").select("doc_id", "text", "starts", "ends")
