"""Suffix-array dedup by external induced sorting.

Removes every byte covered by a ``width``-byte string that also starts anywhere
else in the corpus (same document included). Matches never cross documents and
are judged on the input.

Windows are sharded by winnowed anchor (:mod:`.anchors`), so equal windows meet
in one shard. Runs that are equal as a whole collapse to one representative
first; only representatives that share an anchor with a different run need
sorting. Their bytes are laid one after the other in shards of about
``SHARD_BYTES``, and each shard's suffixes are sorted by external induced sorting
(:mod:`.induced`). Shards are sized to fit in memory: at ``SHARD_BYTES`` the
queues and the text practically never reach the disk, which is a fallback, and
the sort holds several arrays of a whole shard. Windows that share ``width`` bytes of prefix with a neighbour
in suffix order are repeats; the common prefix is compared by 128-bit digests.
An anchor with more than ``CONTEXTS`` different runs (a passage in very many
surroundings) would make one shard grow with the data: its windows are counted
by digest instead, pre-aggregated before the shuffle.

Defined results: a null text is empty; repeated rows are separate occurrences,
so texts of at least ``width`` bytes vanish from both; shorter texts are kept;
null ids are carried; empty tables give empty results; extra columns are
ignored and may have any name.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import M1, M2, Digest, merge_spans, mix, spread_runs
from .common import arrow_map, bits_of, documents, has_bits, staged, whole_groups
from .induced import MEMORY, suffix_order
from .repeats import each_run, keyed, repeated_runs, slices, windows_of, with_spans

WIDTH = 200
ANCHOR_BYTES = 96            # long anchors are rare outside true repeats, also in periodic text
SHARD_BYTES = 1 << 20
CONTEXTS = 4096
MAX_SORT_TASKS = 20_000

_rng = np.random.default_rng(20240229)
_H1, _H2 = _rng.integers(0, 1 << 64, (2, 256), np.uint64)


def _read(part):
    texts = part.column("text").cast("binary").to_pylist()

    def symbols(i, a, b):
        c = np.frombuffer(texts[i], np.uint8, b - a, a)
        return _H1[c], _H2[c]

    return np.array([len(t or b"") for t in texts]), symbols


def repeated_windows(x: np.ndarray, valid: np.ndarray, width: int, memory: int = MEMORY) -> np.ndarray:
    """Window starts of ``x`` (symbols 0 to 256) among ``valid`` whose next
    ``width`` symbols also start elsewhere among them, ascending."""
    with tempfile.TemporaryDirectory() as folder:
        if len(x) > 8 * memory:                                # larger shards are sorted from disk
            path = os.path.join(folder, "text")
            x.tofile(path)
            x = np.memmap(path, x.dtype, "r")
        order = suffix_order(x, 257, folder, memory)
    order = order[valid[order]]
    h = mix(np.asarray(x).astype(np.uint64) + np.uint64(M2))
    d1, d2 = Digest(h, M1, len(x) + 1), Digest(h, M2, len(x) + 1)
    w1, w2 = d1(order, order + width), d2(order, order + width)
    same = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
    return np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(order) else order


def _sort_shards(width: int, memory: int):
    def run(batches):
        for unit, did, th, s, text in whole_groups(batches, ["unit", "did", "th", "s", "text"], 1):
            cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
            for rows in np.split(np.arange(len(unit)), cuts):
                if len(rows) < 2:
                    continue
                sizes = np.array([len(text[r]) for r in rows])
                ends = np.cumsum(sizes + 1)
                starts = ends - sizes - 1
                x = np.frombuffer(b"\x00".join(text[rows]), np.uint8).astype(np.int16) + 1
                x[ends[:-1] - 1] = 0                           # symbol 0 parts the runs
                valid = np.zeros(len(x), bool)
                valid[spread_runs(starts, sizes - width + 1)[0]] = True
                at = repeated_windows(x, valid, width, memory)
                if not len(at):
                    continue
                of = np.searchsorted(starts, at, side="right") - 1
                cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
                b, last = at[cut], at[np.r_[cut[1:] - 1, len(at) - 1]]
                r = rows[of[cut]]
                base = s[r] - starts[of[cut]]
                yield {"did": did[r], "th": th[r], "b": b + base, "e": last + base + width}
    return run


def removed_spans(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR_BYTES, shard_bytes: int = SHARD_BYTES,
                  contexts: int = CONTEXTS, memory: int = MEMORY) -> DataFrame:
    """Byte spans ``(did, th, b, e)`` covered by repeated windows (may overlap)."""
    texts = keyed(docs)
    runs = repeated_runs(texts, _read, width, k)
    run = ["a", "f1", "f2"]
    groups = staged(runs.groupBy(run).agg(F.count(F.lit(1)).alias("n"),
                                          F.min(F.struct("did", "th", "s", "c", "key")).alias("rep")), "groups")
    whole = (runs.join(groups.where("n > 1").select(run), run)
             .select("did", "th", F.col("s").alias("b"), (F.col("s") + F.col("c") + (width - 1)).alias("e")))
    several = staged(groups.groupBy("a").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1"), "several")
    reps = staged(groups.join(several, "a").select("a", "runs", "rep.c", "rep.key"), "reps")
    hot, cold = reps.where(F.col("runs") > contexts), reps.where(F.col("runs") <= contexts)

    windows = staged(windows_of(texts, _read, width, k, hot), "windows")
    twice = staged(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("w1", "w2"), "twice")
    counted = (windows.join(twice, ["w1", "w2"])
               .select("did", "th", F.col("s").alias("b"), (F.col("s") + width).alias("e")))

    size = cold.agg(F.sum(F.col("c") + (width - 1))).first()[0] or 0
    units = max(1, -(-int(size) // shard_bytes))
    scan, wanted = each_run(_read, width, k), bits_of(cold, "key")

    def fragments(batches):
        for r in scan(batches):
            ok = np.flatnonzero(has_bits(wanted.value, r.key))
            if len(ok):
                text = r.part.column("text").cast("binary")
                text = [text[int(i)].as_buffer() for i in r.row[ok]]
                cut = [t[int(a):int(a) + int(c) + width - 1].to_pybytes()
                       for t, a, c in zip(text, r.at[ok], r.count[ok], strict=True)]
                yield {"unit": np.mod(r.anchor[ok], units), "key": r.key[ok], "did": r.did[ok], "th": r.th[ok], "s": r.at[ok], "text": cut}

    parts = arrow_map(texts, fragments, "unit long, key long, did long, th long, s long, text binary")
    # the bitmap only spares work: what it lets through besides goes here, before any shard is
    # gathered, so copies of a passage never come to its shard, however full the bitmap is
    parts = parts.join(cold.select("key"), "key", "left_semi").drop("key")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(units, MAX_SORT_TASKS))
    parts = parts.repartition(tasks, "unit").sortWithinPartitions("unit", "did", "th", "s")
    found = arrow_map(parts, _sort_shards(width, memory), "did long, th long, b long, e long")
    return whole.unionByName(counted).unionByName(found)


def dedup_bytes(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """``doc_id, kept`` (remaining bytes; cuts may fall inside a character),
    ``n_bytes, n_removed`` and ``starts, ends`` (maximal removed runs), one row
    per input row."""
    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                out = {"doc_id": part.column("doc_id"), "kept": [], "n_bytes": [], "n_removed": [],
                       "starts": [], "ends": []}
                for t, b, e in zip(part.column("text").cast("binary").to_pylist(),
                                   part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                    t = t or b""
                    s, f = merge_spans(np.array(b or [], np.int64), np.array(e or [], np.int64))
                    s, f = s.tolist(), f.tolist()
                    out["kept"].append(b"".join(t[x:y] for x, y in zip([0, *f], [*s, len(t)], strict=True)))
                    out["n_bytes"].append(len(t))
                    out["n_removed"].append(sum(f) - sum(s))
                    out["starts"].append(s)
                    out["ends"].append(f)
                yield out

    rows = with_spans(docs, removed_spans(docs, width, **options))
    return arrow_map(rows, cut, "doc_id long, kept binary, n_bytes long, n_removed long, "
                                "starts array<long>, ends array<long>")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


# Windows over the hexadecimal form of the bytes; maximal runs by gaps.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 199, 0), 256)) AS q FROM d),
b AS (SELECT doc_id, q, substr(x, 2 * q + 1, 910) AS x FROM w),
h AS (SELECT doc_id, q + i AS p, md5(substr(x, 2 * i + 1, 400)) AS h
      FROM (SELECT *, unnest(range(0, len(x) // 2 - 199)) AS i FROM b)),
m AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new
      FROM h SEMI JOIN m USING (h)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM s),
r AS (SELECT doc_id, g, min(p) AS b, max(p) + 200 AS e FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM r),
t AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last,
             string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS head
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
