"""Best-fit packing of token pieces into sequences of fixed capacity.

Documents become token ids plus an end id; longer ones than the capacity are cut
into full pieces behind a first piece that takes the remainder. What goes where
depends on the lengths alone, so it is decided on the number of pieces of each
length, at most ``capacity`` numbers at any corpus size, and applied by Spark:

* Large items, above a third of the capacity: at most two fit into one bin, so
  packing them is a matching. Greedy, from the longest down, each takes the
  longest partner that still fits.
* Smaller items, from the longest down, go to the fullest bin that has room for
  them, and to new bins where none has.

Bins of equal filling are kept as runs of consecutive numbers, so a step moves a
whole run. A step is a row of the plan: pieces of one length, by their rank
among all of this length, into the bins from a number on, so many each, from an
offset on. A piece's rank is its rank inside the written part it lies in plus
the count of its length in earlier parts, which a window per length adds up over
a table of counts. Pieces then look their place up in the plan (binary search in
a broadcast whose size depends on the capacity, and is checked).

Memory: a task holds one Arrow batch of texts and its tokens; the driver holds
the counts per length and the plan.

Defined results: a null or empty text is the end id alone; null ids, repeated
rows and ties are packed as they come (rows of one part and length in their
order there); an empty table gives an empty result; extra columns are ignored,
whatever their names. Text that spells a special token is ordinary text.
"""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, staged

CAPACITY = 2048
END = 0
# The vocabulary of byte_bpe_50k.json as ranks: the same ids (tests compare them)
# for a quarter of the time.
TOKENIZER = "byte_bpe_50k.tiktoken"
MAX_PLAN = 1 << 21            # steps, 48 bytes each: bounds the broadcast


# ---- tokens -------------------------------------------------------------------------

def encoder(name: str):
    """Function from a text to its ids, of a public tokenizer's file (JSON of
    `tokenizers`, or ranks of `tiktoken`)."""
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_LOADED: dict = {}


def loaded(name: str):
    """The encoder, built once per worker process."""
    if name not in _LOADED:
        _LOADED[name] = encoder(name)
    return _LOADED[name]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = True,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids, part, place)``: pieces with
    their part and their rank among the part's pieces of this length. ``ids`` is
    null without ``with_ids``. ``tokenizer`` is a public tokenizer's file name."""
    def run(batches):
        encode, part, seen = loaded(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc, piece, start, crc, ids, place = [], [], [], [], [], []
            for d, text in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), strict=True):
                got = np.array([*encode(text or ""), end], "<u4")
                cuts = [0, *range((len(got) - 1) % capacity + 1, len(got) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = got[lo:hi]
                    doc.append(d)
                    piece.append(k)
                    start.append(lo)
                    crc.append(zlib.crc32(own.tobytes()))
                    ids.append(own)
                    place.append(seen[hi - lo])
                    seen[hi - lo] += 1
            sizes = np.array([len(i) for i in ids], np.int64)
            lists = pa.nulls(len(ids), pa.list_(pa.int32()))
            if with_ids:
                lists = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
            yield {"doc_id": pa.array(doc, pa.int64()), "piece": piece, "start": start, "length": sizes, "ids_crc32": crc,
                   "ids": lists, "part": np.full(len(ids), part), "place": np.array(place, np.int64)}

    cols = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return arrow_map(cols, run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, part int, place long")


# ---- plan ---------------------------------------------------------------------------

def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Steps ``(length, rank, bin, per_bin, offset)``: pieces of ``length`` from
    ``rank`` on go to the bins from ``bin`` on, ``per_bin`` in each, one after
    the other from ``offset`` on, until the next step of this length."""
    left = {s: n for s, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    steps: list[tuple] = []
    gaps: list[int] = []                    # fillings with open bins, sorted by room
    open_bins: dict[int, list] = {}         # room -> runs (first bin, bins)
    bins = 0

    def put(s: int, first: int, n_bins: int, per: int, room: int, items: int) -> None:
        steps.append((s, done[s], first, per, capacity - room))
        done[s] += items
        left[s] -= items
        rest = room - per * s
        if n_bins and rest:
            if rest not in open_bins:
                bisect.insort(gaps, rest)
            open_bins.setdefault(rest, []).append((first, n_bins))

    # large items: a matching
    large = sorted(s for s in left if 3 * s > capacity)
    live = list(large)                      # lengths that may have pieces left
    for s in reversed(large):
        while left[s]:
            at = bisect.bisect_right(live, min(s, capacity - s)) - 1
            while at >= 0 and left[live[at]] <= (live[at] == s):    # none left, or only the piece itself
                if not left[live[at]]:
                    del live[at]
                at -= 1
            mate = live[at] if at >= 0 else None
            if mate is None:
                # alone; equal ones too, as any of them would have been a mate
                n = left[s]
                put(s, bins, n, 1, capacity, n)
            elif mate == s:
                n = left[s] // 2
                put(s, bins, n, 2, capacity, 2 * n)
            else:
                n = min(left[s], left[mate])
                steps.append((s, done[s], bins, 1, 0))
                done[s] += n
                left[s] -= n
                put(mate, bins, n, 1, capacity - s, n)
            bins += n
    # smaller items: best fit
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                per = capacity // s
                n = left[s] // per
                if n:
                    put(s, bins, n, per, capacity, n * per)
                elif left[s]:
                    n = 1
                    put(s, bins, 1, left[s], capacity, left[s])
                bins += n
                continue
            room = gaps[at]
            runs, per = open_bins[room], room // s
            first, n = runs.pop()
            full = min(n, left[s] // per)
            if full < n:
                runs.append((first + full, n - full))
            if not runs:
                del open_bins[room], gaps[at]
            if full:
                put(s, first, full, per, room, full * per)
            elif left[s]:                       # fewer than fill one bin's room: into a single one
                first, n = open_bins[room].pop()
                if n > 1:
                    open_bins[room].append((first + 1, n - 1))
                elif not open_bins[room]:
                    del open_bins[room], gaps[at]
                put(s, first, 1, left[s], room, left[s])
    if len(steps) > MAX_PLAN:
        raise ValueError("packing plan over its bound")
    out = np.array(sorted(steps), np.int64).reshape(-1, 5)
    return out


def places(steps: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces by length and rank."""
    # one sorted key: the steps of a length lie together, by rank
    first = np.searchsorted(steps[:, 0], length, "left")
    last = np.searchsorted(steps[:, 0], length, "right")
    lo, hi = first, last - 1
    while (lo < hi).any():                      # last step of the length with step rank <= rank
        mid = (lo + hi + 1) // 2
        under = steps[mid, 1] <= rank
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid - 1)
    _, at, first_bin, per, offset = steps[lo].T
    within = rank - at
    return first_bin + within // per, offset + within % per * length


# ---- operator -----------------------------------------------------------------------

def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, ``part``, ``place``, written) plus
    ``sequence_id`` and ``offset``, without ``part`` and ``place``."""
    spark = pieces.sparkSession
    counts = staged(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    # at most ``capacity`` rows
    totals = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    if not totals:
        return pieces.drop("part", "place").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    steps = spark.sparkContext.broadcast(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd
        at = places(steps.value, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": at[0], "offset": at[1]})

    ranked = pieces.join(earlier, ["length", "part"]).withColumn("at", place("length", F.col("place") + F.col("earlier")))
    return ranked.select(*[F.col(c) for c in pieces.columns if c not in ("part", "place")], "at.sequence_id", "at.offset")


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` with the sequence and offset each one lies at."""
    return pack(staged(token_pieces(docs, tokenizer, capacity, end, with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids, starts)`` of placed pieces with ids: the token
    sequences themselves, at most the capacity in a group."""
    row = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(row.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), with_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
