"""SimHash near-dedup with sharded BK-trees.

A text's fingerprint has bit j set when more than half of its shingles' XXH64
values have it. Fingerprints link at ``radius`` or fewer differing bits;
documents of one connected component form a group.

Fingerprints are grouped first, so copies cost one row per task. By the
pigeonhole principle two linked fingerprints agree on ``c`` of ``radius + c``
bit blocks: each such combination is a shard key, and ``c`` follows the number
of distinct fingerprints so that shards stay small. In a shard a BK-tree (child
edges keyed by the integer distance to the parent) is searched, following only
edges within the radius of the query's distance. A shard over ``TREE`` nodes
becomes several trees of at most that size, each searched by every block of the
shard's fingerprints in a task of its own, so no tree or task grows with the
data. Trees reach their searchers through the shuffle rather than through the
driver, which never sees a fingerprint. A task reports a star per local
component, never all pairs.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other; null ids take part but are never a group's
smallest id (a group of nulls only has a null component); repeated rows are
copies; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, documents, staged, whole_groups

SHINGLE = 3
RADIUS = 3
TREE = 1024                  # nodes of a tree
SHARD = 64                   # aimed-at fingerprints of a shard
_PASS = 1 << 16              # shingles counted at once


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint as an unsigned integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - [len(w) + 1 for w in words])[:len(words) - shingle + 1].tolist()
    ends = (ends - 1)[shingle - 1:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _PASS):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at:at + _PASS], ends[at:at + _PASS], strict=True)],
                     np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: list[str] | None = None) -> DataFrame:
    """``doc_id, fp`` (fp as signed long) and the long columns ``also``."""
    also = also or []

    def run(batches):
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b.column("text").cast("binary").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "fp": np.array(fp, np.uint64).astype(np.int64), **{c: b.column(c) for c in also}}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also), run,
                     ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


class BKTree:
    """BK-tree over distinct uint64 fingerprints (positions in ``points``)."""

    def __init__(self, points: np.ndarray):
        self.points, self.kids = points, {}
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            root, rest = own[0], own[1:]
            if not len(rest):
                continue
            d = np.bitwise_count(points[rest] ^ points[root])
            order = np.argsort(d, kind="stable")
            cuts = np.flatnonzero(np.diff(d[order])) + 1
            groups = np.split(rest[order], cuts)
            self.kids[int(root)] = [(int(d[order[c]]), int(g[0]))
                                    for c, g in zip(np.r_[0, cuts], groups, strict=True)]
            todo += groups

    def search(self, queries: np.ndarray, radius: int):
        """Yields ``(node, positions of the queries within radius of it)``; all
        queries walk the tree together."""
        todo = [(0, np.arange(len(queries)))] if len(self.points) else []
        while todo:
            node, live = todo.pop()
            d = np.bitwise_count(queries[live] ^ self.points[node]).astype(np.int16)
            near = live[d <= radius]
            if len(near):
                yield node, near
            for key, kid in self.kids.get(node, ()):
                go = live[np.abs(d - key) <= radius]
                if len(go):
                    todo.append((kid, go))


class Groups:
    """Union-find over positions, joined a set at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = self.up[x]

    def join(self, members: np.ndarray) -> None:
        roots = self.find(members)
        self.up[roots] = roots.min()

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.up)))


def link_unit(tree_side: np.ndarray, query_side: np.ndarray, radius: int):
    """Star edges ``(point, smallest position's point)`` of one work unit."""
    points = np.concatenate([tree_side, query_side])
    groups, offset = Groups(len(points)), len(tree_side)
    for node, near in BKTree(tree_side).search(query_side, radius):
        groups.join(np.r_[node, near + offset])
    roots = groups.roots()
    far = points[roots] != points
    return points[far], points[roots[far]]


def _units(radius: int):
    """Work units stream in sorted by ``unit``; one is in memory at a time."""
    def run(batches):
        for u, p, fp, side in whole_groups(batches, ["unit", "part", "fp", "side"], 2):
            starts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (p[1:] != p[:-1])])
            nodes, roots = [], []
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(u)], strict=True):
                if y - x > 1:
                    v, s = fp[x:y].astype(np.uint64), side[x:y]
                    a, r = link_unit(v[s <= 1], v[s != 1], radius)
                    nodes.append(a)
                    roots.append(r)
            if nodes:
                yield {"a": np.concatenate(nodes).astype(np.int64), "b": np.concatenate(roots).astype(np.int64)}
    return run


def shard_keys(radius: int, exact: int) -> list:
    """Key columns: every choice of ``exact`` of ``radius + exact`` bit blocks."""
    n = radius + exact
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(n)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = []
    for i, pick in enumerate(itertools.combinations(range(n), exact)):
        mask = 0
        for p in pick:
            mask |= signed[p]
        keys.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    return keys


def links(nodes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Star edges ``(a, b)`` connecting the distinct fingerprints ``fp`` that
    are linked directly or through others of their shards."""
    exact, n = 1, nodes.count()
    while exact < 4 and n / 2 ** (64 * exact / (radius + exact)) > SHARD:
        exact += 1
    keyed = staged(nodes.select("fp", F.explode(F.array(*shard_keys(radius, exact))).alias("unit")), "shards")
    sizes = staged(keyed.groupBy("unit").agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "sizes")
    blocks = F.ceil(F.col("g") / F.lit(tree)).cast("int")
    rows = keyed.join(sizes, "unit").withColumn("n", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    rows = rows.select("unit", "fp", "n", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y"))
    # side 0: tree and query of its own block, 1: tree, 2: query
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
    part = F.least("x", "y") * F.col("n") + F.greatest("x", "y")
    rows = rows.select("unit", part.cast("long").alias("part"), "fp", side.cast("int").alias("side"))
    rows = rows.repartition("unit", "part").sortWithinPartitions("unit", "part", "fp")
    return arrow_map(rows, _units(radius), "a long, b long")


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """Rows of ``fps`` with ``root`` (names the component, also where no row has
    an id) and ``component_id``."""
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    comp = staged(connected_components(links(nodes, radius), "a", "b"), "components")
    low = staged(comp.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("cid")), "low")
    linked = comp.join(low, "root").select(F.col("node").alias("fp"), "root", "cid")
    ids = staged(nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"),
                                                         F.coalesce("cid", "low").alias("component_id")), "ids")
    return fps.join(ids, "fp", "left")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` (smallest id reachable), one row per input row."""
    return _grouped(staged(fingerprints(docs, shingle), "fingerprints"), radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row per group: of the rows with the group's smallest id
    the one whose text has the smallest digest; a row without an id only where no
    row of the group has one. Rows that share an id but not a group are told
    apart by their text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    fps = staged(fingerprints(rows, shingle, ["th"]), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best")
    keep = staged(_grouped(fps, radius).groupBy("root").agg(best)
                  .select(F.col("best.doc_id").alias("id"), F.col("best.th").alias("t")), "keep")
    one = rows.select("row", "doc_id", "th").join(
        keep, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t")), "left_semi")
    return one.dropDuplicates(["doc_id", "th"]).select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
