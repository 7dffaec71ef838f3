"""Near duplicates by SimHash, found with vantage-point trees.

1. Every text gets a 64-bit fingerprint of its four-word shingles.
2. Equal fingerprints collapse; from here on each one counts once.
3. A tree of vantage points, grown from a bounded sample of fingerprints, cuts
   the Hamming space into shards. A fingerprint lives in the one shard that it
   falls into, and calls at every later shard that may hold a neighbour: by the
   triangle inequality a branch is left out if no point in it can be near.
4. The residents of a shard, and those who ask there, are dealt by hash into
   slices, as many as a second sample of fingerprints tells; each slice of
   residents meets each slice of askers in a cell of its own. So no task grows
   with the table, however many fingerprints one region of the space holds.
5. Each cell grows its own vantage-point tree and asks it for all points
   within ``bits`` of every asker, so that every pair of near fingerprints
   meets in one cell. The pairs are merged as they are found: a cell returns a
   spanning forest, never all pairs of a dense group.
6. Components over the forests of all cells.

The search is exact; the samples decide how evenly the cells are filled, not
what is found. Fingerprints of unrelated texts lie about 32 bits apart, give or
take 4, so a radius of 4 prunes about a fifth of each branch: work grows as the
1.75th power of the number of different fingerprints.

Defined results: a null or empty text has no words and gets fingerprint zero,
which links like any other; ties and repeated rows have equal fingerprints, so
one component; rows with one doc_id count as one document; an empty table gives
an empty result; very long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .workspace import Workspace

SHINGLE, BITS, BLOCK = 4, 4, 1 << 15
#: Fingerprints, about, that come to the driver: from half of them the top of the tree is grown, with the others its shards are weighed.
SAMPLE = 1 << 16
#: Residents and askers that a cell should have at most.
RESIDENTS, ASKERS = 1 << 18, 1 << 20
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text as an unsigned number."""
    words = (text or b"").lower().split()  # both know ASCII only, as wanted
    if not words:
        return 0
    if len(words) < SHINGLE:
        return _hash(b" ".join(words))
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        shingles = zip(*(part[k:] for k in range(SHINGLE)), strict=False)
        h = np.fromiter(map(_hash, map(b" ".join, shingles)), dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``fp``); the fingerprint's 64 bits are read as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


class Tree:
    """A vantage-point tree over 64-bit points; inner branches hold d <= radius."""

    def __init__(self, points: np.ndarray, depth: int, least: int, rng: np.random.Generator):
        self.point: np.uint64 | None = None
        self.points = points
        if depth == 0 or len(points) <= least:
            return
        # Of a few candidates, the vantage point with the widest spread of distances prunes best.
        best = None
        for c in points[rng.choice(len(points), size=min(8, len(points)), replace=False)]:
            d = np.bitwise_count(points ^ c)
            spread = float(d.std())
            if best is None or spread > best[0]:
                best = (spread, c, d)
        _, self.point, d = best
        self.radius = int(np.sort(d)[(len(d) - 1) // 2])
        inner = d <= self.radius
        if inner.all():
            self.radius -= 1
            inner = d <= self.radius
        if inner.all() or not inner.any():
            self.point = None
            return
        self.inner = Tree(points[inner], depth - 1, least, rng)
        self.outer = Tree(points[~inner], depth - 1, least, rng)
        self.points = points[:0]

    def leaves(self) -> Iterator[Tree]:
        if self.point is None:
            yield self
        else:
            yield from self.inner.leaves()
            yield from self.outer.leaves()

    def visit(self, queries: np.ndarray, index: np.ndarray, reach: int) -> Iterator[tuple[Tree, np.ndarray]]:
        """Each leaf with the queries (their places in ``index``) whose ball of ``reach`` may touch it."""
        if not len(index):
            return
        if self.point is None:
            yield self, index
            return
        d = np.bitwise_count(queries[index] ^ self.point).astype(np.int16)
        yield from self.inner.visit(queries, index[d - reach <= self.radius], reach)
        yield from self.outer.visit(queries, index[d + reach > self.radius], reach)


def _visits(top: Tree, q: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard its number, the places in ``q`` that ask there, and which of these are at home."""
    home = np.zeros(len(q), dtype=np.int32)
    for leaf, i in top.visit(q, np.arange(len(q)), 0):
        home[i] = leaf.number
    for leaf, i in top.visit(q, np.arange(len(q)), bits):
        i = i[home[i] <= leaf.number]
        if len(i):
            yield leaf.number, i, home[i] == leaf.number


def slices(top: Tree, weighed: np.ndarray, n: int, bits: int, residents: int, askers: int) -> np.ndarray:
    """For each shard the number of slices of its residents and of those who ask there.

    Counts come from ``weighed``, a sample of all ``n`` fingerprints, with twice their standard error added.
    """
    leaves = list(top.leaves())
    for k, leaf in enumerate(leaves):
        leaf.number, leaf.points = k, leaf.points[:0]
    seen = np.zeros((len(leaves), 2))
    for at in range(0, len(weighed), BLOCK):
        for shard, i, at_home in _visits(top, weighed[at : at + BLOCK], bits):
            seen[shard] += np.count_nonzero(at_home), len(i)
    expected = (seen + 2 * np.sqrt(seen) + 1) * (n / max(1, len(weighed)))
    return np.maximum(1, np.ceil(expected / [residents, askers])).astype(np.int64)


def _cells(fp: np.ndarray, at_home: np.ndarray, rows: int, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``fp``, cells, who lives there, who asks there) of a shard with so many slices of residents and of askers."""
    h = fp * np.uint64(0x9E3779B97F4A7C15)
    row, column = ((h >> np.uint64(40)) % np.uint64(rows)).astype(np.int64), ((h >> np.uint64(8) & np.uint64(0xFFFFFFFF)) % np.uint64(columns)).astype(np.int64)
    every = np.arange(len(fp))
    for r in range(rows):
        yield every, r * columns + column, at_home & (row == r), np.ones(len(fp), dtype=bool)
    for c in range(columns):
        here = np.flatnonzero(at_home & (column != c))
        if len(here):
            yield here, row[here] * columns + c, np.ones(len(here), dtype=bool), np.zeros(len(here), dtype=bool)


def _dealt(distinct: DataFrame, top: Tree, dealt: np.ndarray, bits: int) -> DataFrame:
    """(``cell``, ``fp``, ``lives``, ``asks``): each fingerprint at home, and as a caller in later shards."""
    first = np.cumsum(dealt.prod(axis=1)) - dealt.prod(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            everyone = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(everyone), BLOCK):
                q = everyone[at : at + BLOCK]
                for shard, i, at_home in _visits(top, q, bits):
                    for k, cell, lives, asks in _cells(q[i], at_home, *dealt[shard].tolist()):
                        yield pa.RecordBatch.from_arrays([pa.array(first[shard] + cell), pa.array(q[i][k].view(np.int64)), pa.array(lives), pa.array(asks)], ["cell", "fp", "lives", "asks"])

    return distinct.select("fp").mapInArrow(run, "cell bigint, fp bigint, lives boolean, asks boolean")


class Forest:
    """Union-find over numbered points that remembers the edges it needed."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        label = self.label
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return int(x)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = self.label[a] != self.label[b]
        a, b = a[differ], b[differ]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.label[max(p, q)] = min(p, q)
                self.edges.append((x, y))
        while True:  # all labels become roots, so that later calls drop what is joined already
            up = self.label[self.label]
            if np.array_equal(up, self.label):
                return
            self.label = up


def near(residents: np.ndarray, callers: np.ndarray, bits: int, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between residents and those who ask (places in residents and callers, joined; by default all)."""
    everyone = np.concatenate([residents, callers])
    asking = np.arange(len(everyone)) if asking is None else asking
    forest, rng = Forest(len(everyone)), np.random.default_rng(0)
    order = np.argsort(residents, kind="stable")
    tree = Tree(residents, 40, 512, rng)
    for at in range(0, len(asking), BLOCK):
        here = asking[at : at + BLOCK]
        q = everyone[here]
        for leaf, index in tree.visit(q, np.arange(len(q)), bits):
            place = order[np.searchsorted(residents, leaf.points, sorter=order)]
            step = max(1, (1 << 20) // max(1, len(leaf.points)))
            for k in range(0, len(index), step):
                i = index[k : k + step]
                a, b = np.nonzero(np.bitwise_count(q[i][:, None] ^ leaf.points[None, :]) <= bits)
                a = here[i[a]]
                b = place[b]
                real = a != b
                if real.any():
                    forest.add(a[real], b[real])
    return forest.edges


def links(distinct: DataFrame, bits: int = BITS, sample: int = SAMPLE, residents: int = RESIDENTS, askers: int = ASKERS) -> DataFrame:
    """Edges (``a``, ``b``) between fingerprints: with the same components as all pairs within ``bits``."""
    n = distinct.count()
    part = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(min(1.0, sample / max(1, n)) * (1 << 40))
    drawn = np.sort(np.array([r[0] for r in distinct.where(part).select("fp").collect()], dtype=np.int64)).view(np.uint64)
    shards = max(64, -(-n // residents))
    top = Tree(drawn[::2], int(np.ceil(np.log2(shards))), 4, np.random.default_rng(0))
    dealt = slices(top, drawn[1::2], n, bits, residents, askers)

    def run(table):
        fp, lives, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "lives", "asks"))
        fp = fp.view(np.uint64)
        everyone = np.concatenate([fp[lives], fp[~lives]])
        asking = np.flatnonzero(np.concatenate([asks[lives], asks[~lives]]))
        found = np.array(near(fp[lives], fp[~lives], bits, asking), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": everyone[found[:, 0]].view(np.int64), "b": everyone[found[:, 1]].view(np.int64)})

    return _dealt(distinct, top, dealt, bits).groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``) for each row of ``docs``."""
    space = Workspace(docs.sparkSession)
    prints = space.save(fingerprints(docs), "prints")
    distinct = space.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(space.save(links(distinct, bits), "links", grouped=True), space)
    named = distinct.join(found, distinct["fp"] == found["id"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = space.save(named.join(least, "c").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, unchanged, of which each group of near duplicates keeps its smallest doc_id."""
    kept = near_duplicates(docs, bits).where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """One row for each document, the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
