"""Exact Jaccard join of documents by their word n-grams: a grouped prefix join.

Two documents link if their sets of four-word shingles have at least
``SIMILAR`` hundredths of their union in common. In any fixed order of shingles,
sets that similar share one among their first ``n - ceil(t n) + 1``.

1. Every text becomes the sorted set of its shingles' 64-bit hashes. Equal sets
   collapse; from here on each counts once.
2. A lossless sieve keeps most documents from the costly part. In the order of
   hashes, similar sets share at least ``l`` among their first
   ``n - ceil(t n) + l``. A set of which too few of these shingles occur in any
   other set's first ones has no partner.
3. What is left is ordered from rare to frequent. Shingles that one set alone
   has come first, need no name, and often fill the whole prefix; then the set
   has no partner.
4. Sets of one size with one prefix are a group; only groups are joined: on the
   shingles of their prefixes, filtered by sizes and by places, each pair of
   groups at the first shingle that both have.
5. Pairs of groups are expanded to pairs of members, which bitmaps sift without
   loss and exact intersections verify.

Components are wanted, not all links. So that a dense crowd of near copies isn't
expanded, representatives are compared first: each member with its group's, each
group with one leading group for each shingle of its prefix, then once more with
several leaders where a shingle's groups still are in different components. The
exhaustive steps 4 and 5 leave out only pairs of one component, so they lose no
component. They are quadratic only where many sets that stay apart have the same
rarest shingles at places that don't exclude a link.

No group is collected: groups, shingles and leaders are keys of equality joins,
which adaptive execution may split.

Defined results: a text without words, or null, has an empty set, links with
nothing, and is its own component, also if there are several such; fewer words
than ``SHINGLE`` are one shingle; repeated rows are equal texts, so one
component; rows that share a doc_id are documents of their own; a null doc_id
counts as the largest, so a component has a null id only if all its documents
have; an empty table gives an empty result; very long texts are hashed whole;
columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .workspace import Workspace

SHINGLE, SIMILAR = 4, 85
#: Leaders for each shingle in the second round; words of 64 bits in a bitmap.
LEADERS, WORDS = 8, 16
_hash = partial(xxhash.xxh64_intdigest, seed=13)
_TIMES = np.random.default_rng(13).integers(0, 1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9FB21C651E98DF25)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a UTF-8 text, as ascending hashes."""
    words = (text or b"").lower().split()  # both know ASCII only, as wanted
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([_hash(b" ".join(words))], dtype=np.uint64)
    w = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
    n = len(w) - SHINGLE + 1
    h = reduce(np.add, (w[k : k + n] * _TIMES[k] for k in range(SHINGLE)))
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def least(n: int, similar: int = SIMILAR) -> int:
    """Shingles that a set of ``n`` has in common with any similar one, at least."""
    return -(-similar * n // 100)


def extra(n: int) -> int:
    """The sieve's ``l``: shared shingles that it asks for."""
    return -(-n // 10)


def sieved(own: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, int]:
    """The sieve's shingles of a set, and how many of them some other set must have."""
    n = len(own)
    return own[: n - least(n, similar) + extra(n)], extra(least(n, similar))


def bitmap(own: np.ndarray) -> np.ndarray:
    out = np.zeros(WORDS, dtype=np.uint64)
    np.bitwise_or.at(out, ((own >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
    return out


def _mapped(docs: DataFrame, whole: bool, similar: int) -> DataFrame:
    """(``doc_id``, ``digest``, ``n``) of each text, and the sieve's shingles ``pre`` with ``need``, or the whole set ``s`` with its ``map``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingles(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column(1)]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int32))
                cut = [sieved(s, similar) for s in sets]
                lists = sets if whole else [c[0] for c in cut]
                ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists).view(np.int64)))
                if whole:
                    more = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WORDS), pa.array(np.concatenate([bitmap(s) for s in sets]).view(np.int64)))
                else:
                    more = pa.array(np.array([c[1] for c in cut], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), digests, sizes, values, more], ["doc_id", "digest", "n", "s" if whole else "pre", "map" if whole else "need"])

    kind = dict(docs.dtypes)["doc_id"]
    lists = "s array<bigint>, map array<bigint>" if whole else "pre array<bigint>, need int"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, digest binary, n int, {lists}")


def _sieved(cand: DataFrame, space: Workspace) -> DataFrame:
    """Ids of sets that may have a partner, of rows (``id``, ``need``, ``pre``) in the table ``cand0``.

    What goes was the only company of some of the rest, so the sieve is used again while it takes a tenth.
    """
    n, k = None, 0
    while True:
        one = cand.select("id", F.explode("pre").alias("x"))
        shared = one.groupBy("x").agg(F.count(F.lit(1)).alias("often")).where("often > 1").select("x")
        met = one.join(shared.hint("shuffle_hash"), "x").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
        left, (now,) = space.save_counted(met.join(cand.select("id", "need"), "id").where("c >= need").select("id"), f"left{k}", heavy=True)
        if not now or n is not None and now > 0.9 * n:
            space.drop(f"cand{k}")
            return left
        rest = space.save(cand.join(left.hint("shuffle_hash"), "id", "left_semi"), f"cand{k + 1}", heavy=True)
        space.drop(f"cand{k}", f"left{k}")
        cand, k, n = rest, k + 1, now


def _ordered(sets: DataFrame, similar: int) -> DataFrame:
    """(``id``, ``n``, ``alone``, ``pre``): size, number of shingles that no other set has, and the rest of the prefix, rare ones first."""
    own = sets.select("id", "n", F.explode("s").alias("x"))
    often = own.groupBy("x").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Frequency and a part of the hash in one number is the order. Shingles that agree in both are taken for one, which excludes no pair.
    place = F.shiftleft(F.least("often", F.lit((1 << 22) - 1)), 40) + F.col("x").bitwiseAND(F.lit((1 << 40) - 1))
    rows = own.join(often.hint("shuffle_hash"), "x").groupBy("id", "n").agg(F.sort_array(F.collect_list(place)).alias("s"))
    alone = F.col("n") - F.size("s")
    reach = F.col("n") - F.expr(f"({similar} * cast(n as bigint) + 99) div 100") + 1 - alone
    return rows.where(reach > 0).select("id", "n", alone.alias("alone"), F.slice("s", F.lit(1), reach.cast("int")).alias("pre"))


def _grouped(ordered: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Groups (``g``, ``n``, ``alone``, ``pre``, ``size``) and members (``id``, ``g``); a group is named after its smallest member."""
    ordered = space.save(ordered, "ordered", heavy=True)
    groups = space.save(ordered.groupBy("n", "alone", "pre").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("size")), "groups")
    members = space.save(ordered.join(groups, ["n", "alone", "pre"]).select("id", "g"), "members")
    space.drop("ordered")
    return groups, members


def _group_pairs(groups: DataFrame, similar: int) -> DataFrame:
    """Pairs (``g``, ``h``) of groups that share a shingle of their prefixes and that sizes and places don't exclude.

    ``groups`` has the least and the greatest component of its members, ``lo`` and ``hi``; a pair of one component is left out.
    """
    n = F.col("n").cast("bigint")
    # The smaller set of a pair needs a shorter prefix.
    reach = n - F.expr(f"({2 * similar} * cast(n as bigint) + {99 + similar}) div {100 + similar}") + 1
    rows = groups.select("g", n.alias("n"), "alone", "lo", "hi", reach.alias("reach"), "pre", F.posexplode("pre").alias("k", "x"))
    rows = rows.select("g", "n", "lo", "hi", "reach", (F.col("alone") + F.col("k")).alias("p"), F.slice("pre", F.lit(1), F.col("k")).alias("before"), "x")
    small = rows.where("p < reach").select("x", *[F.col(c).alias(f"{c}i") for c in ("g", "n", "lo", "hi", "p", "before")])
    large = rows.select("x", *[F.col(c).alias(f"{c}j") for c in ("g", "n", "lo", "hi", "p", "before")])
    near = (
        f"(ni < nj or (ni = nj and gi <= gj)) and (loi < hij or loj < hii) and 100 * ni >= {similar} * nj"
        f" and {100 + similar} * least(ni - pi, nj - pj) >= {similar} * (ni + nj) and not arrays_overlap(beforei, beforej)"
    )
    return small.join(large, "x").where(F.expr(near)).select(F.col("gi").alias("g"), F.col("gj").alias("h"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _verified(pairs: DataFrame, maps: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Of the pairs (``a``, ``b``) those whose sets are similar.

    Sets differ in at least as many shingles as their bitmaps do in bits; similar ones in at most a (1 - t) / (1 + t) of both sizes together.
    """
    one, other = (maps.select(F.col("id").alias(x), F.col("n").cast("bigint").alias(f"n{x}"), F.col("map").alias(f"m{x}")) for x in ("a", "b"))
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.get("ma", F.lit(w)).bitwiseXOR(F.get("mb", F.lit(w)))) for w in range(WORDS)])
    likely = pairs.join(one, "a").join(other, "b").where((100 + similar) * differ <= (100 - similar) * (F.col("na") + F.col("nb"))).select("a", "b")
    one, other = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in ("a", "b"))
    both = likely.join(one, "a").join(other, "b").select("a", "b", (F.size("sa") + F.size("sb")).cast("bigint").alias("n"), F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("c"))
    return both.where(f"100 * c >= {similar} * (n - c)").select("a", "b")


class _Links:
    """Links found so far and the components that they make."""

    def __init__(self, members: DataFrame, maps: DataFrame, sets: DataFrame, similar: int, space: Workspace):
        self.members, self.maps, self.sets, self.similar, self.space = members, maps, sets, similar, space
        self.edges: list[DataFrame] = []

    def add(self, pairs: DataFrame, name: str) -> DataFrame:
        """Verifies the pairs; (``id``, ``component``) by all links."""
        self.edges.append(self.space.save(_verified(pairs.where("a <> b").distinct(), self.maps, self.sets, self.similar), f"links-{name}", heavy=True))
        return components(reduce(DataFrame.unionByName, self.edges), self.space, f"stars-{name}")

    def cells(self, found: DataFrame, name: str) -> DataFrame:
        """(``id``, ``g``, ``c``): members with their component so far."""
        return self.space.save(self.members.join(found, "id", "left").select("id", "g", F.coalesce("component", "id").alias("c")), f"cells-{name}")


def _linked(groups: DataFrame, links: _Links, similar: int, space: Workspace) -> DataFrame:
    """(``id``, ``component``) of all sets with a link."""
    tokens = groups.select("g", "size", F.explode("pre").alias("x"))
    crowd = tokens.groupBy("x").agg(F.sum("size").alias("crowd"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    # Who meets the most others leads; a hash decides among equals.
    ranked = tokens.join(crowd.hint("shuffle_hash"), "x").groupBy("g").agg((F.sum("crowd") + (F.xxhash64("g") / 2.0**64 + 0.5)).alias("rank"))
    met = space.save(tokens.join(crowd.select("x").hint("shuffle_hash"), "x", "left_semi").join(ranked, "g").select("x", "g", "rank"), "met")
    lead = met.groupBy("x").agg(F.max_by("g", "rank").alias("lead"))
    pairs = links.members.select(*_pair("id", "g")).unionByName(met.join(lead, "x").select(*_pair("g", "lead")))
    cells = links.cells(links.add(pairs, "first"), "first")
    # Shingles whose groups are still in different components, by the smallest member of each group and component.
    each = cells.groupBy("g", "c").agg(F.min("id").alias("id"))
    open_ = met.join(each, "g").select("x", "id", "c", "rank")
    mixed = open_.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("x")
    open_, (left,) = space.save_counted(open_.join(mixed.hint("shuffle_hash"), "x", "left_semi"), "open")
    if left:
        dealt = open_.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(LEADERS)))
        lead = dealt.groupBy("x", "part").agg(F.max_by("id", "rank").alias("lead"), F.max_by("c", "rank").alias("lc")).drop("part")
        cells = links.cells(links.add(open_.join(lead, "x").where("c <> lc").select(*_pair("id", "lead")), "second"), "second")
    span = cells.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    near = space.save(_group_pairs(groups.join(span, "g"), similar), "near", heavy=True)
    one, other = (cells.select(F.col("g").alias(g), F.col("id").alias(f"id{g}"), F.col("c").alias(f"c{g}")) for g in ("g", "h"))
    pairs = near.join(one, "g").join(other, "h").where("cg <> ch and (g <> h or idg < idh)").select(*_pair("idg", "idh"))
    return links.add(pairs, "last")


def similar_documents(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``) for each row of ``docs``."""
    space = Workspace(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    prints = space.save(_mapped(docs, False, similar).withColumn("row", F.monotonically_increasing_id()), "prints")
    distinct = space.save(prints.where("n > 0").groupBy("digest").agg(F.min("row").alias("id"), F.min("doc_id").alias("first")), "distinct")
    cand = space.save(prints.join(distinct.select(F.col("id").alias("row")).hint("shuffle_hash"), "row", "left_semi").select(F.col("row").alias("id"), "need", "pre"), "cand0", heavy=True)
    rows = space.save(prints.select("doc_id", "digest", "n"), "rows")
    space.drop("prints")
    left = space.save(distinct.join(_sieved(cand, space), "id", "left_semi"), "left")
    wanted = left.select(F.col("first").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    # Rows with one doc_id may have other texts; only the sets that were asked for count.
    sets = _mapped(texts, True, similar).select("digest", "n", "s", "map").join(left.select("digest", "id"), "digest").dropDuplicates(["digest"])
    sets = space.save(sets.select("id", "n", "s", "map"), "sets", heavy=True)
    groups, members = _grouped(_ordered(sets, similar), space)
    few = space.save(sets.join(members.select("id"), "id", "left_semi"), "few")
    space.drop("sets")
    links = _Links(members, few.select("id", "n", "map"), few.select("id", "s"), similar, space)
    found = _linked(groups, links, similar, space)
    named = distinct.join(found, "id", "left").select("id", "digest", "first", F.coalesce("component", "id").alias("c"))
    least_id = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = space.save(named.join(least_id, "c").select("digest", "component_id"), "named")
    out = rows.where("n > 0").join(named, "digest").select("doc_id", "n", "component_id")
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").cast(kind).alias("component_id"))
    return out.unionByName(empty).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
