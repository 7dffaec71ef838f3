"""Near copies of whole documents: SimHash fingerprints, then the Jaccard similarity of their word shingles.

1. Every text gets its SimHash fingerprint, and fingerprints are linked within
   ``simhash.BITS`` bits by vantage-point trees (``simhash.links``). Texts of one
   component of fingerprints are candidates.
2. Every text becomes the set of hashes of its five-word shingles. Equal sets
   collapse; from here on each one counts once.
3. A set gives ``BANDS * ROWS`` minimum hashes; sets that share a band are
   candidates too. At a similarity of 0.8 a pair shares one of 24 bands of 4 with
   probability 0.999997, and unrelated texts hardly ever do, whatever single
   stretches they have in common.
4. Candidates are verified by exact Jaccard similarity and linked as lines are
   (``linking``).

Bands come beside the fingerprints since a pair at similarity 0.8 differs in 7 to
12 bits or more, and at the radius that this takes trees no longer prune.

Defined results: a text of fewer than ``SHINGLE`` words is one shingle, a null or
empty one a shingle without words; rows with one doc_id count as one document; a
null doc_id counts as the largest; an empty table gives an empty result;
very long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .linking import Linker
from .simhash import BITS, BLOCK, _hash, fingerprint, links
from .workspace import Workspace, free_names

SHINGLE, BANDS, ROWS, SIMILAR = 5, 24, 4, 0.8
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a UTF-8 text, as ascending hashes."""
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        return np.array([_hash(b" ".join(words))], dtype=np.uint64)
    parts = []
    for at in range(0, len(words) - SHINGLE + 1, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        grams = zip(*(part[k:] for k in range(SHINGLE)), strict=False)
        parts.append(np.unique(np.fromiter(map(_hash, map(b" ".join, grams)), dtype=np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each band of a set's minimum hashes."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), 4096):
        low = np.minimum(low, ((own[None, at : at + 4096] ^ _XOR) * _TIMES).min(axis=1))
    return np.array([_hash(bytes([b]) + low[b * ROWS : (b + 1) * ROWS].tobytes()) for b in range(BANDS)], dtype=np.uint64)


def _mapped(docs: DataFrame, inner: str, schema: str) -> DataFrame:
    """``doc_id``, ``id`` (a hash of the whole set) and of each text either the band keys and the fingerprint, or the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, lists, prints = [], [], []
                for x in part.column(1):
                    text = x.as_buffer().to_pybytes() if x.is_valid else None
                    own = shingles(text)
                    ids.append(_hash(own.tobytes()))
                    lists.append((bands(own) if inner == "keys" else own).view(np.int64))
                    if inner == "keys":
                        prints.append(fingerprint(text))
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                numbers = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in ([ids, prints] if inner == "keys" else [ids])]
                yield pa.RecordBatch.from_arrays([part.column(0), numbers[0], values, *numbers[1:]], ["doc_id", "id", inner, *["fp"][: len(numbers) - 1]])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def fingerprinted(prints: DataFrame, space: Workspace, bits: int = BITS) -> DataFrame:
    """(``id``, ``keys``): a key for each component of fingerprints that texts of a set lie in."""
    distinct = space.save(prints.select("fp").distinct(), "fingerprints")
    found = components(space.save(links(distinct, bits), "fingerprint-links", grouped=True), space, "fingerprint-stars")
    pairs = prints.select("id", "fp").distinct().join(found.select(F.col("id").alias("fp"), "component"), "fp", "left")
    return pairs.select("id", F.array(F.xxhash64(F.lit("fingerprint"), F.coalesce("component", "fp"))).alias("keys")).distinct()


def near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(``doc_id``, ``component_id``) for each row of ``docs``."""
    space = Workspace(docs.sparkSession)
    (first,) = free_names(docs, "first")
    kind = dict(docs.dtypes)["doc_id"]
    prints = space.save(_mapped(docs, "keys", f"doc_id {kind}, id bigint, keys array<bigint>, fp bigint"), "prints")
    distinct = space.save(prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")), "distinct")

    def held(ids: DataFrame) -> DataFrame:
        wanted = distinct.join(ids, "id", "left_semi").select(F.col("first").alias(first))
        texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted[first]), "left_semi")
        # Rows with one doc_id may have other texts; only those that were asked for count.
        return _mapped(texts, "s", f"doc_id {kind}, id bigint, s array<bigint>").select("id", F.col("s").alias("held")).join(ids, "id", "left_semi").dropDuplicates(["id"])

    shingles_of = lambda held: held.select("id", F.explode("held").alias("x"))
    signed = fingerprinted(prints, space).unionByName(distinct.select("id", "keys"))
    found = Linker(space, held, shingles_of, lambda s: s, similar)(signed)
    named = distinct.join(found, "id", "left").select("id", "first", F.coalesce("component", "id").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = space.save(named.join(least, "c").select("id", "component_id"), "named")
    return prints.join(named, "id").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, unchanged, of which each group of near copies keeps its smallest doc_id."""
    kept = near_copies(docs, similar).where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept"]), "left_semi")
