"""Packing documents into token sequences: shortest pack first over the length histogram.

A document's ids, and the id that ends it, are cut into pieces of ``LENGTH`` ids
and a rest. Only the histogram of piece lengths (at most ``LENGTH`` rows) comes
to the driver. There lengths are placed longest first, each into the open
pattern with the least content that still has room; all pieces of one length
and all sequences of one pattern move together, so the work depends on the
number of different lengths, not on the number of documents. Each piece then
finds its place by its rank among the pieces of its length.

Ranks need no task that sees all pieces of a length: pieces are numbered inside
(length, slice), where slices are dealt by a hash, and the slices' totals, a
table bounded by lengths times slices, give the start of each.

Tokens: a text is cut at single spaces, where the tokenizer also cuts; parts
seen before come from a bounded cache. Texts with white space beside a space,
where this would differ, are handed over whole, and those that hold one of the
tokenizer's added tokens, such as ``<|endoftext|>``, go to the tokenizer itself.

Defined results: a null or empty text is one piece that holds the final id
alone; ties are ordered by (doc_id, start); repeated rows are packed as often
as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace

LENGTH, END = 1024, 0
#: Entries of the cache of parts, and the longest part that it takes.
CACHE, PART = 300_000, 64
#: Pieces that one slice of a length should hold, and the most slices.
SLICE, SLICES = 100_000, 1024
_BESIDE = re.compile(r"[^\S\n]\s|\s[^\S\n]|\A\s|\s\Z")


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes; one for each worker process."""

    def __init__(self, added: list[str], vocabulary: str | None = None, tokenizer: str | None = None):
        import public_tokenizers as P
        import tiktoken

        path, self.file = vocabulary or P.path("byte_bpe_50k.tiktoken"), tokenizer or P.path("byte_bpe_50k.json")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.tokenizer = None
        self.encode = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self._whole(" " + part)
        if len(part) <= PART:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[part] = ids
        return ids

    def _by_tokenizer(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.file)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.added.search(text):
            return self._by_tokenizer(text)
        if _BESIDE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        get = self.cache.get
        return b"".join([self._whole(first), *[get(p) or self._part(p) for p in rest]])


def added_tokens(tokenizer: str | None = None) -> list[str]:
    """What the tokenizer takes for one token wherever it stands in a text."""
    import public_tokenizers as P

    with open(tokenizer or P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """(``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``) for each piece of each row."""
    added = added_tokens(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(added, vocabulary, tokenizer), np.array([END], dtype="<u4").tobytes()
        for b in batches:
            row, start, size, crc, total = [], [], [], [], []
            for k, x in enumerate(b.column(1)):
                ids = tokens(x.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    row.append(k)
                    start.append(at)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            numbers = [pa.array(v, type=pa.int64()) for v in (start, size, crc, total)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, type=pa.int64())), *numbers], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns: (number of sequences, ((piece length, pieces of it per sequence), ...)).

    ``open_`` holds by content the patterns that may still grow, ordered so that the
    one with the least content, shortest pack first, is found in logarithmic time.
    """
    content: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    used: list[int] = []

    def put(total: int, count: int, parts: tuple[tuple[int, int], ...]) -> None:
        if total not in content:
            content[total] = []
            insort(used, total)
        content[total].append((count, parts))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        grown = []
        while left:
            # The least content of all has the most room; once it is too full, new sequences are opened.
            if not used or used[0] + size > length:
                per = min(length // size, left)
                count = left // per
                grown.append((per * size, count, ((size, per),)))
                left -= count * per
                continue
            # Of those with room, the fullest that this piece completes comes first: it leaves no padding.
            exact = bisect_left(used, length - size)
            total = used[exact] if exact < len(used) and used[exact] == length - size else used[0]
            count, parts = content[total].pop()
            if not content[total]:
                del content[total]
                used.remove(total)
            take = min(count, left)
            if take < count:
                put(total, count - take, parts)
            grown.append((total + size, take, (*parts, (size, 1))))
            left -= take
        for total, count, parts in grown:
            put(total, count, parts)
    return [x for total in used for x in content[total]]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, ranks per sequence, offset) of each run of ranks."""
    out, sequence, rank = [], 0, {}
    for count, parts in patterns:
        at = 0
        for size, per in parts:
            first = rank.get(size, 0)
            out.append((size, first, first + count * per, sequence, per, at))
            rank[size] = first + count * per
            at += size * per
        sequence += count
    return out


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Each piece with its sequence (``sequence_id``) and its place there (``offset``)."""
    spark = docs.sparkSession
    space = Workspace(spark)
    cut = space.save(pieces(docs, length, vocabulary, tokenizer), "pieces")
    n = cut.count()
    slices = max(8, min(SLICES, n // SLICE))
    cut = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)).cast("int"))
    histogram: dict[int, int] = {}
    starts = []
    for r in sorted(tuple(x) for x in cut.groupBy("length", "_slice").agg(F.count(F.lit(1))).collect()):
        starts.append((r[0], r[1], histogram.get(r[0], 0)))
        histogram[r[0]] = histogram.get(r[0], 0) + r[2]
    if not n:
        return cut.drop("_slice").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # At most ``length * slices`` rows, and a few runs of ranks for each length.
    first = spark.createDataFrame(starts, "length bigint, _slice int, _first bigint")
    runs = spark.createDataFrame(places(plan(histogram, length)), "length bigint, _a bigint, _b bigint, _seq bigint, _per bigint, _at bigint")
    within = F.row_number().over(_window())
    ranked = cut.withColumn("_rank", within - 1).join(F.broadcast(first), ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_a", "_b", "_seq", "_per", "_at"))).alias("_runs"))
    run = F.filter("_runs", lambda r: (r["_a"] <= F.col("_rank")) & (F.col("_rank") < r["_b"])).getItem(0)
    placed = ranked.join(F.broadcast(runs), "length").withColumn("_run", run)
    step = F.col("_rank") - F.col("_run._a")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_run._seq") + F.expr("(_rank - _run._a) div _run._per")).alias("sequence_id"),
        (F.col("_run._at") + F.pmod(step, F.col("_run._per")) * F.col("length")).alias("offset"),
    )


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("length", "_slice").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
