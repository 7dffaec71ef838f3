"""Suffix-array deduplication: bytes that an earlier document holds too, found by external induced sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id. Strings never cross documents.

1. Documents are gathered into blocks of bytes, written once.
2. Every string of ``LENGTH`` bytes is filed under its anchor: the least hash
   among its runs of ``GRAM`` bytes. Equal strings have equal anchors. Strings
   that follow one another under one anchor form a segment.
3. Each block says which anchors it has (once each, with a mark for those in
   more than one of its documents), by buckets of the hash; a bucket answers
   which of them another document has too. Only those can hold a repeat.
4. The segments of these anchors, each different one once per block, go to the
   buckets again. A bucket merges equal segments, and sorts all suffixes of
   the others by external induced sorting (``suffix_sort``): among neighbours
   with a common prefix of ``LENGTH``, the least doc_id is known to all.
5. What was found goes back to the blocks, which cut their texts.

A passage in a third of all documents reaches its bucket once for each block,
not for each document, and is held there once; sorting works on disk beyond its
memory budget.

Defined results: a null text is empty; repeated rows with one doc_id do not
remove each other's bytes, since no id is smaller; a null doc_id counts as
larger than all others; an empty table gives no rows; very long texts are
blocks of their own. Results are exact: hashes only choose what is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .suffix_sort import least_of_repeats
from .workspace import Workspace, input_bytes

LENGTH, GRAM = 50, 24
#: Bytes of text in a block, and text for which one bucket is meant.
BLOCK, BUCKET = 2 << 20, 20 << 20
NONE = 2**63 - 1
_BLOCKS = "block bigint, ids binary, lens binary, data binary"


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _large(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _rows(batch) -> Iterator[dict]:  # noqa: ANN001
    """Rows one at a time: each holds a block."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents by the block: ids, lengths and texts one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            values = (np.array(ids, dtype=np.int64).tobytes(), np.array([len(t) for t in texts], dtype=np.int64).tobytes(), _small(b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([number], type=pa.int64()), *(pa.array([v], type=pa.binary()) for v in values)], ["block", "ids", "lens", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(NONE if i is None else i)
                texts.append(t.as_py() or b"")
                held += len(texts[-1])
                if held >= BLOCK:
                    yield full()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield full()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, _BLOCKS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Segments:
    """The segments of a block: document, first place, number of strings, and the key of the anchor."""

    def __init__(self, lens: np.ndarray, data: bytes):
        raw = np.frombuffer(data, dtype=np.uint8)
        n = len(raw)
        starts = np.cumsum(lens) - lens
        self.starts = starts
        if n < LENGTH:
            self.key = np.zeros(0, dtype=np.uint64)
            self.doc = self.first = self.count = np.zeros(0, dtype=np.int64)
            return
        base = 0x100000001B3
        power = lambda k: np.uint64(pow(base, k, 1 << 64))
        h = raw.astype(np.uint64) + np.uint64(1)
        for k in (1, 2, 4):
            h = h[:-k] * power(k) + h[k:]
        tail = h[16 : 16 + n - GRAM + 1].copy()  # eight bytes from the 17th on
        h = h[:-8] * power(8) + h[8:]
        h = _mixed(h[: n - GRAM + 1] * power(8) + tail)
        del tail
        # Least hash of each window of grams, by doubling.
        window, wide = LENGTH - GRAM + 1, 1
        low = h
        while 2 * wide <= window:
            low = np.minimum(low[: len(low) - wide], low[wide:])
            wide *= 2
        low = np.minimum(low[: len(h) - window + 1], low[window - wide : window - wide + len(h) - window + 1])
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[: len(low)]
        inside = np.arange(LENGTH, len(low) + LENGTH, dtype=np.int64) <= (starts + lens)[doc]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        # Strings inside a document are consecutive, so a run ends where the next begins or its document does.
        head = np.flatnonzero(inside & new)
        self.first = head
        self.doc = doc[head].astype(np.int64)
        if len(head):
            upto = np.append(head[1:], n)
            last = (starts + lens)[self.doc] - LENGTH
            self.count = np.minimum(upto - 1, last) - head + 1
        else:
            self.count = head
        self.key = _mixed(low[head] + np.uint64(1))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Different keys in order, and whether each one is in more than one document of the block."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        more = np.logical_or.reduceat(np.concatenate([[False], (doc[1:] != doc[:-1]) & (key[1:] == key[:-1])]), head) if len(key) else np.zeros(0, dtype=bool)
        return key[head], more


def _read(ids: bytes, lens: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(lens, dtype=np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """48 bits of each key: a chance match only adds a comparison."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _bucketed(keys: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket that has keys, with their places in the order of the keys."""
    if not len(keys):
        return []
    bucket = ((keys >> np.uint64(16)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    return list(zip(bucket[order[np.concatenate([[0], edge])]].tolist(), np.split(order, edge), strict=True))


def _anchors(blocks: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                keys, more = Segments(_read(r["ids"], r["lens"])[1], _large(r["data"])).anchors()
                parts = _bucketed(keys, n)
                columns = [pa.array([k for k, _ in parts], type=pa.int32()), pa.array([r["block"]] * len(parts), type=pa.int64()), pa.array([_packed(keys[p]) for _, p in parts], type=pa.binary()), pa.array([np.packbits(more[p]).tobytes() for _, p in parts], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "more"])

    return blocks.mapInArrow(run, "bucket int, block bigint, keys binary, more binary")


def _shared(anchors: DataFrame) -> DataFrame:
    """For each block and bucket a bit for each anchor: whether another document has it."""

    def run(table):
        each = []
        for keys in table.column("keys"):
            raw = np.zeros((len(keys.as_buffer()) // 6, 8), dtype=np.uint8)
            raw[:, :6] = np.frombuffer(keys.as_buffer(), dtype=np.uint8).reshape(-1, 6)
            each.append(raw.view(np.uint64)[:, 0])
        more = [np.unpackbits(np.frombuffer(m.as_buffer(), dtype=np.uint8), count=len(k)).astype(bool) for m, k in zip(table.column("more"), each, strict=True)]
        every, back = np.unique(np.concatenate(each), return_inverse=True)
        hits = np.bincount(back, minlength=len(every)) > 1
        hits |= np.bincount(back, weights=np.concatenate(more), minlength=len(every)) > 0
        answer = np.split(hits[back], np.cumsum([len(k) for k in each])[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "mask": pa.array([np.packbits(a).tobytes() for a in answer], type=pa.binary())})

    return anchors.groupBy("bucket").applyInArrow(run, "block bigint, bucket int, mask binary")


_PARTS = "kind int, block bigint, bucket int, ids binary, lens binary, data binary"


def _parts(blocks: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """By kind: 0, digests of documents without a candidate; 1, blocks of the others; 2, segments for a bucket."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in names[3:])])

    def run(left, right):
        rows = []
        masks = {b: m for b, m in zip(right.column("bucket").to_pylist(), right.column("mask").to_pylist(), strict=True)}
        for r in _rows(left.combine_chunks()):
            ids, lens = _read(r["ids"], r["lens"])
            data = _large(r["data"])
            seg = Segments(lens, data)
            keys, _ = seg.anchors()
            hit = np.zeros(len(keys), dtype=bool)
            for k, p in _bucketed(keys, n):
                if k in masks:
                    hit[p] = np.unpackbits(np.frombuffer(masks[k], dtype=np.uint8), count=len(p)).astype(bool)
            mine = np.flatnonzero(hit[np.searchsorted(keys, seg.key)]) if len(keys) else np.zeros(0, dtype=np.int64)
            touched = np.zeros(len(ids), dtype=bool)
            touched[seg.doc[mine]] = True
            starts = seg.starts
            done = np.flatnonzero(~touched)
            if len(done):
                digests = b"".join(hashlib.sha256(data[starts[d] : starts[d] + lens[d]]).digest() for d in done.tolist())
                rows.append((0, r["block"], -1, ids[done].tobytes(), lens[done].tobytes(), digests))
            rest = np.flatnonzero(touched)
            if len(rest):
                body = b"".join(data[starts[d] : starts[d] + lens[d]] for d in rest.tolist())
                rows.append((1, r["block"], -1, ids[rest].tobytes(), lens[rest].tobytes(), _small(body)))
            renumbered = np.cumsum(touched) - 1
            for bucket, p in _bucketed(seg.key[mine], n):
                part = mine[p]
                number: dict[bytes, int] = {}
                owner: list[int] = []
                keys_of: list[int] = []
                which = np.empty(len(part), dtype=np.int32)
                for k, (d, f, c, key) in enumerate(zip(seg.doc[part].tolist(), seg.first[part].tolist(), seg.count[part].tolist(), seg.key[part].tolist(), strict=True)):
                    s = data[f : f + c + LENGTH - 1]
                    at = number.setdefault(s, len(owner))
                    if at == len(owner):
                        owner.append(d)
                        keys_of.append(key)
                    elif ids[d] < ids[owner[at]]:
                        owner[at] = d
                    which[k] = at
                there, doc = np.unique(seg.doc[part], return_inverse=True)
                numbers = [np.array([len(number), len(part), len(there)]), np.array([len(s) for s in number]), np.array(keys_of, dtype=np.uint64).astype(np.uint32).view(np.int32), np.searchsorted(there, owner), which, doc, seg.first[part] - starts[seg.doc[part]], renumbered[there]]
                packed = np.concatenate([x.astype(np.int32) for x in numbers]).tobytes()
                rows.append((2, r["block"], bucket, ids[there].tobytes(), _small(packed), _small(b"".join(number))))
        return pa.Table.from_pydict({c: [row[k] for row in rows] for k, c in enumerate(names)}, schema=schema)

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, _PARTS)


def _removed(parts: DataFrame) -> DataFrame:
    """For each block the runs of places whose strings an earlier document holds: (document, first place, places).

    A bucket is read in batches: of equal segments, however many blocks have them, one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[bytes, int] = {}
        owner: list[int] = []
        keys: list[int] = []
        local: list[tuple[np.ndarray, ...]] = []
        blocks: list[int] = []
        for r in (r for b in batches for r in _rows(b)):
            blocks.append(r["block"])
            ids, x = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(_large(r["lens"]), dtype=np.int32)
            m, k, t = x[:3].tolist()
            lens, key, by, which, doc, first, number = np.split(x[3:], np.cumsum([m, m, m, k, k, k]))
            data, at, to = _large(r["data"]), 0, []
            for o, length, name in zip(ids[by].tolist(), lens.tolist(), key.tolist(), strict=True):
                s = data[at : at + length]
                at += length
                k = merged.setdefault(s, len(owner))
                if k == len(owner):
                    owner.append(o)
                    keys.append(name)
                elif o < owner[k]:
                    owner[k] = o
                to.append(k)
            local.append((np.array(to, dtype=np.int64)[which], number[doc].astype(np.int64), first.astype(np.int64), ids[doc]))
        own = np.array(owner, dtype=np.int64)
        size = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
        # Segments that stand alone under their anchor have nothing to be compared with.
        _, back, count = np.unique(np.array(keys, dtype=np.int32), return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[back] > 1)
        strings = list(merged)
        least, begin = least_of_repeats([strings[k] for k in several.tolist()], own[several], LENGTH)
        start = np.full(len(strings), -1, dtype=np.int64)
        start[several] = begin
        del strings, merged
        out: list[bytes] = []
        for n, (seg, doc, first, ids) in enumerate(local, 1):
            whole = own[seg] < ids
            runs = [np.stack([doc[whole], first[whole], size[seg[whole]] - LENGTH + 1])]
            for k in np.flatnonzero(~whole & (start[seg] >= 0)).tolist():
                a = start[seg[k]]
                gone = least[a : a + size[seg[k]] - LENGTH + 1] < ids[k]
                if gone.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    runs.append(np.stack([np.full(len(edge) // 2, doc[k]), first[k] + edge[::2], edge[1::2] - edge[::2]]))
            out.append(_small(np.concatenate(runs, axis=1).astype(np.int64).tobytes()))
            if n == len(local) or len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(blocks[n - len(out) : n], type=pa.int64()), pa.array(out, type=pa.binary())], ["block", "runs"])
                out = []

    return parts.where("kind = 2").select("bucket", "block", "ids", "lens", "data").groupBy("bucket").applyInArrow(run, "block bigint, runs binary")


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(parts: DataFrame, removed: DataFrame, with_kept: bool) -> DataFrame:
    """One row for each document that had candidates."""

    def run(left, right):
        runs = [np.frombuffer(_large(r.as_py()), dtype=np.int64).reshape(3, -1) for r in right.column("runs")]
        rows = []
        for r in left.select(["ids", "lens", "data"]).to_pylist():
            ids, lens = _read(r["ids"], r["lens"])
            doc, first, places = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), dtype=np.int64)
            begin = np.concatenate([[0], np.cumsum(lens)])
            raw = np.frombuffer(_large(r["data"]), dtype=np.uint8)
            edges = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(edges, begin[doc] + first, 1)
            np.add.at(edges, begin[doc] + first + places + LENGTH - 1, -1)
            gone = np.cumsum(edges[:-1]) > 0
            for d, (i, n) in enumerate(zip(ids.tolist(), lens.tolist(), strict=True)):
                g, body = gone[begin[d] : begin[d] + n], raw[begin[d] : begin[d] + n]
                kept = body[~g].tobytes()
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (n > 0 and bool(g[0])))
                rows.append((None if i == NONE else i, n, int(np.count_nonzero(g)), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = [c.split()[0] for c in _OUT.split(", ")]
        return pa.table([pa.array([x[k] for x in rows], type=kind) for k, kind in enumerate(kinds)], names=names)

    return parts.where("kind = 1").groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(run, _OUT)


def _untouched(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, lens = _read(r["ids"], r["lens"])
                digests = [r["data"][k : k + 32].hex() for k in range(0, len(r["data"]), 32)]
                doc = pa.array([None if i == NONE else i for i in ids.tolist()], type=pa.int64())
                zero = pa.array(np.zeros(len(ids), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([doc, pa.array(lens), zero, zero, pa.array(digests, type=pa.string()), pa.nulls(len(ids), pa.binary())], [c.split()[0] for c in _OUT.split(", ")])

    return parts.where("kind = 0").select("ids", "lens", "data").mapInArrow(run, _OUT)


def repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """For each document ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    ``with_kept`` adds the remaining bytes, ``kept``, of documents that had a candidate for
    removal; for the others it is null, and their text stays as it is.
    """
    space = Workspace(docs.sparkSession)
    n = max(24, -(-input_bytes(docs) // BUCKET))
    blocks = space.save(_blocks(docs), "blocks", grouped=True)
    shared = space.save(_shared(_anchors(blocks, n)), "shared", grouped=True)
    parts = space.save(_parts(blocks, shared, n), "parts", by=["kind"], grouped=True)
    space.drop("blocks", "shared")
    removed = space.save(_removed(parts), "removed", grouped=True)
    out = _untouched(parts).unionByName(_cut(parts, removed, with_kept))
    return out if with_kept else out.drop("kept")
