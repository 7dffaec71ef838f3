"""External induced sorting of all suffixes of a text, with common-prefix values.

The suffixes that begin a descent-to-ascent ("leftmost S") are ordered first, by
tuples of seven symbols down to ``DEPTH`` symbols. All others are induced: the
suffixes are scanned in order, and each one tells its left neighbour's place.
What is induced waits in a monotone priority queue with a run of blocks for each
leading symbol; the queue keeps within its memory and moves its largest runs to
an unlinked temporary file. A symbol's run is handled as one vector, and what
falls into the same run again forms the next vector, so the loop is over
symbols and repeats, not over suffixes.

Each entry carries its common prefix with its predecessor: that of two induced
neighbours is one more than the least value between the suffixes that induced
them, a range minimum over the scanned block.

Order and values are exact to ``DEPTH`` symbols, which is what callers compare;
ties beyond are in no particular order. This is why the first step may stop at
``DEPTH`` instead of recursing on a shortened text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

DEPTH, PACK, BITS = 56, 7, 9
#: Symbols: 0 ends the text, 1 parts strings, then the bytes.
END, PART, FIRST, SYMBOLS = 0, 1, 2, 258
#: Bytes that a queue holds in memory, and from which an array is kept in a file.
QUEUE_BYTES, ARRAY_BYTES = 32 << 20, 16 << 20


def array(n: int, dtype) -> np.ndarray:  # noqa: ANN001
    """Zeros in memory or, where large, in a temporary file that vanishes with the array."""
    if n * np.dtype(dtype).itemsize <= ARRAY_BYTES:
        return np.zeros(n, dtype=dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype=dtype, mode="r+", shape=(n,))


class Queue:
    """Blocks of (place, common prefix) for each symbol, first in first out, spilled beyond ``limit`` bytes."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.blocks: list[list] = [[] for _ in range(SYMBOLS)]
        self.held, self.size, self.limit, self.file = 0, [0] * SYMBOLS, limit, None

    def push(self, symbol: int, place: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((place, lcp))
        n = place.nbytes + lcp.nbytes
        self.held += n
        self.size[symbol] += n
        while self.held > self.limit:
            most = max(range(SYMBOLS), key=self.size.__getitem__)
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for k, b in enumerate(self.blocks[most]):
                if len(b) == 2:
                    at = self.file.seek(0, 2)
                    self.file.write(b[0].tobytes() + b[1].tobytes())
                    self.blocks[most][k] = (at, len(b[0]), b[0].dtype)
            self.held -= self.size[most]
            self.size[most] = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Everything that waits under ``symbol``, in order."""
        waiting, self.blocks[symbol] = self.blocks[symbol], []
        self.held -= self.size[symbol]
        self.size[symbol] = 0
        if not waiting:
            return None
        for k, b in enumerate(waiting):
            if len(b) == 3:
                self.file.seek(b[0])
                waiting[k] = (np.frombuffer(self.file.read(b[1] * b[2].itemsize), dtype=b[2]), np.frombuffer(self.file.read(b[1]), dtype=np.uint8))
        return np.concatenate([p for p, _ in waiting]), np.concatenate([c for _, c in waiting])


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as one text of symbols, each followed by a ``PART``, and where each begins."""
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = array(int(starts[-1]) + 1, np.uint16)
    raw = np.frombuffer(b"\0".join([*strings, b""]), dtype=np.uint8)
    text[:-1] = raw
    text[:-1] += FIRST
    text[starts[1:] - 1] = PART
    text[-1] = END
    return text, starts[:-1]


def _kinds(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (type S)."""
    n = len(text)
    rise = np.empty(n, dtype=bool)
    rise[:-1] = text[:-1] < text[1:]
    same = np.empty(n, dtype=bool)
    same[:-1] = text[:-1] == text[1:]
    rise[-1], same[-1] = True, False
    # Within a run of equal symbols the type is that of its last one.
    nxt = np.where(same, n, np.arange(n, dtype=np.int32 if n < 2**31 else np.int64))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return rise[nxt]


def _words(text: np.ndarray) -> np.ndarray:
    """Seven symbols from each place, as one number."""
    n = len(text)
    w = array(n + DEPTH, np.uint64)
    for k in range(PACK):
        w[: max(0, n - k)] |= text[k:].astype(np.uint64) << np.uint64(BITS * (PACK - 1 - k))
    return w


def _seeds(text: np.ndarray, s_type: np.ndarray, place_type) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The leftmost S suffixes in order to ``DEPTH`` symbols, with their common prefixes."""
    first = s_type.copy()
    first[0] = False
    first[1:] &= ~s_type[:-1]
    pos = np.flatnonzero(first).astype(place_type)
    words = _words(text)
    pos = pos[np.argsort(words[pos], kind="stable")]
    lcp = np.zeros(len(pos), dtype=np.uint8)
    tied = np.zeros(len(pos), dtype=bool)  # with the one before it, so far

    def differ(k: int, where: np.ndarray) -> None:
        """Sets prefix values of neighbours at ``where`` by their k-th words."""
        x = words[pos[where] + PACK * k] ^ words[pos[where - 1] + PACK * k]
        lead = np.zeros(len(where), dtype=np.uint8)
        for j in range(1, PACK):
            lead += (x >> np.uint64(BITS * (PACK - j))) == 0
        lead[x == 0] = PACK
        lcp[where] = PACK * k + lead
        tied[where] = x == 0

    if len(pos) > 1:
        differ(0, np.arange(1, len(pos)))
    for k in range(1, DEPTH // PACK):
        if not tied.any():
            break
        group = np.cumsum(~tied)
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        order = np.lexsort((words[pos[at] + PACK * k], group[at]))
        pos[at] = pos[at[order]]
        differ(k, np.flatnonzero(tied))
    return pos, lcp


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``values[lo..hi]``, ends included, for each pair; by a sparse table."""
    out = np.empty(len(lo), dtype=np.uint8)
    width = hi - lo + 1
    level, table = 0, values
    rest = np.arange(len(lo))
    while len(rest):
        fits = width[rest] < (2 << level)
        i = rest[fits]
        out[i] = np.minimum(table[lo[i]], table[hi[i] - (1 << level) + 1])
        rest = rest[~fits]
        if len(rest):
            table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
            level += 1
    return out


class _Scan:
    """One direction of the induction: hands what it scans to the queue of the left neighbours."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray, want: bool, limit: int):
        self.text, self.s_type, self.want, self.queue = text, s_type, want, Queue(limit)
        self.since = np.zeros(SYMBOLS, dtype=np.uint8)
        self.begun = np.zeros(SYMBOLS, dtype=bool)

    def __call__(self, block: np.ndarray, lcp: np.ndarray) -> None:
        left = block - 1
        at = np.flatnonzero((block > 0) & (self.s_type[left] == self.want))
        since = np.minimum(self.since, lcp.min())
        if len(at):
            symbol = self.text[left[at]]
            order = np.argsort(symbol, kind="stable")
            at, symbol = at[order], symbol[order]
            head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            lo = np.concatenate([[0], at[:-1] + 1])
            lo[head] = 0
            low = _range_min(lcp, lo, at)
            names = symbol[head]
            low[head] = np.minimum(low[head], self.since[names])
            value = np.minimum(low.astype(np.int16) + 1, DEPTH).astype(np.uint8)
            value[head[~self.begun[names]]] = 0
            self.begun[names] = True
            ends = np.append(head[1:], len(at))
            place = left[at]
            for name, a, b in zip(names.tolist(), head.tolist(), ends.tolist(), strict=True):
                self.queue.push(name, place[a:b], value[a:b])
            last = at[ends - 1]
            more = last + 1 < len(lcp)
            since[names] = DEPTH
            if more.any():
                since[names[more]] = _range_min(lcp, last[more] + 1, np.full(int(more.sum()), len(lcp) - 1))
        self.since = since


def _common(text: np.ndarray, a: int, b: int) -> int:
    """Common prefix of two suffixes, to ``DEPTH`` symbols."""
    n = min(DEPTH, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def descending(text: np.ndarray, limit: int = QUEUE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last one, from the largest down, in blocks: (places, common prefix with the one before)."""
    place_type = np.int32 if len(text) < 2**31 - 2 * DEPTH else np.int64
    s_type = _kinds(text)
    seeds, seed_lcp = _seeds(text, s_type, place_type)
    starts = np.searchsorted(text[seeds], np.arange(SYMBOLS + 1))
    scan, large = _Scan(text, s_type, False, limit), Queue(limit)
    for c in range(SYMBOLS):
        last = None
        while found := scan.queue.pop(c):
            large.push(c, *found)
            last = found[0][-1]
            scan(*found)
        a, b = starts[c], starts[c + 1]
        if a < b:
            lcp = seed_lcp[a:b].copy()
            lcp[0] = 0 if last is None else _common(text, int(last), int(seeds[a]))
            scan(seeds[a:b], lcp)
    scan = _Scan(text, s_type, True, limit)
    for c in range(SYMBOLS - 1, -1, -1):
        last = None
        while found := scan.queue.pop(c):
            yield found
            last = found[0][-1]
            scan(*found)
        if found := large.pop(c):
            block = found[0][::-1]
            seam = 0 if last is None else _common(text, int(last), int(block[0]))
            lcp = np.concatenate([[seam], found[1][:0:-1]]).astype(np.uint8)
            yield block, lcp
            scan(block, lcp)


def least_of_repeats(strings: list[bytes], owner: np.ndarray, length: int, limit: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the joined strings the least owner of a string that holds the same ``length`` bytes.

    Returns that array, and where each string begins in it; only places with ``length`` bytes
    of their string ahead have a meaning.
    """
    text, starts = joined(strings)
    group, least = array(len(text), np.int64), []
    n = 0
    for place, lcp in descending(text, limit):
        new = lcp < length
        own = owner[np.searchsorted(starts, place, side="right") - 1]
        g = n - 1 + np.cumsum(new)
        group[place] = g
        heads = np.flatnonzero(new)
        if not len(heads) or heads[0] > 0:  # the block goes on with the last group
            end = heads[0] if len(heads) else len(place)
            least[-1][-1] = min(least[-1][-1], own[:end].min())
        if len(heads):
            least.append(np.minimum.reduceat(own, heads))
            n += len(heads)
    table = np.concatenate(least) if least else np.zeros(0, dtype=np.int64)
    for at in range(0, len(group) - 1, 1 << 20):
        part = slice(at, min(at + (1 << 20), len(group) - 1))
        group[part] = table[group[part]]
    return group, starts
