"""Benchmark decontamination by pigeonhole edit matching.

Text is compared as its letters and digits, lower case, words parted by one
space. Each test item is covered by units: the whole item if it is shorter than
``WHOLE`` characters, and in any case stretches of ``SHORT`` characters so dense
that every passage of ``SHORT + STEP - 1`` characters (59) of an item holds one
of them whole. A unit with an error budget of k edits is split into k + 1
pieces: wherever a text holds the unit with at most k edits, one piece at least
stands there unchanged. One automaton finds all pieces of all units in one pass
over a text; around each hit Myers' bit-parallel recurrence decides, exactly,
whether the unit is within its budget.

An item of fewer than ``LEAST`` characters, but at least ``FEW`` words, is
searched for without an edit, on word bounds; one of fewer words is no evidence,
since ordinary text holds it.

The test items are a stated query set; they are handed out in blocks of bounded
size, and each block is held against all rows in one pass without a shuffle.

Defined results: null and empty texts, and null items, match nothing; equal rows
get equal results, and rows that repeat an item_id count as one item; an empty
table on either side gives no matches; other columns may have any name. A long
text costs its length, and the windows around hits are merged before they are
verified.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

LEAST, FEW, WHOLE = 40, 3, 150
#: Short units start at every STEP characters. Their pieces are STEP long as well, so that neighbours share them.
SHORT, STEP = 50, 10
#: One edit is allowed for so many characters.
CHARS_PER_EDIT = 12
GRAM = 5
#: Characters of test items in a block. A worker holds about 1.2 KB for each, so some 250 MB; every block is one scan of the documents.
BLOCK = 200_000
_WORD = re.compile(r"[^\W_]+")
_PLAIN = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def normal(text: str) -> str:
    if text.isascii():
        return " ".join(text.translate(_PLAIN).split())
    return " ".join(_WORD.findall(text.lower()))


def budget(unit: str) -> int:
    return len(unit) // CHARS_PER_EDIT


def units(item: str) -> list[tuple[int, str, int]]:
    """Stretches of a normalised item that are searched for: (place, stretch, edits that it may have)."""
    if len(item) < LEAST:
        return [(0, f" {item} ", 0)] if item.count(" ") + 1 >= FEW else []
    found = {item: 0} if len(item) < WHOLE else {}
    if len(item) >= SHORT:
        for k in (*range(0, len(item) - SHORT, STEP), len(item) - SHORT):
            found.setdefault(item[k : k + SHORT], k)
    return [(at, u, budget(u)) for u, at in found.items()]


def grams(unit: str, k: int) -> tuple[list[str], int]:
    """The unit's stretches of ``GRAM`` characters, and how many of them survive ``k`` edits.

    An edit touches ``GRAM`` of them at most, so that a text with fewer can't hold the unit.
    """
    all_ = [unit[x : x + GRAM] for x in range(len(unit) - GRAM + 1)]
    return all_, len(all_) - GRAM * k


def pieces(unit: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces with their places."""
    n = k + 1
    cuts = [len(unit) * k // n for k in range(n + 1)]
    return [(a, unit[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(unit: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Myers: the fewest edits that turn ``unit`` into a stretch of ``text``, and where the first such stretch ends."""
    m = len(unit)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (full & ~(xh | vp))
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        vp = hn | (full & ~(xv | hp))
        vn = hp & xv
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """The units of a block of items, with an automaton over their pieces.

    Units of an item overlap and share pieces. What is around a piece in an item is
    kept once for all units that have the piece there: if the text around a hit shares
    too little with it, none of them is there.
    """

    def __init__(self, items: list[tuple[object, str]]):
        import ahocorasick

        self.units: list[tuple[object, str, dict[str, int], int]] = []
        self.grams: list[tuple[list[str], int]] = []
        owners: dict[str, dict[tuple[object, int], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            for place, u, k in units(normal(text)):
                masks: dict[str, int] = defaultdict(int)
                for x, c in enumerate(u):
                    masks[c] |= 1 << x
                for at, p in pieces(u, k):
                    owners[p][item_id, place + at].append((len(self.units), at))
                self.units.append((item_id, u, dict(masks), k))
                self.grams.append(grams(u, k))
        self.automaton = ahocorasick.Automaton()
        for p, places in owners.items():
            self.automaton.add_word(p, (len(p), [self._around(p, own) for own in places.values()]))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def _around(self, piece: str, own: list[tuple[int, int]]) -> tuple:
        """(characters before the piece and after its begin that count, different stretches there, how many must be shared, units)."""
        before = max(at + self.units[u][3] for u, at in own)
        after = max(len(self.units[u][1]) - at + self.units[u][3] for u, at in own)
        need = min(len(set(self.grams[u][0])) - GRAM * self.units[u][3] for u, _ in own)
        return before, after, frozenset(g for u, _ in own for g in self.grams[u][0]), need, own

    @staticmethod
    def _shared(own: list[str], text: str) -> int:
        there = {text[k : k + GRAM] for k in range(len(text) - GRAM + 1)}
        return sum(map(there.__contains__, own))

    def __call__(self, text: str | None) -> dict[object, tuple[int, int, int]]:
        """For each item that is found: fewest edits of a unit, units found, where (normalised) the best one ends."""
        if self.empty or not text:
            return {}
        t = f" {normal(text)} "
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(t):
            s = end + 1 - size
            for before, after, around, need, own in places:
                # Most hits are chance: what shares too few stretches is dropped before it is measured.
                if len(around.intersection([t[k : k + GRAM] for k in range(max(0, s - before), s + after - GRAM + 1)])) >= need:
                    for u, at in own:
                        starts[u].add(s - at)
        found: dict[object, tuple[int, int, int]] = {}
        for u, at in starts.items():
            item_id, unit, masks, k = self.units[u]
            runs: list[list[int]] = []
            for s in sorted(at):
                lo, hi = max(0, s - k), s + len(unit) + k
                if runs and lo <= runs[-1][1] - len(unit):
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
            own, need = self.grams[u]
            runs = [r for r in runs if self._shared(own, t[r[0] : r[1]]) >= need]
            if not runs:
                continue
            best = min(((*distance(unit, masks, t[lo:hi]), lo) for lo, hi in runs), key=lambda x: (x[0], x[2]))
            if best[0] <= k:
                edits, n, where = found.get(item_id, (k + 1, 0, 0))
                found[item_id] = (best[0], n + 1, best[2] + best[1]) if not n or best[0] < edits else (edits, n + 1, where)
        return found


def _blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``size`` characters; one block at a time is on the driver."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(``doc_id``, ``item_id``, ``n_edits``, ``n_units``, ``n_item_units``) for each item that a text holds, in whole or in part."""
    doc, item = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc}, item_id {item}, n_edits bigint, n_units bigint, n_item_units bigint"
    kinds = (to_arrow_type(benchmark.schema["item_id"].dataType), pa.int64(), pa.int64(), pa.int64())
    source, out = docs.select("doc_id", "text"), None
    for block in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            total: dict[object, int] = defaultdict(int)
            for item_id, *_ in matcher.units:
                total[item_id] += 1
            for b in batches:
                row, rest = [], []
                for k, x in enumerate(b.column(1)):
                    for item_id, (edits, n, _) in matcher(x.as_py()).items():
                        row.append(k)
                        rest.append((item_id, edits, n, total[item_id]))
                columns = [pa.array([r[j] for r in rest], type=kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, type=pa.int64())), *columns], ["doc_id", "item_id", "n_edits", "n_units", "n_item_units"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text holds nothing of any test item."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for b in batches:
                yield b.filter(pa.array([not matcher(x.as_py()) for x in b.column(at)], type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The matches with the edits as a share of what a unit may have, least first in each document."""
    return matches(docs, benchmark).withColumn("coverage", F.round(F.col("n_units") / F.col("n_item_units"), 4))
