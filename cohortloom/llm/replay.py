"""Quarantine and cascading release: when each turn of each conversation is delivered, and in which order.

Turns hang on earlier turns, so a conversation is a forest. A turn's delivery is
a piecewise function of its parent's: constant up to the turn's own arrival,
then a shift, with steps where another attempt is the first to succeed.

1. Turns are dealt by range over (conversation, turn) and numbered inside their
   slice; only starts of slices, and of the one conversation that may cross a
   slice's edge, are added afterwards. No task needs to hold a conversation.
2. Subtree sizes by doubling of ancestors: a logarithm of the depth in rounds of
   equality joins. Each turn's heavy child is the one with the largest subtree;
   heavy edges make paths, whose heads are found by doubling as well.
3. Each path carries a segment tree. A row holds up to ``LEAF`` turns or ``FAN``
   children, so that log2(``FAN``) levels of the tree are worked on in a task,
   bottom up by composing functions, top down by passing them what has come in.
   A path as long as a row needs no composed function.
4. Light edges top-down: paths that hang on a path of the round before get its
   deliveries. Above any turn lie at most log2(n) light edges. All prefixes of
   all paths of a round are evaluated at once.
5. Deliveries are dealt by range over (conversation, time, turn) and numbered
   with running sums in the same way as in step 1.

Functions compose without growing out of hand: times are whole seconds, and
outside the time from the first arrival of a segment to ``REPAIRED`` after its
last one a composed function is constant or a shift, so it has at most as many
pieces as that time has seconds; in practice a few.

Defined results: a null conv_id is a conversation of its own; a null turn comes
last; both are written ``null`` where they are hashed; a null text is empty;
rows that repeat a turn are numbered one after another, ordered by the crc32 of
their text; sums beyond 63 bits wrap around; an empty table gives an empty
result; columns other than these three aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace

#: Turns, and functions, that a row of the segment tree holds.
LEAF, FAN = 32, 32
#: Seconds between arrivals, parents' distances, limits of faults and repairs, seconds from the first to each attempt.
EVERY, BACK, FAULTY, OF, REPAIRED = 7, 5, 50, 101, 100
AFTER = np.array([0, 20, 60, 140, 300, 620])
#: In place of a delivery: nothing to wait for; never.
FREE, NEVER = -1, -2
_ALL = (1 << len(AFTER)) - 1

Pieces = list[tuple[int, int, int]]


def piece(arrival: int, repaired: int, ok: int) -> Pieces:
    """A turn's delivery as pieces (from, slope, shift) over its parent's delivery, or over ``FREE``.

    Attempt ``a`` delivers if it doesn't come before ``repaired`` and bit ``a`` of ``ok`` is set.
    """
    starts = sorted({arrival, *(int(repaired - AFTER[a]) for a in range(len(AFTER)) if ok >> a & 1 and repaired - AFTER[a] > arrival)})
    out = []
    for s in starts:
        a = next((a for a in range(len(AFTER)) if ok >> a & 1 and s + AFTER[a] >= repaired), None)
        out.append((s, 0, NEVER) if a is None else (s, 1, int(AFTER[a])))
    at, slope, shift = out[0]
    return [(FREE, 0, slope * at + shift), *out]


def value(f: Pieces, x: int) -> int:
    """The delivery that ``f`` gives for ``x``."""
    if x == NEVER:
        return NEVER
    _, slope, shift = next(p for p in reversed(f) if p[0] <= x)
    return slope * x + shift


def composed(f: Pieces, g: Pieces) -> Pieces:
    """First ``f``, then ``g``."""
    out: Pieces = []
    for k, (at, slope, shift) in enumerate(f):
        end = f[k + 1][0] if k + 1 < len(f) else None
        if not slope:
            parts = [(at, 0, value(g, shift))]
        else:
            parts = []
            for n, (low, own, more) in enumerate(g):
                high = g[n + 1][0] if n + 1 < len(g) else None
                start = max(at, low - shift)
                if (end is None or start < end) and (high is None or start < high - shift):
                    parts.append((start, own, more + own * shift))
        for p in parts:
            if not out or out[-1][1:] != p[1:]:
                out.append(p)
    return out


def folded(parts: list[Pieces]) -> Pieces:
    """The composition of all, by halves."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return composed(folded(parts[:half]), folded(parts[half:]))


def _long(*words: int | Column) -> Column:
    return F.crc32(F.concat_ws(":", *[F.lit(str(w)) if isinstance(w, int) else F.coalesce(w.cast("string"), F.lit("null")) for w in words]))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows (``conv_id``, ..., ``w``), sorted within their slice, their place there, their number in the slice's part of
    the conversation from 1, and the running sums of ``w`` and of number times ``w``, both modulo 2**64."""
    place, last, n, total, weighted = 0, object(), 0, np.uint64(0), np.uint64(0)
    for b in batches:
        m = b.num_rows
        if not m:
            continue
        conv = b.column(0).to_pylist()
        same = np.fromiter((y == x for x, y in zip([last, *conv], conv, strict=False)), dtype=bool, count=m)
        w = b.column(b.num_columns - 1).to_numpy().astype(np.uint64)
        first = np.flatnonzero(~same)
        run = np.cumsum(~same)  # 0: goes on from the batch before
        start = np.concatenate([[0], first])[run]
        number = np.arange(m) - start + 1 + np.where(run == 0, n, 0)
        sums, sums_n = np.cumsum(w), np.cumsum(w * number.astype(np.uint64))
        before = np.where(start > 0, sums[start - 1], np.uint64(0))
        before_n = np.where(start > 0, sums_n[start - 1], np.uint64(0))
        c = sums - before + np.where(run == 0, total, np.uint64(0))
        cn = sums_n - before_n + np.where(run == 0, weighted, np.uint64(0))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place + np.arange(m)), pa.array(number), pa.array(c.view(np.int64)), pa.array(cn.view(np.int64))], [*b.schema.names, "place", "number", "sum", "weighted"])
        place, last, n, total, weighted = place + m, conv[-1], int(number[-1]), c[-1], cn[-1]


def _decimal(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _unsigned(name: str) -> Column:
    c = F.col(name).cast("decimal(38,0)")
    return F.when(c < 0, c + _decimal(1 << 64)).otherwise(c)


def _wrapped(c: Column) -> Column:
    rest = F.pmod(c.cast("decimal(38,0)"), _decimal(1 << 64))
    return F.when(rest >= _decimal(1 << 63), rest - _decimal(1 << 64)).otherwise(rest).cast("bigint")


def sequenced(rows: DataFrame, order: list[Column], weight: str, space: Workspace, name: str) -> DataFrame:
    """Adds ``at`` (a place over all rows, from 0), ``number`` (from 1 in each conv_id) and ``state``, the running
    sum of number times ``weight`` in the conversation, by an order in which conv_id comes first."""
    kept = [c for c in rows.columns if c != weight] + [weight]
    dealt = rows.select(kept).repartitionByRange(F.col("conv_id").asc_nulls_first(), *order).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    dealt = space.save(dealt.mapInArrow(_numbered, f"{kinds}, place bigint, number bigint, sum bigint, weighted bigint").withColumn("slice", F.spark_partition_id()), name, grouped=True)
    sizes = dealt.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.min_by("conv_id", "place").alias("first"), F.max_by("conv_id", "place").alias("final"))
    ends = dealt.groupBy("slice", "conv_id").agg(F.max("number").alias("n"), F.max_by("sum", "number").alias("sum"), F.max_by("weighted", "number").alias("weighted"))
    # One row a slice from here on. Only the conversation at a slice's upper edge may go on in the next one.
    edge = sizes.join(ends, (sizes["slice"] == ends["slice"]) & sizes["final"].eqNullSafe(ends["conv_id"])).select(sizes["slice"], "rows", "first", "final", "n", "sum", "weighted").collect()
    starts, goes_on, at = [], None, 0
    for r in sorted(edge, key=lambda r: r["slice"]):
        held = goes_on if goes_on and goes_on[0] == r["first"] else (r["first"], 0, 0)
        starts.append((r["slice"], at, *held))
        at += r["rows"]
        n, state = (held[1], held[2]) if r["first"] == r["final"] else (0, 0)
        goes_on = (r["final"], n + r["n"], (state + n * (r["sum"] % (1 << 64)) + r["weighted"]) % (1 << 64))
    kind = dict(rows.dtypes)["conv_id"]
    table = rows.sparkSession.createDataFrame([(a, b, c, d, str(e)) for a, b, c, d, e in starts], f"slice int, start bigint, held {kind}, n0 bigint, state0 string")
    out = dealt.join(F.broadcast(table), "slice").withColumn("state0", F.col("state0").cast("decimal(38,0)"))
    on = F.col("conv_id").eqNullSafe(F.col("held")) & (F.col("n0") > 0)
    state = F.when(on, _wrapped(F.col("state0") + F.col("n0").cast("decimal(18,0)") * _unsigned("sum").cast("decimal(20,0)") + _unsigned("weighted"))).otherwise(F.col("weighted"))
    number = F.when(on, F.col("n0") + F.col("number")).otherwise(F.col("number"))
    return out.select(*kept, (F.col("start") + F.col("place")).alias("at"), number.alias("number"), state.alias("state"))


def turns_of(conversations: DataFrame, space: Workspace) -> DataFrame:
    """(``v``, ``u``, ``conv_id``, ``turn``, ``crc``, ``arrival``, ``repaired``, ``ok``): each turn, its parent, and how its attempts go."""
    rows = conversations.select("conv_id", "turn", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    at = sequenced(rows, [F.col("turn").asc_nulls_last(), F.col("crc").asc()], "crc", space, "dealt")
    h = lambda k: _long(k, F.col("conv_id"), F.col("turn"))
    p, back, faulty = F.col("number") - 1, h(0) % BACK, h(1) % OF < FAULTY
    arrival = p * EVERY
    ok = F.lit(0)
    for a in range(len(AFTER)):
        ok = ok + F.when(h(a + 3) % 3 != 0, F.lit(1 << a)).otherwise(F.lit(0))
    parent = F.when((back > 0) & (back <= p), F.col("at") - back)
    made = at.select(
        F.col("at").alias("v"), parent.alias("u"), "conv_id", "turn", "crc", arrival.alias("arrival"),
        F.when(faulty, arrival + h(2) % OF).otherwise(F.lit(0)).cast("bigint").alias("repaired"), F.when(faulty, ok).otherwise(F.lit(_ALL)).cast("int").alias("ok"),
    )
    out = space.save(made, "turns")
    space.drop("dealt")
    return out


def heavy_paths(forest: DataFrame, space: Workspace) -> DataFrame:
    """(``v``, ``head``, ``k``): the heavy path that each node of a forest (``v``, parent ``u`` or null) lies on, and its place there from 0."""
    state, left = space.save_counted(forest.select("v", F.col("u").alias("a"), F.lit(1).cast("bigint").alias("s")), "sizes-0", F.count("a"))
    k = 0
    while left[1]:
        # ``s`` counts what hangs below a node at less than 2**k edges, ``a`` is its ancestor at 2**k.
        more = state.where("a is not null").groupBy("a").agg(F.sum("s").alias("more")).select(F.col("a").alias("v"), "more")
        up = state.where("a is not null").select(F.col("v").alias("a"), F.col("a").alias("b"))
        grown = state.join(more, "v", "left").join(up, "a", "left").select("v", F.col("b").alias("a"), (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"))
        k += 1
        state, left = space.save_counted(grown, f"sizes-{k}", F.count("a"))
        space.drop(f"sizes-{k - 1}")
    child = forest.where("u is not null").select("v", "u").join(state, "v")
    heavy = child.groupBy("u").agg(F.max(F.struct("s", (-F.col("v")).alias("v"))).alias("m")).select((-F.col("m.v")).alias("v"), F.col("u").alias("a"))
    path, left = space.save_counted(forest.select("v").join(heavy, "v", "left").select("v", F.coalesce("a", "v").alias("a"), F.when(F.col("a").isNull(), 0).otherwise(1).cast("bigint").alias("k")), "paths-0", F.sum("k"))
    space.drop(f"sizes-{k}")
    n = 0
    while left[1]:
        # ``a`` lies ``k`` edges above; it is the head once nothing lies above it on the path.
        above = path.where("k > 0").select(F.col("v").alias("a"), F.col("a").alias("b"), F.col("k").alias("more"))
        jumped = path.join(above, "a", "left").select("v", F.coalesce("b", "a").alias("a"), (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"), F.col("more").isNotNull().cast("int").alias("m"))
        n += 1
        path, left = space.save_counted(jumped, f"paths-{n}", F.sum("m"))
        space.drop(f"paths-{n - 1}")
    return path.select("v", F.col("a").alias("head"), "k")


def _ends(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy()).astype(np.int64)


def _evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (``x``, ``nodes``) to one row for each node: what is passed along a stretch of a path, turn by turn, for all rows at once."""
    for b in batches:
        length = _ends(b.column(1))
        start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
        nodes = b.column(1).flatten()
        _, v, arrival, repaired, ok = (nodes.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in range(5))
        first, last, tries, status = (np.zeros(len(v), dtype=np.int64) for _ in range(4))
        x = b.column(0).to_numpy().astype(np.int64)
        for j in range(length.max(initial=0)):
            rows = np.flatnonzero(length > j)
            at = start[rows] + j
            s = np.maximum(arrival[at], x[rows])
            t = s[:, None] + AFTER
            good = (t >= repaired[at][:, None]) & (ok[at][:, None] >> np.arange(len(AFTER)) & 1 > 0)
            some, a = good.any(1), good.argmax(1)
            blocked = x[rows] == NEVER
            a = np.where(some, a, len(AFTER) - 1)
            first[at], last[at], tries[at] = s, s + AFTER[a], np.where(blocked, 0, a + 1)
            status[at] = np.where(blocked, 2, np.where(some, 0, 1))
            x[rows] = np.where(status[at] == 0, last[at], NEVER)
        shown = status == 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(v), pa.array(status.astype(np.int32)), pa.array(tries.astype(np.int32)), pa.array(first, mask=shown), pa.array(last, mask=shown)],
            ["v", "status", "attempts", "first_at", "last_at"],
        )


_FUNCTION = "array<struct<at:bigint,slope:bigint,shift:bigint>>"


def _pieces(f: list[dict]) -> Pieces:
    return [(p["at"], p["slope"], p["shift"]) for p in f]


def _leaf_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [{"head": r["head"], "block": r["block"], "f": [dict(zip(("at", "slope", "shift"), p, strict=True)) for p in folded([piece(n["arrival"], n["repaired"], n["ok"]) for n in r["nodes"]])]} for r in b.to_pylist()]
        yield from _batches(out)


def _inner_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [{"head": r["head"], "block": r["block"], "f": [dict(zip(("at", "slope", "shift"), p, strict=True)) for p in folded([_pieces(c["f"]) for c in r["below"]])]} for r in b.to_pylist()]
        yield from _batches(out)


_F = pa.list_(pa.struct([("at", pa.int64()), ("slope", pa.int64()), ("shift", pa.int64())]))


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("head", pa.int64()), ("block", pa.int64()), ("f", _F)]))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What comes into each child, given what comes into its parent."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            x = r["x"]
            for c in r["below"]:
                out.append({"head": r["head"], "block": c["block"], "x": x})
                x = value(_pieces(c["f"]), x)
        yield pa.RecordBatch.from_pylist(out, pa.schema([("head", pa.int64()), ("block", pa.int64()), ("x", pa.int64())]))


def segment_trees(leaves: DataFrame, heads: DataFrame, longest: int, space: Workspace, leaf: int, fan: int) -> list[DataFrame]:
    """Rows (``head``, ``block``, ``below``) for each level above the leaves, lowest first; none if no path is longer than a leaf."""
    levels: list[DataFrame] = []
    if longest <= leaf:
        return levels
    size = leaf
    many = leaves.join(heads.where(F.col("long") > leaf).select("head"), "head", "left_semi")
    f = many.select("head", "block", "nodes").mapInArrow(_leaf_functions, f"head bigint, block bigint, f {_FUNCTION}")
    while size < longest:
        below = F.sort_array(F.collect_list(F.struct("block", "f"))).alias("below")  # at most ``fan`` of them
        rows = f.select("head", F.expr(f"block div {fan}").alias("up"), "block", "f").groupBy("head", "up").agg(below).withColumnRenamed("up", "block")
        levels.append(space.save(rows, f"level{len(levels)}", grouped=True))
        f = levels[-1].select("head", "block", "below").mapInArrow(_inner_functions, f"head bigint, block bigint, f {_FUNCTION}")
        size *= fan
    return levels


def deliveries(turns: DataFrame, space: Workspace, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(``v``, ``status`` 0 delivered, 1 dead, 2 blocked, ``attempts``, ``first_at``, ``last_at``) for turns with columns
    ``v``, ``u`` (parent), ``arrival``, ``repaired``, ``ok``."""
    paths = heavy_paths(turns.select("v", "u"), space)
    on = turns.join(paths, "v").withColumn("block", F.expr(f"k div {leaf}"))
    node = F.struct("k", "v", "arrival", "repaired", "ok")
    nodes = on.groupBy("head", "block").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.min(F.struct("k", "u"))["u"].alias("u"))
    leaves, (_, last) = space.save_counted(nodes, "leaves", F.max(F.element_at("nodes", -1)["k"]))
    longest = 1 + (last if last is not None else -1)
    long = leaves.groupBy("head").agg(F.sum(F.size("nodes")).alias("long"))
    heads = space.save(leaves.where("block = 0").select("head", "u").join(long, "head"), "heads")
    levels = segment_trees(leaves, heads, longest, space, leaf, fan)
    results, here, k = [], heads.where("u is null").select("head", "long", F.lit(FREE).cast("bigint").alias("x")), 0
    while True:
        here, (n, most) = space.save_counted(here, f"here{k}", F.max("long"))
        if k:
            space.drop(f"here{k - 1}")
        if not n:
            break
        # Paths that begin at this level of the tree, and children of the level above.
        entries = None
        for t in range(len(levels), 0, -1):
            size = leaf * fan ** (t - 1)
            if most <= size:
                continue
            own = here.where((F.col("long") > size) & (F.col("long") <= size * fan)).select("head", F.lit(0).cast("bigint").alias("block"), "x")
            rows = own if entries is None else own.unionByName(entries)
            entries = rows.join(levels[t - 1], ["head", "block"]).mapInArrow(_entries, "head bigint, block bigint, x bigint")
        own = here.where(F.col("long") <= leaf).select("head", F.lit(0).cast("bigint").alias("block"), "x")
        rows = own if entries is None else own.unionByName(entries)
        done = rows.join(leaves, ["head", "block"]).select("x", "nodes").mapInArrow(_evaluated, "v bigint, status int, attempts int, first_at bigint, last_at bigint")
        results.append(space.save(done, f"done{k}"))
        came = results[-1].select(F.col("v").alias("u"), F.when(F.col("status") == 0, F.col("last_at")).otherwise(F.lit(NEVER)).alias("x"))
        here, k = heads.join(came, "u").select("head", "long", "x"), k + 1
    out = results[0] if results else turns.select("v", *[F.lit(None).cast(t).alias(c) for c, t in (("status", "int"), ("attempts", "int"), ("first_at", "bigint"), ("last_at", "bigint"))])
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def replay(conversations: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(``conv_id``, ``turn``, ``status``, ``attempts``, ``first_at``, ``last_at``, ``release_no``, ``state``) for each row."""
    space = Workspace(conversations.sparkSession)
    turns = turns_of(conversations, space)
    done = turns.select("v", "conv_id", "turn", "crc").join(deliveries(turns, space, leaf, fan), "v")
    there = F.col("status") == 0
    rows = done.select("conv_id", F.when(there, F.col("last_at")).alias("at_last"), "turn", "v", "status", "attempts", "first_at", "last_at", "crc")
    order = [F.col("at_last").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("v").asc()]
    out = sequenced(rows, order, "crc", space, "released")
    named = F.when(there, "delivered").when(F.col("status") == 1, "dead").otherwise("blocked")
    return out.select("conv_id", "turn", named.alias("status"), "attempts", "first_at", "last_at", F.when(there, F.col("number")).alias("release_no"), F.when(there, F.col("state")).alias("state"))
