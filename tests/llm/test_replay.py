"""Deliveries and releases against a plain replay, attempt by attempt."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import replay
from cohortloom.llm.workspace import Workspace

KIND = "conv_id bigint, turn bigint, role string, text string"


def crc(s):
    return zlib.crc32(s.encode())


def word(x):
    return "null" if x is None else str(x)


def attempts(arrival, repaired, ok, parent):
    """(status, attempts, first, last) for a parent that gave ``parent``: a second, None (no parent) or "never"."""
    if parent == "never":
        return "blocked", 0, None, None
    t = first = arrival if parent is None else max(arrival, parent)
    for a in range(1, 7):
        if t >= repaired and ok[a - 1]:
            return "delivered", a, first, t
        last, t = t, t + 20 * 2 ** (a - 1)
    return "dead", 6, first, last


def plain(rows):
    of = defaultdict(list)
    for conv, turn, _, text in rows:
        of[conv].append((turn, crc(text or "")))
    out = []
    for conv, turns in of.items():
        turns.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        came, done = [], []
        for p, (turn, c) in enumerate(turns):
            h = lambda k: crc(f"{k}:{word(conv)}:{word(turn)}")  # noqa: B023, E731
            d = h(0) % 5
            parent = None if d == 0 or p - d < 0 else came[p - d]
            if h(1) % 101 < 50:
                got = attempts(7 * p, 7 * p + h(2) % 101, [h(a + 2) % 3 != 0 for a in range(1, 7)], parent)
            else:
                got = attempts(7 * p, 0, [True] * 6, parent)
            came.append(got[3] if got[0] == "delivered" else "never")
            done.append((got[3], turn, p, c, got))
        free = sorted((d for d in done if d[4][0] == "delivered"), key=lambda d: (d[0], d[1] is None, d[1] or 0, d[2]))
        state = 0
        for n, (_, turn, _, c, got) in enumerate(free, 1):
            state += n * c
            out.append((conv, turn, *got, n, state))
        out += [(conv, d[1], *d[4], None, None) for d in done if d[4][0] != "delivered"]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def talk(seed, convs, most):
    rng = random.Random(seed)
    return [(c, t * rng.choice([1, 1, 2]), "user", None if rng.random() < 0.05 else f"text {rng.random()}") for c in range(convs) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize(("leaf", "fan"), [(32, 32), (2, 3)])
def test_equals_plain_replay(spark, leaf, fan):
    rows = talk(leaf, 30, 60) + [(77, t, "user", str(t)) for t in range(600)]
    df = spark.createDataFrame(rows, KIND)
    assert got(replay.replay(df.repartition(7), leaf, fan)) == plain(rows)


def test_nulls_repeats_names_and_partitions(spark):
    rows = talk(5, 6, 12) + [(None, 1, None, "a"), (None, None, "user", None), (None, 2, None, ""), (3, None, None, "x"), (3, None, None, "y"), (4, 2, "u", "b"), (4, 2, "u", "b"), (4, 2, "u", "c"), (None, 2, None, "")]
    df = spark.createDataFrame(rows, KIND)
    want = plain(rows)
    for parts in (1, 17):
        assert got(replay.replay(df.repartition(parts))) == want
    clash = df.select("*", *[F.lit("mine").alias(n) for n in ("v", "u", "k", "head", "at", "slice", "state", "number", "crc", "status", "x")])
    assert got(replay.replay(clash)) == want
    assert replay.replay(df.limit(0)).collect() == []
    assert got(replay.replay(df.where("conv_id = 3 and turn is null and text = 'x'"))) == plain([(3, None, None, "x")])


def test_text_ids(spark):
    rows = [(f"c{c}", t, r, x) for c, t, r, x in talk(8, 5, 9)]
    assert got(replay.replay(spark.createDataFrame(rows, KIND.replace("conv_id bigint", "conv_id string")))) == plain(rows)


def test_sums_wrap_around(spark):
    batch = spark.range(5).selectExpr("cast(7 as bigint) conv_id", "id turn", "(1L << 62) w")
    space = Workspace(spark)
    out = replay.sequenced(batch.repartition(3), [F.col("turn").asc()], "w", space, "t").orderBy("turn").collect()
    sums = [sum(n << 62 for n in range(1, k + 2)) % (1 << 64) for k in range(5)]
    assert [r["state"] for r in out] == [s - (1 << 64) if s >= 1 << 63 else s for s in sums] and [r["number"] for r in out] == [1, 2, 3, 4, 5]


def forest():
    """A chain, a star, a comb, a binary tree and a random forest side by side; parents come before children."""
    rng = random.Random(6)
    shapes = [
        [(k, k - 1 if k else None) for k in range(300)],
        [(k, 0 if k else None) for k in range(200)],
        [(k, None if k == 0 else k - 2 if k % 2 and k > 1 else k - 1) for k in range(200)],
        [(k, (k - 1) // 2 if k else None) for k in range(255)],
        [(k, None if k == 0 or rng.random() < 0.02 else rng.randrange(max(0, k - 6), k)) for k in range(500)],
    ]
    return [(1000 * n + v, None if u is None else 1000 * n + u) for n, shape in enumerate(shapes) for v, u in shape]


def test_any_forest(spark):
    """Paths of all lengths, over several levels of the tree."""
    rng = random.Random(1)
    nodes, want, came = [], {}, {}
    for v, u in forest():
        arrival = 7 * (v % 1000)
        ok = [rng.random() < 0.8 for _ in range(6)]
        faulty = rng.random() < 0.5
        repaired = arrival + rng.randrange(101) if faulty else 0
        nodes.append((v, u, arrival, repaired, sum(1 << a for a in range(6) if ok[a]) if faulty else 63))
        r = attempts(arrival, repaired, ok if faulty else [True] * 6, None if u is None else came[u])
        came[v], want[v] = (r[3] if r[0] == "delivered" else "never"), r
    df = spark.createDataFrame(nodes, "v bigint, u bigint, arrival bigint, repaired bigint, ok int").repartition(5)
    out = {r["v"]: (["delivered", "dead", "blocked"][r["status"]], r["attempts"], r["first_at"], r["last_at"]) for r in replay.deliveries(df, Workspace(spark), 4, 3).collect()}
    assert out == want


def test_heavy_paths(spark):
    """Every node lies on one path, a path goes on to a child with the largest subtree, and light edges are few."""
    edges = forest()
    size, kids, up = defaultdict(int), defaultdict(list), dict(edges)
    for v, u in sorted(edges, reverse=True):
        size[v] += 1
        if u is not None:
            size[u] += size[v]
            kids[u].append(v)
    found = {r["v"]: (r["head"], r["k"]) for r in replay.heavy_paths(spark.createDataFrame(edges, "v bigint, u bigint"), Workspace(spark)).collect()}
    assert len(found) == len(edges)
    for v, u in edges:
        on = u is not None and v == min(kids[u], key=lambda c: (-size[c], c))
        assert found[v] == ((found[u][0], found[u][1] + 1) if on else (v, 0))
    for v in up:
        light, at = 0, v
        while at is not None:
            light += found[at][0] == at and up[at] is not None
            at = up[at]
        assert 2**light <= len(edges)


def test_functions_compose():
    rng = random.Random(1)
    for _ in range(60):
        parts = [(7 * k, 7 * k + rng.randrange(101) if rng.random() < 0.7 else 0, rng.randrange(64)) for k in range(rng.randrange(1, 14))]
        whole = replay.folded([replay.piece(*p) for p in parts])
        assert [p[0] for p in whole] == sorted({p[0] for p in whole}) and len(whole) <= 7 * len(parts) + 103
        for x in (-1, *range(0, 260, 3)):
            y = x
            for p in parts:
                y = replay.value(replay.piece(*p), y)
            assert replay.value(whole, x) == y
        arrival, repaired, ok = parts[0]
        for x in (-1, *range(0, 150)):
            r = attempts(arrival, repaired, [ok >> a & 1 for a in range(6)], None if x < 0 else x)
            assert replay.value(replay.piece(arrival, repaired, ok), x) == (r[3] if r[0] == "delivered" else replay.NEVER)
