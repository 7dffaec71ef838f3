"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import prefix_join

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain(rows):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(set() if not w else {" ".join(w)} if len(w) < 4 else {" ".join(w[k : k + 4]) for k in range(len(w) - 3)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        best[r] = i if best.get(r) is None else best[r] if i is None else min(best[r], i)
    return sorted(map(repr, ((i, len(s), best[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def corpus(seed, crowd=60):
    """Unrelated texts, edited copies around the threshold, a crowd of near copies, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 160))]
        texts.append(base)
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 40 + 1))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [word()], [own[at], word()]])
            texts.append(own)
        texts.append([*(word() for _ in range(40)), *passage])
    common = [word() for _ in range(170)]
    for _ in range(crowd):
        own = list(common)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = word()
        texts.append(own)
    texts += [list(common)] * 5 + [["a"], ["A"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], ["x"] * 50, ["x"] * 70]
    rng.shuffle(texts)
    return [(k, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.2 else w for w in t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, docs, seed):
    rows = corpus(seed)
    out = prefix_join.similar_documents(docs(rows).repartition(3 * seed))
    assert got(out) == plain(rows)


def test_chain_and_exact_threshold(docs):
    """A chain whose ends are unlike; a pair at exactly 85 of 100, and one just below."""
    one = [f"w{k}" for k in range(103)]
    chain = [" ".join(one[:100]), " ".join(one[8:103] + [f"v{k}" for k in range(5)]), " ".join(one[16:103] + [f"v{k}" for k in range(13)])]
    rows = [(k, t) for k, t in enumerate(chain)]
    base = [f"b{k}" for k in range(103)]  # 100 shingles
    rows += [(10, " ".join(base)), (11, " ".join(base[:88]))]  # 85 of 100
    base = [f"c{k}" for k in range(103)]
    rows += [(20, " ".join(base)), (21, " ".join(base[:87]))]  # 84 of 100
    want = plain(rows)
    assert got(prefix_join.similar_documents(docs(rows))) == want
    assert "(11, 85, 10)" in want and "(21, 84, 21)" in want


def test_nulls_repeats_names_and_partitions(spark, docs):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (3, text), (None, text + " eleven"), (7, None), (7, ""), (None, None), (8, " \t\n"), (9, "x"), (9, "x"), (9, "y"), (None, "z"), (4, "é漢字   x"), (5, "é漢字   X")]
    rows += [(12, " ".join(f"w{k}" for k in range(30_000))), (11, " ".join(f"w{k}" for k in range(1000, 30_000))), (13, "a" * 50_000)]
    want = plain(rows)
    df = docs(rows)
    assert got(prefix_join.similar_documents(df.coalesce(1))) == want
    clash = df.repartition(17).select("*", *[F.lit("mine").alias(n) for n in ("id", "digest", "n", "pre", "row", "g", "s", "map", "component")])
    assert got(prefix_join.similar_documents(clash)) == want
    empty = prefix_join.similar_documents(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id"]
    assert got(prefix_join.similar_documents(df.where("text is null"))) == plain([(7, None), (None, None)])


def test_sieve_loses_nothing():
    """Similar sets share as many shingles among their first ones as the sieve asks for."""
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = rng.random(len(a)) < rng.random() * 0.2
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64)]))
        c = len(np.intersect1d(a, b))
        if 100 * c >= 85 * (len(a) + len(b) - c):
            seen += 1
            (x, nx), (y, ny) = prefix_join.sieved(a), prefix_join.sieved(b)
            assert len(np.intersect1d(x, y)) >= max(nx, ny)
    assert seen > 1000


def test_bitmaps_lose_nothing():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.choice(500, size=int(rng.integers(1, 300)), replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        differ = int(np.bitwise_count(prefix_join.bitmap(a) ^ prefix_join.bitmap(b)).sum())
        assert differ <= len(np.setxor1d(a, b))
