"""Edge cases of the operators, and properties that hold for any input."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cohortloom.functions import measure, stats, text
from cohortloom.operators import batching, cohort, contingency, metrics, pangenome, ranking, reconcile, resolve, rollup, split, testing, vectors

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_measurements(spark):
    cases = {
        ">= 64/4 mg/L": (">=", 64.0, math.log10(64), None),
        "<= .25 mg/L": ("<=", 0.25, math.log10(0.25), None),
        "< 4 mg/L": ("<", 4.0, math.log10(4) - 1, None),
        "> 4 mg/L": (">", 4.0, math.log10(4) + 1, None),
        "== 8": ("==", 8.0, math.log10(8), None),
        "32": (None, None, None, "parts"),
        "~ 4 mg/L": (None, None, None, "operator"),
        ">= abc": (None, None, None, "number"),
        ">= 5.": (None, None, None, "number"),
        "= 0 mg/L": ("=", 0.0, -math.inf, None),
        "  = 2  mg/L ": ("=", 2.0, math.log10(2), None),
        None: (None, None, None, None),
    }
    df = frame(spark, [(k,) for k in cases], "m string")
    m = F.col("m")
    df = df.select("m", measure.operator(m).alias("op"), measure.number(m).alias("v"), measure.reject_reason(m).alias("why"))
    for r in df.withColumn("lg", measure.log_value(F.col("v"), F.col("op"))).collect():
        op, v, lg, why = cases[r.m]
        assert (r.op, r.v, r.why) == (op, v, why), r
        assert r.lg == lg or r.lg == pytest.approx(lg)


def test_phenotypes_and_labels(spark):
    df = frame(spark, [("Resistant",), ("SUSCEPTIBLE",), ("intermediate",), ("resistant ",), (None,)], "p string")
    assert [r[0] for r in df.select(measure.binary_phenotype(F.col("p"))).collect()] == [1, 0, None, None, None]
    assert frame(spark, [(0.5,), (1.0,), (None,)], "x double").select(measure.training_label(F.col("x"))).collect() == [(0,), (1,), (None,)]


def test_text_keys(spark):
    paths = {"/x/a.fa.gz": "a", "/x/a.fna.gz": "a", "/x/a.fa": "a.fa", "/x/GCF_1.1_ASM.fna.gz": "GCF_1.1_ASM"}
    df = frame(spark, [(k,) for k in paths], "p string")
    assert [r[0] for r in df.select(text.assembly_id(F.col("p"))).collect()] == list(paths.values())
    one = frame(spark, [("GCF_1.1_ASM", "x.gff3.gz", "x.bakta.gff3.gz", "A & B!", "!!")], "a string, b string, c string, d string, e string")
    got = one.select(text.lookup_key(F.col("a")), text.annotation_id(F.col("b")), text.bakta_id(F.col("c")), text.slug(F.col("d")), text.slug(F.col("e"))).first()
    assert tuple(got) == ("GCF_1.1", "x", "x", "a_b", "unknown")
    assert text.pair_name("Blood & co", "faeces") == "blood_co_vs_faeces"
    with pytest.raises(ValueError):
        text.pair_name("!", "a")


def test_resolution(spark):
    df = frame(spark, [("blood & sterile",), ("blood & sterile",), ("bloodstream",), ("faeces",), (None,)], "c string")
    assert resolve.resolve(df, "c", " Blood") == "blood & sterile"
    assert resolve.resolve_pair(df, "c", "blood", "faeces") == ("blood & sterile", "faeces")
    for tokens in (("none", "faeces"), ("sterile", "blood"), ("", "blood")):
        with pytest.raises(ValueError):
            resolve.resolve_pair(df, "c", *tokens)
    with pytest.raises(ValueError, match="several"):
        resolve.resolve(df.unionByName(frame(spark, [("cord blood",)], "c string")), "c", "blood")


def test_first_non_null_and_pivot(spark):
    df = frame(spark, [("s", 1, None, "x"), ("s", 2, 5, None), (None, 3, 1, "y")], "k string, o int, a int, b string")
    assert rollup.first_non_null(df, "k", "o", ["a", "b"]).collect() == [("s", 5, "x")]
    long = frame(spark, [("s", "A", 1.0), ("s", "A", 0.0), ("t", "A", None), ("s", "B", None)], "k string, c string, v double")
    wide = rollup.pivot_mean(long, "k", "c", "v")
    assert wide.columns == ["k", "A"] and wide.collect() == [("s", 0.5)]


@pytest.mark.parametrize(
    ("n1", "n2", "r", "expected"),
    [(10, 5, 2.0, (10, 5, "accepted_all")), (11, 5, 2.0, (10, 5, "country_sampled")), (5, 0, 2.0, None), (0, 0, 2.0, None), (5, 0, 0.0, (5, 0, "accepted_all_no_ratio")), (4, 4, 0.5, (2, 4, "country_sampled")), (3, 20, 2.5, (3, 7, "country_sampled"))],
)
def test_ratio_audit(spark, n1, n2, r, expected):
    rows = cohort.audited(frame(spark, [("c", n1, n2)], "country string, n1 bigint, n2 bigint"), r).collect()
    assert [(x.sampled1, x.sampled2, x.action) for x in rows] == ([expected] if expected else [])


def test_routing(spark):
    df = frame(spark, [("AMR surveillance",), ("Surveillance",), (None,), ("outbreak",)], "s string")
    assert [r.thread for r in cohort.routed(df, "s").collect()] == ["AMR", "Surveillance", "NA", None]


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.sampled_from(["a", "b"])), max_size=40), st.sampled_from([0.0, 1.0, 2.0, 2.5]), st.integers(1, 5))
def test_balance_never_drops_the_smaller_class(spark, rows, r, parts):
    df = frame(spark, [(i, c, k) for i, (c, k) in enumerate(rows)], "id int, country string, kind string")
    s = cohort.Stratum(("country",), "kind", "a", "b", "id")
    out = cohort.balanced(df, s, r)
    kept = sorted(out.collect())
    assert kept == sorted(cohort.balanced(df.repartition(parts), s, r).collect())
    for c in ("x", "y"):
        n = {k: sum(x == (c, k) for x in rows) for k in "ab"}
        got = {k: sum((x.country, x.kind) == (c, k) for x in kept) for k in "ab"}
        if r <= 0:
            assert got == n
        elif min(n.values()) == 0:
            assert sum(got.values()) == 0
        else:
            assert min(got.values()) == min(n.values()) and max(got.values()) == min(max(n.values()), int(max(r, 1) * min(n.values())))


@SLOW
@given(st.integers(0, 200))
def test_split_sizes(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("s")).crossJoin(spark.range(2))
    got = {r[0]: r[1] for r in split.with_splits(df, "s").groupBy("train_val_eval").agg(F.countDistinct("s")).collect()}
    train, validate = int(0.7 * n), int(0.1 * n)
    assert {k: got.get(k, 0) for k in split.NAMES} == {"train": train, "validate": validate, "evaluate": n - train - validate}


def test_split_of_ten_and_ninety(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("s"))
    out = split.with_splits(df.unionByName(df), "s")
    assert out.groupBy("s").agg(F.countDistinct("train_val_eval").alias("n")).where("n > 1").count() == 0
    assert {r[0]: r[1] for r in out.groupBy("train_val_eval").count().collect()} == {"train": 14, "validate": 2, "evaluate": 4}
    assert int(0.7 * 90) == 62
    assert split.helper_free(["id", "Sample", "train_val_eval", "a", "b"], {"id", "Sample", "train_val_eval"}) == ["a", "b"]
    assert split.with_splits(df.limit(0), "s").count() == 0


@SLOW
@given(st.lists(st.integers(-5, 50), max_size=60), st.integers(1, 9))
def test_batches_partition_the_input(spark, values, size):
    df = frame(spark, [(v, i) for i, v in enumerate(values)], "v int, i int")
    out = batching.fixed(df, "i", size).orderBy("i").collect()
    assert [r.batch for r in out] == [k // size for k in range(len(values))]
    width = max(2, len(str(max(0, len(values) - 1) // size)))
    assert all(r.batch_name == f"batch_{r.batch:0{width}d}" for r in out)
    ranks = ranking.ordered_rank(df, "v", ("i",)).orderBy("v", "i").collect()
    assert [r["rank"] for r in ranks] == list(range(1, len(values) + 1))


@SLOW
@given(st.lists(st.integers(1, 30), max_size=25), st.integers(1, 60))
def test_greedy_packing(spark, sizes, target):
    df = frame(spark, [(f"{i:03d}", s) for i, s in enumerate(sizes)], "g string, n bigint")
    expected, batch, held = [], 0, 0
    for s in sizes:
        expected.append(batch)
        held += s
        if held >= target:
            batch, held = batch + 1, 0
    assert [r.batch for r in batching.greedy(df, "g", "n", target).orderBy("g").collect()] == expected


def test_reconciliation(spark):
    ids = frame(spark, [("GCF_10.1_x",), ("GCF_2",), (None,), ("SAM1",)], "a string")
    assert sorted(r[0] or "" for r in reconcile.without_substrings(ids, "a", frame(spark, [("GCF_1",), (None,)], "s string")).collect()) == ["", "GCF_2", "SAM1"]
    present = frame(spark, [("SAM1",), (None,)], "p string")
    assert [r.a for r in reconcile.flagged(ids, "a", present, "there").where("there").collect()] == ["SAM1"]
    assert reconcile.missing(ids, "a", present, "SAM").count() == 0
    assert reconcile.limited(ids, -1, "a").count() == 4 and reconcile.limited(ids, 0, "a").count() == 0
    m = frame(spark, [("GCF_2", "first", 1), ("GCF_2", "second", 2)], "k string, v string, o int")
    assert [r.v for r in reconcile.looked_up(ids, F.col("a"), m, "k", "v", "o", "v").where("a = 'GCF_2'").collect()] == ["first"]
    assert reconcile.left_mapped(ids, "a", m, "k").where("a = 'GCF_2'").count() == 2
    flags = frame(spark, [("GCF_2", None), ("GCF_2", False)], "a string, f boolean")
    out = reconcile.looked_up_in_either(flags, F.col("a"), F.coalesce("f", F.lit(True)), m.where("o = 1"), m.where("o = 2"), "k", "v", "o", "v")
    assert sorted((r.f is None, r.v) for r in out.collect()) == [(False, "second"), (True, "first")]


def test_contingency(spark):
    df = frame(spark, [("x", "a"), ("x", "b"), ("y", "a"), (None, "a"), ("z", None)], "r string, c string")
    assert sorted(contingency.crosstab(df, "r", "c").collect()) == [("x", "a", 1), ("x", "b", 1), ("y", "a", 1)]
    assert sorted(contingency.wide_crosstab(df, "r", "c", ["a", "b"]).collect()) == [("x", 1, 1), ("y", 1, 0)]
    assert [r.ratio for r in contingency.class_ratio(df, "r", "c", "a", "b").orderBy("r").collect()] == [1.0, math.inf]
    assert sorted(r.r for r in contingency.top_or_other(df, "r", 1).collect()) == ["other", "other", "other", "x", "x"]


def test_vectors(spark):
    df = frame(spark, [("s", [[1.0, 2.0], [3.0, 4.0]]), ("t", [])], "k string, m array<array<double>>")
    assert df.select(vectors.mean_of_rows(F.col("m"))).first()[0] == [2.0, 3.0]
    genes = vectors.exploded(df, "k", "m")
    assert genes.count() == 2 and vectors.mean_pool(genes, "k", "embedding").collect() == [("s", [2.0, 3.0])]
    pads = vectors.padded(frame(spark, [(1, [1.0]), (1, [1.0, 2.0, 3.0]), (1, [])], "b int, x array<double>"), "b", "x")
    assert sorted((r.x, r["mask"]) for r in pads.collect()) == [([0.0] * 3, [0] * 3), ([1.0, 0.0, 0.0], [1, 0, 0]), ([1.0, 2.0, 3.0], [1, 1, 1])]


def test_pangenome(spark):
    wide = frame(spark, [("f", "1", "1"), ("g", "0", "1")], "feature string, s1 string, s2 string")
    long = pangenome.long_presence(wide, "feature")
    assert sorted(long.select("feature", "sample").collect()) == [("f", "s1"), ("f", "s2"), ("g", "s2")]
    assert {r.feature: r["class"] for r in pangenome.feature_classes(long, "sample", "feature").collect()} == {"f": "core", "g": "shell"}


def test_z_tests(spark):
    rows = [("a", 10.0, 2.0, 5, 1), ("b", 30.0, 1.0, 50, 1), ("c", 11.0, 2.0, 9, 2), ("no_sd", 1.0, 0.0, 9, 1), ("one", 1.0, 1.0, 1, 1)]
    df = frame(spark, rows, "g string, size_mean double, size_sd double, n int, k int")
    out = {r.g: r for r in testing.z_tests(df, "g", "size_mean", "size_sd", "n", "k").collect()}
    assert set(out) == {"a", "b"}
    se = math.sqrt(4 / 5 + 4 / 9)
    assert out["a"].p == pytest.approx(math.erfc(abs(-1 / se) / math.sqrt(2)), rel=1e-9) and out["b"].p < 1e-30
    assert out["a"].p_bonferroni == pytest.approx(min(1, 2 * out["a"].p))
    assert out["b"].p == pytest.approx(math.erfc(abs(out["b"].z) / math.sqrt(2)), rel=1e-12, abs=0)
    assert testing.z_tests(df.where("k = 1"), "g", "size_mean", "size_sd", "n", "k").count() == 0


def test_erfc_to_full_precision(spark):
    xs = [k / 50 for k in range(1340)] + [0.46875, 4.0, 1e-9, 30.0]
    rows = frame(spark, [(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-13, abs=1e-300) for r in rows)
    assert frame(spark, [(None,)], "x double").select(stats.erfc(F.col("x"))).first()[0] is None


def test_binary_metrics(spark):
    df = frame(spark, [(2.0, 1), (1.0, 0), (1.0, 1), (-1.0, 0), (5.0, -100)], "l double, y int")
    r = metrics.binary_metrics(df, "l", "y").first()
    assert (r.n, r.accuracy, r.auroc) == (4, 0.75, pytest.approx(3.5 / 4)) and r.f1 == pytest.approx(0.8)
    one = metrics.binary_metrics(df.where("y = 1"), "l", "y").first()
    assert math.isnan(one.auroc) and one.accuracy == 1.0
    none = metrics.binary_metrics(frame(spark, [(-1.0, 0)], "l double, y int"), "l", "y").first()
    assert none.f1 == 0.0 and math.isnan(none.auprc)


def test_histogram_closes_its_last_bin(spark):
    df = frame(spark, [(0.0,), (0.5,), (2.0,), (2.1,), (-0.1,)], "x double")
    assert [r[0] for r in df.select(stats.histogram_bin(F.col("x"), 0.0, 0.5, 4)).collect()] == [0, 1, 3, None, None]


def test_nearest_beyond_one_block_of_queries(spark):
    import numpy as np

    from cohortloom.operators import vectors

    m = np.random.default_rng(3).normal(size=(40, 6))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "gene bigint, embedding array<double>")
    got = {(r["query"], r.gene) for r in vectors.nearest(df.where("gene < 23"), df, "gene", "embedding", 3, limit=7).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(i, int(j)) for i in range(23) for j in np.argsort(-s[i])[:3]}


def test_without_substrings_equals_brute_force(spark):
    import random

    from cohortloom.operators import reconcile

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    values = [None, "", *[word(rng.randrange(1, 30)) for _ in range(120)]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k bigint, v string")
    for sizes in ([3, 5, 9], list(range(4, 60)), [1], []):
        stems = [word(n) for n in sizes for _ in range(3)] + [None]
        left = reconcile.without_substrings(df, "v", spark.createDataFrame([(x,) for x in stems], "stem string"))
        assert sorted(r.k for r in left.collect()) == [k for k, v in enumerate(values) if v is None or not any(x is not None and x in v for x in stems)]
    assert [r.k for r in reconcile.without_substrings(df, "v", spark.createDataFrame([("",)], "stem string")).collect()] == [0]


def test_nearest_leaves_broken_vectors_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, []), (None, [1.0, 0.0])]
    df = frame(spark, rows, "id bigint, e array<double>")
    assert sorted((r["query"], r["id"]) for r in vectors.nearest(df, df, "id", "e", 3).collect()) == [(1, 2), (2, 1)]
    assert vectors.nearest(df.where("id = 3"), df, "id", "e", 3).collect() == []


def test_measurements_with_other_white_space(spark):
    raw = [">\u00a04\u2009mg/L", "\u3000<= 2", "=\x1f8 mg", ">=\u20282", "~\u00a04", ">\u00a0"]
    df = frame(spark, [(x,) for x in raw], "m string").select(measure.operator(F.col("m")).alias("o"), measure.number(F.col("m")).alias("n"), measure.reject_reason(F.col("m")).alias("r"))
    assert [tuple(r) for r in df.collect()] == [(">", 4.0, None), ("<=", 2.0, None), ("=", 8.0, None), (">=", 2.0, None), (None, None, "operator"), (None, None, "parts")]


def test_coverage_of_no_files(spark):
    files, used = frame(spark, [("a",), ("b",)], "f string"), frame(spark, [("a",)], "u string")
    assert tuple(reconcile.coverage(files, "f", used, "u").first()) == (2, 1, False) and tuple(reconcile.coverage(files.limit(0), "f", used, "u").first()) == (0, 0, None)


def test_ranks_with_ties_and_hot_groups(spark):
    """Ranks in groups of which one has most rows, and values that most rows share."""
    rows = [("hot" if k % 10 else None if k % 20 else "b", k * 7919 % 5, k) for k in range(600)]
    out = ranking.rank_within(frame(spark, rows, "g string, v int, i int").repartition(9), ["g"], [F.col("v"), F.col("i")], "r").collect()
    want = {}
    for g in ("hot", None, "b"):
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[i] = n
    assert {r.i: r.r for r in out} == want
    tied = ranking.ordered_rank(frame(spark, [(1,)] * 50, "v int"), "v").collect()
    assert sorted(r["rank"] for r in tied) == list(range(1, 51))
    marks, asks = frame(spark, [(k * 3, k) for k in range(40)], "s bigint, m int"), frame(spark, [(k,) for k in range(-5, 130)], "s bigint")
    found = ranking.next_at_least(marks, asks, "s", "m").collect()
    assert {r.s: r.m for r in found} == {k: (max(0, -(-k // 3)) if k <= 117 else None) for k in range(-5, 130)}


def test_nearest_orders_ties_by_id(spark):
    from cohortloom.operators import vectors

    rows = [(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(60)]
    v = spark.createDataFrame(rows, "id bigint, e array<double>")
    for n in (1, 7):
        found = vectors.nearest(v.where("id < 4"), v.repartition(n), "id", "e", 3, limit=2).collect()
        got = {q: sorted(r.id for r in found if r["query"] == q) for q in range(4)}
        assert got == {0: [2, 4, 6], 1: [3, 5, 7], 2: [0, 4, 6], 3: [1, 5, 7]}


def test_argmax_rows_with_text_ties(spark):
    from cohortloom.operators import rollup

    df = spark.createDataFrame([("a", 2.0, "z"), ("a", 2.0, "b"), ("a", 1.0, "a"), ("c", None, "q")], "k string, m double, t string")
    assert [tuple(r) for r in rollup.argmax_rows(df, "k", "m", "t").collect()] == [("a", 2.0, "b")]


def test_flag_must_be_known(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, f boolean")
    assert [r.id for r in cohort.flagged_only(df, "f").collect()] == [1]
    with pytest.raises(Exception, match="f is null"):
        cohort.flagged_only(df.union(spark.createDataFrame([(3, None)], df.schema)), "f").collect()
    with pytest.raises(ValueError):
        cohort.united([])
    with pytest.raises(ValueError, match="no id is present"):
        split.pruned(df, "id", spark.createDataFrame([(9,)], "id int"), required=True)


def test_greedy_equals_a_loop(spark):
    import random

    rng = random.Random(1)
    sizes = [rng.randint(1, 30) for _ in range(500)]
    got = {r.k: r.batch for r in batching.greedy(spark.createDataFrame(list(enumerate(sizes)), "k int, n bigint").repartition(7), "k", "n", 50).collect()}
    total = batch = 0
    for k, n in enumerate(sizes):
        assert got[k] == batch
        total += n
        if total >= 50:
            total, batch = 0, batch + 1
    assert batching.greedy(spark.createDataFrame([], "k int, n bigint"), "k", "n", 50).collect() == []


def test_running_sums(spark):
    rows = [(float(k * 7 % 101), k) for k in range(101)]
    out = ranking.running_sums(spark.createDataFrame(rows, "s double, n bigint").repartition(5), "s", {"up": "n"}).collect()
    total = 0
    for r in sorted(out, key=lambda r: r.s):
        total += r.n
        assert r.up == total
    assert ranking.running_sums(spark.createDataFrame([], "s double, n bigint"), "s", {"up": "n"}).collect() == []


def test_names_and_batches_of_one(spark):
    names = text.run_names("A b", "C_vs_d", "/x", 0.1)
    assert names["train"] == "/x/training_a_b_c_vs_d/train" and names["label"] == "a_b_vs_c_vs_d_label"
    df = spark.createDataFrame([([[1.0, 2.0]],), ([],), (None,)], "m array<array<double>>")
    assert [r.v for r in df.select(vectors.squeezed(F.col("m")).alias("v")).collect()] == [[1.0, 2.0], None, None]
    with pytest.raises(Exception, match="more than one vector"):
        spark.createDataFrame([([[1.0], [2.0]],)], "m array<array<double>>").select(vectors.squeezed(F.col("m"))).collect()
    with pytest.raises(KeyError):
        rollup.renamed(df, {"x": "y"})


def test_tests_come_by_corrected_p(spark):
    rows = [("a", 1.0, 1.0, 10, 1), ("b", 9.0, 1.0, 10, 1), ("c", 5.0, 1.0, 10, 1), ("r", 5.0, 1.0, 50, 2)]
    out = testing.z_tests(spark.createDataFrame(rows, "g string, m double, s double, n bigint, k int"), "g", "m", "s", "n", "k").collect()
    assert [r.g for r in out] in (["a", "b", "c"], ["b", "a", "c"]) and [r.p_bonferroni for r in out] == sorted(r.p_bonferroni for r in out)


def test_substrings_send_nothing_whole_through_the_driver(spark):
    """Stems and values grow with the input: neither side may be broadcast, however short Spark takes it to be."""
    from cohortloom.plans import queries as plans

    for name in ("substring_anti", "accession_collect"):
        df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.count() > 0
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_presence_is_dealt_by_rows(spark, monkeypatch):
    """The rows that one task spells out and makes distinct don't grow with the table."""
    from cohortloom.plans import adapters

    whole = adapters.adapted(spark, "/root/testdata/sf0.001", "presence")
    monkeypatch.setitem(adapters.DEALT, "presence", ("lineitem", 500))
    dealt = adapters.adapted(spark, "/root/testdata/sf0.001", "presence")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert dealt.rdd.getNumPartitions() == 1 + n // 500 and max(sizes) < n
    assert dealt.exceptAll(whole).count() == whole.exceptAll(dealt).count() == 0
