"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names, and other partitions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import decontam, langid, license_scan, line_dedup, near_copies, packing, quality, secret_scan, simhash, suffix_dedup, toxicity
from cohortloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = "river stone walk bright over under house tree seven music token idiot license copy the of to and".split()
NAMES = "d drop first kept row id c s _t _w _l _h _g _s _p _q _v _z _d _drop _first _kept _base_failed _posterior fp n_words item_id start length offset sequence_id shard home hash block pos line".split()


def texts():
    rng = random.Random(3)
    prose = [" ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(40)) for _ in range(12)]
    long = "\n".join(" ".join(rng.choice(WORDS) for _ in range(400)) for _ in range(40))
    return [*prose, prose[0], prose[1], None, "", " \t\n", "x", "short line", long, "é漢字 𝄞 " * 30, "a" * 60_000, "\x00\x01"]


@pytest.fixture
def table(spark):
    rows = [(k, t, "en" if k % 3 else None, "s", None if t is None else len(t)) for k, t in enumerate(texts())]
    rows += [rows[2], rows[2], (None, texts()[3], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(0, " ".join(WORDS * 2)), (0, None), (None, "seven bright trees stand over the river"), (2, "")], "item_id bigint, text string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(14)] + [(None, None, None), (1, 0, None)], "doc_id bigint, quality int, toxic int")


FILTERS = {
    "quality": lambda docs, bench: quality.quality_filter(docs),
    "lines": lambda docs, bench: line_dedup.line_dedup(docs),
    "simhash": lambda docs, bench: simhash.near_dedup(docs),
    "near_copies": lambda docs, bench: near_copies.near_dedup(docs),
    "decontam": lambda docs, bench: decontam.decontaminated(docs, bench),
    "redacted": lambda docs, bench: secret_scan.redacted(docs),
}
REPORTS = {
    "op1": lambda docs, bench, labels: langid.language_report(docs),
    "op2": lambda docs, bench, labels: secret_scan.secrets(docs),
    "op3": lambda docs, bench, labels: decontam.contamination_report(docs, bench),
    "op4": lambda docs, bench, labels: suffix_dedup.repeats(docs),
    "op5": lambda docs, bench, labels: line_dedup.line_report(docs),
    "op6": lambda docs, bench, labels: license_scan.licenses(docs),
    "op7": lambda docs, bench, labels: simhash.near_duplicate_report(docs),
    "op8": lambda docs, bench, labels: quality.quality_report(docs),
    "op9": lambda docs, bench, labels: packing.pack(docs),
    "op10": lambda docs, bench, labels: toxicity.toxicity_report(docs, labels),
}
PER_ROW = {"op1", "op2", "op4", "op5", "op7", "op8", "op10"}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", FILTERS)
def test_filters(name, table, bench):
    run = FILTERS[name]
    plain = rows(run(table, bench))
    assert 0 < len(plain) <= table.count() and run(table, bench).columns == table.columns
    assert run(table.limit(0), bench).count() == 0
    more = table.select("*", *[F.lit("mine").alias(n) for n in NAMES])
    out = run(more, bench)
    assert out.columns == more.columns
    assert rows(out.select(table.columns)) == plain and out.select(NAMES).distinct().collect() == [("mine",) * len(NAMES)]


@pytest.mark.parametrize("name", REPORTS)
def test_reports(name, table, bench, labels):
    run = REPORTS[name]
    plain = rows(run(table, bench, labels))
    if name in PER_ROW:
        assert len(plain) == table.count()
    assert run(table.limit(0), bench, labels).count() == 0
    more = table.select("*", *[F.lit("mine").alias(n) for n in NAMES])
    assert rows(run(more, bench, labels)) == plain
    assert rows(run(table.coalesce(1), bench, labels)) == plain
    assert rows(run(table.repartition(17), bench, labels)) == plain


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(stage, spark, table, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage[1](spark, table, str(tmp_path))
    n = out.count()
    assert n > 0 and (stage[0] == "packing" or out.columns == table.columns)
    assert stage[1](spark, table.limit(0), str(tmp_path)).count() == 0
    more = table.select("*", *[F.lit("mine").alias(x) for x in NAMES])
    assert stage[1](spark, more, str(tmp_path)).count() == n


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op6_license_scan", "op9_packing"])
def test_queries_give_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
