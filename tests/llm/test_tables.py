"""Intermediate tables: who deletes what, and what a block of test items takes."""

import os
import random
import subprocess
import sys

import corpus_pipeline
from cohortloom.llm import decontam, line_dedup, workspace


def kept(spark):
    base = workspace.shared_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(base) if x.startswith("cohortloom-")}


def test_closing_deletes_its_own_tables_only(spark, docs):
    table = docs(["one line here\nanother line there", "one line here\nmore of it"])
    other = line_dedup.line_dedup(table)
    before = kept(spark)
    with workspace.closing():
        inner = line_dedup.line_dedup(table)
        rows = inner.count()
        assert kept(spark) > before
    assert kept(spark) == before and other.count() == rows


def test_the_pipeline_keeps_its_last_table(spark):
    before = kept(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = kept(spark) - before
    assert len(new) == 1 and out.count() > 0
    base = workspace.shared_dir(spark).removeprefix("file:")
    assert os.listdir(f"{base}/{new.pop()}") == ["stage4_packing"]


def test_blocks_of_items_fit_a_worker(spark):
    """Blocks hold what they should, and a block's matcher stays below 400 MB."""
    rng = random.Random(1)
    items = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))) for k in range(1500)]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    blocks = list(decontam._blocks(df))
    assert sum(map(len, blocks)) == 1500 and all(sum(len(t) for _, t in b) < decontam.BLOCK + 500 for b in blocks)
    code = "import resource, random; from cohortloom.llm import decontam; rng = random.Random(1); items = [(k, ' '.join(''.join(rng.choice('abcdefghij') for _ in range(6)) for _ in range(40))) for k in range(720)]; at = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; m = decontam.Matcher(items); print(sum(len(t) for _, t in items), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - at) // 1024)"
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__)).stdout.split())
    assert 0.9 * decontam.BLOCK < n < 1.1 * decontam.BLOCK and mb < 400
