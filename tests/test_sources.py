"""Readers, writers and resumable streams on small files."""

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.text import parent_name
from cohortloom.sources import readers, sinks
from cohortloom.streaming.incremental import process_new_files, undone


def test_delimited_nulls_and_rejects(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("id\tx\ty\n1\tNA\tnone\n2\tNone\n3\ta\tb\tc\n")
    good, bad = readers.delimited_with_rejects(spark, str(p))
    assert sorted(good.collect()) == [("1", None, "none"), ("2", None, None)]
    assert [r.line for r in bad.collect()] == ["3\ta\tb\tc"]
    assert readers.with_sample(good, ["missing", "id"]).columns[-1] == "Sample"
    with pytest.raises(KeyError):
        readers.with_sample(good, ["missing"])


def test_quoted_fields_and_rows_like_the_header(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,x,y\n1,"a,b","say ""hi"""\nid,x,y\n2,p\n3,p,q,\n4,"u,v",w,z\n5,5" pipe,k\n')
    good, bad = readers.delimited_with_rejects(spark, str(p), ",")
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("1", "a,b", 'say "hi"'), ("id", "x", "y"), ("2", "p", None), ("5", '5" pipe', "k")], key=str)
    assert sorted((r["first"], r["line"]) for r in bad.collect()) == [("3", "3,p,q,"), ("4", '4,"u,v",w,z')]


def test_label_sheet(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,drug-a\nS1,1.0\nS2,\n")
    assert [tuple(r) for r in readers.label_sheet(spark, str(p), "id").collect()] == [("S1", 1.0, "S1"), ("S2", None, "S2")]
    with pytest.raises(ValueError, match="first column"):
        readers.label_sheet(spark, str(p), "Sample")


def test_listing_and_paths(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "x.gbff").write_text("abc")
    files = readers.listing(spark, str(tmp_path), "*.gbff", recursive=True)
    assert files.count() == 2 and readers.first_files(files, 1).count() == 1 and readers.first_files(files, 0).count() == 2
    assert sorted(r[0] for r in readers.samples_in(files, parent_name(F.col("path"))).collect()) == ["s1", "s2"]
    rows = readers.parsed_files(spark, str(tmp_path), lambda p, c: [(p.rsplit("/", 1)[1], len(c))], "name string, n bigint", "*.gbff")
    assert sorted(rows.collect()) == [("x.gbff", 3), ("x.gbff", 3)]
    (tmp_path / "l.txt").write_text(" /a \n\n/b\n")
    assert [r.path for r in readers.path_list(spark, str(tmp_path / "l.txt")).collect()] == ["/a", "/b"]
    (tmp_path / "e.txt").write_text("\n")
    with pytest.raises(ValueError):
        readers.path_list(spark, str(tmp_path / "e.txt"))


def test_presence_matrix(spark, tmp_path):
    (tmp_path / "m.Rtab").write_text("Gene\ts1\ts2\ng1\t1\t0\ng2\t1\t1\n")
    assert sorted(tuple(r) for r in readers.presence_matrix(spark, str(tmp_path / "m.Rtab")).collect()) == [("g1", "s1"), ("g2", "s1"), ("g2", "s2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    assert not sinks.delimited(df.limit(0), str(tmp_path / "none"), only_if_rows=True) and not (tmp_path / "none").exists()
    target = str(tmp_path / "t")
    assert sinks.delimited(df, target, "\t")
    again = readers.delimited(spark, target, "\t").withColumn("flag", F.lit("x"))
    sinks.replaced(again, target)
    assert readers.delimited(spark, target, "\t").columns == ["s", "n", "flag"] and readers.delimited(spark, target, "\t").count() == 2
    sinks.partitioned(df, str(tmp_path / "p"), ["s"])
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["s=a", "s=b"]
    sinks.batches(df, "n", 1, str(tmp_path / "b"))
    assert sorted(x.name for x in (tmp_path / "b").iterdir() if x.is_dir()) == ["batch_name=batch_00", "batch_name=batch_01"]
    profile = readers.parquet_profile(spark, str(tmp_path / "p")).first()
    assert profile.n_rows == 2 and profile.n_columns == 2


def test_stream_resumes(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k in range(2):
        spark.createDataFrame([(k,)], "n int").write.mode("append").parquet(source)
        process_new_files(spark, source, "n int", lambda df: df.withColumn("m", F.col("n") * 2), target, mark)
        assert spark.read.parquet(target).count() == k + 1
    assert undone(spark.range(3).withColumnRenamed("id", "n"), "n", spark.read.parquet(target)).count() == 1
