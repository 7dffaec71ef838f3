"""Order of lines, files that nothing is wanted from, versions that readers can rely on, outputs written once."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from cohortloom.sources import readers, sinks
from cohortloom.streaming.incremental import output, process_to_outputs


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path, small_splits):
    rng, n, want = random.Random(1), 0, []
    for f, size in enumerate((150, 1, 0, 80, 400)):
        lines = ["k,v"]
        for _ in range(size):
            lines.append(f"{rng.randrange(40)},{'x' * rng.randrange(30)}{n}")
            want.append((n, int(lines[-1].split(",")[0]), lines[-1].split(",")[1]))
            n += 1
        (tmp_path / f"part-{f}.csv").write_text("\n".join(lines) + "\n")
    df = readers.numbered(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 0 and readers.in_file_order(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    assert sorted((r["line"], int(r["k"]), r["v"]) for r in df.collect()) == want
    first = {}
    for i, k, _ in want:
        first.setdefault(k, i)
    got = df.groupBy("k").agg(F.min("line").alias("line")).collect()
    assert {int(r["k"]): r["line"] for r in got} == first
    kept = readers.in_file_order(spark, str(tmp_path)).groupBy("k").agg(F.min_by("v", "line").alias("v")).collect()
    assert {int(r["k"]): r["v"] for r in kept} == {k: want[i][2] for k, i in first.items()}


def test_quoted_fields_over_lines(spark, tmp_path, small_splits):
    for f in range(3):
        (tmp_path / f"{f}.tsv").write_text("k\tv\n" + "".join(f'{f}-{k}\t"a\nb ""{k}"" \n{"y" * 40}"\n' for k in range(60)))
    rows = readers.numbered(spark, str(tmp_path), "\t", multi_line=True).orderBy("line").collect()
    assert [r["k"] for r in rows] == [f"{f}-{k}" for f in range(3) for k in range(60)] and rows[7]["v"] == f'a\nb "7" \n{"y" * 40}'
    assert [r["line"] for r in rows] == list(range(180))


def test_files_that_nothing_is_wanted_from(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([(i, f"v{i}") for i in range(10 * k, 10 * k + 10)], "id int, v string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    names = {k: next(x for x in os.listdir(tmp_path / "in" / str(k)) if x.endswith(".parquet")) for k in range(5)}
    wanted = spark.createDataFrame([(names[1], 12), (names[1], 12), (names[1], 21), (names[3], 30), (names[3], 39), ("other.parquet", 1), (None, 2), (names[4], None)], "file string, id int")
    rows = readers.wanted_rows(spark, str(tmp_path / "in"), wanted, "file", "id")
    assert sorted((r["id"], r["v"], r["file"]) for r in rows.collect()) == [(12, "v12", names[1]), (30, "v30", names[3]), (39, "v39", names[3])]
    read = [f for f in rows.inputFiles() if str(tmp_path) in f]
    assert len(read) == 3
    sinks.by_input(rows, str(tmp_path / "out"), "file")
    assert sorted(x for x in os.listdir(tmp_path / "out") if x.startswith("file=")) == sorted(f"file={names[k]}" for k in (1, 3))
    assert readers.wanted_rows(spark, str(tmp_path / "in"), wanted.limit(0), "file", "id").collect() == []


def test_folders_have_as_many_files_as_their_bytes_ask_for(spark, tmp_path):
    """A value with most of the rows is written by several tasks, and small ones stay whole."""
    rng = random.Random(2)
    rows = [("train", "".join(rng.choice("abcdefghijklmnop") for _ in range(200))) for _ in range(6000)] + [("evaluate", "x")] * 40
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        sinks.partitioned(spark.createDataFrame(rows, "split string, v string").repartition(8), str(tmp_path / "d"), ["split"])
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    files = {s: [x for x in os.listdir(tmp_path / "d" / f"split={s}") if x.endswith(".parquet")] for s in ("train", "evaluate")}
    assert 3 <= len(files["train"]) <= 12 and len(files["evaluate"]) == 1
    assert spark.read.parquet(str(tmp_path / "d")).groupBy("split").count().count() == 2


def test_readers_see_whole_versions(spark, tmp_path):
    """While versions are published a reader always finds one, whole."""
    path, seen, stop = str(tmp_path / "t"), [], threading.Event()
    table = lambda k: spark.range(50).select("id", F.lit(k).alias("version"))
    with pytest.raises(FileNotFoundError):
        readers.current(spark, path)
    sinks.published(table(0), path)

    def watch():
        while not stop.is_set():
            try:
                rows = readers.current(spark, path).groupBy("version").count().collect()
                seen.append([tuple(r) for r in rows])
            except Exception as e:  # noqa: BLE001
                seen.append(repr(e))

    thread = threading.Thread(target=watch)
    thread.start()
    pinned = readers.current(spark, path)
    for k in range(1, 6):
        sinks.published(table(k), path)
    stop.set()
    thread.join()
    assert seen and all(len(s) == 1 and s[0][1] == 50 for s in seen)
    assert pinned.select("version").distinct().collect() == [(0,)] and readers.current(spark, path).first()["version"] == 5
    assert sinks.swept(spark, path, older=3600) == 0 and sinks.swept(spark, path) == 5 and readers.current(spark, path).count() == 50


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.published(spark.range(3), path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "point", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            sinks.published(spark.range(9), path)
    assert readers.current(spark, path).count() == 3
    with pytest.raises(Exception, match="oops"):
        sinks.published(spark.range(9).select(F.raise_error(F.lit("oops")).cast("string").alias("x")), path)
    assert readers.current(spark, path).count() == 3 and sinks.swept(spark, path) >= 1
    sinks.published(readers.current(spark, path).union(spark.range(2)), path)
    assert readers.current(spark, path).count() == 5


def test_a_batch_that_died_between_its_outputs(spark, tmp_path):
    """The second output fails once; the next call repairs the batch, and nothing is doubled."""
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    failing = [True]

    def second(df):
        if failing[0]:
            raise RuntimeError("died")
        return df.where("n % 2 = 1")

    outputs = {"even": lambda df: df.where("n % 2 = 0"), "odd": second, "rejects": lambda df: df.where("n is null")}
    spark.createDataFrame([(k,) for k in range(10)] + [(None,)], "n int").write.parquet(source)
    with pytest.raises(Exception, match="died"):
        process_to_outputs(spark, source, "n int", outputs, target, mark)
    assert output(spark, target, "even").count() == 5 and not os.path.exists(f"{target}/odd")
    spark.createDataFrame([(100,), (101,)], "n int").write.mode("append").parquet(source)
    failing[0] = False
    for _ in range(2):
        process_to_outputs(spark, source, "n int", outputs, target, mark)
        assert sorted(r["n"] for r in output(spark, target, "even").collect()) == [0, 2, 4, 6, 8, 100]
        assert sorted(r["n"] for r in output(spark, target, "odd").collect()) == [1, 3, 5, 7, 9, 101]
        assert [r["n"] for r in output(spark, target, "rejects").collect()] == [None]
