"""Readers: delimited text with explicit null tokens, path lists, listings, parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Texts that stand for a missing value in delimited files; case matters.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_CORRUPT = "_corrupt_record"


def nulls_normalised(df: DataFrame) -> DataFrame:
    """Text columns with null for every null token."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    one = lambda c: F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`")
    return df.select(*map(one, df.columns))


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.option("sep", sep).option("header", True).csv(path).columns


def delimited(spark: SparkSession, path: str, sep: str = ",", schema: StructType | None = None) -> DataFrame:
    """All columns as text (or by ``schema``), with null tokens as null."""
    schema = schema or StructType([StructField(c, StringType()) for c in _header(spark, path, sep)])
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    df = nulls_normalised(spark.read.option("sep", sep).option("header", True).schema(text).csv(path))
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def in_file_order(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False, name: str = "line") -> DataFrame:
    """``delimited`` as text, with where each row stands: (file, start of its split, place), which sorts as the files are read.

    Enough for "first" and "last" (``min_by``), at no cost: rows of one split are read one after
    another by one task, whose running number grows. Files come by name. ``multi_line`` is for
    quoted fields that hold line ends; such files aren't split.
    """
    names = _header(spark, path, sep)
    text = StructType([StructField(c, StringType()) for c in names])
    options = {"sep": sep, "header": True, "escape": '"', "multiLine": multi_line}
    rows = spark.read.options(**options).schema(text).csv(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return nulls_normalised(rows.select(*[F.col(f"`{c}`") for c in names], at.alias(name)))


def numbered(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False, name: str = "line") -> DataFrame:
    """The same with dense line numbers from 0 over all files: the place in the split and the rows of all splits before it.

    Nothing is sorted but one row for each split.
    """
    rows = in_file_order(spark, path, sep, multi_line, "_at")
    splits = rows.groupBy(F.col("_at.file").alias("_file"), F.col("_at.start").alias("_start")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at.at").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = (F.col("_at.file") == F.col("_file")) & (F.col("_at.start") == F.col("_start"))
    names = [c for c in rows.columns if c != "_at"]
    return rows.join(starts, on).select(*[F.col(f"`{c}`") for c in names], (F.col("_at.at") - F.col("_first") + F.col("_before")).alias(name))


def wanted_rows(spark: SparkSession, folder: str, wanted: DataFrame, file: str, key: str) -> DataFrame:
    """Rows of the parquet files below a folder whose (file name, key) is wanted, with the name as ``file``.

    Files that nothing is wanted from aren't opened: their names are dropped from the list of paths
    that is read, which Spark keeps on the driver anyway. No file at all gives the folder's schema.
    """
    from cohortloom.functions.text import basename

    there = listing(spark, folder, "*.parquet", True).select("path", basename(F.col("path")).alias(file))
    paths = sorted(r[0] for r in there.join(wanted.select(file).distinct(), file, "left_semi").select("path").collect())
    rows = spark.read.parquet(*paths) if paths else spark.read.option("recursiveFileLookup", True).parquet(folder).limit(0)
    named = rows.select("*", F.col("_metadata.file_name").alias(file))
    return named.join(wanted.select(file, key), [file, key], "left_semi")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that ``sinks.published`` made the current one. Later versions don't change what this reads."""
    from .sinks import current_version

    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/versions/{version}")


def delimited_with_rejects(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and those with too many fields (their first field and their line); short rows are filled with nulls.

    Fields may be quoted, and a quote inside them is doubled. A row that equals the header is a row.
    """
    names = _header(spark, path, sep)
    schema = StructType([StructField(c, StringType()) for c in [*names, _CORRUPT]])
    options = {"sep": sep, "header": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "columnPruning": False}
    rows = spark.read.options(**options).schema(schema).csv(path)
    # Spark marks rows of any other length; separators outside of quotes tell long ones from short ones.
    bare = F.regexp_replace(_CORRUPT, f'(?<=^|\\Q{sep}\\E)"(?:[^"]|"")*+"', "")
    long = F.coalesce(F.size(F.split(bare, f"\\Q{sep}\\E", -1)) > len(names), F.lit(False))
    first = F.col(f"`{names[0]}`")
    return nulls_normalised(rows.where(~long).select(*[f"`{c}`" for c in names])), rows.where(long).select(first.alias("first"), F.col(_CORRUPT).alias("line"))


def with_sample(df: DataFrame, ids: list[str], name: str = "Sample") -> DataFrame:
    """Adds the sample id from the first of some columns that there is."""
    for c in ids:
        if c in df.columns:
            return df.withColumn(name, F.col(f"`{c}`").cast("string"))
    raise KeyError(f"none of {ids} is a column")


def label_sheet(spark: SparkSession, path: str, first: str) -> DataFrame:
    """A wide sheet of labels whose first column must be ``first``; the others are numbers."""
    names = _header(spark, path, ",")
    if not names or names[0] != first:
        raise ValueError(f"the first column is {names[:1]}, not {first!r}")
    df = delimited(spark, path)
    return df.select(F.col(f"`{first}`"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names[1:]]).withColumn("Sample", F.col(f"`{first}`"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths, one in each line, trimmed, without blanks; an error if there is none."""
    df = spark.read.text(path).select(F.trim("value").alias("path")).where(F.length("path") > 0)
    if df.isEmpty():
        raise ValueError(f"no paths in {path}")
    return df


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(``path``, ``length``) of the files in a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path", "length")


def first_files(files: DataFrame, n: int | None) -> DataFrame:
    """The first n paths in order; all for 0 or nothing."""
    ordered = files.orderBy("path")
    return ordered.limit(n) if n and n > 0 else ordered


def found_files(spark: SparkSession, folder: str, pattern: str, n: int | None = None) -> DataFrame:
    """Files below a folder in order; with a positive n any n of them, without listing order, then sorted."""
    files = listing(spark, folder, pattern, True)
    return (files.limit(n) if n and n > 0 else files).orderBy("path")


def samples_in(files: DataFrame, by: Column) -> DataFrame:
    """Different sample ids among files, by an expression over ``path``."""
    return files.select(by.alias("sample")).where("sample is not null and sample <> ''").distinct()


def presence_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(feature, ``sample``) of the ones in a tab-separated 0/1 matrix."""
    from cohortloom.operators.pangenome import long_presence

    return long_presence(delimited(spark, path, "\t"), _header(spark, path, "\t")[0])


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def parquet_profile(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a parquet folder, and its rows, from metadata."""
    df = spark.read.parquet(path)
    files = listing(spark, path, "*.parquet", True) if not path.endswith(".parquet") else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")).withColumn("n_rows", F.lit(df.count()).cast("long")).withColumn("n_columns", F.lit(len(df.columns)))


def shared_columns(frames: list[DataFrame]) -> list[str]:
    """Columns that all have, in the order of the first."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames)] if frames else []


def value_kinds(df: DataFrame) -> dict[str, str]:
    """scalar, string, list or nested list, for each column."""
    kind = lambda t: "nested list" if t.startswith("array<array") else "list" if t.startswith("array") else "string" if t == "string" else "scalar"
    return {c: kind(t) for c, t in df.dtypes}


def value_profile(df: DataFrame) -> DataFrame:
    """(``column``, ``kind``, ``n_known``, ``shortest``, ``longest``, ``n_elements``) of every column in one pass.

    Lengths are characters of texts and entries of lists; elements of nested lists are those
    of the inner ones. Scalars have none.
    """
    kinds, sums, rows = value_kinds(df), [], []
    for k, (c, kind) in enumerate(kinds.items()):
        x = F.col(f"`{c}`")
        size = (F.length(x) if kind == "string" else F.when(x.isNotNull(), F.size(x)) if "list" in kind else F.lit(None)).cast("long")
        inner = F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(F.when(v.isNotNull(), F.size(v)), F.lit(0))) if kind == "nested list" else size
        sums += [F.count(x).alias(f"_n{k}"), F.min(size).alias(f"_s{k}"), F.max(size).alias(f"_l{k}"), F.sum(inner).alias(f"_e{k}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(f"_n{k}").alias("n_known"), F.col(f"_s{k}").alias("shortest"), F.col(f"_l{k}").alias("longest"), F.col(f"_e{k}").alias("n_elements")))
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """(``path``, ``n_bytes``, ``n_row_groups``, ``n_rows``, ``n_columns``) of parquet files, from their footers, read where tasks run."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            out = []
            for p, n in zip(b["path"], b["length"], strict=True):
                system, inside = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                with system.open_input_file(inside) as f:
                    meta = pq.read_metadata(f)
                out.append((p, n, meta.num_row_groups, meta.num_rows, len(meta.schema.to_arrow_schema())))
            yield pd.DataFrame(out, columns=["path", "n_bytes", "n_row_groups", "n_rows", "n_columns"])

    return listing(spark, folder, "*.parquet", True).mapInPandas(run, "path string, n_bytes bigint, n_row_groups bigint, n_rows bigint, n_columns bigint")


def schema_rows(df: DataFrame) -> DataFrame:
    """(``place``, ``column``, ``type``) of a table's columns."""
    return df.sparkSession.createDataFrame([(k, c, t) for k, (c, t) in enumerate(df.dtypes, 1)], "place int, column string, type string")


def annotated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Rows with their vectors, the table of samples, and the parameters that ``sinks.annotated`` wrote."""
    params = {r.name: r.value for r in spark.read.parquet(f"{folder}/params").collect()}  # as many as were stated
    return spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/samples"), params


def parsed_files(spark: SparkSession, folder: str, parse, schema: str, pattern: str = "*") -> DataFrame:  # noqa: ANN001
    """Rows that ``parse(path, content)`` yields for each file; files are parsed where they are read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b["path"], b["content"], strict=True) for r in parse(p, bytes(c))], columns=names)

    return raw.mapInPandas(run, schema)
