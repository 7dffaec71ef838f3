"""What metadata says against what is there: look-ups, flags, missing ids, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.text import base_accession, truthy

#: Rows of the whole collection, and its terabytes, by which sizes are estimated; a quota in GiB.
COLLECTION_ROWS, COLLECTION_TB, QUOTA_GIB = 1_683_600, 14.7, 100
#: Substrings of so many different lengths are looked up whole; of longer ones a beginning is, and the rest compared.
STEM_LENGTHS = 32


def left_mapped(df: DataFrame, key: str, mapping: DataFrame, map_key: str) -> DataFrame:
    """All rows with the mapping's columns; repeated mappings multiply rows."""
    m = mapping.select(F.col(map_key).alias("_k"), *[c for c in mapping.columns if c != map_key])
    return df.join(m, F.col(key) == F.col("_k"), "left").drop("_k")


def first_of(mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value for each key: the first by ``order``."""
    return mapping.groupBy(key).agg(F.min_by(value, order).alias(value))


def looked_up(df: DataFrame, key: Column, mapping: DataFrame, map_key: str, value: str, order: str, name: str) -> DataFrame:
    """Adds ``name`` from a dictionary; unlike a join it never multiplies rows."""
    m = first_of(mapping, map_key, value, order).select(F.col(map_key).alias("_k"), F.col(value).alias("_v"))
    return df.withColumn("_key", key).join(m, F.col("_key") == F.col("_k"), "left").withColumn(name, F.col("_v")).drop("_key", "_k", "_v")


def looked_up_in_either(df: DataFrame, key: Column, use_first: Column, first: DataFrame, second: DataFrame, map_key: str, value: str, order: str, name: str) -> DataFrame:
    """From one of two dictionaries; an unknown flag means the first."""
    out = looked_up(looked_up(df, key, first, map_key, value, order, "_a"), key, second, map_key, value, order, "_b")
    return out.withColumn(name, F.when(use_first, F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b")


def flagged(df: DataFrame, key: str, present: DataFrame, name: str) -> DataFrame:
    """Adds whether the key is present."""
    there = present.select(F.col(present.columns[0]).alias("_k")).where("_k is not null").distinct()
    return df.join(there, F.col(key) == F.col("_k"), "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")


def missing(df: DataFrame, key: str, present: DataFrame, prefix: str = "") -> DataFrame:
    """Rows expected (by a prefix of their key) that are not present; repeated rows stay as they are."""
    expected = df.where(F.col(key).startswith(prefix)) if prefix else df.where(F.col(key).isNotNull())
    there = present.select(F.col(present.columns[0]).alias("_k"))
    return expected.join(there, F.col(key) == F.col("_k"), "left_anti")


def without_substrings(df: DataFrame, column: str, stems: DataFrame) -> DataFrame:
    """Rows in whose column no stem stands anywhere; nulls stay, and an empty stem stands in every text.

    Each different value is cut into its stretches of the lengths that stems have, and
    these are joined with the stems by equality, so that no row meets all stems. Both
    sides grow with the input and Spark takes computed texts for short ones, so the
    hints keep it from sending one of them through the driver.
    """
    s = stems.select(F.col(stems.columns[0]).alias("_stem")).where("_stem is not null").distinct()
    sizes = [r[0] for r in s.select(F.length("_stem").alias("n")).distinct().orderBy("n").limit(STEM_LENGTHS).collect()]
    if not sizes:
        return df
    if sizes[0] == 0:
        return df.where(F.col(column).isNull())
    s = s.withColumn("_part", F.substring("_stem", 1, sizes[-1]))
    values = df.select(F.col(column).alias("_value")).where("_value is not null").distinct()
    place = lambda n: F.transform(F.sequence(F.lit(1), F.length("_value") - n + 1), lambda i: F.substring(F.col("_value"), i, F.lit(n)))
    parts = [F.when(F.length("_value") >= n, place(n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    cut = values.select("_value", F.explode(F.array_distinct(F.concat(*parts))).alias("_part"))
    hit = cut.join(s.hint("merge"), "_part").where(F.col("_value").contains(F.col("_stem"))).select("_value").distinct()
    return df.join(hit.hint("merge"), F.col(column) == F.col("_value"), "left_anti")


def aligned(keys: DataFrame, key: str, meta: DataFrame, meta_key: str) -> DataFrame:
    """Metadata in terms of the keys of another table, null where there is none."""
    m = meta.select(F.col(meta_key).alias("_k"), *[c for c in meta.columns if c != meta_key])
    return keys.join(m, F.col(key) == F.col("_k"), "left").withColumn("found", F.col("_k").isNotNull()).drop("_k")


def coverage(files: DataFrame, file_key: str, used: DataFrame, used_key: str) -> DataFrame:
    """Files, those matched at least once, and whether all are; null if there are no files."""
    total = files.agg(F.countDistinct(file_key).alias("n_files"))
    hit = files.select(file_key).distinct().join(used.select(F.col(used_key).alias("_u")), F.col(file_key) == F.col("_u"), "left_semi").agg(F.count(F.lit(1)).alias("n_used"))
    return total.join(F.broadcast(hit)).withColumn("all_used", F.when(F.col("n_files") > 0, F.col("n_files") == F.col("n_used")))


def size_estimate(matched: DataFrame) -> DataFrame:
    """Share of the collection that was matched, its size, and whether that fits the quota."""
    n = matched.agg(F.count(F.lit(1)).alias("n_matched"))
    gib = F.col("n_matched") / COLLECTION_ROWS * COLLECTION_TB * 1e12 / 2**30
    return n.withColumn("gib", gib).withColumn("fits", gib <= QUOTA_GIB)


def prefix_counts(df: DataFrame, column: str, size: int = 3, top: int = 10) -> DataFrame:
    out = df.where(F.col(column).isNotNull()).groupBy(F.substring(column, 1, size).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "prefix").limit(top)


def limited(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an order; all if n is negative, none if it is 0."""
    return df if n < 0 else df.orderBy(*order).limit(n)


def accessions_to_fetch(df: DataFrame, id: str, done: str, order: str, stems: DataFrame | None = None, n: int = -1, all_rows: bool = False) -> DataFrame:
    """Base accessions (``GCF_``, ``GCA_``) not fetched yet, in the order in which they first appear."""
    rows = df if all_rows else df.where(~truthy(F.col(done)))
    if stems is not None:
        rows = without_substrings(rows, id, stems)
    rows = rows.where(F.col(id).startswith("GCF_") | F.col(id).startswith("GCA_"))
    out = rows.groupBy(base_accession(F.col(id)).alias("accession")).agg(F.min(order).alias("first"))
    return limited(out, n, "first")


def both_present(ids: DataFrame, id: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids that lack one of two outputs, and so are still to be done."""
    done = first.select(id).distinct().join(second.select(id), id, "left_semi")
    return ids.join(done, id, "left_anti")


def requested(df: DataFrame, columns: list[str], id: str) -> tuple[DataFrame, list[str]]:
    """The requested columns that there are (at least the id), and those that there are not."""
    there = [c for c in columns if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in there or [id]]), [c for c in columns if c not in df.columns]


def constant_mapped(df: DataFrame, column: str, values: dict[str, str], name: str) -> DataFrame:
    """Adds what a literal dictionary has for a column, null where it has nothing."""
    if not values:
        return df.withColumn(name, F.lit(None).cast("string"))
    pairs = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    return df.withColumn(name, F.try_element_at(pairs, F.col(column)))


def with_reference(df: DataFrame, reference: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Appends the same reference rows to each of some groups (a stated, short list)."""
    rows = reference.drop(column).withColumn(column, F.explode(F.array(*map(F.lit, groups))))
    return df.unionByName(rows.select(*df.columns))


def distinct_in_order(df: DataFrame, column: str, order: str, n: int = -1) -> DataFrame:
    """Different values in the order in which they first appear; the first n of them unless n is negative."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first"))
    return out.orderBy("first", column) if n < 0 else limited(out, n, "first", column)


def ids_to_fetch(df: DataFrame, id: str, done: str, prefix: str, skip_done: bool = True, n: int = -1) -> tuple[DataFrame, DataFrame]:
    """Ids with a prefix that are not done yet, and the rows left after each filter."""
    from .cohort import funnel_counts

    open_ = ~truthy(F.col(done)) if skip_done else F.lit(True)
    counts = funnel_counts(df, [("all", None), ("not_done", open_), ("prefix", F.col(id).startswith(prefix))])
    return limited(df.where(open_ & F.col(id).startswith(prefix)).select(id), n, id), counts


def reconciled(df: DataFrame, id: str, present: DataFrame, flag: str, columns: list[str], prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table with its flag set, rows present and absent, and the expected ids that are missing with some columns."""
    out = flagged(df.drop(flag), id, present, flag)
    counts = out.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))
    return out, counts, requested(missing(df, id, present, prefix), columns, id)[0]


def file_list(df: DataFrame, id: str, files: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Paths of the files named ``<id><suffix>`` that exist, and the ids without one."""
    from cohortloom.functions.text import basename

    names = files.select("path", basename(F.col("path")).alias("_name"))
    wanted = df.select(id).where(F.col(id).isNotNull()).distinct().withColumn("_name", F.concat(F.col(id).cast("string"), F.lit(suffix)))
    return wanted.join(names, "_name").select(id, "path"), wanted.join(names, "_name", "left_anti").select(id)


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text, with ``nan`` for nulls, as a writer of mixed columns leaves them."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns})


def flattened(files: DataFrame, folder: str, name: Column, present: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Moves of nested files into one folder (``path``, ``target``), and those refused.

    A move is refused if its target is there already, or if several files would share it.
    """
    moves = files.select("path", F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("target"))
    taken = moves.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("target")
    if present is not None:
        taken = taken.union(present.select(F.col(present.columns[0]).alias("target"))).distinct()
    return moves.join(taken, "target", "left_anti").select("path", "target"), moves.join(taken, "target", "left_semi").select("path", "target")


def batch_outcomes(lines: DataFrame, batch: str, line: str) -> DataFrame:
    """For each batch of a log its lines and whether it succeeded, failed, or did neither (``open``).

    A batch with a line of both kinds counts as failed.
    """
    has = lambda word: F.max(F.coalesce(F.col(line).contains(f"{word}:"), F.lit(False)))
    out = lines.groupBy(batch).agg(F.count(F.lit(1)).alias("n_lines"), has("SUCCESS").alias("_ok"), has("FAILED").alias("_bad"))
    return out.select(batch, "n_lines", F.when(F.col("_bad"), "failed").when(F.col("_ok"), "success").otherwise("open").alias("outcome"))


def paths_by_sample(files: DataFrame, sample: Column, suffixes: dict[str, str]) -> DataFrame:
    """(``sample``, and a path for each named suffix): one row for each sample, null where a file is lacking, the least path of several."""
    one = lambda name, suffix: F.min(F.when(F.col("path").endswith(suffix), F.col("path"))).alias(name)
    return files.withColumn("sample", sample).where(F.col("sample").isNotNull()).groupBy("sample").agg(*[one(k, v) for k, v in suffixes.items()])
