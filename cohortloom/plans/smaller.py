"""Queries of the smaller operators: reports, names, profiles, preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import stats, text
from cohortloom.operators import batching, cohort, contingency, reconcile, resolve, rollup, split, testing, vectors
from cohortloom.sources import readers

from .registry import query, r6

S1, S2 = "blood & sterile fluids", "faeces / rectal swab"


# Counts and reports


@query("SELECT sample, count(*) AS n FROM ast_records GROUP BY 1 HAVING count(*) < 60 AND count(*) > 50")
def dropped_counts(t):  # noqa: ANN001, ANN201
    return rollup.dropped_counts(t("ast_records"), "sample", 60, 50)


PER_SAMPLE = "SELECT sample, count(*) AS n_rows, sum(x)::DOUBLE AS total FROM baskets GROUP BY 1"


@query(f"""SELECT 'n_rows' AS "column", count(n_rows) AS n, round(avg(n_rows), 6)::DOUBLE AS mean, min(n_rows)::DOUBLE AS least, max(n_rows)::DOUBLE AS most FROM ({PER_SAMPLE})
  UNION ALL SELECT 'total', count(total), round(avg(total), 6), min(total), max(total) FROM ({PER_SAMPLE})""")
def count_spread(t):  # noqa: ANN001, ANN201
    per = t("baskets").groupBy("sample").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("total"))
    return rollup.spread(per, ["n_rows", "total"]).select("column", "n", *r6("mean"), "least", "most")


@query("SELECT category AS grp, count(*) AS n, sum((host = 'human')::INT)::BIGINT AS n_human, arg_min(country, sample) AS country FROM sample_meta GROUP BY 1 HAVING count(*) > 20")
def large_groups_first(t):  # noqa: ANN001, ANN201
    return batching.large_groups(t("sample_meta").withColumnRenamed("category", "grp"), "grp", 20, {"n_human": "host = 'human'"}, {"country": "sample"})


@query(f"SELECT country, sum((category = '{S1}')::INT)::BIGINT AS n_first, sum((category = '{S2}')::INT)::BIGINT AS n_second, count(*) AS n_all FROM sample_meta WHERE country NOT IN ('src0', 'src3') GROUP BY 1")
def breakdown_excluding(t):  # noqa: ANN001, ANN201
    return contingency.breakdown(t("sample_meta"), "country", "category", S1, S2, exclude=("src0", "src3"))


@query("SELECT * FROM (SELECT country, min(sample) AS first FROM sample_meta WHERE country IS NOT NULL GROUP BY 1) ORDER BY first, country LIMIT 3")
def distinct_first_three(t):  # noqa: ANN001, ANN201
    return reconcile.distinct_in_order(t("sample_meta"), "country", "sample", 3)


OPEN = "SELECT accession FROM expected_ids WHERE NOT coalesce(lower(done) IN ('true', '1', 'yes'), false) AND accession LIKE 'SAM%'"


@query(OPEN)
def ids_to_fetch_all(t):  # noqa: ANN001, ANN201
    return reconcile.ids_to_fetch(t("expected_ids"), "accession", "done", "SAM", n=-1)[0]


@query(f"{OPEN} LIMIT 0")
def ids_to_fetch_none(t):  # noqa: ANN001, ANN201
    return reconcile.ids_to_fetch(t("expected_ids"), "accession", "done", "SAM", n=0)[0]


# Filters and unions


@query("SELECT sample, accession FROM expected_ids WHERE coalesce(lower(done) IN ('true', '1', 'yes'), false)")
def flag_filter(t):  # noqa: ANN001, ANN201
    rows = t("expected_ids").withColumn("known", text.truthy(F.col("done")))
    return cohort.flagged_only(rows, "known").select("sample", "accession")


@query("SELECT record, sample, country FROM ast_records WHERE country = 'C3' OR country IS NULL")
def group_or_none(t):  # noqa: ANN001, ANN201
    return cohort.in_group_or_none(t("ast_records"), "country", "C3").select("record", "sample", "country")


@query("SELECT record AS \"lab-record\", sample AS \"BioSample\", antibiotic AS drug, host AS \"host organism\" FROM ast_records")
def renamed_columns(t):  # noqa: ANN001, ANN201
    return rollup.renamed(t("ast_records"), {"record": "lab-record", "sample": "BioSample", "antibiotic": "drug", "host": "host organism"})


@query("SELECT sample, segment FROM expected_ids")
def requested_columns(t):  # noqa: ANN001, ANN201
    return reconcile.requested(t("expected_ids"), ["sample", "nowhere", "segment"], "sample")[0]


@query("SELECT sample, CAST(sample AS VARCHAR) AS \"Sample id\" FROM expected_ids")
def first_present_column(t):  # noqa: ANN001, ANN201
    df = t("expected_ids")
    return readers.with_sample(df, ["biosample", resolve.first_present(df, ["genome", "sample"])], "Sample id").select("sample", "Sample id")


@query("SELECT e.sample FROM expected_ids e WHERE sample NOT IN (SELECT sample FROM present_ids) OR sample NOT IN (SELECT sample FROM mapping)")
def both_outputs_missing(t):  # noqa: ANN001, ANN201
    return reconcile.both_present(t("expected_ids").select("sample"), "sample", t("present_ids"), t("mapping"))


@query("SELECT segment, count(*) + 1 AS n, sum((accession = 'REF')::INT)::BIGINT + 1 AS n_reference FROM expected_ids WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def reference_rows(t):  # noqa: ANN001, ANN201
    df = t("expected_ids").where("segment in ('BUILDING', 'MACHINERY')")
    reference = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("sample"), F.lit("REF").alias("accession"), F.lit(None).cast("string").alias("done"), F.lit("").alias("segment"))
    out = reconcile.with_reference(df.withColumn("sample", F.col("sample").cast("long")), reference, ["BUILDING", "MACHINERY"], "segment")
    return out.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("accession") == "REF").cast("long")).alias("n_reference"))


# Names


@query("SELECT record, regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem, replace(regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1'), '.1_ASM', '') AS sample, replace(path, '/a/b', '') AS relative FROM path_list")
def names_from_paths(t):  # noqa: ANN001, ANN201
    p = F.col("path")
    return t("path_list").select("record", text.stem_without(p, "|").alias("stem"), text.stem_without(p, ".1_ASM").alias("sample"), text.without_prefix(p, "/a/b").alias("relative"))


@query("""SELECT unnest(['label', 'output', 'sheet', 'suffix', 'train', 'validate']) AS name, unnest(['blood_vs_rectal_swab_label', '/x/training_blood_rectal_swab/finetuned_lr_0.01',
  '/x/training_blood_rectal_swab/binary_blood_vs_rectal_swab_with_split.csv', '_with_blood_vs_rectal_swab.pt', '/x/training_blood_rectal_swab/train', '/x/training_blood_rectal_swab/validate']) AS value""")
def run_names(t):  # noqa: ANN001, ANN201
    return _rows(t, sorted(text.run_names("Blood", "rectal swab", "/x/", 0.01).items()), "name string, value string")


def _rows(t, rows: list, schema: str) -> DataFrame:  # noqa: ANN001
    return t("run_summary").sparkSession.createDataFrame(rows, schema)


@query("SELECT record, n AS ratio, CASE WHEN n <= 0 THEN 0 ELSE 1 / n END::DOUBLE AS low, CASE WHEN n <= 0 THEN 'inf'::DOUBLE ELSE n END AS high FROM (SELECT record, x - 10 AS n FROM baskets)")
def ratio_bounds(t):  # noqa: ANN001, ANN201
    low, high = stats.bounds_of(F.col("x") - 10)
    return t("baskets").select("record", (F.col("x") - 10).alias("ratio"), low.alias("low"), high.alias("high"))


@query("SELECT unnest(['steps_per_epoch', 'total_steps', 'warmup_steps']) AS name, unnest([(n + 15) // 16 // 4, (n + 15) // 16 // 4 * 10, CAST(floor((n + 15) // 16 // 4 * 10 * 0.1::DOUBLE) AS BIGINT)])::BIGINT AS n FROM (SELECT count(*) AS n FROM ast_records)")
def training_steps(t):  # noqa: ANN001, ANN201
    return _rows(t, list(split.steps(t("ast_records").count(), 16, 4, 10, 0.1).items()), "name string, n bigint")


# Categories and splits


@query("""SELECT (SELECT DISTINCT category FROM sample_meta WHERE regexp_matches(lower(category), '(^|[^a-z0-9])blood([^a-z0-9]|$)')) AS first,
  (SELECT DISTINCT category FROM sample_meta WHERE regexp_matches(lower(category), '(^|[^a-z0-9])swab([^a-z0-9]|$)')) AS second""")
def resolved_pair(t):  # noqa: ANN001, ANN201
    return _rows(t, [resolve.resolve_pair(t("sample_meta"), "category", "Blood", "swab")], "first string, second string")


@query("SELECT category, count(*) AS n FROM sample_meta WHERE regexp_matches(lower(category), '(^|[^a-z0-9])rectal([^a-z0-9]|$)') GROUP BY 1")
def matching_categories(t):  # noqa: ANN001, ANN201
    return resolve.matching(t("sample_meta"), "category", "rectal")


@query("""WITH s AS (SELECT segment, count(DISTINCT sample) AS size FROM expected_ids GROUP BY 1), k AS (SELECT segment, size, CAST(floor(0.7::DOUBLE * size) AS BIGINT) AS a, CAST(floor(0.1::DOUBLE * size) AS BIGINT) AS b FROM s)
  SELECT segment, 'train' AS split, a AS n FROM k WHERE a > 0 UNION ALL SELECT segment, 'validate', b FROM k WHERE b > 0 UNION ALL SELECT segment, 'evaluate', size - a - b FROM k""")
def split_sizes(t):  # noqa: ANN001, ANN201
    """Each segment is split on its own; there are five."""
    df = t("expected_ids").select("segment", "sample")
    names = sorted(r[0] for r in df.select("segment").distinct().collect())
    one = lambda s: split.with_splits(df.where(F.col("segment") == s), "sample", name="split").groupBy("segment", "split").agg(F.count(F.lit(1)).alias("n"))
    return cohort.united([one(s) for s in names])


SPLIT = """SELECT sample, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train' WHEN k <= floor(0.7::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'validate' ELSE 'evaluate' END AS split
  FROM (SELECT sample, row_number() OVER (ORDER BY md5('1:' || sample), sample) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT sample FROM expected_ids))"""


@query(f"WITH s AS (SELECT sample FROM ({SPLIT}) WHERE split = 'train' ORDER BY sample LIMIT 10) SELECT sample, 'train' AS split FROM s UNION ALL SELECT sample, 'validate' FROM s")
def smoke_sample(t):  # noqa: ANN001, ANN201
    return split.smoke_sample(split.with_splits(t("expected_ids").select("sample"), "sample", name="split"), "sample", "split")


@query("SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS label")
def label_columns(t):  # noqa: ANN001, ANN201
    wide = split.with_splits(rollup.pivot_mean(t("ast_records").withColumn("y", F.col("year").cast("double")), "sample", "antibiotic", "y"), "sample")
    return _rows(t, [(c,) for c in split.helper_free(wide.columns, {"sample", "train_val_eval"})], "label string")


@query("SELECT unnest(['sample', 'record']) AS \"column\"")
def shared_columns(t):  # noqa: ANN001, ANN201
    names = readers.shared_columns([t("mapping"), t("baskets"), t("ast_records")])
    return _rows(t, [(c,) for c in names], "column string")


# Profiles and vectors


@query("""SELECT 'sample' AS "column", 'scalar' AS kind, count(*) AS n_known, NULL::BIGINT AS shortest, NULL::BIGINT AS longest, NULL::BIGINT AS n_elements FROM genes
  UNION ALL SELECT 'vector', 'list', count(*), min(len(embedding)), max(len(embedding)), sum(len(embedding))::BIGINT FROM genes
  UNION ALL SELECT 'batch', 'nested list', count(*), 1, 1, sum(len(embedding))::BIGINT FROM genes
  UNION ALL SELECT 'name', 'string', count(*), min(length('g' || gene)), max(length('g' || gene)), sum(length('g' || gene))::BIGINT FROM genes""")
def value_profile(t):  # noqa: ANN001, ANN201
    df = t("genes").select("sample", F.col("embedding").alias("vector"), vectors.unsqueezed(F.col("embedding")).alias("batch"), F.concat(F.lit("g"), F.col("gene").cast("string")).alias("name"))
    return readers.value_profile(df)


@query("SELECT gene, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM genes")
def squeezed_vectors(t):  # noqa: ANN001, ANN201
    v = vectors.squeezed(vectors.unsqueezed(F.col("embedding").cast("array<double>")))
    return t("genes").select("gene", F.posexplode(v).alias("dim", "x"))


@query("SELECT gene, CASE WHEN sample % 3 = 0 THEN sample WHEN sample % 3 = 1 THEN gene ELSE 0 END::BIGINT AS idx FROM genes")
def first_of_columns(t):  # noqa: ANN001, ANN201
    df = t("genes").withColumn("contig_idx", F.when(F.col("sample") % 3 == 0, F.col("sample"))).withColumn("contig_ids", F.when(F.col("sample") % 3 == 1, F.col("gene").cast("long")))
    return df.select("gene", vectors.first_of_columns(df, ["contig_idx", "contig_ids", "token_type_ids"], F.lit(0).cast("long")).alias("idx"))


@query("SELECT record, coalesce(CAST(year AS VARCHAR), 'nan') AS year, coalesce(country, 'nan') AS country FROM ast_records")
def columns_as_text(t):  # noqa: ANN001, ANN201
    return reconcile.as_text(t("ast_records").select("record", "year", "country"), ["year", "country"])


# Tests


@query("""WITH k AS (SELECT *, CASE WHEN strain = 'common' THEN n_samples ELSE in_strain END AS size FROM run_table WHERE kind IN ('whole', 'split')),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strain, n_lineages ORDER BY n_samples DESC, segment) AS r FROM k) WHERE r = 1)
  SELECT CASE WHEN strain = 'common' THEN 'rare ' || row_number() OVER (PARTITION BY strain ORDER BY n_lineages, size DESC) ELSE strain END AS strain, n_lineages, segment, n_samples, size AS in_strain,
  CASE strain WHEN 'CHINA' THEN 'G1' WHEN 'INDIA' THEN 'G1' WHEN 'JAPAN' THEN 'G2' END AS major FROM b""")
def summary_prepared(t):  # noqa: ANN001, ANN201
    names = testing.Summary("strain", "kind", "n_lineages", "n_samples", "in_strain")
    columns = ["strain", "n_lineages", "segment", "n_samples", "in_strain"]
    return testing.prepared(t("run_table"), names, ["whole", "split"], columns, "common", "rare", {"CHINA": "G1", "INDIA": "G1", "JAPAN": "G2"}, ties="segment")


@query("""WITH r AS (SELECT *, sd_size * sd_size / n AS v FROM run_summary WHERE n > 1 AND sd_size > 0), q AS (SELECT sum(n * n * v) / (sum(n) * sum(n)) AS rv FROM r WHERE n_lineages > 1)
  SELECT strain, round(1.96::DOUBLE * sqrt(v + rv), 4) AS lower, round(1.96::DOUBLE * sqrt(v + rv), 4) AS upper FROM r, q WHERE n_lineages = 1""")
def error_bars(t):  # noqa: ANN001, ANN201
    out = testing.error_bars(testing.z_tests(t("run_summary"), "strain", "mean_size", "sd_size", "n", "n_lineages"))
    return out.select("strain", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


# Files and logs, from tables of their paths and lines


@query("SELECT path, '/flat/' || split_part(path, '/', -1) AS target FROM path_list WHERE record % 9 <> 0")
def flattened_moves(t):  # noqa: ANN001, ANN201
    there = t("path_list").where("record % 9 = 0").select(F.concat(F.lit("/flat/"), text.basename(F.col("path"))))
    return reconcile.flattened(t("path_list"), "/flat", text.basename(F.col("path")), there)[0]


@query("SELECT path, '/flat/' || split_part(path, '.', -2) AS target FROM path_list WHERE split_part(path, '.', -2) IN (SELECT split_part(path, '.', -2) FROM path_list GROUP BY 1 HAVING count(*) > 1)")
def flattened_refused(t):  # noqa: ANN001, ANN201
    return reconcile.flattened(t("path_list"), "/flat", F.element_at(F.split("path", "[.]"), -2))[1]


@query("""SELECT 'batch_' || batch AS batch, n AS n_lines, CASE WHEN bad THEN 'failed' WHEN ok THEN 'success' ELSE 'open' END AS outcome FROM (
  SELECT sample % 40 AS batch, count(*) AS n, bool_or(coalesce(done = 'True', false)) AS ok, bool_or(coalesce(done = '1', false) AND sample % 8 = 1) AS bad FROM expected_ids GROUP BY 1)""")
def batch_outcomes(t):  # noqa: ANN001, ANN201
    line = F.when(F.col("done") == "True", "[t] SUCCESS: b").when((F.col("done") == "1") & (F.col("sample") % 8 == 1), "[t] FAILED: b").otherwise(F.col("done"))
    lines = t("expected_ids").select(F.concat(F.lit("batch_"), (F.col("sample") % 40).cast("string")).alias("batch"), line.alias("line"))
    return reconcile.batch_outcomes(lines, "batch", "line")


@query("""SELECT regexp_extract(path, '([0-9]+)[.]1_', 1) AS sample, min(CASE WHEN path LIKE '%.fa.gz' THEN path END) AS genome, min(CASE WHEN path LIKE '%.gff3.gz' THEN path END) AS genes FROM path_list GROUP BY 1""")
def paths_by_sample(t):  # noqa: ANN001, ANN201
    return reconcile.paths_by_sample(t("path_list"), F.regexp_extract("path", "([0-9]+)[.]1_", 1), {"genome": ".fa.gz", "genes": ".gff3.gz"})
