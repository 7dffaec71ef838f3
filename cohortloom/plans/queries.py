"""The operators as registered queries over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import measure, stats, text
from cohortloom.operators import batching, cohort, communities, contingency, metrics, neighbours, pangenome, reconcile, resolve, rollup, split, testing, vectors

from .registry import ORACLE_SQL, QUERIES, query, r6  # noqa: F401

# Measurements and phenotypes

OP, NUM = "split_part(trim(measurement), ' ', 1)", "split_part(trim(measurement), ' ', 2)"
PARSED = f"""
  SELECT *, CASE WHEN measurement IS NULL THEN NULL WHEN {NUM} = '' THEN 'parts' WHEN {OP} NOT IN ('>','<','>=','<=','=','==') THEN 'operator'
    WHEN NOT regexp_full_match({NUM}, '\\d*\\.?\\d+(/\\d+.*)?') THEN 'number' END AS reason FROM ast_records"""
VALUED = f"SELECT *, CASE WHEN reason IS NULL AND measurement IS NOT NULL THEN {OP} END AS op, CASE WHEN reason IS NULL AND measurement IS NOT NULL THEN CAST(split_part({NUM}, '/', 1) AS DOUBLE) END AS v FROM ({PARSED})"
LOGGED = f"SELECT *, CASE WHEN v = 0 THEN CAST('-inf' AS DOUBLE) ELSE log10(v) END + CASE op WHEN '<' THEN -1 WHEN '>' THEN 1 ELSE 0 END AS lg FROM ({VALUED})"
BINARY = "CASE lower(phenotype) WHEN 'resistant' THEN 1 WHEN 'susceptible' THEN 0 END"


def parsed(t) -> DataFrame:  # noqa: ANN001
    df = t("ast_records")
    m = F.col("measurement")
    df = df.withColumn("op", measure.operator(m)).withColumn("value", measure.number(m))
    return df.withColumn("log_mic", measure.log_value(F.col("value"), F.col("op"))).withColumn("binary", measure.binary_phenotype(F.col("phenotype")))


@query(f"SELECT record, op, v AS value, round(lg, 6) AS log_mic FROM ({LOGGED})")
def mic_parse(t):  # noqa: ANN001, ANN201
    return parsed(t).select("record", "op", "value", *r6("log_mic"))


@query(f"SELECT record, measurement AS raw, reason FROM ({PARSED}) WHERE reason IS NOT NULL")
def mic_rejects(t):  # noqa: ANN001, ANN201
    return t("ast_records").select("record", F.col("measurement").alias("raw"), measure.reject_reason(F.col("measurement")).alias("reason")).where("reason is not null")


@query(f"SELECT record, {BINARY} AS binary FROM ast_records")
def phenotype_binary(t):  # noqa: ANN001, ANN201
    return t("ast_records").select("record", measure.binary_phenotype(F.col("phenotype")).alias("binary"))


def _kept(t) -> DataFrame:  # noqa: ANN001
    """Antibiotics with at least a sixth of all rows."""
    df = t("ast_records")
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    n = df.groupBy("antibiotic").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).where("n * 6 >= _all")
    return df.join(n.select("antibiotic"), "antibiotic", "left_semi")


KEPT = "SELECT * FROM ast_records WHERE antibiotic IN (SELECT antibiotic FROM ast_records GROUP BY 1 HAVING count(*) * 6 >= (SELECT count(*) FROM ast_records))"
STATS = """count(*) AS n_total, sum((lower(phenotype) = 'resistant')::INT)::BIGINT AS r, sum((lower(phenotype) = 'susceptible')::INT)::BIGINT AS s, sum((lower(phenotype) = 'intermediate')::INT)::BIGINT AS i"""


def _stats_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, n_total, coalesce(r, 0)::BIGINT AS n_r, coalesce(s, 0)::BIGINT AS n_s, coalesce(i, 0)::BIGINT AS n_i, (n_total - coalesce(r + s + i, 0))::BIGINT AS n_other,
      round(CASE WHEN r + s + i > 0 THEN 100.0 * r / (r + s + i) ELSE 0 END, 6)::DOUBLE AS r_percent, round(CASE WHEN r + s + i > 0 THEN 100.0 * s / (r + s + i) ELSE 0 END, 6)::DOUBLE AS s_percent
      FROM (SELECT {by}, {STATS} FROM ({source}) GROUP BY {by})"""


@query(f"SELECT antibiotic, count(*) AS n FROM ({KEPT}) GROUP BY 1")
def antibiotic_having(t):  # noqa: ANN001, ANN201
    return _kept(t).groupBy("antibiotic").agg(F.count(F.lit(1)).alias("n"))


@query(_stats_sql(KEPT, "antibiotic"))
def antibiogram(t):  # noqa: ANN001, ANN201
    out = rollup.test_stats(_kept(t), "antibiotic", "phenotype").orderBy(F.desc("r_percent"), "antibiotic")
    return out.select("antibiotic", "n_total", "n_r", "n_s", "n_i", "n_other", *r6("r_percent", "s_percent"))


@query(f"SELECT * FROM ({_stats_sql(KEPT, 'antibiotic')}) WHERE n_total > (SELECT avg(n) FROM (SELECT count(*) AS n FROM ast_records GROUP BY antibiotic))")
def reporting_subset(t):  # noqa: ANN001, ANN201
    df = t("ast_records")
    mean = df.groupBy("antibiotic").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("_mean"))
    out = rollup.test_stats(_kept(t), "antibiotic", "phenotype").join(F.broadcast(mean)).where("n_total > _mean")
    return out.select("antibiotic", "n_total", "n_r", "n_s", "n_i", "n_other", *r6("r_percent", "s_percent"))


@query(f"""SELECT host, antibiotic, n_total, r_percent, round(CASE WHEN n_total < 100 OR tested < 100 THEN 0 ELSE least(1.0, 100.0 * tested / n_total / 100) END, 6)::DOUBLE AS opacity
  FROM (SELECT *, n_r + n_s + n_i AS tested FROM ({_stats_sql("SELECT * FROM ast_records WHERE host IS NOT NULL", "host, antibiotic")}))""")
def antibiogram_by_species(t):  # noqa: ANN001, ANN201
    out = rollup.test_stats(t("ast_records").where("host is not null"), ["host", "antibiotic"], "phenotype")
    tested = F.col("n_r") + F.col("n_s") + F.col("n_i")
    out = out.withColumn("opacity", measure.opacity(F.col("n_total"), tested, 100.0 * tested / F.col("n_total")))
    return out.select("host", "antibiotic", "n_total", *r6("r_percent", "opacity"))


# Roll-ups, pivots, profiles


@query("SELECT sample, arg_min(year, CASE WHEN year IS NOT NULL THEN record END) AS year, arg_min(country, CASE WHEN country IS NOT NULL THEN record END) AS country, arg_min(host, CASE WHEN host IS NOT NULL THEN record END) AS host FROM ast_records WHERE sample IS NOT NULL GROUP BY sample")
def sample_metadata_first(t):  # noqa: ANN001, ANN201
    return rollup.first_non_null(t("ast_records"), "sample", "record", ["year", "country", "host"])


DRUGS = ("click", "error", "purchase", "signup", "view")


def _pivot_sql(source: str, value: str) -> str:
    cells = ", ".join(f"round(avg(CASE WHEN antibiotic = '{d}' THEN {value} END), 6)::DOUBLE AS \"{d}\"" for d in DRUGS)
    return f"SELECT sample, {cells} FROM ({source}) WHERE {value} IS NOT NULL GROUP BY sample"


@query(_pivot_sql(f"SELECT *, {BINARY} AS b FROM ast_records", "b"))
def pivot_binary(t):  # noqa: ANN001, ANN201
    return rollup.pivot_mean(parsed(t), "sample", "antibiotic", "binary", list(DRUGS)).select("sample", *r6(*DRUGS))


@query(_pivot_sql(LOGGED, "lg"))
def pivot_log_mic(t):  # noqa: ANN001, ANN201
    return rollup.pivot_mean(parsed(t), "sample", "antibiotic", "log_mic", list(DRUGS)).select("sample", *r6(*DRUGS))


@query(f"SELECT sample, antibiotic, CAST(trunc(avg(b)) AS INT) AS label FROM (SELECT *, {BINARY} AS b FROM ast_records) WHERE b IS NOT NULL GROUP BY 1, 2")
def label_truncation(t):  # noqa: ANN001, ANN201
    return rollup.long_mean(parsed(t), "sample", "antibiotic", "binary").select("sample", "antibiotic", measure.training_label(F.col("mean")).alias("label"))


@query(f"SELECT a AS n_keys, b AS n_columns, a * b AS n_cells, a * b - f AS n_null, round((a * b - f) / (a * b)::DOUBLE, 6) AS sparsity FROM (SELECT count(DISTINCT sample) AS a, count(DISTINCT antibiotic) AS b, count(DISTINCT sample || '/' || antibiotic) AS f FROM (SELECT *, {BINARY} AS b FROM ast_records) WHERE b IS NOT NULL)")
def pivot_sparsity(t):  # noqa: ANN001, ANN201
    return rollup.sparsity(parsed(t), "sample", "antibiotic", "binary").select("n_keys", "n_columns", "n_cells", "n_null", *r6("sparsity"))


@query("""WITH p AS (SELECT unnest(['host', 'country', 'year']) AS facet, unnest([host, country, CAST(year AS VARCHAR)]) AS value FROM ast_records),
  c AS (SELECT facet, value, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY facet) AS tot, row_number() OVER (PARTITION BY facet ORDER BY value IS NULL, n DESC, value) AS place FROM c)
  SELECT facet, value, n, round(100.0 * n / tot, 6)::DOUBLE AS percent FROM k WHERE place <= 10 OR value IS NULL""")
def profile_facets(t):  # noqa: ANN001, ANN201
    return rollup.profile(t("ast_records"), ["host", "country", "year"]).select("facet", "value", "n", *r6("percent"))


@query("SELECT min(year) AS first, max(year) AS last, count(year) AS n_known, round(100.0 * count(year) / count(*), 6)::DOUBLE AS percent_known FROM ast_records")
def year_range(t):  # noqa: ANN001, ANN201
    return rollup.year_range(t("ast_records"), "year").select("first", "last", "n_known", *r6("percent_known"))


@query("SELECT phenotype, count(*) AS n FROM ast_records GROUP BY 1")
def value_counts_with_null(t):  # noqa: ANN001, ANN201
    return rollup.value_counts(t("ast_records"), "phenotype", nulls=True)


@query("SELECT host, count(*) AS n FROM ast_records WHERE host IS NOT NULL GROUP BY 1")
def value_counts(t):  # noqa: ANN001, ANN201
    return rollup.value_counts(t("ast_records"), "host")


@query("SELECT unnest(['measurement', 'phenotype', 'year', 'country', 'host']) AS \"column\", unnest([count(*) - count(measurement), count(*) - count(phenotype), count(*) - count(year), count(*) - count(country), count(*) - count(host)]) AS n_null FROM ast_records")
def null_counts(t):  # noqa: ANN001, ANN201
    return rollup.null_counts(t("ast_records"), ["measurement", "phenotype", "year", "country", "host"])


@query("SELECT count(DISTINCT sample) AS sample, count(DISTINCT antibiotic) AS antibiotic, count(DISTINCT country) AS country FROM ast_records")
def distinct_counts(t):  # noqa: ANN001, ANN201
    return rollup.distinct_counts(t("ast_records"), ["sample", "antibiotic", "country"])


# Resolution and cohorts


@query("SELECT category, count(*) AS n FROM sample_meta WHERE list_contains(regexp_extract_all(lower(category), '[a-z0-9]+'), 'blood') GROUP BY 1")
def token_match(t):  # noqa: ANN001, ANN201
    return resolve.matching(t("sample_meta"), "category", " Blood")


@query("SELECT sample, coalesce(nullif(trim(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM sample_meta")
def slugify(t):  # noqa: ANN001, ANN201
    return t("sample_meta").select("sample", text.slug(F.col("category")).alias("slug"))


S1, S2 = "blood & sterile fluids", "faeces / rectal swab"
STRATUM = cohort.Stratum(("thread", "country"), "category", S1, S2, "sample")
THREAD = "CASE WHEN lower(study) LIKE '%amr%' THEN 'AMR' WHEN lower(study) LIKE '%surveillance%' THEN 'Surveillance' WHEN study IS NULL THEN 'NA' END"
ROUTED = f"SELECT * FROM (SELECT *, {THREAD} AS thread FROM sample_meta WHERE host = 'human') WHERE thread IS NOT NULL"


def _routed(t) -> DataFrame:  # noqa: ANN001
    return cohort.routed(t("sample_meta").where("host = 'human'"), "study").where("thread is not null")


@query("""SELECT unnest([0, 1, 2, 3, 4]) AS step, unnest(['initial', 'category', 'host', 'setting', 'study']) AS stage,
  unnest([count(*), count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND d)]) AS n
  FROM (SELECT category IN ('blood & sterile fluids', 'faeces / rectal swab') AS a, host = 'human' AS b, coalesce(lower(setting) LIKE '%hospital%', false) AS c, study IS NOT NULL AS d FROM sample_meta)""")
def filter_funnel(t):  # noqa: ANN001, ANN201
    stages = [("initial", None), ("category", F.col("category").isin(S1, S2)), ("host", F.col("host") == "human"), ("setting", text.mentions(F.col("setting"), "Hospital")), ("study", F.col("study").isNotNull())]
    return cohort.funnel_counts(t("sample_meta"), stages)


@query(f"SELECT thread, count(*) AS n FROM (SELECT {THREAD} AS thread FROM sample_meta) GROUP BY 1")
def thread_routing(t):  # noqa: ANN001, ANN201
    return cohort.routed(t("sample_meta"), "study").groupBy("thread").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT country, sum((category = '{S1}')::INT)::BIGINT AS n_first, sum((category = '{S2}')::INT)::BIGINT AS n_second, count(*) AS n_all FROM sample_meta WHERE country IS NOT NULL GROUP BY 1 ORDER BY n_all DESC, country LIMIT 12")
def category_breakdown(t):  # noqa: ANN001, ANN201
    return contingency.breakdown(t("sample_meta"), "country", "category", S1, S2, top=12)


def _audit_sql(target: str, source: str = "c") -> str:
    return f"""SELECT *, CASE WHEN action = 'country_sampled' AND n1 >= n2 THEN cut ELSE n1 END AS sampled1, CASE WHEN action = 'country_sampled' AND n1 < n2 THEN cut ELSE n2 END AS sampled2 FROM (
      SELECT *, least(CAST(floor({target} * least(n1, n2)) AS BIGINT), greatest(n1, n2)) AS cut, CASE WHEN greatest(n1, n2) = 0 THEN 0 WHEN least(n1, n2) = 0 THEN CAST('inf' AS DOUBLE) ELSE greatest(n1, n2) / least(n1, n2)::DOUBLE END AS ratio,
        CASE WHEN {target} <= 0 THEN 'accepted_all_no_ratio' WHEN least(n1, n2) = 0 THEN NULL WHEN greatest(n1, n2) / least(n1, n2)::DOUBLE BETWEEN 1 / nullif({target}, 0) AND {target} THEN 'accepted_all' ELSE 'country_sampled' END AS action FROM {source}) WHERE action IS NOT NULL"""


COUNTS = f"SELECT thread, country, sum((category = '{S1}')::INT)::BIGINT AS n1, sum((category = '{S2}')::INT)::BIGINT AS n2 FROM ({ROUTED}) WHERE country IS NOT NULL GROUP BY 1, 2"


def _balanced_sql(target: str) -> str:
    return f"""WITH r AS ({ROUTED}), c AS ({COUNTS}), a AS ({_audit_sql(target)}), k AS (SELECT *, row_number() OVER (PARTITION BY thread, country, category ORDER BY md5('42:' || sample), sample) AS place FROM r)
      SELECT k.sample, k.thread, k.country, k.category FROM k JOIN a USING (thread, country) WHERE action <> 'country_sampled' OR place <= CASE WHEN category = '{S1}' THEN sampled1 ELSE sampled2 END"""


@query(_balanced_sql("2.0::DOUBLE"))
def stratified_sample(t):  # noqa: ANN001, ANN201
    return cohort.balanced(_routed(t), STRATUM, 2.0).select("sample", "thread", "country", "category")


@query(_balanced_sql("0.0::DOUBLE"))
def stratify_no_ratio(t):  # noqa: ANN001, ANN201
    return cohort.balanced(_routed(t), STRATUM, 0.0).select("sample", "thread", "country", "category")


@query(f"WITH c AS ({COUNTS}) SELECT thread, country, n1, n2, sampled1, sampled2, round(ratio, 6) AS ratio, action FROM ({_audit_sql('2.0::DOUBLE')})")
def stratify_audit(t):  # noqa: ANN001, ANN201
    out = cohort.audited(cohort.stratum_counts(_routed(t), STRATUM), 2.0)
    return out.select("thread", "country", "n1", "n2", "sampled1", "sampled2", *r6("ratio"), "action")


@query(f"WITH c AS ({COUNTS}) SELECT sum(n1)::BIGINT AS n1, sum(n2)::BIGINT AS n2, sum(sampled1)::BIGINT AS sampled1, sum(sampled2)::BIGINT AS sampled2, round(greatest(sum(sampled1), sum(sampled2))::DOUBLE / least(sum(sampled1), sum(sampled2)), 6) AS ratio FROM ({_audit_sql('2.0::DOUBLE')})")
def stratify_totals(t):  # noqa: ANN001, ANN201
    return cohort.audit_totals(cohort.audited(cohort.stratum_counts(_routed(t), STRATUM), 2.0)).select("n1", "n2", "sampled1", "sampled2", *r6("ratio"))


@query(f"WITH c AS ({COUNTS}) SELECT substr(country, 1, 28) AS label, n1, n2, n1 + n2 AS n, sampled1, sampled2, action FROM ({_audit_sql('2.0::DOUBLE')}) WHERE thread = 'AMR'")
def stratify_report(t):  # noqa: ANN001, ANN201
    return cohort.detailed_report(cohort.audited(cohort.stratum_counts(_routed(t), STRATUM), 2.0).where("thread = 'AMR'"), "country")


@query(f"WITH c AS (SELECT * FROM ({COUNTS}), (SELECT unnest([1.0, 2.0, 2.5, 3.0])::DOUBLE AS target) WHERE thread = 'AMR') SELECT target, count(*) AS n_strata, sum(sampled1)::BIGINT AS n1, sum(sampled2)::BIGINT AS n2, sum(sampled1 + sampled2)::BIGINT AS n FROM ({_audit_sql('target')}) GROUP BY 1")
def ratio_sweep(t):  # noqa: ANN001, ANN201
    return cohort.ratio_sweep(_routed(t).where("thread = 'AMR'"), STRATUM)


@query(f"SELECT * FROM ({_balanced_sql('2.0::DOUBLE')}) WHERE thread = 'AMR'")
def ratio_sweep_rows(t):  # noqa: ANN001, ANN201
    return cohort.swept(_routed(t).where("thread = 'AMR'"), STRATUM)[1].select("sample", "thread", "country", "category")


@query(f"""WITH x AS ({_balanced_sql("2.0::DOUBLE")}), i AS (SELECT country, sum((category = '{S1}')::INT)::BIGINT AS init1, sum((category = '{S2}')::INT)::BIGINT AS init2 FROM ({ROUTED}) GROUP BY 1),
  f AS (SELECT country, sum((category = '{S1}')::INT)::BIGINT AS final1, sum((category = '{S2}')::INT)::BIGINT AS final2 FROM x GROUP BY 1)
  SELECT country, coalesce(init1, 0) AS init1, coalesce(init2, 0) AS init2, coalesce(final1, 0) AS final1, coalesce(final2, 0) AS final2,
  round(CASE WHEN coalesce(greatest(final1, final2), 0) = 0 THEN 0 WHEN least(final1, final2) = 0 THEN CAST('inf' AS DOUBLE) ELSE greatest(final1, final2) / least(final1, final2)::DOUBLE END, 6) AS ratio FROM i FULL OUTER JOIN f USING (country)""")
def country_init_final(t):  # noqa: ANN001, ANN201
    before = _routed(t)
    out = cohort.before_after(before, cohort.balanced(before, STRATUM, 2.0), "country", "category", S1, S2)
    return out.select("country", "init1", "init2", "final1", "final2", *r6("ratio"))


@query("SELECT sample, category FROM sample_meta WHERE country = 'src3' ORDER BY md5('42:' || sample), sample LIMIT 7")
def group_sample_n(t):  # noqa: ANN001, ANN201
    return cohort.sample_n(t("sample_meta").where("country = 'src3'"), "sample", 7).select("sample", "category")


@query("SELECT sample, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY sample) AS k FROM sample_meta) WHERE k <= 3")
def first_k_per_group(t):  # noqa: ANN001, ANN201
    return cohort.first_k(t("sample_meta"), "country", "sample", 3).select("sample", "country")


# Splits and labels

SPLIT = """SELECT sample, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train' WHEN k <= floor(0.7::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'validate' ELSE 'evaluate' END AS split
  FROM (SELECT sample, row_number() OVER (ORDER BY md5('1:' || sample), sample) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT sample FROM ast_records))"""


@query(f"SELECT record, sample, split FROM ast_records JOIN ({SPLIT}) USING (sample)")
def split_70_10_20(t):  # noqa: ANN001, ANN201
    return split.with_splits(t("ast_records"), "sample", name="split").select("record", "sample", "split")


@query(f"SELECT split, count(DISTINCT sample) AS n FROM ast_records JOIN ({SPLIT}) USING (sample) WHERE {BINARY} IS NOT NULL GROUP BY 1")
def split_counts(t):  # noqa: ANN001, ANN201
    return split.split_counts(split.with_splits(parsed(t), "sample", name="split"), "sample", "binary", "split")


@query(f"SELECT sample, (category = '{S2}')::INT AS label FROM sample_meta WHERE category IN ('{S1}', '{S2}')")
def pair_label(t):  # noqa: ANN001, ANN201
    return split.pair_label(t("sample_meta"), "category", S2, S1, "label").select("sample", "label")


@query("SELECT sample, segment FROM expected_ids WHERE sample IN (SELECT sample FROM present_ids)")
def prune_kept(t):  # noqa: ANN001, ANN201
    return split.pruned(t("expected_ids"), "sample", t("present_ids"))[0].select("sample", "segment")


@query("SELECT DISTINCT sample FROM expected_ids WHERE sample NOT IN (SELECT sample FROM present_ids)")
def prune_missing(t):  # noqa: ANN001, ANN201
    return split.pruned(t("expected_ids"), "sample", t("present_ids"))[1]


# Look-ups and reconciliation


@query("SELECT e.sample, e.segment, m.file FROM expected_ids e LEFT JOIN mapping m USING (sample)")
def left_join_mapping(t):  # noqa: ANN001, ANN201
    return reconcile.left_mapped(t("expected_ids"), "sample", t("mapping"), "sample").select("sample", "segment", "file")


@query("SELECT count(*) AS n_matched, round(count(*) / 1683600.0::DOUBLE * 14.7::DOUBLE * 1e12 / 1073741824, 6) AS gib, count(*) / 1683600.0::DOUBLE * 14.7::DOUBLE * 1e12 / 1073741824 <= 100 AS fits FROM mapping")
def size_estimate(t):  # noqa: ANN001, ANN201
    return reconcile.size_estimate(t("mapping")).select("n_matched", *r6("gib"), "fits")


@query("SELECT e.sample, m.file FROM expected_ids e LEFT JOIN (SELECT sample, arg_min(file, record) AS file FROM mapping GROUP BY 1) m USING (sample)")
def lookup_map(t):  # noqa: ANN001, ANN201
    return reconcile.looked_up(t("expected_ids"), F.col("sample"), t("mapping"), "sample", "file", "record", "file").select("sample", "file")


@query("""SELECT e.sample, CASE WHEN coalesce(sample % 3 = 0, true) THEN a.file ELSE b.file END AS file FROM expected_ids e
  LEFT JOIN (SELECT sample, arg_min(file, record) AS file FROM mapping WHERE record % 2 = 0 GROUP BY 1) a USING (sample) LEFT JOIN (SELECT sample, arg_min(file, record) AS file FROM mapping WHERE record % 2 = 1 GROUP BY 1) b USING (sample)""")
def conditional_lookup(t):  # noqa: ANN001, ANN201
    m = t("mapping")
    flag = F.coalesce(F.col("sample") % 3 == 0, F.lit(True))
    return reconcile.looked_up_in_either(t("expected_ids"), F.col("sample"), flag, m.where("record % 2 = 0"), m.where("record % 2 = 1"), "sample", "file", "record", "file").select("sample", "file")


@query("SELECT sample, sample IN (SELECT sample FROM present_ids) AS present FROM expected_ids")
def existence_flag(t):  # noqa: ANN001, ANN201
    return reconcile.flagged(t("expected_ids"), "sample", t("present_ids"), "present").select("sample", "present")


@query("SELECT sample, accession FROM expected_ids WHERE accession LIKE 'SAM%' AND accession NOT IN (SELECT concat('SAM', sample) FROM present_ids)")
def reconcile_missing(t):  # noqa: ANN001, ANN201
    there = t("present_ids").select(F.concat(F.lit("SAM"), F.col("sample").cast("string")).alias("accession"))
    return reconcile.missing(t("expected_ids"), "accession", there, "SAM").select("sample", "accession")


@query("SELECT record, accession FROM accessions a WHERE NOT EXISTS (SELECT 1 FROM stems s WHERE contains(a.accession, s.stem))")
def substring_anti(t):  # noqa: ANN001, ANN201
    return reconcile.without_substrings(t("accessions"), "accession", t("stems")).select("record", "accession")


@query("SELECT p.sample, e.segment, e.sample IS NOT NULL AS found FROM (SELECT DISTINCT sample * 2 AS sample FROM present_ids) p LEFT JOIN expected_ids e ON p.sample = e.sample")
def align_metadata(t):  # noqa: ANN001, ANN201
    keys = t("present_ids").select((F.col("sample") * 2).alias("sample")).distinct()
    return reconcile.aligned(keys, "sample", t("expected_ids").select("sample", "segment"), "sample")


@query("SELECT count(DISTINCT sample) AS n_files, (SELECT count(DISTINCT m.sample) FROM mapping m WHERE m.sample IN (SELECT sample FROM present_ids)) AS n_used, count(DISTINCT sample) = (SELECT count(DISTINCT m.sample) FROM mapping m WHERE m.sample IN (SELECT sample FROM present_ids)) AS all_used FROM mapping")
def list_coverage(t):  # noqa: ANN001, ANN201
    return reconcile.coverage(t("mapping"), "sample", t("present_ids"), "sample")


@query("SELECT sample, done FROM expected_ids WHERE NOT coalesce(lower(done) IN ('true', '1', 'yes'), false)")
def truthy_filter(t):  # noqa: ANN001, ANN201
    return t("expected_ids").where(~text.truthy(F.col("done"))).select("sample", "done")


@query("SELECT substr(accession, 1, 3) AS prefix, count(*) AS n FROM accessions GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10")
def prefix_counts(t):  # noqa: ANN001, ANN201
    return reconcile.prefix_counts(t("accessions"), "accession")


@query("""SELECT regexp_extract(accession, '^[^_]*_[^_]*') AS accession, min(record) AS first FROM accessions a WHERE downloaded <> 'true' AND (accession LIKE 'GCF\\_%' ESCAPE '\\' OR accession LIKE 'GCA\\_%' ESCAPE '\\')
  AND NOT EXISTS (SELECT 1 FROM stems s WHERE contains(a.accession, s.stem)) GROUP BY 1""")
def accession_collect(t):  # noqa: ANN001, ANN201
    return reconcile.accessions_to_fetch(t("accessions"), "accession", "downloaded", "record", t("stems"))


@query("""SELECT record, replace(replace(b, '.fa.gz', ''), '.fna.gz', '') AS assembly, split_part(b, '.gff', 1) AS annotation, regexp_replace(b, '\\.bakta\\.gff3\\.gz$', '') AS bakta,
  CASE WHEN b LIKE 'GC%' THEN concat(split_part(b, '_', 1), '_', split_part(b, '_', 2)) ELSE b END AS key FROM (SELECT record, split_part(path, '/', -1) AS b FROM path_list)""")
def path_to_sample(t):  # noqa: ANN001, ANN201
    p = F.col("path")
    return t("path_list").select("record", text.assembly_id(p).alias("assembly"), text.annotation_id(p).alias("annotation"), text.bakta_id(p).alias("bakta"), text.lookup_key(text.basename(p)).alias("key"))


# Batches


@query("SELECT sample, (k - 1) // 100 AS batch, concat('batch_', lpad(CAST((k - 1) // 100 AS VARCHAR), CAST(greatest(2, length(CAST((n - 1) // 100 AS VARCHAR))) AS INT), '0')) AS batch_name FROM (SELECT sample, row_number() OVER (ORDER BY sample) AS k, count(*) OVER () AS n FROM expected_ids)")
def fixed_batches(t):  # noqa: ANN001, ANN201
    return batching.fixed(t("expected_ids").select("sample"), "sample", 100)


GROUPS = "SELECT segment || '/' || (sample % 20) AS grp, count(*) AS n FROM expected_ids GROUP BY 1"


@query(f"""WITH RECURSIVE g AS (SELECT grp, n, row_number() OVER (ORDER BY grp) AS k FROM ({GROUPS})), f AS (
  SELECT k, grp, n, 0::BIGINT AS batch, CASE WHEN n >= 40 THEN 0 ELSE n END AS held, (n >= 40)::INT AS full FROM g WHERE k = 1
  UNION ALL SELECT g.k, g.grp, g.n, f.batch + f.full, CASE WHEN f.held + g.n >= 40 THEN 0 ELSE f.held + g.n END, (f.held + g.n >= 40)::INT FROM f JOIN g ON g.k = f.k + 1) SELECT grp, n, batch FROM f""")
def greedy_packing(t):  # noqa: ANN001, ANN201
    g = t("expected_ids").groupBy(F.concat_ws("/", "segment", (F.col("sample") % 20).cast("string")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return batching.greedy(g, "grp", "n", 40)


@query("SELECT category AS grp, count(*) AS n, sum((host = 'human')::INT)::BIGINT AS n_human, sum(coalesce(setting LIKE 'Hosp%', false)::INT)::BIGINT AS n_hospital FROM sample_meta GROUP BY 1 HAVING count(*) > 20")
def large_groups(t):  # noqa: ANN001, ANN201
    return batching.large_groups(t("sample_meta").withColumnRenamed("category", "grp"), "grp", 20, {"n_human": "host = 'human'", "n_hospital": "setting like 'Hosp%'"})


@query("SELECT sample FROM expected_ids ORDER BY sample LIMIT 35 OFFSET 25")
def index_slice(t):  # noqa: ANN001, ANN201
    return batching.sliced(t("expected_ids").select("sample"), "sample", 25, 60)


# Vectors


@query("SELECT sample, i - 1 AS i, round(avg(x::DOUBLE), 6) AS x FROM (SELECT sample, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM genes) GROUP BY 1, 2")
def mean_pool(t):  # noqa: ANN001, ANN201
    out = vectors.mean_pool(t("genes"), "sample", "embedding").select("sample", F.posexplode("embedding").alias("i", "x"))
    return out.select("sample", F.col("i").cast("bigint").alias("i"), *r6("x"))


@query("SELECT sample, gene, gene_idx, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY gene) - 1 AS gene_idx FROM genes)")
def gene_explode(t):  # noqa: ANN001, ANN201
    rows = vectors.gene_rows(t("genes"), "sample", "gene", "embedding")
    return rows.select("sample", "gene", F.col("gene_idx").cast("bigint").alias("gene_idx"), F.posexplode("embedding").alias("dim", "x")).select("sample", "gene", "gene_idx", F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))


@query("SELECT g.gene, g.sample, m.country, m.host FROM genes g LEFT JOIN sample_meta m ON g.sample = m.sample")
def gene_metadata(t):  # noqa: ANN001, ANN201
    meta = t("sample_meta").select("sample", "country", "host")
    return reconcile.left_mapped(t("genes").select("gene", "sample"), "sample", meta, "sample")


@query("SELECT record, n, n AS there, max(n) OVER (PARTITION BY sample) AS padded FROM (SELECT sample, record, CAST(count(*) AS INT) AS n FROM baskets GROUP BY 1, 2)")
def pad_batch(t):  # noqa: ANN001, ANN201
    lists = t("baskets").groupBy("sample", "record").agg(F.sort_array(F.collect_list("x")).alias("x"))
    out = vectors.padded(lists.withColumn("n", F.size("x")), "sample", "x")
    return out.select("record", "n", F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("there"), F.size("x").alias("padded"))


@query("SELECT sample, gene FROM genes WHERE sample % 2 = 0 AND gene % 3 = 0")
def embedding_filter(t):  # noqa: ANN001, ANN201
    g = t("genes")
    wanted = g.where("sample % 2 = 0 and gene % 3 = 0").select("sample", "gene").distinct()
    return vectors.by_file(g, wanted, "sample", "gene").select("sample", "gene")


@query("""SELECT query, gene, round(s, 6) AS cosine FROM (SELECT q.gene AS query, v.gene, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.gene ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.gene) AS k FROM genes q JOIN genes v ON q.gene <> v.gene WHERE q.gene % 50 = 0) WHERE k <= 5""")
def nearest_vectors(t):  # noqa: ANN001, ANN201
    g = t("genes")
    near = neighbours.graph(g, "gene", "embedding", 5, 64, "cosine", asking=g.where("gene % 50 = 0"))
    return near.select(F.col("id").alias("query"), F.col("neighbour").alias("gene"), F.round(1 - F.col("distance"), 6).alias("cosine"))


@query("""SELECT id, neighbour, CAST(k AS INT) AS rank, round(d, 6) AS distance FROM (SELECT a.gene AS id, b.gene AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
  row_number() OVER (PARTITION BY a.gene ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.gene) AS k FROM genes a JOIN genes b ON a.gene <> b.gene) WHERE k <= 15""")
def neighbour_graph(t):  # noqa: ANN001, ANN201
    """All rows against all rows."""
    return neighbours.graph(t("genes"), "gene", "embedding", 15, 64).select("id", "neighbour", "rank", *r6("distance"))


@query("""SELECT id, neighbour, CAST(k AS INT) AS rank, round(1 - s, 6) AS distance FROM (SELECT a.gene AS id, b.gene AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY a.gene ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.gene) AS k FROM genes a JOIN genes b ON a.gene <> b.gene) WHERE k <= 5""")
def cosine_graph(t):  # noqa: ANN001, ANN201
    return neighbours.graph(t("genes"), "gene", "embedding", 5, 64, "cosine").select("id", "neighbour", "rank", *r6("distance"))


@query(None)
def neighbour_communities(t):  # noqa: ANN001, ANN201
    """Communities of the weighted neighbour graph; SQL has no equal, tests hold them against a greedy pass."""
    knn = neighbours.graph(t("genes"), "gene", "embedding", 15, 64)
    return communities.communities(neighbours.connectivities(knn))


# Contingency tables


@query("SELECT country, category, count(*) AS n FROM sample_meta WHERE country IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2")
def crosstab_counts(t):  # noqa: ANN001, ANN201
    return contingency.crosstab(t("sample_meta"), "country", "category")


@query("SELECT country, category, n, round(100.0 * n / sum(n) OVER (PARTITION BY country), 6)::DOUBLE AS percent FROM (SELECT country, category, count(*) AS n FROM sample_meta GROUP BY 1, 2)")
def crosstab_row_pct(t):  # noqa: ANN001, ANN201
    return contingency.row_percent(t("sample_meta"), "country", "category").select("country", "category", "n", *r6("percent"))


TOP = "SELECT country FROM sample_meta GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 5"


@query(f"SELECT sample, CASE WHEN country IN ({TOP}) THEN country ELSE 'other' END AS country FROM sample_meta")
def topk_other(t):  # noqa: ANN001, ANN201
    return contingency.top_or_other(t("sample_meta"), "country", 5).select("sample", "country")


@query("SELECT country, category, count(*) AS n FROM sample_meta WHERE country IN (SELECT country FROM sample_meta GROUP BY 1 HAVING 100.0 * count(*) / (SELECT count(*) FROM sample_meta) >= 5) GROUP BY 1, 2")
def share_threshold(t):  # noqa: ANN001, ANN201
    return contingency.share_crosstab(t("sample_meta"), "country", "category", 5.0)


RATIOS = f"SELECT country, sum((category = '{S1}')::INT)::BIGINT AS n_first, sum((category = '{S2}')::INT)::BIGINT AS n_second FROM sample_meta GROUP BY 1"


@query(f"SELECT *, round(CASE WHEN n_second = 0 THEN CAST('inf' AS DOUBLE) ELSE n_first / n_second::DOUBLE END, 6) AS ratio, n_first + n_second AS total FROM ({RATIOS})")
def cluster_ratio(t):  # noqa: ANN001, ANN201
    out = contingency.class_ratio(t("sample_meta"), "country", "category", S1, S2)
    return out.select("country", "n_first", "n_second", *r6("ratio"), "total")


@query(f"SELECT country, n_first + n_second AS total FROM ({RATIOS}) WHERE n_second = 0 OR n_first / n_second::DOUBLE > 10 OR n_first / n_second::DOUBLE < 0.1")
def extreme_ratio(t):  # noqa: ANN001, ANN201
    return contingency.extreme(contingency.class_ratio(t("sample_meta"), "country", "category", S1, S2)).select("country", "total")


# Presence and absence, tests, metrics


@query("SELECT sample, count(DISTINCT feature) AS n_features FROM presence GROUP BY 1")
def features_per_sample(t):  # noqa: ANN001, ANN201
    return pangenome.features_per_sample(t("presence"), "sample", "feature")


CLASSES = "SELECT feature, n_samples, n_samples / k::DOUBLE AS f, CASE WHEN n_samples / k::DOUBLE >= 0.95 THEN 'core' WHEN n_samples / k::DOUBLE <= 0.05 THEN 'cloud' ELSE 'shell' END AS class FROM (SELECT feature, count(DISTINCT sample) AS n_samples, (SELECT count(DISTINCT sample) FROM presence) AS k FROM presence GROUP BY 1)"


@query(f"SELECT feature, n_samples, round(f, 6) AS frequency, class FROM ({CLASSES})")
def feature_class(t):  # noqa: ANN001, ANN201
    return pangenome.feature_classes(t("presence"), "sample", "feature").select("feature", "n_samples", *r6("frequency"), "class")


@query(f"SELECT sample, sum((class = 'core')::INT)::BIGINT AS core, sum((class = 'shell')::INT)::BIGINT AS shell, sum((class = 'cloud')::INT)::BIGINT AS cloud FROM presence JOIN ({CLASSES}) USING (feature) GROUP BY 1")
def sample_class_counts(t):  # noqa: ANN001, ANN201
    return pangenome.sample_class_counts(t("presence"), "sample", "feature")


@query("SELECT sample, feature FROM presence WHERE feature IN (SELECT feature FROM presence GROUP BY 1 HAVING count(DISTINCT sample) >= 10)")
def prevalence_filter(t):  # noqa: ANN001, ANN201
    return pangenome.prevalent(t("presence"), "sample", "feature", 10).select("sample", "feature")


@query("SELECT region, strain, n FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, strain) AS k FROM run_summary) WHERE k = 1")
def argmax_per_group(t):  # noqa: ANN001, ANN201
    return rollup.argmax_rows(t("run_summary"), "region", "n", "strain").select("region", "strain", "n")


@query("SELECT round(sum(n * mean_size) / sum(n), 4) AS mean, round(sum(n * n * sd_size * sd_size / n) / (sum(n) * sum(n)), 4) AS var FROM run_summary WHERE n > 1 AND sd_size > 0")
def weighted_mean(t):  # noqa: ANN001, ANN201
    rows = t("run_summary").where("n > 1 and sd_size > 0").withColumn("v", F.col("sd_size") * F.col("sd_size") / F.col("n"))
    return rollup.weighted_mean(rows, "mean_size", "n", "v").select(F.round("mean", 4).alias("mean"), F.round("var", 4).alias("var"))


# Tails by other ways than the library's: a series without cancellation below 2.5, a continued fraction above.
_SERIES = "1 - 2 / sqrt(pi()) * x * exp(-x * x) * list_reduce(list_concat([1.0::DOUBLE], list_reverse(range(1, 80))), lambda s, n: 1 + s * 2 * x * x / (2 * n + 1))"
_CONTINUED = "exp(-x * x) / sqrt(pi()) / list_reduce(list_concat([x], list_reverse(range(1, 150))), lambda f, n: x + n / 2.0::DOUBLE / f)"
_ERFC = f"CASE WHEN x < 2.5 THEN {_SERIES} ELSE {_CONTINUED} END"


@query(f"""WITH r AS (SELECT *, sd_size * sd_size / n AS v FROM run_summary WHERE n > 1 AND sd_size > 0), q AS (SELECT sum(n * mean_size) / sum(n) AS rm, sum(n * n * v) / (sum(n) * sum(n)) AS rv FROM r WHERE n_lineages > 1),
  k AS (SELECT strain, mean_size - rm AS d, sqrt(v + rv) AS se, (SELECT count(*) FROM r WHERE n_lineages = 1) AS m FROM r, q WHERE n_lineages = 1), e AS (SELECT *, abs(d / se) / sqrt(2.0::DOUBLE) AS x FROM k), p AS (SELECT *, {_ERFC} AS p FROM e)
  SELECT strain, round(d, 4) AS difference, round(d / se, 6) AS z, round(p, 12) AS p, round(log10(p), 8) AS log_p, round(least(p * m, 1.0), 12) AS p_bonferroni, round(d - 1.96::DOUBLE * se, 4) AS ci_low, round(d + 1.96::DOUBLE * se, 4) AS ci_high FROM p""")
def z_test(t):  # noqa: ANN001, ANN201
    out = testing.z_tests(t("run_summary"), "strain", "mean_size", "sd_size", "n", "n_lineages")
    r = lambda c, n, name=None: F.round(c, n).alias(name or c)
    return out.select("strain", r("difference", 4), r("z", 6), r("p", 12), r(F.log10("p"), 8, "log_p"), r("p_bonferroni", 12), r("ci_low", 4), r("ci_high", 4))


@query(f"""WITH e AS (SELECT record, x / 2.0::DOUBLE AS x FROM baskets), k AS (SELECT DISTINCT x FROM e), p AS (SELECT x, {_ERFC} AS p FROM k)
  SELECT round(x, 6) AS x, count(*) AS n, round(min(log10(p)), 8) AS log_p FROM e JOIN p USING (x) GROUP BY 1""")
def normal_tails(t):  # noqa: ANN001, ANN201
    """Tails far out, where p-values have up to 300 zeros."""
    rows = t("baskets").select((F.col("x") / 2).alias("x"))
    return rows.groupBy(F.round("x", 6).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(F.log10(stats.erfc(F.col("x")))), 8).alias("log_p"))


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN logit >= -2 AND logit < 2 THEN CAST(floor((logit + 2) / 0.5) AS INT) WHEN logit = 2 THEN 7 END AS bin FROM predictions) WHERE bin IS NOT NULL GROUP BY 1")
def histogram_bins(t):  # noqa: ANN001, ANN201
    return t("predictions").select(stats.histogram_bin(F.col("logit"), -2.0, 0.5, 8).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT logit AS s, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM predictions GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM b WINDOW w AS (ORDER BY s DESC)),
  k AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, sum(CASE WHEN s >= 0 THEN pos ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN s >= 0 THEN neg ELSE 0 END)::DOUBLE AS fp, sum(pos * tp / (tp + fp)::DOUBLE) AS ap FROM c),
  u AS (SELECT sum(CASE WHEN a.logit > b.logit THEN 1 WHEN a.logit = b.logit THEN 0.5 ELSE 0 END)::DOUBLE AS w FROM predictions a, predictions b WHERE a.label = 1 AND b.label = 0)
  SELECT round((tp + n - fp) / (p + n), 6) AS accuracy, round(w / (p * n), 6) AS auroc, round(ap / p, 6) AS auprc, round(2 * tp / (2 * tp + fp + p - tp), 6) AS f1, CAST(p + n AS BIGINT) AS n FROM k, u""")
def binary_metrics(t):  # noqa: ANN001, ANN201
    return metrics.binary_metrics(t("predictions"), "logit", "label").select(*r6("accuracy", "auroc", "auprc", "f1"), "n")


# Smaller operators


@query("SELECT sample, CASE country WHEN 'src1' THEN 'north' WHEN 'src2' THEN 'south' WHEN 'src3' THEN 'north' END AS region FROM sample_meta")
def constant_map(t):  # noqa: ANN001, ANN201
    return reconcile.constant_mapped(t("sample_meta"), "country", {"src1": "north", "src2": "south", "src3": "north"}, "region").select("sample", "region")


@query("SELECT country, min(sample) AS first FROM sample_meta WHERE country IS NOT NULL GROUP BY 1")
def distinct_in_order(t):  # noqa: ANN001, ANN201
    return reconcile.distinct_in_order(t("sample_meta"), "country", "sample")


@query("SELECT accession FROM expected_ids WHERE NOT coalesce(lower(done) IN ('true', '1', 'yes'), false) AND accession LIKE 'SAM%' ORDER BY accession LIMIT 40")
def ids_to_fetch(t):  # noqa: ANN001, ANN201
    return reconcile.ids_to_fetch(t("expected_ids"), "accession", "done", "SAM", n=40)[0]


@query("SELECT unnest([0, 1, 2]) AS step, unnest(['all', 'not_done', 'prefix']) AS stage, unnest([count(*), count(*) FILTER (o), count(*) FILTER (o AND accession LIKE 'SAM%')]) AS n FROM (SELECT *, NOT coalesce(lower(done) IN ('true', '1', 'yes'), false) AS o FROM expected_ids)")
def fetch_funnel(t):  # noqa: ANN001, ANN201
    return reconcile.ids_to_fetch(t("expected_ids"), "accession", "done", "SAM")[1]


@query("SELECT sample IN (SELECT sample FROM present_ids) AS present, count(*) AS n FROM expected_ids GROUP BY 1")
def reconcile_counts(t):  # noqa: ANN001, ANN201
    return reconcile.reconciled(t("expected_ids"), "sample", t("present_ids"), "present", ["sample", "segment"])[1]


@query("SELECT e.sample, m.file AS path FROM (SELECT DISTINCT record AS sample FROM mapping UNION SELECT DISTINCT sample FROM expected_ids) e JOIN mapping m ON m.file = concat('/f/', e.sample, '.parquet')")
def file_list(t):  # noqa: ANN001, ANN201
    ids = t("mapping").select(F.col("record").alias("sample")).union(t("expected_ids").select("sample"))
    return reconcile.file_list(ids, "sample", t("mapping").select(F.col("file").alias("path")), ".parquet")[0]


@query(f"SELECT n_first, n_second, round(n_first / n_second::DOUBLE, 6) AS ratio, round(log10(n_first / n_second::DOUBLE), 6) AS log10_ratio FROM (SELECT sum((category = '{S1}')::INT)::BIGINT AS n_first, sum((category = '{S2}')::INT)::BIGINT AS n_second FROM sample_meta)")
def overall_ratio(t):  # noqa: ANN001, ANN201
    return contingency.overall_ratio(t("sample_meta"), "category", S1, S2).select("n_first", "n_second", *r6("ratio", "log10_ratio"))


@query("WITH c AS (SELECT country, count(*) AS n FROM sample_meta GROUP BY 1) SELECT * FROM (SELECT country, n, 'head' AS \"end\" FROM c ORDER BY n DESC, country LIMIT 3) UNION ALL SELECT * FROM (SELECT country, n, 'tail' AS \"end\" FROM c ORDER BY n, country DESC LIMIT 3)")
def ratio_ends(t):  # noqa: ANN001, ANN201
    return contingency.ends(t("sample_meta").groupBy("country").agg(F.count(F.lit(1)).alias("n")), "n", "country", 3)


@query("SELECT sample, feature FROM presence WHERE feature IN (SELECT feature FROM presence GROUP BY 1 HAVING count(DISTINCT sample) < 40)")
def rare_features(t):  # noqa: ANN001, ANN201
    df = t("presence")
    return df.join(pangenome.prevalent(df, "sample", "feature", 40).select("feature").distinct(), "feature", "left_anti").select("sample", "feature")


from . import round_trips, smaller  # noqa: E402, F401  (they register their queries)
