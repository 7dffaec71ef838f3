"""End-to-end plans: label tables, cohorts, filtered and pooled embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import measure
from cohortloom.operators import cohort, resolve, rollup, split, vectors


@dataclass(frozen=True)
class LabelTables:
    """What the label plan makes; all parts are lazy and share one scan of the records."""

    records: DataFrame
    rejects: DataFrame
    metadata: DataFrame
    binary: DataFrame
    log_mic: DataFrame
    antibiogram: DataFrame


def label_tables(records: DataFrame, sample: str, antibiotic: str, measurement: str, phenotype: str, order: str, metadata: list[str], least: int = 1000) -> LabelTables:
    """Codes phenotypes, reads measurements, keeps frequent antibiotics, rolls up metadata and pivots labels."""
    m = F.col(measurement)
    df = records.withColumn("binary_resistance", measure.binary_phenotype(F.col(phenotype))).withColumn("op", measure.operator(m)).withColumn("value", measure.number(m))
    df = df.withColumn("log_mic", measure.log_value(F.col("value"), F.col("op")))
    rejects = records.select(order, m.alias("raw"), measure.reject_reason(m).alias("reason")).where("reason is not null")
    kept = rollup.having_count(df, antibiotic, least)
    stats = rollup.test_stats(kept, antibiotic, phenotype).where(F.col("n_total") > least).orderBy(F.desc("r_percent"), antibiotic)
    return LabelTables(kept, rejects, rollup.first_non_null(kept, sample, order, metadata), rollup.pivot_mean(kept, sample, antibiotic, "binary_resistance"), rollup.pivot_mean(kept, sample, antibiotic, "log_mic"), stats)


@dataclass(frozen=True)
class Cohort:
    """Selected samples with their split and label, the audit, the funnel, and samples without embeddings."""

    samples: DataFrame
    audit: DataFrame
    funnel: DataFrame
    missing: DataFrame


def isolation_cohort(meta: DataFrame, tokens: tuple[str, str], present: DataFrame, ratio: float, sample: str = "sample", category: str = "category", host: str = "host", country: str = "country", study: str = "study", seed: int = 1) -> Cohort:
    """Two categories by token, human hosts, threads, balance by country, splits, then samples that have embeddings.

    Splits are assigned before samples are pruned, so that they don't depend on what is on storage.
    """
    first, second = resolve.resolve_pair(meta, category, *tokens)
    stages = [("initial", None), ("category", F.col(category).isin(first, second)), ("host", F.col(host) == "human")]
    rows = cohort.routed(cohort.funnel(meta, stages), study).where("thread is not null")
    s = cohort.Stratum(("thread", country), category, first, second, sample)
    chosen = split.with_splits(split.pair_label(cohort.balanced(rows, s, ratio), category, first, second, "label"), sample, seed)
    kept, missing = split.pruned(chosen, sample, present)
    return Cohort(kept, cohort.audited(cohort.stratum_counts(rows, s), ratio), cohort.funnel_counts(meta, stages), missing)


def pooled_embeddings(embeddings: DataFrame, wanted: DataFrame, key: str, embedding: str) -> DataFrame:
    """Mean vectors of the wanted keys: filtered at the scan, pooled by dimension."""
    return vectors.mean_pool(embeddings.join(wanted.select(key).distinct(), key, "left_semi"), key, embedding)
