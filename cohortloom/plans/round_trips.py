"""Sources and sinks as queries: whole tables are written, read again, and must be the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.text import parent_name
from cohortloom.operators import cohort, reconcile, rollup, split
from cohortloom.sources import genomes, readers, sinks
from cohortloom.streaming.incremental import output, process_new_files, process_to_outputs

from .registry import query
from .smaller import S1, S2


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("SELECT record, sample, antibiotic, measurement, phenotype, year, country, host FROM ast_records", written=True)
def csv_round_trip(t, spark, folder):  # noqa: ANN001, ANN201
    df = t("ast_records")
    sinks.delimited(df, folder + "/a")
    return readers.delimited(spark, folder + "/a", schema=df.schema)


@query("SELECT CAST(sample AS VARCHAR) AS sample, accession, done, segment FROM expected_ids", written=True)
def tsv_round_trip(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.delimited(t("expected_ids"), folder + "/a", "\t", only_if_rows=True)
    return readers.delimited(spark, folder + "/a", "\t")


def _lines(df: DataFrame, header: str, line: Column, path: str) -> None:
    """Raw lines below a header in each file."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    df.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value")).write.text(path)


def _ragged(t, spark, folder: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Every 7th line has a field too many, every 5th of the others lacks one, and a field holds the separator and quotes."""
    df, quoted = t("expected_ids"), F.concat(F.lit('"a, ""'), F.col("segment"), F.lit('"""'))
    tail = F.when(F.col("sample") % 7 == 0, F.lit(",x,")).when(F.col("sample") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(","), F.coalesce("done", F.lit("NA"))))
    _lines(df, "sample,segment,done", F.concat(F.col("sample").cast("string"), F.lit(","), quoted, tail), folder + "/a")
    return readers.delimited_with_rejects(spark, folder + "/a", ",")


@query("""SELECT CAST(sample AS VARCHAR) AS sample, 'a, "' || segment || '"' AS segment, CASE WHEN sample % 5 <> 0 THEN done END AS done FROM expected_ids WHERE sample % 7 <> 0""", written=True)
def ragged_rows(t, spark, folder):  # noqa: ANN001, ANN201
    return _ragged(t, spark, folder)[0]


@query('''SELECT CAST(sample AS VARCHAR) AS first, sample || ',"a, ""' || segment || '""",x,' AS line FROM expected_ids WHERE sample % 7 = 0''', written=True)
def ragged_rejects(t, spark, folder):  # noqa: ANN001, ANN201
    bad = _ragged(t, spark, folder)[1]
    sinks.rejects(_text(bad).withColumn("line", F.base64(F.col("line").cast("binary"))), folder + "/bad")
    return readers.delimited(spark, folder + "/bad").withColumn("line", F.unbase64("line").cast("string"))


DRUGS = ("click", "error", "purchase", "signup", "view")
CELLS = ", ".join(f"avg(CASE WHEN antibiotic = '{d}' THEN year END)::DOUBLE AS \"{d}\"" for d in DRUGS)


@query(f"SELECT sample AS id, {CELLS}, sample AS \"Sample\" FROM ast_records WHERE year IS NOT NULL GROUP BY sample", written=True)
def label_sheet(t, spark, folder):  # noqa: ANN001, ANN201
    wide = rollup.pivot_mean(t("ast_records"), "sample", "antibiotic", "year", list(DRUGS))
    sinks.delimited(wide.withColumnRenamed("sample", "id"), folder + "/a")
    return readers.label_sheet(spark, folder + "/a", "id")


@query("SELECT path FROM path_list", written=True)
def path_list_file(t, spark, folder):  # noqa: ANN001, ANN201
    padded = F.concat(F.lit("  "), "path", F.when(F.col("record") % 3 == 0, F.lit(" \n")).otherwise(F.lit("")))
    t("path_list").select(padded.alias("value")).write.text(folder + "/a")
    return readers.path_list(spark, folder + "/a")


@query("SELECT DISTINCT 'segment=' || segment AS sample FROM expected_ids", written=True)
def samples_in_files(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.partitioned(t("expected_ids"), folder + "/a", ["segment"])
    files = readers.first_files(readers.listing(spark, folder + "/a", "*.parquet", recursive=True), 0)
    return readers.samples_in(files, parent_name(F.col("path")))


@query("SELECT DISTINCT 'segment=' || segment AS folder, true AS in_order FROM expected_ids", written=True)
def found_files(t, spark, folder):  # noqa: ANN001, ANN201
    """Every file below a folder, by name; of the few names the order is looked at as well."""
    sinks.partitioned(t("expected_ids"), folder + "/a", ["segment"])
    paths = [r[0] for r in readers.found_files(spark, folder + "/a", "*.parquet").select("path").collect()]
    found = spark.createDataFrame([(p,) for p in paths], "path string")
    return found.select(parent_name(F.col("path")).alias("folder"), F.lit(paths == sorted(paths)).alias("in_order")).distinct()


@query("SELECT segment, sample, accession FROM expected_ids", written=True)
def partitioned_parquet(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.partitioned(t("expected_ids"), folder + "/a", ["segment"])
    return readers.parquet(spark, folder + "/a", ["segment", "sample", "accession"])


@query("SELECT count(*) AS n_rows, 4 AS n_columns FROM expected_ids", written=True)
def parquet_profile(t, spark, folder):  # noqa: ANN001, ANN201
    t("expected_ids").write.parquet(folder + "/a")
    return readers.parquet_profile(spark, folder + "/a").select("n_rows", "n_columns")


@query("SELECT count(*)::BIGINT AS n_rows, 4::BIGINT AS n_columns, true AS grouped FROM expected_ids", written=True)
def parquet_footers(t, spark, folder):  # noqa: ANN001, ANN201
    t("expected_ids").write.parquet(folder + "/a")
    out = readers.footers(spark, folder + "/a")
    return out.agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"), (F.sum("n_row_groups") >= 1).alias("grouped"))


@query("SELECT unnest([1, 2, 3, 4])::INT AS place, unnest(['sample', 'accession', 'done', 'segment']) AS \"column\"", written=False)
def parquet_schema(t):  # noqa: ANN001, ANN201
    return readers.schema_rows(t("expected_ids")).select("place", "column")


@query("SELECT CAST(sample AS VARCHAR) AS sample, accession, done, segment, CAST(sample IN (SELECT sample FROM present_ids) AS VARCHAR) AS present FROM expected_ids", written=True)
def replaced_in_place(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.delimited(t("expected_ids"), folder + "/a", "\t")
    again = readers.delimited(spark, folder + "/a", "\t").withColumn("sample", F.col("sample").cast("long"))
    sinks.replaced(reconcile.flagged(again, "sample", t("present_ids"), "present"), folder + "/a")
    return readers.delimited(spark, folder + "/a", "\t")


DIMS = 64


@query(f"SELECT gene, {', '.join(f'embedding[{k + 1}]::DOUBLE AS dim_{k}' for k in range(DIMS))} FROM genes", written=True)
def wide_matrix(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.wide_matrix(t("genes"), "gene", "embedding", DIMS, folder + "/a")
    return readers.parquet(spark, folder + "/a").select("gene", *[F.col(f"dim_{k}").cast("double").alias(f"dim_{k}") for k in range(DIMS)])


@query("""SELECT split, count(*) AS n, sum(gene)::BIGINT AS total FROM (SELECT gene, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train' WHEN k <= floor(0.7::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'validate' ELSE 'evaluate' END AS split
  FROM (SELECT gene, row_number() OVER (ORDER BY md5('1:' || gene), gene) AS k, count(*) OVER () AS n FROM genes)) GROUP BY 1""", written=True)
def split_dataset(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.split_dataset(t("genes"), split.with_splits(t("genes").select("gene"), "gene", name="split"), "gene", folder + "/a", "split")
    return readers.parquet(spark, folder + "/a").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gene").cast("long")).alias("total"))


@query("SELECT CAST(sample AS VARCHAR) AS value, concat('batch_', lpad(CAST((k - 1) // 100 AS VARCHAR), CAST(greatest(2, length(CAST((n - 1) // 100 AS VARCHAR))) AS INT), '0')) AS batch_name FROM (SELECT sample, row_number() OVER (ORDER BY sample) AS k, count(*) OVER () AS n FROM expected_ids)", written=True)
def batch_files(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.batches(t("expected_ids"), "sample", 100, folder + "/a")
    return spark.read.text(folder + "/a")


@query("SELECT CAST(sample AS VARCHAR) AS customer, feature AS sample FROM brand_presence", written=True)
def presence_matrix(t, spark, folder):  # noqa: ANN001, ANN201
    pairs = t("brand_presence").select(F.col("sample").alias("customer"), "feature")
    wide = pairs.groupBy("customer").pivot("feature").agg(F.count(F.lit(1))).na.fill(0)
    sinks.delimited(wide, folder + "/a", "\t")
    return readers.presence_matrix(spark, folder + "/a")


@query("SELECT segment, count(*) + 1 AS n, 1::BIGINT AS n_reference FROM expected_ids WHERE segment <> 'BUILDING' GROUP BY 1", written=True)
def files_by_group(t, spark, folder):  # noqa: ANN001, ANN201
    df = _text(t("expected_ids"))
    reference = spark.range(1).select(F.lit("0").alias("sample"), F.lit("REF").alias("accession"), F.lit("no").alias("done"), F.lit("").alias("segment"))
    sinks.per_group(df, folder + "/a", "segment", reference, ("BUILDING",))
    back = spark.read.option("header", True).option("sep", "\t").csv(folder + "/a")
    return back.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("accession") == "REF").cast("long")).alias("n_reference"))


@query("SELECT g.gene, g.sample, count(*) OVER (PARTITION BY g.sample) AS n_genes, '64' AS dims FROM genes g", written=True)
def annotated_pair(t, spark, folder):  # noqa: ANN001, ANN201
    genes = t("genes")
    sinks.annotated(genes, genes.groupBy("sample").agg(F.count(F.lit(1)).alias("n_genes")), {"dims": 64}, folder)
    rows, samples, params = readers.annotated(spark, folder)
    return rows.join(samples, "sample").select("gene", "sample", "n_genes", F.lit(params["dims"]).alias("dims"))


@query("SELECT accession AS name, length(accession)::BIGINT AS n FROM expected_ids", written=True)
def parsed_files(t, spark, folder):  # noqa: ANN001, ANN201
    t("expected_ids").select("accession").write.text(folder + "/a")
    return readers.parsed_files(spark, folder + "/a", lambda p, c: [(x.decode(), len(x)) for x in c.split()], "name string, n bigint", "*.txt")


CODONS = dict(zip("ADEFGHWKNPQRSTVY", "gct gat gaa ttt ggt cat tgg aaa aat cct caa cgt tct act gtt tat".split(), strict=True))


@query(f"""SELECT 'C' || sample AS contig, 'L' || sample AS locus_tag, CASE WHEN sample % 11 = 0 THEN '5..x' WHEN sample % 4 = 0 THEN '10..108' WHEN sample % 4 = 1 THEN '11..109' WHEN sample % 4 = 2 THEN 'complement(5..103)' ELSE 'join(1..48,60..110)' END AS location,
  CASE WHEN sample % 11 <> 0 THEN translate(md5(CAST(sample AS VARCHAR)), '0123456789abcdef', '{"".join(CODONS)}') END AS protein, CASE WHEN sample % 11 = 0 THEN 'location' END AS reason FROM expected_ids""", written=True)
def genome_proteins(t, spark, folder):  # noqa: ANN001, ANN201
    """Proteins as stated, or translated from either strand and from parts."""
    n = F.col("sample")
    df = t("expected_ids").select("sample", F.translate(F.md5(n.cast("string")), "0123456789abcdef", "".join(CODONS)).alias("aa"))
    codon = F.create_map(*[F.lit(x) for p in CODONS.items() for x in p])
    dna = F.concat(F.array_join(F.transform(F.split("aa", ""), lambda c: codon[c]), ""), F.lit("taa"))
    df = df.withColumn("dna", dna)
    pick = lambda *v: F.when(n % 4 == 0, v[0]).when(n % 4 == 1, v[1]).when(n % 4 == 2, v[2]).otherwise(v[3])
    location = F.when(n % 11 == 0, "5..x").otherwise(pick("10..108", "11..109", "complement(5..103)", "join(1..48,60..110)"))
    other = F.concat(F.lit("gggg"), F.reverse(F.translate("dna", "acgt", "tgca")))
    bases = pick(F.lit(""), F.concat(F.lit("c" * 10), "dna"), other, F.concat(F.substring("dna", 1, 48), F.lit("a" * 11), F.substring("dna", 49, 99)))
    pad = " " * 21
    stated = F.when(n % 4 == 0, F.concat(F.lit(f'{pad}/translation="'), F.substring("aa", 1, 20), F.lit("\n" + pad), F.substring("aa", 21, 99), F.lit('"\n'))).otherwise("")
    record = F.concat(
        F.lit("LOCUS       C"), n, F.lit(" 200 bp DNA\nDEFINITION  made.\nFEATURES             Location/Qualifiers\n     source          1..200\n     CDS             "), location,
        F.lit(f'\n{pad}/locus_tag="L'), n, F.lit('"\n'), stated, F.lit("ORIGIN\n        1 "), F.substring(bases, 1, 60), F.lit("\n       61 "), F.substring(bases, 61, 99), F.lit("\n//"),
    )
    df.select(record.alias("value")).repartition(5).write.option("compression", "gzip").text(folder + "/a")
    return genomes.proteins(spark, folder + "/a", "*.txt.gz").select("contig", "locus_tag", "location", "protein", "reason")


@query("SELECT record, row_number() OVER (ORDER BY record) - 1 AS line FROM ast_records", written=True)
def line_numbers(t, spark, folder):  # noqa: ANN001, ANN201
    """Rows written in order to several files come back with their numbers."""
    t("ast_records").orderBy("record").write.option("header", True).csv(folder + "/a")
    return readers.numbered(spark, folder + "/a").select(F.col("record").cast("bigint").alias("record"), "line")


@query("SELECT sample, min(record) AS record, arg_min(antibiotic, record) AS antibiotic FROM ast_records GROUP BY 1", written=True)
def first_lines(t, spark, folder):  # noqa: ANN001, ANN201
    """The first line of each sample, by the order of lines in files alone."""
    t("ast_records").orderBy("record").write.option("header", True).csv(folder + "/a")
    rows = readers.in_file_order(spark, folder + "/a")
    first = rows.groupBy("sample").agg(F.min_by(F.struct("record", "antibiotic"), "line").alias("r"))
    return first.select("sample", F.col("r.record").cast("bigint").alias("record"), F.col("r.antibiotic").alias("antibiotic"))


@query("SELECT g.sample % 3 AS part, g.gene, len(g.embedding)::INT AS size FROM genes g WHERE g.sample % 3 <> 2 AND g.gene IN (SELECT sample FROM present_ids)", written=True)
def wanted_of_files(t, spark, folder):  # noqa: ANN001, ANN201
    """Files are named by what they hold; a third of them is wanted by nobody, and the result is parted by input."""
    for k in range(3):
        t("genes").where(F.col("sample") % 3 == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
    names = readers.listing(spark, folder + "/in", "*.parquet", True).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).cast("bigint").alias("part"))
    genes = t("genes").join(t("present_ids").select(F.col("sample").alias("gene")).distinct(), "gene", "left_semi")
    wanted = genes.select("gene", (F.col("sample") % 3).alias("part")).where("part <> 2").join(names, "part").select("file", "gene")
    sinks.by_input(readers.wanted_rows(spark, folder + "/in", wanted, "file", "gene"), folder + "/out", "file")
    return spark.read.parquet(folder + "/out").join(names, "file").select("part", "gene", F.size("embedding").alias("size"))


@query("SELECT sample, accession, done, segment, sample IN (SELECT sample FROM present_ids) AS present FROM expected_ids", written=True)
def published_versions(t, spark, folder):  # noqa: ANN001, ANN201
    sinks.published(t("expected_ids"), folder + "/a")
    sinks.published(reconcile.flagged(readers.current(spark, folder + "/a"), "sample", t("present_ids"), "present"), folder + "/a")
    sinks.swept(spark, folder + "/a")
    return readers.current(spark, folder + "/a")


@query("""SELECT 'kept' AS output, record, measurement AS value FROM ast_records WHERE measurement LIKE '%mg/L' UNION ALL SELECT 'counts', count(*), antibiotic FROM ast_records WHERE measurement LIKE '%mg/L' GROUP BY antibiotic
  UNION ALL SELECT 'rejects', record, measurement FROM ast_records WHERE NOT coalesce(measurement LIKE '%mg/L', false)""", written=True)
def streamed_outputs(t, spark, folder):  # noqa: ANN001, ANN201
    """Three outputs of two batches; counts are added up over batches."""
    df = t("ast_records").select("record", "antibiotic", "measurement")
    fine = F.coalesce(F.col("measurement").like("%mg/L"), F.lit(False))
    outputs = {
        "kept": lambda b: b.where(fine).select("record", F.col("measurement").alias("value")),
        "counts": lambda b: b.where(fine).groupBy(F.col("antibiotic").alias("value")).agg(F.count(F.lit(1)).alias("record")),
        "rejects": lambda b: b.where(~fine).select("record", F.col("measurement").alias("value")),
    }
    for k in (0, 1):
        df.where(F.col("record") % 2 == k).write.mode("append").parquet(folder + "/in")
        process_to_outputs(spark, folder + "/in", df.schema, outputs, folder + "/out", folder + "/mark")
    parts = {name: output(spark, folder + "/out", name) for name in outputs}
    parts["counts"] = parts["counts"].groupBy("value").agg(F.sum("record").alias("record"))
    return cohort.united([p.select(F.lit(name).alias("output"), "record", "value") for name, p in parts.items()])


@query("SELECT sample, accession, upper(segment) AS segment FROM expected_ids", written=True)
def streamed_batches(t, spark, folder):  # noqa: ANN001, ANN201
    """Two calls of the resumable stream; the second one sees only what came after the first."""
    df, half = t("expected_ids").select("sample", "accession", "segment"), F.col("sample") % 2
    for k in (0, 1):
        df.where(half == k).write.mode("append").parquet(folder + "/in")
        process_new_files(spark, folder + "/in", df.schema, lambda s: s.withColumn("segment", F.upper("segment")), folder + "/out", folder + "/mark")
    return spark.read.parquet(folder + "/out")


@query(f"SELECT thread, category, count(*) AS n FROM (SELECT *, CASE WHEN lower(study) LIKE '%amr%' THEN 'AMR' WHEN lower(study) LIKE '%surveillance%' THEN 'Surveillance' WHEN study IS NULL THEN 'NA' END AS thread FROM sample_meta) WHERE thread IS NOT NULL AND category IN ('{S1}', '{S2}') GROUP BY 1, 2")
def united_threads(t):  # noqa: ANN001, ANN201
    routed = cohort.routed(t("sample_meta"), "study")
    parts = cohort.united([routed.where(F.col("thread") == name) for name in ("AMR", "Surveillance", "NA")])
    return parts.where(F.col("category").isin(S1, S2)).groupBy("thread", "category").agg(F.count(F.lit(1)).alias("n"))
