"""End-to-end plans on the smallest tables."""

from pyspark.sql import functions as F

from cohortloom.operators import reconcile
from cohortloom.plans.adapters import adapted
from cohortloom.plans.pipelines import isolation_cohort, label_tables, pooled_embeddings

DIR = "/root/testdata/sf0.001"


def test_label_tables(spark):
    out = label_tables(adapted(spark, DIR, "ast_records"), "sample", "antibiotic", "measurement", "phenotype", "record", ["year", "country"], least=100)
    assert out.binary.columns[0] == "sample" and "signup" not in out.binary.columns
    assert {r[0] for r in out.rejects.select("reason").distinct().collect()} == {"parts", "operator", "number"}
    assert out.metadata.count() == out.records.select("sample").distinct().count()
    assert [r.r_percent for r in out.antibiogram.collect()] == sorted((r.r_percent for r in out.antibiogram.collect()), reverse=True)


def test_isolation_cohort(spark):
    meta = adapted(spark, DIR, "sample_meta")
    present = meta.where("sample % 5 <> 0").select("sample")
    out = isolation_cohort(meta, ("blood", "faeces"), present, 2.0)
    rows = out.samples.collect()
    assert rows and all(r.sample % 5 for r in rows) and {r.thread for r in rows} <= {"AMR", "Surveillance", "NA"}
    assert len(rows) + out.missing.count() == sum(r.sampled1 + r.sampled2 for r in out.audit.collect())
    assert [r.n for r in out.funnel.orderBy("step").collect()][0] == meta.count()


def test_pooled_embeddings(spark):
    genes = adapted(spark, DIR, "genes")
    out = pooled_embeddings(genes, genes.where("sample < 3"), "sample", "embedding").collect()
    assert {r.sample for r in out} <= {0, 1, 2} and all(len(r.embedding) == 64 for r in out)


def test_small_operators(spark):
    df = spark.createDataFrame([("a", None), ("b", 1)], "id string, n int")
    got, absent = reconcile.requested(df, ["n", "x"], "id")
    assert got.columns == ["n"] and absent == ["x"] and reconcile.requested(df, ["x"], "id")[0].columns == ["id"]
    assert sorted(r.n for r in reconcile.as_text(df, ["n"]).collect()) == ["1", "nan"]
    ref = spark.createDataFrame([("ref", 0)], "id string, n int").withColumn("g", F.lit("x"))
    out = reconcile.with_reference(df.withColumn("g", F.lit("u")), ref, ["u", "v"], "g")
    assert out.where("id = 'ref'").count() == 2
    assert reconcile.constant_mapped(df, "id", {}, "m").where("m is null").count() == 2
    paths = spark.createDataFrame([("/x/a_with.pt",)], "path string")
    there, lacking = reconcile.file_list(df, "id", paths, "_with.pt")
    assert there.collect() == [("a", "/x/a_with.pt")] and [r.id for r in lacking.collect()] == ["b"]
