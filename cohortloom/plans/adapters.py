"""Test tables in the shapes that the operators take, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "ast_records": """
        SELECT event_id AS record, concat('S', CAST(user_id AS STRING)) AS sample, event_type AS antibiotic,
          CASE WHEN event_id % 17 = 0 THEN '32' WHEN event_id % 19 = 0 THEN '~ 4 mg/L' WHEN event_id % 23 = 0 THEN '>= abc mg/L'
               WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN '<= .25 mg/L' WHEN event_id % 37 = 0 THEN '>= 64/4 mg/L'
               ELSE concat(CASE event_id % 6 WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '>=' WHEN 3 THEN '<=' WHEN 4 THEN '=' ELSE '==' END,
                           ' ', CAST(CAST(value AS DECIMAL(10,2)) AS STRING), ' mg/L') END AS measurement,
          CASE WHEN user_id % 10 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'Resistant' WHEN event_id % 4 = 1 THEN 'susceptible'
               WHEN event_id % 4 = 2 THEN 'Intermediate' END AS phenotype,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(2000 + user_id % 20 AS INT) END AS year,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('C', CAST(user_id % 7 AS STRING)) END AS country,
          CASE WHEN user_id % 4 = 0 THEN 'human' WHEN user_id % 4 = 1 THEN 'cattle' WHEN event_id % 2 = 0 THEN 'water' END AS host
        FROM events WHERE NOT (event_type = 'signup' AND event_id % 3 <> 0)""",
    "sample_meta": """
        SELECT d.doc_id AS sample, CASE WHEN l.quality = 1 THEN 'blood & sterile fluids' ELSE 'faeces / rectal swab' END AS category,
          CASE WHEN l.toxic = 0 THEN 'human' ELSE 'animal' END AS host, d.source AS country,
          CASE d.lang WHEN 'en' THEN 'AMR control' WHEN 'fr' THEN 'Surveillance' WHEN 'de' THEN NULL ELSE 'outbreak' END AS study,
          CASE WHEN d.doc_id % 3 = 0 THEN 'Hospital inpatient' WHEN d.doc_id % 3 = 1 THEN 'community' END AS setting
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "present_ids": "SELECT DISTINCT o_custkey AS sample FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "expected_ids": """
        SELECT c_custkey AS sample, concat(CASE WHEN c_custkey % 4 = 0 THEN 'GCF_' ELSE 'SAM' END, CAST(c_custkey AS STRING)) AS accession,
          CASE c_custkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'no' WHEN 3 THEN NULL ELSE 'YES' END AS done,
          c_mktsegment AS segment FROM customer""",
    "accessions": """
        SELECT p_partkey AS record, CASE WHEN p_partkey % 3 = 0 THEN concat('SAM', CAST(p_partkey AS STRING))
          ELSE concat('GCF_', lpad(CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING), 9, '0'), '.1_ASM', CAST(p_size AS STRING)) END AS accession,
          CASE WHEN p_partkey % 7 = 0 THEN 'true' ELSE 'false' END AS downloaded FROM part""",
    "stems": "SELECT concat('_', lpad(CAST(p_partkey AS STRING), 9, '0')) AS stem FROM part WHERE p_partkey * 7919 % 101 < 50",
    "path_list": """
        SELECT p_partkey AS record, concat('/a/b/', CASE WHEN p_partkey % 2 = 0 THEN 'GCF_' ELSE 'X_' END, CAST(p_partkey AS STRING), '.1_ASM',
          CASE p_partkey % 3 WHEN 0 THEN '.fa.gz' WHEN 1 THEN '.fna.gz' ELSE '.bakta.gff3.gz' END) AS path FROM part""",
    "presence": """
        SELECT DISTINCT sample, feature FROM (
          SELECT o_custkey AS sample, concat('T:', p_type) AS feature FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
          UNION ALL SELECT o_custkey, concat('B:', p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
          UNION ALL SELECT o_custkey, concat('C:', p_brand, '/', p_type, '/', CAST(p_size AS STRING)) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) x""",
    "brand_presence": "SELECT DISTINCT o_custkey AS sample, p_brand AS feature FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey",
    "genes": "SELECT CAST(label AS BIGINT) AS sample, vec_id AS gene, embedding FROM embeddings",
    "baskets": "SELECT o_custkey AS sample, o_orderkey AS record, CAST(l_quantity AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "run_summary": """
        SELECT n_name AS strain, CASE WHEN n_nationkey % 3 <> 0 THEN 1 ELSE 2 + n_nationkey % 4 END AS n_lineages, count(*) AS n,
          avg(o_totalprice) AS mean_size, stddev_samp(o_totalprice) AS sd_size, n_regionkey AS region
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey, n_regionkey""",
    "run_table": """
        SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'common' ELSE n_name END AS strain, CASE n_regionkey WHEN 4 THEN 'other' WHEN 3 THEN 'split' ELSE 'whole' END AS kind,
          CAST(1 + length(c_mktsegment) % 4 AS INT) AS n_lineages, c_mktsegment AS segment, count(*) AS n_samples, CAST(sum(c_custkey % 7) AS BIGINT) AS in_strain
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey, n_regionkey, c_mktsegment""",
    "predictions": "SELECT CAST(quality AS INT) AS label, CAST((n_chars % 41 - 20) / 10.0 AS DOUBLE) AS logit FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "mapping": "SELECT o_custkey AS sample, o_orderkey AS record, concat('/f/', CAST(o_orderkey AS STRING), '.parquet') AS file FROM orders",
}
#: What Spark reads in another way: a double's cents are those of its product with 100, as DuckDB's cast takes them, not of its shortest decimal
#: form (1.005 is 1.00); one join for the three kinds of features, dealt by sample before they are spelt out.
SPARK_SQL = {
    "ast_records": SQL["ast_records"].replace("CAST(value AS DECIMAL(10,2))", "CAST(round(value * 100) / 100 AS DECIMAL(10,2))"),
    "presence": """
        SELECT DISTINCT sample, explode(array(concat('T:', p_type), concat('B:', p_brand), concat('C:', p_brand, '/', p_type, '/', CAST(p_size AS STRING)))) AS feature FROM (
          SELECT /*+ REPARTITION({parts}, sample), MERGE(part) */ o_custkey AS sample, p_type, p_brand, p_size
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) x""",
}
#: For these, the table by whose rows they are dealt, and rows of it for a partition: so no task's share grows with the input.
DEALT = {"presence": ("lineitem", 500_000)}
#: Tables that each adapter reads.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter over the tables of a folder; no view is left behind."""
    import re

    sql, used = SPARK_SQL.get(name, SQL[name]), {}
    if name in DEALT:
        table, rows = DEALT[name]
        sql = sql.replace("{parts}", str(1 + spark.read.parquet(f"{sf_dir}/{table}.parquet").count() // rows))
    for t in TABLES:
        new = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        if new != sql:
            sql, used[t] = new, spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **used)


def with_adapters(sql: str) -> str:
    """DuckDB SQL over adapters: each one that is named becomes a common table expression."""
    import re

    named = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    if not named:
        return sql
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in named)
    own = re.match(r"WITH( RECURSIVE)? ", sql)
    return f"WITH{own[1] or ''} {head}, {sql[own.end():]}" if own else f"WITH {head} {sql}"
