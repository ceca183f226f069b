from pyspark.sql import functions as F

from catalink.operators import audit
from catalink.session import spread

LOG = [(1, "SELECT 1 FROM orders", "Table: orders"), (2, "DROP TABLE orders", "Table: orders"), (3, "SELECT 1 FROM nowhere", ""), (4, None, None)]


def test_tasks_are_bounded_by_rows_when_splits_are_as_many_as_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 1000, 1, cores)
    assert spread(df).rdd.getNumPartitions() == cores
    held = spread(df, 50).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 20 and sum(r["count"] for r in held) == 1000 and max(r["count"] for r in held) <= 60


def test_the_audit_is_not_copied_into_a_filter(spark):
    log = spark.createDataFrame(LOG, "query_id int, sql string, schema_context string").withColumn("dialect", F.lit("mysql"))
    audited = audit.audit(log)
    kept = audit.failed(audited)
    plan = audit.repair_reason(kept, "query_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
    assert [r["query_id"] for r in kept.orderBy("query_id").collect()] == [r["query_id"] for r in audited.filter(~F.col("passed")).orderBy("query_id").collect()]
