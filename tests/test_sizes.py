"""Memory of a task: shuffles dealt by the rows of a table, one sort for the maxima of a signal."""

from pyspark.sql import functions as F

from tidemark.operators import peaks
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
NUMBER = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_shuffles_grow_with_rows(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(catalogue, "TASK_ROWS", 100)
    catalogue.queries()["local_maxima"](spark, SF)
    assert int(spark.conf.get(NUMBER)) == -(-rows // 100)
    monkeypatch.undo()
    catalogue.queries()["calibration"](spark, SF)
    assert spark.conf.get(NUMBER) == spark.conf.get("spark.sql.shuffle.partitions")


def test_maxima_sort_a_signal_once(spark):
    signal = spark.range(1000).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("idx"), F.pmod(F.hash("id"), F.lit(3)).cast("double").alias("value"))
    plan = peaks.local_maxima(signal)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan
