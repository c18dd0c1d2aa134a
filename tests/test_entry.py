import importlib
import sys

import pytest
from pyspark.sql import functions as F

from quern import runtime


def test_entry_without_what_the_subpackage_needs(monkeypatch):
    import __spark_entry__ as entry
    from quern.queries import registry

    monkeypatch.setitem(sys.modules, "quern.llm.queries", None)  # importing it raises ImportError
    assert set(entry.queries()) == set(registry()[0])
    importlib.reload(entry)


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: None)

    with pytest.raises(RuntimeError):
        runtime.checkpoint_dir(Session())


def test_spread_looks_at_plan_nodes_not_at_names(spark, tmp_path):
    spark.range(100).withColumn("Exchange", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert runtime.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shuffled = rows.groupBy("id").count()
    assert runtime.spread(shuffled) is shuffled


def test_cut_table_reads_back_the_same_rows(spark):
    rows = spark.range(20).withColumn("part", (F.col("id") % 3).cast("int")).withColumn("note", F.when(F.col("id") > 5, "x"))
    again = runtime.cut_table(rows, "test", "part")
    assert again.columns == rows.columns and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert "PartitionFilters: [isnotnull(part" in again.filter("part = 1")._jdf.queryExecution().executedPlan().toString()
