"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A temporary folder takes its place only where the setting is absent and driver and executors
    are one process (tests); on a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, for tables that live as long as the session."""
    context = spark.sparkContext
    root = getattr(context, "_quern_scratch", None)
    if root is None:
        root = f"{checkpoint_dir(spark).rstrip('/')}/quern-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._quern_scratch = root
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: later filters on
    ``partition_by`` read only their folders, later selections only their columns."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(*df.columns)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``max_rows`` rows, else as it is.

    The count stops after ``max_rows + 1`` rows. Larger sides are left to a shuffled join, whose
    hot partitions AQE splits.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def with_columns_free(df: DataFrame, *names: str) -> None:
    """Raise if a helper column the operator needs already exists in its input."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in taken:
            raise ValueError(f"column {name!r} is reserved by the operator; rename it first")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need no install.

    Arrow batches are bounded by bytes as well as by rows, so that long texts cannot fill a worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))  # Spark's file server hands it to the executors
    context._quern_shipped = True


def hash_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows, those with the smallest hashes of their id; all if there are no more.

    A count and a filter: no sort, and nothing but the sample moves.
    """
    n, space = df.count(), 2**31 - 1
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(id_col), F.lit(space)) < int(space * rows / n))


#: Plan nodes that keep the partitions of a scan.
_NARROW = {"Project", "Filter", "Generate", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "SubqueryAlias", "MapInArrow", "MapInPandas", "Union"}


def _narrow(plan) -> bool:
    if plan.getClass().getSimpleName() not in _NARROW:
        return False
    children = plan.children()
    return all(_narrow(children.apply(n)) for n in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores.

    A scan of few files would leave Python work to a few tasks; where it has partitions enough, as
    any large input has, nothing is added to the plan, nor where it was shuffled anyway.
    """
    if not _narrow(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
