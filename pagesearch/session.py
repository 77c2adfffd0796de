"""Session helpers: local session for tests/bench, shared checkpoint folder,
and a size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound (rows) for a side we broadcast on purpose.  The check reads at
# most ``BROADCAST_MAX_ROWS + 1`` rows, so it is cheap even on a huge input.
BROADCAST_MAX_ROWS = 200_000


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "pagesearch") -> SparkSession:
    """Session for tests and the bench.  On a cluster use the session you are
    given; this only fills in settings that are not already set."""
    master = master or os.environ.get("PAGESEARCH_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("PAGESEARCH_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PAGESEARCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location comes from ``spark.checkpoint.dir``.  Only when that is unset
    (local tests) is one created under the system temp folder and set on the
    session, so later calls agree.
    """
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only a local
    session (tests, bench) without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so the
    setting is required there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="pagesearch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


# Source bytes (compressed Parquet) per task for exchanges whose output
# expands a lot (documents -> tokens); override with conf pagesearch.bytesPerTask.
# A megabyte gives about 25 of postings, which a task sorts: they have to fit
# its share of an executor's memory, or all are spilled.
BYTES_PER_TASK = 8 * 1024 * 1024


def expand_partitions(df: DataFrame) -> int:
    """Partition count for an exchange feeding an expanding stage: from the
    sizes that the plan's sources state (no file is asked for again), at least
    twice the default parallelism.  AQE would coalesce such an exchange by
    its *input* bytes and leave a few tasks with all the expanded work.
    Sources without a stated size (rows of the driver) count as nothing."""
    spark = df.sparkSession
    target = int(spark.conf.get("pagesearch.bytesPerTask", str(BYTES_PER_TASK)))
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    unknown = int(str(spark._jsparkSession.sessionState().conf().defaultSizeInBytes()))
    total = sum(s for s in sizes if s < unknown)
    return max(2 * spark.sparkContext.defaultParallelism, -(-total // target))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` into ``expand_partitions`` parts."""
    return df.repartition(expand_partitions(df), *keys)


def fits(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only behind a row-count check; otherwise leave the join
    to the planner (sort-merge with AQE skew splitting)."""
    return F.broadcast(df) if fits(df, max_rows) else df


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a bounded intermediate result (expanded query terms, a top-k
    page) once to the shared checkpoint folder and read it back: lineage is
    cut, size checks and later joins read the small file instead of
    recomputing the plan, and a lost executor does not lose it."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)
