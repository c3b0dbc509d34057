"""Session, durability and bounded-broadcast helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000
BATCH_BYTES = 6 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def get_session(name: str = "cohortlab", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session; cluster settings win unless the caller names its own."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a temporary folder only for local runs that set none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="cohortlab-checkpoint-")
    sc.setCheckpointDir(configured)


def durable(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in the checkpoint folder and return the stored copy.

    It survives executor loss and cuts the lineage like a checkpoint, and as a columnar table it also
    keeps column pruning, filter pushdown and a known size for the joins that read it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.durable_path = path
    return stored


def release(stored: DataFrame) -> None:
    """Delete a table of :func:`durable` that nothing reads any more; a DataFrame that isn't one stays as it is."""
    path = getattr(stored, "durable_path", None)
    if path is not None:
        jvm = stored.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(stored.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver's JVM collect what finished steps have left.

    Spark removes shuffle files and broadcasts once the driver's objects for them are collected, by itself every 30 minutes or
    when the heap is full. Without it the heap of a query of many short jobs grows far beyond what is live.
    """
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``small`` only once its row count is known to be at most ``max_rows``.

    The rows read by the check become the broadcast side, so they are computed once. A larger side
    is returned as it is and joins by shuffle.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def bound_batches(spark: SparkSession) -> None:
    """Let an Arrow batch hold at most ``BATCH_BYTES`` rather than Spark's 64 MB, unless the session names its own limit.

    Each task holds a batch in the JVM, whose buffers double as they grow, and again in its Python worker; 10,000 rows
    with texts take far more than 10,000 rows of numbers. It holds for the session, as lazy results are planned later.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def bucket_count(spark: SparkSession) -> int:
    """Number of value ranges for ordered operators: follows the shuffle width, within a fixed bound."""
    return max(64, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
