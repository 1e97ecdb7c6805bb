"""Session helpers: local test session, checkpoint folder, size limits."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

WINDOW_ROWS_KEY = "spark.dosewise.windowRows"
BROADCAST_BYTES_KEY = "spark.dosewise.broadcastBytes"
BLOCK_ROWS_KEY = "spark.dosewise.blockRows"

# Largest group sorted inside one window task before it is range-split.
DEFAULT_WINDOW_ROWS = 2_000_000
# Largest model shipped to every executor; bigger ones take the shuffled path.
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024
# Rows per side of one dense block in blocked distance computations.
DEFAULT_BLOCK_ROWS = 2048


def local_session(cpus: str | int = "*", memory: str = "16g", app: str = "dosewise") -> SparkSession:
    """Session for tests and the local benchmark."""
    partitions = "8" if str(cpus) == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def limit(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def fresh(df: DataFrame) -> DataFrame:
    """Same columns under new attribute ids, so two sides of a cogroup never share one."""
    return df.select(*[df[c].alias(c) for c in df.columns])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only a local session gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows no longer depend on upstream recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
