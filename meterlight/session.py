"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
PARTITIONS_SETTING = "spark.sql.shuffle.partitions"


def local_session(cores: str = "8", name: str = "meterlight") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the submitter makes the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so that Python tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_meterlight_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="meterlight-")) / "meterlight.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._meterlight_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only a local master, where driver and executors share one machine, may fall back to
    a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="meterlight-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/meterlight/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """At least ``least`` shuffle partitions for what is written inside, so that a task sorts a bounded share of it."""
    before = spark.conf.get(PARTITIONS_SETTING)
    spark.conf.set(PARTITIONS_SETTING, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS_SETTING, before)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def materialize(df: DataFrame, label: str, metrics: dict[str, Column] | None = None):
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage, survives lost executors, and gives Catalyst its
    true size, so later joins broadcast it only when it is under the session's threshold.
    With ``metrics`` the aggregates are observed during the write, and ``(table, values)``
    is returned.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    observation = None
    if metrics:
        observation = Observation(label)
        df = df.observe(observation, *[c.alias(name) for name, c in metrics.items()])
    df.write.parquet(path)
    table = spark.read.parquet(path)
    return (table, observation.get) if observation else table
