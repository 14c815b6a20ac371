"""Session settings and the shared folder for cut-lineage tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARED_DIR = "spark.checkpoint.dir"

# The small tables joined here have rows of some 100 bytes: this many are sure to fit a broadcast.
BROADCAST_ROWS = 10_000


def local_session(app: str = "counterscope", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks. On a cluster, use the one spark-submit configures."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_homes: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting falls back to
    the temporary folder; a cluster session without it is an error.
    """
    root = spark.conf.get(_SHARED_DIR, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {_SHARED_DIR} to a folder all executors share")
        root = tempfile.gettempdir()
    return root.rstrip("/")


def _home(spark: SparkSession) -> str:
    """This session's own folder below the shared one, deleted when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _homes:
        home = f"{shared_root(spark)}/counterscope-{app}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _homes[app] = home
    return _homes[app]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, for the time of the session."""
    return f"{_home(spark)}/{purpose}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for the operators whose classes run in their Python workers."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "counterscope-core.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def materialized(df: DataFrame) -> DataFrame:
    """Compute a small table once and keep it in reliable storage, so that its uses share one run."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table that holds at most ``rows`` rows; beyond the limit Spark picks the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def counted_side(df: DataFrame) -> DataFrame:
    """Compute a table of unknown but probably small size, and broadcast it if it is.

    Left to estimates, Spark would expect it to be as large as the log it was aggregated from and shuffle
    that log for the join.
    """
    table = materialized(df)
    return small_side(table, table.count())
