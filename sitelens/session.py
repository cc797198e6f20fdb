"""Spark session helpers: local/test session, checkpoint folder, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sitelens") -> SparkSession:
    """A local session for tests and the bench (no UI, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "sitelens-warehouse"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SITELENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small local data: keep several tasks per CPU-heavy (regex) stage.  On a cluster these stay
        # at their defaults (64-128 MB partitions, 128 MB row groups) so partitions fit executor memory.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", os.environ.get("SITELENS_ADVISORY", "2m"))
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("SITELENS_SPLIT", "4m"))
        .config("spark.hadoop.parquet.block.size", str(4 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taking it from the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is.  Only a local session (tests, bench) without one gets a fresh
    folder of its own.  A cluster session without one is an error: a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sitelens-ckpt-", dir="/tmp"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_sql(spark: SparkSession, template: str, **tables: DataFrame) -> DataFrame:
    """Run a SQL template whose table references are written ``$name``.

    Literal braces in the text are protected before Spark's own ``{name}``
    substitution of DataFrame arguments.
    """
    query = template.replace("{", "{{").replace("}", "}}")
    for name in sorted(tables, key=len, reverse=True):
        query = query.replace(f"${name}", "{" + name + "}")
    return spark.sql(query, **tables)


#: (application, run) -> (folder, catalog table or None) of each table written in that run.
_written: dict[tuple[str, str], list[tuple[str, str | None]]] = {}
_run: ContextVar[str] = ContextVar("sitelens_run", default="")


@contextmanager
def run_scope(name: str | None = None) -> Iterator[str]:
    """Tables that are materialised inside belong to this run; ``drop_materialized(spark, name)`` deletes them and no others."""
    name = name or uuid.uuid4().hex
    token = _run.set(name)
    try:
        yield name
    finally:
        _run.reset(token)


def drop_materialized(spark: SparkSession, run: str | None = None) -> int:
    """Delete the tables of one run (the current one, if none is named), once its results are written.

    Tables written with ``keep=True`` (inputs that later queries share) belong to no run and stay.
    """
    tables = _written.pop((spark.sparkContext.applicationId, _run.get() if run is None else run), [])
    for path, table in tables:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        target, fs = _file_system(spark, path)
        fs.delete(target, True)
    return len(tables)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a table's folder (or file): another state, other rows."""
    target, fs = _file_system(spark, path)
    if not fs.exists(target):
        return 0, 0, 0
    size = fs.getContentSummary(target)
    return size.getLength(), size.getFileCount(), fs.getFileStatus(target).getModificationTime()


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _note(spark: SparkSession, path: str, table: str | None, keep: bool) -> None:
    if not keep:
        _written.setdefault((spark.sparkContext.applicationId, _run.get()), []).append((path, table))


def materialize(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the checkpoint folder and reading it back.

    One pass (a reliable ``checkpoint()`` computes its input twice unless it is
    cached), columnar, and it survives the loss of executors: the folder is the
    shared one named by ``spark.checkpoint.dir``.  Whole texts pass through here, so
    it is packed closely (zstd).  ``keep``: the table belongs to
    no run (see ``drop_materialized``).
    """
    spark = df.sparkSession
    path = _place(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _note(spark, path, None, keep)
    return spark.read.parquet(path)


def materialize_by_key(df: DataFrame, name: str, key: str, buckets: int, keep: bool = False) -> DataFrame:
    """``materialize`` into ``buckets`` buckets by ``key``, sorted by it: joins on the key need no exchange of this
    table, and a condition on the key leaves out buckets and row groups.  ``df`` should be partitioned by the key."""
    spark = df.sparkSession
    path = _place(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    _note(spark, path, table, keep)
    return spark.table(table)
