"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a session of a local master (one process, as in tests) gets a temporary folder of its own; on a
    cluster a machine-local folder would lose tables, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="postmill-")
        root = _own[app]
    return root.rstrip("/")


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialise`` wrote; missing paths are fine."""
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def narrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hold the session's Arrow batches to ``rows`` rows, for functions that read texts; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared scratch folder; what is there when the driver's Python ends is removed then."""
    path = f"{scratch_root(spark)}/postmill/{name}-{uuid.uuid4().hex}"
    atexit.register(_quietly_drop, spark, path)
    return path


def materialise(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared scratch folder and read it back.

    This cuts lineage and survives lost executors: every later stage rereads files that all executors see.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _quietly_drop(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop_scratch(spark, path)
    except Exception:  # noqa: BLE001 - the gateway may be gone at exit
        pass
