"""Session defaults and shared scratch space.

Intermediate tables that cut a lineage are written below the folder that the
session names in ``spark.checkpoint.dir``.  Only a local master may do without
that setting; it then gets a private temporary folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_written: list[tuple[SparkSession, str]] = []
_local_dirs: dict[int, str] = {}


def local_session(cores: int | str = "*", name: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Raises ``RuntimeError`` on a cluster that names none, because a folder of
    one machine is not readable by the others.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    key = os.getpid()
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local_dirs[key], True)
    return "file://" + _local_dirs[key]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage before the written files, so a lost executor
    costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


@atexit.register
def release_all() -> None:
    """Delete every intermediate table that this process wrote."""
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:
            pass
    _written.clear()
