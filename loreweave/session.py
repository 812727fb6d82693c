"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loreweave", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOREWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors are one process on one disk, may fall back
    to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[app]


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder.

    Unlike an RDD checkpoint this computes the rows once, gives the planner real
    sizes, and carries no inferred constraints from pass to pass. Losing executors
    costs nothing: the next stage reads the files again.
    """
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables written by ``durable`` that nothing reads any more."""
    for table in tables:
        path = table.__dict__.pop("_durable_path", None)
        if path:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder.getFileSystem(conf).delete(folder, True)
