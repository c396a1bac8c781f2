"""Session construction and cluster-shared settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "offerlake") -> SparkSession:
    """Local/test session. On a cluster, the submitter's session is used as-is."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("OFFERLAKE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("OFFERLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Where it is unset, a local-mode session (driver and executors are one process on one
    machine, as in tests) gets a scratch folder of its own, removed at exit. On a cluster a
    machine-local folder would not be seen by the others, so there it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="offerlake-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - Connect sessions take the conf value directly
        pass
    return current


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables in the shared checkpoint folder."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        app = "shared"
    return f"{checkpoint_dir(spark).rstrip('/')}/offerlake/{app}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df):
    """Cut the lineage of a reused intermediate: write it as Parquet under the
    cluster's shared ``spark.checkpoint.dir`` and read it back (survives executor
    loss, unlike cache or local checkpoints). Reading the written files also
    gives the planner their real size, so a small result is broadcast where it
    is joined. ``clear_scratch`` removes the files."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/materialized/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows that one task reads of a table that models are fitted on, and rows of its row groups.
FIT_ROWS, FIT_GROUP_ROWS = 100_000, 20_000


def materialize_for_fit(df, rows: int = FIT_ROWS):
    """As ``materialize``, for tables that models are fitted on or explained: no task reads many more than ``rows`` rows.
    Feature vectors are compact in the file, so the reader's usual splits hold millions of them, but MLlib keeps every row
    unpacked and reads these blocks again for each level of each tree. The files get short row groups, and are read through
    a session of their own (``newSession``: same context and catalog) whose splits have as many bytes as ``rows`` rows take."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/materialized/{uuid.uuid4().hex}"
    df.write.option("parquet.block.row.count.limit", min(rows, FIT_GROUP_ROWS)).parquet(path)
    written, p = spark.read.parquet(path), spark._jvm.org.apache.hadoop.fs.Path(path)
    size, n = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength(), written.count()
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, size * rows // max(n, 1))))
    return own.read.parquet(path)
