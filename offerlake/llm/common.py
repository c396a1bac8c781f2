"""Helpers shared by the operators: reading tables, written intermediates, ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlake.session import scratch_root

#: Words of a text: maximal runs of bytes that are not ASCII white space (fixed by the contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in this application's part of the shared ``spark.checkpoint.dir``."""
    return f"{scratch_root(spark)}/{kind}/{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between Spark and Python, and of a row group of an intermediate table.
BATCH_BYTES, GROUP_BYTES = 8 << 20, 16 << 20
#: Rows that the Parquet reader decodes at once: texts of a whole batch lie in one array.
READ_ROWS = 512


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's bounds on batches, where they are higher: an Arrow batch (``BATCH_BYTES``) is held by
    the JVM and by Python at once, a Parquet batch (``READ_ROWS``) by the JVM, and rows may be long."""
    arrow, parquet = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(arrow)) > BATCH_BYTES:
        spark.conf.set(arrow, str(BATCH_BYTES))
    if int(spark.conf.get(parquet)) > READ_ROWS:
        spark.conf.set(parquet, str(READ_ROWS))
    return spark


def written(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (lineage is cut there)."""
    path = scratch_path(small_batches(df.sparkSession), kind)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a DataFrame made by :func:`written` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores in front as keep it apart from all columns of ``frames``."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(text: Column) -> Column:
    """UTF-8 length; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def gapless_rank(df: DataFrame, group: list[str], cell: str, order: list[str], out: str) -> DataFrame:
    """0-based gapless number of each row in its group, without one task holding a group.

    ``cell`` splits every group into bounded pieces: rows are numbered inside
    (group, cell) and a table of piece sizes, one row each, gives the offsets.
    """
    sizes = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col(cell).alias("_g_cell"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, cell).orderBy(*order)
    numbered = df.withColumn("_in", F.row_number().over(inside) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col(cell) == F.col("_g_cell")]
    joined = numbered.join(offsets, on)
    return joined.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop(
        "_before", "_in", "_g_cell", *[f"_g_{g}" for g in group])
