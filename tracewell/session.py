"""Session helpers: the package's code on the executors, and the folder that all share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each Spark context.

    Python functions of the package are pickled by reference, so the workers have to be
    able to import it wherever it is not installed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tracewell_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "tracewell.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(Path(top.name) / f.relative_to(top)))
    sc.addPyFile(target)
    sc._tracewell_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``. Only a session on one machine
    (``local[...]``) may leave it unset; a folder under /tmp/checkpoints is then used.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Staged rows are often many times as large in memory as in their files. Told so, Spark broadcasts none that only look small.
FILE_TO_MEMORY = "16.0"


def staged(df: DataFrame, name: str, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts lineage.

    A lost executor costs only the tasks that it ran: what is staged is never recomputed.
    The DataFrame returned here is lazy, so the table stays until the application ends;
    the file system then deletes it. ``partition_by`` writes a folder for each value of a
    column, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_TO_MEMORY)
    w = df.write.option("compression", compression)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``staged``, in buckets of ``key``: joins, windows and groups whose keys have ``key`` among them need no shuffle.

    That goes for what is derived from several such tables too, as all have as many
    buckets as there are shuffle partitions. The table stands in the session's catalogue.
    Spark joins such tables on more keys without a shuffle if the setting made here allows
    it, which only moves rows less and changes no result.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_TO_MEMORY)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    _delete_on_exit(spark, path)
    return spark.table(table)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have Hadoop's file system, which Spark writes through, delete a path when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
