"""Tables in the folder that all executors of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session on one machine may leave it unset, as in local tests, and gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; with master {sc.master}, tables must go to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a written table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, observed: Observation | None = None, **measures) -> DataFrame:
    """`df` as a table that is written to the shared folder and read again; `observed` gets the `measures` of the rows as they are written.

    For tables that go on from round to round: unlike a checkpoint's, its plan has its true size and carries no constraints on, which
    would grow with every round and slow the optimizer down.
    """
    folder = scratch(df.sparkSession, "table")
    if observed is not None:
        df = df.observe(observed, *[c.alias(n) for n, c in measures.items()])
    df.write.parquet(folder)
    return at(df.sparkSession.read.schema(df.schema).parquet(folder), folder)


def at(table: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """`table`, with the place that `discard` deletes."""
    table.stored_at = (folder, name)
    return table


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df` stored, and its number of rows, in one job."""
    rows = Observation()
    table = stored(df, rows, n=F.count(F.lit(1)))
    return table, rows.get["n"]


def bucketed(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """`df` stored in buckets of `column`: joins and aggregates by it, of this and other tables of as many buckets, need no shuffle."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt first, so that each bucket is one file
    folder = scratch(spark, name)
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", folder).saveAsTable(name)
    return at(spark.table(name), folder, name)


def discard(df: DataFrame) -> None:
    """Deletes a `stored` or `bucketed` table that is no longer needed."""
    folder, name = df.stored_at
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
