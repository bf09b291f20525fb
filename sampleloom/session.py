"""Session helpers: table access, the shared scratch folder and materialisation.

Nothing here assumes local mode: intermediate results go to the folder the
session names in ``spark.checkpoint.dir``, which every executor can reach. A
folder of our own is set only where that is unset and the master is local.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sampleloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint; partitions keep their numbers."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table into the shared folder and read back.

    Columnar and compressed, so cheaper on disk than a checkpoint; partition
    boundaries are not kept. The tables go with the folder, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table behind :func:`materialised`'s result, for loops whose rounds each write one; no plan may read it any more."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions_for(spark: SparkSession) -> int:
    """Number of partitions for explicit exchanges: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
