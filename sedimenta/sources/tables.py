"""Table readers and the one place where intermediate results are cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset directory; a table may be a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` where the cluster sets it.

    Only where it is unset and the master is local (tests, a laptop) a temporary folder is made and written back to the
    session; a cluster without a shared folder is an error, as a machine's own folder would give partial tables.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    The copy survives the loss of executors, is read columnar, and gives later joins real sizes to plan with.
    """
    path = f"{_own_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/sedimenta-{spark.sparkContext.applicationId}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, on whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has materialized, once no DataFrame that reads it is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
