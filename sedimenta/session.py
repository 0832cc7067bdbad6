"""A local session with the settings the library is tested with; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("sedimenta").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
