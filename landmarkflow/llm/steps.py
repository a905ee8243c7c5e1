"""Written intermediate steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from landmarkflow.sources.tables import materialize, run_folder, work_dir

__all__ = ["bucketed", "run_folder", "written"]


def written(df: DataFrame, name: str, folder: str) -> DataFrame:
    """``df`` as a table of the run's shared folder, read back.

    Spark drops the shuffle files of a finished job once the driver has collected
    the objects that stand for them, which a quiet driver may put off for half an
    hour; asking for it after each step keeps one step's shuffles on disk, not all.
    """
    out = materialize(df, name, folder)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def bucketed(df: DataFrame, keys) -> DataFrame:
    """``df`` as a table bucketed by ``keys`` in the shared folder, read back.

    Joins and groupings on these keys then shuffle the other side only.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"CREATE DATABASE {name} LOCATION '{work_dir(spark)}/{name}'")
    (df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet")
     .saveAsTable(f"{name}.rows"))
    spark.sparkContext._jvm.System.gc()
    return spark.table(f"{name}.rows")
