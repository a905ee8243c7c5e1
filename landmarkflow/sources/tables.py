"""Parquet and report sinks, materialisation, manifests and counts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmarkflow.config import Config

CORE_TABLES = ("onset", "cohort", "landmarks", "labels", "numeric_events", "rolling",
               "treatments")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by=(), codec: str = "zstd") -> None:
    writer = df.write.mode("overwrite").option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str, summary: bool = True) -> None:
    """CSV with headers. A ``summary`` is one file: its rows are bounded by the
    configuration (a row per check, feature, threshold or result). Other frames give a
    file per partition."""
    (df.coalesce(1) if summary else df).write.mode("overwrite").csv(path, header=True)


def values_column(values) -> "F.Column":
    """Inline list relation as an array literal, to be exploded next to a frame."""
    return F.array(*[F.lit(v) for v in values])


_LOCAL_DIR = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the one ``spark.checkpoint.dir`` names.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder every executor can "
                         "reach before materialising tables")
    if context.applicationId not in _LOCAL_DIR:
        _LOCAL_DIR[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIR[context.applicationId]


def run_folder(spark: SparkSession) -> str:
    """A fresh folder under :func:`work_dir`, so runs never overwrite each other."""
    return f"{work_dir(spark)}/landmarkflow-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as table ``name`` (replacing it) and read it back.

    The written table cuts the lineage and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{name}"
    write_parquet(df, path)
    return spark.read.parquet(path)


def input_manifest(df: DataFrame) -> DataFrame:
    """Per input file: size, modification time, row count and content hash.

    The hash is an order-free XOR of row hashes, so it needs one distributed
    pass and no file is read whole by anyone.
    """
    meta = F.col("_metadata")
    return (df.select(meta["file_name"].alias("file_name"), meta["file_size"].alias("size_bytes"),
                      meta["file_modification_time"].alias("modified"),
                      F.xxhash64(*df.columns).alias("_h"))
            .groupBy("file_name", "size_bytes", "modified")
            .agg(F.count("*").alias("n_rows"), F.hex(F.bit_xor("_h")).alias("content_hash")))


def table_counts(tables: dict) -> DataFrame:
    """Row count per named table, in the given order; a missing one gives NULL.

    ``tables`` maps a name to a DataFrame or to None.
    """
    spark = next(d.sparkSession for d in tables.values() if d is not None)
    rows = []
    for pos, (name, df) in enumerate(tables.items()):
        head = [F.lit(pos).alias("position"), F.lit(name).alias("table_name")]
        if df is None:
            rows.append(spark.range(1).select(*head, F.lit(None).cast("bigint").alias("n_rows")))
        else:
            rows.append(df.agg(F.count("*").alias("n_rows")).select(*head, "n_rows"))
    return reduce(DataFrame.unionByName, rows)


def catalog_table_counts(spark: SparkSession, names=CORE_TABLES) -> DataFrame:
    """:func:`table_counts` over catalog tables or views."""
    return table_counts({n: spark.table(n) if spark.catalog.tableExists(n) else None
                         for n in names})


def with_run_columns(df: DataFrame, cfg: Config) -> DataFrame:
    """Attach the configuration fingerprint to report rows."""
    return df.withColumn("config_hash", F.lit(cfg.fingerprint()))
