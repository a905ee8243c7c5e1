"""Staging that redoes only what changed.

A raw table is a folder of files. Each run compares their listing with that of the last
run, stages new and changed files, and finds the patients whose rows really differ.
Derived steps are kept in buckets of patients, and only buckets of such patients are
computed again. Nothing is overwritten: every attempt writes to parts of its own, and the
manifest, written last, says which part of every file or bucket counts. An attempt that
dies leaves the last manifest in force and is simply repeated. A table remembers which
buckets changed in which generation, and a step which generations it has seen, so a step
that was not reached, or is updated less often, catches up. Parts that no longer count are
deleted by whoever owns the folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landmarkflow.sources.clinical import TABLES, cast_columns

_FILES = ("file string, source string, modified timestamp, length bigint, attempt string, "
          "generation int")
_CHANGES = "bucket int, generation int"
_BUCKETS = "bucket int, attempt string, seen map<string,int>, generation int"


@dataclass(frozen=True)
class Staged:
    """The table as of now, its generation, and the buckets of patients whose rows this run
    found to differ. The number of buckets, and with it the length of ``changed``, is a
    parameter."""

    rows: DataFrame
    changed: list
    generation: int
    path: str


def bucket(key: str, buckets: int) -> Column:
    """Bucket of a patient; a missing patient has one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, source, modified, length) of a raw file or folder; contents are not read.

    ``source`` is a short name of the file that can be part of a path.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"),
                     "length"))
    return files.select("file", F.concat(F.lit("f"), F.substring(F.sha2("file", 256), 1, 16))
                        .alias("source"), "modified", "length")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change): ``added``, ``removed``, ``changed`` or ``same``, from two listings."""
    both = old.select("file", F.struct("modified", "length").alias("_o")).join(
        new.select("file", F.struct("modified", "length").alias("_n")), "file", "full_outer")
    return both.select("file", F.when(F.col("_o").isNull(), "added")
                       .when(F.col("_n").isNull(), "removed")
                       .when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
                       .alias("change"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by generation; one without rows if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """The manifest in force and its generation; none, and 0, before the first run."""
    every = _table(spark, f"{path}/manifest", schema)
    last = every.agg(F.max("generation")).first()[0] or 0
    return every.filter(F.col("generation") == last), last


def _commit(rows: DataFrame, path: str, generation: int, table: str = "manifest") -> None:
    """One file, replaced as a whole if a dead attempt has left the generation."""
    (rows.withColumn("generation", F.lit(generation)).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("generation")
     .parquet(f"{path}/{table}"))


def _add(rows: DataFrame, path: str, part: str) -> str:
    """Write rows as parts of a new attempt and return its name."""
    attempt = "a" + uuid.uuid4().hex
    (rows.withColumn("attempt", F.lit(attempt)).hint("rebalance").write.mode("append")
     .option("compression", "zstd").partitionBy("attempt", part).parquet(f"{path}/rows"))
    return attempt


def _live(spark: SparkSession, path: str, schema: T.StructType, part: str, kept) -> DataFrame:
    """Rows of the parts in force. Both conditions are on partition columns, so parts that
    do not count are never opened."""
    by: dict = {}
    for value, attempt in kept:
        by.setdefault(attempt, []).append(value)
    full = T.StructType([*schema.fields, T.StructField("attempt", T.StringType()),
                         T.StructField(part, T.IntegerType() if part == "bucket"
                                       else T.StringType())])
    if not by:
        return spark.createDataFrame([], schema)
    wanted = F.lit(False)
    for attempt, values in sorted(by.items()):
        wanted = wanted | ((F.col("attempt") == attempt) & F.col(part).isin(values))
    try:
        rows = spark.read.schema(full).parquet(f"{path}/rows")
    except AnalysisException as e:  # no part had a row
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(wanted).select(*schema.fieldNames())


def stage_changes(spark: SparkSession, root: str, name: str, out: str, key: str = "subject_id",
                  buckets: int = 256) -> Staged:
    """Bring the staged copy of a raw table up to date.

    Only files whose size or time differs from the last run's are read. A patient counts
    as changed if the multiset of rows in those files differs between the runs (by count
    and sum of 64-bit row hashes), so a file that was only touched changes nobody. The
    lists of files and of changed buckets are all that reaches the driver.
    """
    path, layout = TABLES[name]
    names = [c for c, _ in layout]
    if key not in names:
        raise ValueError(f"{name} has no column {key!r} to find changed patients by")
    schema = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in layout)).schema
    base = f"{out}/{name}"
    old, last = _manifest(spark, base, _FILES)
    now = list_files(spark, f"{root}/{path}").collect()
    listing = spark.createDataFrame(now, "file string, source string, modified timestamp, "
                                         "length bigint")
    change = {r["file"]: r["change"] for r in compare(old, listing).collect()}
    before = {r["file"]: (r["source"], r["attempt"]) for r in old.collect()}
    was = [before[f] for f, c in change.items() if c in ("changed", "removed")]
    fresh = [r for r in now if change[r["file"]] in ("added", "changed")]
    live = [(s, g) for f, (s, g) in before.items() if change[f] == "same"]
    if not was and not fresh:
        return Staged(_live(spark, base, schema, "source", live), [], last, base)

    generation, attempt = last + 1, None
    if fresh:
        raw = spark.read.csv([r["file"] for r in fresh], header=True)
        missing = [c for c in names if c not in raw.columns]
        if missing:
            raise ValueError(f"{name}: columns {missing} not in {path}")
        file = F.col("_metadata.file_path")
        rows = cast_columns(raw.select(*names, F.concat(
            F.lit("f"), F.substring(F.sha2(file, 256), 1, 16)).alias("source")), dict(layout))
        attempt = _add(rows, base, "source")
    added = [(r["source"], attempt) for r in fresh]
    print_ = F.xxhash64(*names).cast("decimal(38,0)")
    both = _live(spark, base, schema, "source", added).select(
        key, F.lit(1).alias("_s"), print_.alias("_h")).unionByName(
        _live(spark, base, schema, "source", was).select(
            key, F.lit(-1).alias("_s"), print_.alias("_h")))
    differ = both.groupBy(key).agg(F.sum("_s").alias("n"), F.sum(
        F.col("_h") * F.col("_s")).alias("h")).filter("n <> 0 or h <> 0")
    changed = sorted(r[0] for r in differ.select(bucket(key, buckets)).distinct().collect())
    kept = {r["source"] for r in fresh}
    _commit(spark.createDataFrame([(b,) for b in changed], "bucket int"), base, generation,
            "changes")
    _commit(spark.createDataFrame(
        [(r["file"], r["source"], r["modified"], r["length"],
          attempt if r["source"] in kept else before[r["file"]][1]) for r in now],
        "file string, source string, modified timestamp, length bigint, attempt string"),
        base, generation)
    return Staged(_live(spark, base, schema, "source", live + added), changed, generation, base)


def update_step(spark: SparkSession, name: str, out: str, compute, tables: dict,
                key: str = "subject_id", buckets: int = 256) -> DataFrame:
    """Bring a derived table up to date and return it whole.

    ``tables`` are :class:`Staged` by name, of one number of buckets; ``compute`` makes the
    step from their rows. It must work patient by patient and keep ``key``. It runs on the
    buckets that changed in any table since the step last saw it (on all of them the first
    time, or with a table it has not seen). Rows of other buckets stay in their files.
    """
    base = f"{out}/{name}"
    old, last = _manifest(spark, base, _BUCKETS)
    kept = old.collect()
    live = {r["bucket"]: r["attempt"] for r in kept}
    seen = kept[0]["seen"] if kept else {}
    if live and len(live) != buckets:
        raise ValueError(f"{name} is kept in {len(live)} buckets, not {buckets}")
    todo = set()
    for table, staged in tables.items():
        if table not in seen:
            todo = set(range(buckets))
            break
        changes = _table(spark, f"{staged.path}/changes", _CHANGES).filter(
            (F.col("generation") > seen[table]) & (F.col("generation") <= staged.generation))
        todo |= {r[0] for r in changes.select("bucket").distinct().collect()}
    some = F.lit(True) if len(todo) == buckets else F.col("_bucket").isin(sorted(todo))
    part = compute({n: t.rows.withColumn("_bucket", bucket(key, buckets)).filter(some)
                    .drop("_bucket") for n, t in tables.items()})
    if todo:
        attempt = _add(part.withColumn("bucket", bucket(key, buckets)), base, "bucket")
        live.update((b, attempt) for b in todo)
        now = {n: t.generation for n, t in tables.items()}
        _commit(spark.createDataFrame([(b, a, now) for b, a in sorted(live.items())],
                                      "bucket int, attempt string, seen map<string,int>"),
                base, last + 1)
    return _live(spark, base, part.schema, "bucket", live.items())
