"""Patient-level temporal splits and grouped folds."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.config import EvalConfig
from landmarkflow.operators.joins import salted_join

SPLITS = ("train", "val", "test")


def split_of(group: str = "anchor_year_group", cfg: EvalConfig = EvalConfig()) -> Column:
    """Split name of a year group; NULL when it is in none."""
    g = F.col(group)
    return (F.when(g.isin(*cfg.train_groups), "train").when(g.isin(*cfg.val_groups), "val")
            .when(g.isin(*cfg.test_groups), "test"))


def assign_splits(df: DataFrame, cfg: EvalConfig = EvalConfig(), check: bool = False
                  ) -> DataFrame:
    """Add ``split`` and drop rows of unlisted year groups.

    With ``check`` the dropped rows are counted (a warning) and a patient in two
    splits raises; both cost a job, so lazy callers leave it off.
    """
    tagged = df.withColumn("split", split_of(cfg=cfg))
    if check:
        lost = tagged.filter(F.col("split").isNull()).count()
        if lost:
            warnings.warn(f"{lost} rows have a year group outside the splits", stacklevel=2)
    kept = tagged.filter(F.col("split").isNotNull())
    if check:
        assert_exclusive(kept)
    return kept


def load_split(df: DataFrame, name: str) -> DataFrame:
    if name not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, got {name!r}")
    if "split" not in df.columns:
        raise ValueError("no 'split' column: call assign_splits first")
    return df.filter(F.col("split") == name)


def split_overlap(df: DataFrame) -> DataFrame:
    """Patients seen in more than one split."""
    return (df.groupBy("subject_id").agg(F.count_distinct("split").alias("n_splits"))
            .filter(F.col("n_splits") > 1))


def assert_exclusive(df: DataFrame) -> None:
    leaked = split_overlap(df).orderBy("subject_id").limit(5).collect()
    if leaked:
        raise AssertionError(f"patient leakage: {[r['subject_id'] for r in leaked]} ...")


def split_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"),
                                   F.count_distinct("stay_id").alias("n_stays"),
                                   F.count_distinct("subject_id").alias("n_patients"))


def hash_bucket(column: str, digits: int = 3) -> Column:
    """Bucket 0..16**digits-1 from the MD5 of a key, the same on every engine."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, digits), 16, 10).cast("int")


def rank_in_order(df: DataFrame, buckets, bucket_order, order, name: str) -> DataFrame:
    """Dense 0-based position over the whole frame, without one global sort task.

    ``buckets`` are columns with a bounded number of combinations. Rows are
    numbered inside each bucket, and a bucket starts after the rows of those
    before it, which is known from one count per bucket. With several bucket
    columns only the values of the first are put in order in one task.
    """
    sizes = df.groupBy(*buckets).agg(F.count("*").alias("_size"))
    first = sizes.groupBy(buckets[0]).agg(F.sum("_size").alias("_all"))
    ahead = Window.orderBy(bucket_order[0]).rowsBetween(Window.unboundedPreceding, -1)
    starts = first.select(buckets[0], F.coalesce(F.sum("_all").over(ahead), F.lit(0))
                          .alias("_from"))
    if len(buckets) > 1:
        within = (Window.partitionBy(buckets[0]).orderBy(*bucket_order[1:])
                  .rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(
            starts, buckets[0]).select(*buckets, (F.col("_from") + F.col("_in")).alias("_from"))
    inside = Window.partitionBy(*buckets).orderBy(*order)
    return (df.withColumn("_pos", F.row_number().over(inside) - 1)
            .join(starts, list(buckets))
            .withColumn(name, F.col("_from") + F.col("_pos")).drop("_from", "_pos"))


def packing_runs(sizes, k: int) -> list:
    """Which folds the groups of each size go to, as (size, first, end, folds).

    ``sizes`` are (size, number of groups), largest size first; groups are numbered in that
    order. Each goes to the lightest fold, ties to the lowest number. Groups ``first`` to
    ``end`` of a run go to its folds in turn: while the lightest folds are closer together
    than a group, they take turns, so whole rounds are dealt at once.
    """
    loads, out, place = [0] * k, [], 0
    for size, n in sizes:
        while n:
            order = sorted(range(k), key=lambda i: (loads[i], i))
            near = [i for i in order if loads[i] < loads[order[0]] + size]
            room = (n if len(near) == k else
                    (loads[order[len(near)]] - loads[near[-1]] - 1) // size * len(near))
            take = min(n, max(room, 1))
            turn = near[:take]
            for at, i in enumerate(turn):
                loads[i] += size * len(range(at, take, len(near)))
            out.append((size, place, place + take, turn))
            place, n = place + take, n - take
    return out


def group_kfold(df: DataFrame, group: str = "subject_id", k: int = 5) -> DataFrame:
    """Fold per row: no group in two folds, sizes balanced.

    Groups go largest first to the lightest fold. Only the histogram of group sizes is
    needed for that (its rows are the different sizes); groups of one size are numbered
    by hash bucket, so the many small groups of a large table are ranked in parallel.
    """
    sizes = (df.groupBy(group).agg(F.count("*").alias("_n"))
             .withColumn("_hash", hash_bucket(group, 2)))
    histogram = sizes.groupBy("_n").agg(F.count("*").alias("c")).orderBy(F.desc("_n")).collect()
    runs: dict = {}
    for size, *run in packing_runs([(r["_n"], r["c"]) for r in histogram], k):
        runs.setdefault(size, []).append(tuple(run))
    table = df.sparkSession.createDataFrame(
        list(runs.items()), "_n bigint, _runs array<struct<a:bigint,b:bigint,folds:array<int>>>")
    ranked = rank_in_order(sizes, ["_n", "_hash"], [F.desc("_n"), F.col("_hash")],
                           [F.col(group)], "_rank").join(table, "_n")
    own = F.filter("_runs", lambda r: (r["a"] <= F.col("_rank")) & (F.col("_rank") < r["b"]))
    placed = ranked.select(group, "_rank", F.get(own, F.lit(0)).alias("_r"))
    turn = F.pmod(F.col("_rank") - F.col("_r.a"), F.size("_r.folds")).cast("int")
    return salted_join(df, placed.select(group, F.get("_r.folds", turn).alias("fold")), group)
