"""Joins that stay linear and spread out when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.functions.timefns import DAY_US, floor_div, hours, micros

SALTS = 8


def salted_join(big: DataFrame, small: DataFrame, on, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Equi-join of many rows with few rows per key, spread over ``salts`` parts.

    Each ``big`` row takes a part from the hash of its own content and every
    ``small`` row is repeated once per part. Because the part is no grouping key,
    an aggregation that follows keeps its own exchange with map-side combining,
    and adaptive execution is free to split a part that is still too large.
    ``how`` is ``inner`` or ``left``.
    """
    on = [on] if isinstance(on, str) else list(on)
    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    left = big.withColumn("_part", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_part", F.explode(parts))
    return left.join(right, [*on, "_part"], how).drop("_part")


def attach_static(episodes: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Inner joins that bring patient and admission columns onto episodes."""
    adm = admissions.drop("subject_id")
    return episodes.join(patients, "subject_id").join(adm, "hadm_id")


def attach_optional(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left outer equi-join: every left row stays."""
    return left.join(right, on, "left")


def densify(grid: DataFrame, series: DataFrame, on, value: str, flag: str) -> DataFrame:
    """Fill a sparse series onto a dense grid: missing value 0, and an observed flag."""
    joined = grid.join(series, on, "left")
    return (joined.withColumn(flag, F.col(value).isNotNull().cast("int"))
            .withColumn(value, F.coalesce(F.col(value), F.lit(0.0))))


def events_in_episode(episodes: DataFrame, events: DataFrame, max_days: int = 30,
                      key: str = "subject_id", time: str = "charttime") -> DataFrame:
    """Pairs with ``intime <= time <= intime + max_days`` for the same ``key``.

    Time is cut into blocks of ``max_days``; an episode's range touches at most
    two, so an event meets only the episodes near it, not all of its patient.
    """
    width = max_days * DAY_US
    first = floor_div(micros("intime"), width)
    last = floor_div(micros("intime") + F.lit(width), width)
    ep = episodes.withColumn("_block", F.explode(F.sequence(first, last)))
    ev = events.withColumn("_block", floor_div(micros(time), width))
    inside = (F.col(time) >= F.col("intime")) & (
        F.col(time) <= F.col("intime") + hours(24 * max_days))
    return ev.join(ep, [key, "_block"]).filter(inside).drop("_block")


def lookback_join(episodes: DataFrame, events: DataFrame, days: int, key: str = "subject_id",
                  time: str = "charttime") -> DataFrame:
    """Left outer join with events in ``[intime - days, intime)``, block by block."""
    width = days * DAY_US
    first = floor_div(micros("intime") - F.lit(width), width)
    last = floor_div(micros("intime"), width)
    ep = episodes.withColumn("_block", F.explode(F.sequence(first, last)))
    ev = events.withColumn("_block", floor_div(micros(time), width))
    pairs = (ep.join(ev, [key, "_block"])
             .filter((F.col(time) < F.col("intime"))
                     & (F.col(time) >= F.col("intime") - hours(24 * days)))
             .drop("_block", *[c for c in episodes.columns if c not in (key, "stay_id")]))
    return episodes.join(pairs.drop(key), "stay_id", "left")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              value: str, tolerance_hours: int | None = None,
              bucket_us: int = DAY_US) -> DataFrame:
    """Latest ``value`` of ``right`` at or before ``left_time``, not older than the tolerance.

    Rows of both sides are put into one window per (key, day), so no window
    holds a whole key. A day's first rows take the value carried over from the
    days before, found on one summary row per day. Equal times: highest value.
    """
    found = F.struct(F.col(right_time).alias("_rt"), F.col(value).alias("_rv"))
    lhs = left.withColumn("_bucket", floor_div(micros(left_time), bucket_us))
    rhs = right.filter(F.col(right_time).isNotNull()).select(
        key, floor_div(micros(right_time), bucket_us).alias("_bucket"),
        F.col(right_time).alias("_t"), F.lit(0).alias("_side"), found.alias("_hit"))
    rows = (lhs.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
            .unionByName(rhs, allowMissingColumns=True))
    in_day = (Window.partitionBy(key, "_bucket")
              .orderBy("_t", "_side", F.col("_hit").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = rows.withColumn("_near", F.last("_hit", ignorenulls=True).over(in_day))

    days = (rhs.select(key, "_bucket", "_hit")
            .unionByName(lhs.select(key, "_bucket").distinct(), allowMissingColumns=True)
            .groupBy(key, "_bucket").agg(F.max("_hit").alias("_day")))
    before = (Window.partitionBy(key).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = days.select(key, "_bucket",
                        F.last("_day", ignorenulls=True).over(before).alias("_far"))

    hit = F.coalesce(F.col("_near"), F.col("_far"))
    out = near.filter(F.col("_side") == 1).join(carry, [key, "_bucket"], "left")
    ok = hit.isNotNull()
    if tolerance_hours is not None:
        ok = ok & (hit["_rt"] >= F.col(left_time) - hours(tolerance_hours))
    return out.select(*left.columns, F.when(ok, hit["_rv"]).alias(value))


def exclude(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in no exclusion list (``NOT IN`` with non-null keys)."""
    listed = keys.select(on).filter(F.col(on).isNotNull()).distinct()
    return df.filter(F.col(on).isNotNull()).join(listed, on, "left_anti")


def map_signals(events: DataFrame, signal_map: DataFrame, source: str, items=None) -> DataFrame:
    """Inner join with the signal lookup of one source (tens of rows: broadcast).

    ``items``, the configured ids, become a filter that reaches the scan.
    """
    lookup = signal_map.filter(F.col("source") == source).drop("source")
    if items is not None:
        events = events.filter(F.col("itemid").isin(*items))
    return events.join(F.broadcast(lookup), "itemid")


def join_blocks(landmarks: DataFrame, on, labels: DataFrame | None = None, *blocks) -> DataFrame:
    """Feature blocks left-joined on the landmark key, labels inner-joined last."""
    out = landmarks
    for block in blocks:
        out = out.join(block, on, "left")
    return out.join(labels, on) if labels is not None else out


def align_frames(a: DataFrame, b: DataFrame, keys, columns) -> DataFrame:
    """Bring ``columns`` of ``b`` next to the rows of ``a`` with equal keys."""
    return a.join(b.select(*keys, *columns), list(keys))


def first_match(df: DataFrame, by: str, order: str, predicate: Column, value: Column,
                name: str) -> DataFrame:
    """Value of the earliest row of each group that satisfies the predicate."""
    return df.groupBy(by).agg(
        F.min_by(F.when(predicate, value), F.when(predicate, F.col(order))).alias(name))


def union_events(*frames) -> DataFrame:
    """``UNION ALL`` by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_keys(df: DataFrame, *keys) -> DataFrame:
    return df.select(*keys).distinct()
