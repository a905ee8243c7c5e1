"""Trailing windows that never sort a whole key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.functions.timefns import DAY_US, floor_div, micros


def trailing_min(queries: DataFrame, events: DataFrame, key: str, query_time: str,
                 event_time: str, value: str, spans: dict,
                 bucket_us: int = DAY_US) -> DataFrame:
    """Minimum of ``value`` over ``[t - span, t]`` for every distinct query time.

    ``spans`` maps an output column to its length in microseconds, each at
    least ``bucket_us``. Time is cut into buckets; the range is then

    * whole buckets between, from one summary row per (key, bucket), and
    * the end of its first bucket and the start of its last one, from running
      minima inside one (key, bucket). They are looked up only where the bucket's
      own minimum is below that of the buckets between.

    So a key with most of the rows is spread over its days, and the work is
    linear in events plus queries. Returns ``key, query_time`` and the minima.
    """
    if min(spans.values()) < bucket_us:
        raise ValueError("every span must be at least one bucket long")
    ev = (events.filter(F.col(value).isNotNull())
          .select(key, micros(event_time).alias("_t"), F.col(value).alias("_v")))
    bucket = floor_div(F.col("_t"), bucket_us)
    q = queries.select(key, F.col(query_time).alias("_q")).distinct()

    # whole buckets: frames over one row per (key, bucket)
    summary = ev.groupBy(key, bucket.alias("_b")).agg(F.min("_v").alias("_v"))
    at = micros("_q")
    wanted = q.select(key, floor_div(at, bucket_us).alias("_b")).distinct()
    line = (summary.unionByName(wanted, allowMissingColumns=True)
            .groupBy(key, "_b").agg(F.min("_v").alias("_own")))
    order = Window.partitionBy(key).orderBy("_b")

    def lowest(first, last):
        if first > last:
            return F.lit(None).cast("double")
        return F.min("_own").over(order.rangeBetween(first, last))

    steps = {name: us // bucket_us for name, us in spans.items()}
    whole = line.select(key, "_b", "_own", *[
        c.alias(f"_{part}_{name}") for name, k in steps.items()
        for part, c in (("mid", lowest(1 - k, -1)), ("near", lowest(-k, -k)),
                        ("far", lowest(-k - 1, -k - 1)))])
    known = q.withColumn("_b", floor_div(at, bucket_us)).join(whole, [key, "_b"])
    middle, first = {}, {}
    for name, us in spans.items():  # the first bucket is k or k + 1 behind the last
        near = F.col("_b") - floor_div(at - F.lit(us), bucket_us) == steps[name]
        mid, edge = F.col(f"_mid_{name}"), F.col(f"_near_{name}")
        middle[name] = F.when(near, mid).otherwise(F.least(mid, edge))
        first[name] = F.when(near, edge).otherwise(F.col(f"_far_{name}"))
    known = known.select(key, "_q", "_own", *[c.alias(n) for n, c in middle.items()],
                         *[c.alias(f"_first_{n}") for n, c in first.items()])

    # ends that can matter, as extra rows next to the events
    def lower(end, *names):
        return reduce(lambda x, y: x | y, [F.col(end).isNotNull() & (
            F.col(n).isNull() | (F.col(end) < F.col(n))) for n in names])

    ends = [F.when(lower("_own", *spans), F.struct(F.lit("").alias("span"), at.alias("at")))]
    ends += [F.when(lower(f"_first_{name}", name), F.struct(
        F.lit(name).alias("span"), (at - F.lit(us)).alias("at"))) for name, us in spans.items()]
    probes = (known.select(key, "_q", F.explode(F.array_compact(F.array(*ends))).alias("_e"))
              .select(key, "_q", F.col("_e.span").alias("_span"), F.col("_e.at").alias("_t")))
    rows = ev.unionByName(probes, allowMissingColumns=True).withColumn("_b", bucket)
    parts = Window.partitionBy(key, "_b")
    upto = parts.orderBy(F.col("_t").asc()).rangeBetween(Window.unboundedPreceding, 0)
    since = parts.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    edge = (rows.withColumn("_upto", F.min("_v").over(upto))
            .withColumn("_since", F.min("_v").over(since))
            .filter(F.col("_span").isNotNull())
            .withColumn("_m", F.when(F.col("_span") == "", F.col("_upto"))
                        .otherwise(F.col("_since"))))
    edge = edge.select(key, "_q", *[F.when(F.col("_span").isin("", name), F.col("_m")).alias(name)
                                    for name in spans])
    return (known.select(key, "_q", *spans).unionByName(edge).groupBy(key, "_q")
            .agg(*[F.min(name).alias(name) for name in spans])
            .withColumnRenamed("_q", query_time))


def trailing_sums(grid: DataFrame, key: str, order: str, columns: dict, sizes) -> DataFrame:
    """Trailing ROWS sums over a dense grid: ``columns`` maps prefix to column.

    The grid is capped per episode (30 days of hours), so a partition has at
    most that many rows; one sort serves every frame.
    """
    out = list(grid.columns)
    for size in sizes:
        frame = Window.partitionBy(key).orderBy(order).rowsBetween(-(size - 1), 0)
        for template, column in columns.items():
            out.append(F.sum(column).over(frame).alias(template.format(size)))
    return grid.select(*out)
