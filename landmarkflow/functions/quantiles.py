"""Exact quantiles without gathering a column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.functions.scalars import order_cell


def exact_quantiles(df: DataFrame, by, value: str, probs, weight: str | None = None
                    ) -> DataFrame:
    """``(by, prob, quantile)`` with linear interpolation between neighbours; ``weight``
    names the number of rows that a row stands for.

    Values are put into cells of equal relative width. Counts per cell (a bounded
    number of rows) tell which cells hold the wanted ranks; only values of those
    cells are then counted one by one, inside their cell.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counts = (df.filter(F.col(value).isNotNull() & ~F.isnan(v))
              .groupBy(*by, v.alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_n")))
    placed = counts.withColumn("_cell", order_cell("_v"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (placed.groupBy(*by, "_cell").agg(F.sum("_n").alias("_c"))
             .withColumn("_total", F.sum("_c").over(group))
             .withColumn("_first", F.sum("_c").over(upto) - F.col("_c")))

    # the two ranks each probability needs, laid between the cells by their first rank
    asked = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"))
                      for p in probs for side in (0, 1)])
    pos = F.col("prob") * (F.col("_total") - 1)
    totals = cells.groupBy(*by).agg(F.max("_total").alias("_total"))
    ranks = (totals.select(*by, "_total", F.explode(asked).alias("_q"))
             .select(*by, "_total", "_q.*")
             .withColumn("_rank", F.when(F.col("side") == 0, F.floor(pos)).otherwise(
                 F.ceil(pos))))
    laid = ranks.withColumn("_at", F.col("_rank")).unionByName(
        cells.select(*by, "_total", F.col("_first").alias("_at"), F.struct("_cell", "_first")
                     .alias("_own")), allowMissingColumns=True)
    held = F.last("_own", ignorenulls=True).over(
        group.orderBy("_at", F.col("_own").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    wanted = laid.withColumn("_c", held).filter(F.col("_own").isNull()).select(
        *by, "_total", "prob", "side", "_rank", "_c._cell", "_c._first")
    inside = (Window.partitionBy(*by, "_cell").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, 0))
    held = placed.select(*by, "_cell", "_v", "_n").join(
        wanted.select(*by, "_cell").distinct(), [*by, "_cell"], "left_semi")
    ranked = held.withColumn("_end", F.sum("_n").over(inside))
    hits = (wanted.join(ranked, [*by, "_cell"])
            .filter((F.col("_rank") < F.col("_first") + F.col("_end"))
                    & (F.col("_rank") >= F.col("_first") + F.col("_end") - F.col("_n"))))
    part = F.max(pos) - F.floor(F.max(pos))
    low = F.max(F.when(F.col("side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("side") == 1, F.col("_v")))
    return hits.groupBy(*by, "prob").agg((low + (high - low) * part).alias("quantile"))

