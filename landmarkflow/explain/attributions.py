"""Exact attributions of boosted trees: path-dependent Shapley values.

A tree is a sum over its leaves. A leaf's value counts for a coalition of features as far
as the row meets the conditions of the coalition's features on the leaf's path, times, for
the other features, the shares of training rows that do. The Shapley value of such a
product needs only sums by coalition size, the coefficients of one polynomial, so it is
exact without going through coalitions. Rows that meet the same conditions of a path share
their values.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.models.base import FittedModel
from landmarkflow.models.blocks import as_doubles, bin_rows, binned


def leaf_paths(tree: dict) -> list:
    """Per leaf: its value, and per feature of its path the share of rows that follow it
    and the bins (low, high] it leaves open."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        a, b = tree["left"][node], tree["right"][node]
        if a < 0:
            out.append((tree["value"][node], path))
            continue
        f, cut = tree["feature"][node], tree["bin"][node]
        share, low, high = path.get(f, (1.0, -1, np.iinfo(np.int64).max))
        rows = max(tree["rows"][node], 1e-300)
        stack.append((a, {**path, f: (share * tree["rows"][a] / rows, low, min(high, cut))}))
        stack.append((b, {**path, f: (share * tree["rows"][b] / rows, max(low, cut), high)}))
    return out


def base_margin(model: FittedModel) -> float:
    """Mean margin of the trees over their training rows: what no feature explains."""
    return model.extra["start"] + sum(
        value * np.prod([s for s, _, _ in path.values()]) for t in model.extra["trees"]
        for value, path in leaf_paths(t))


def path_values(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values (patterns x features) of the product over features of ``met`` inside
    the coalition and ``shares`` outside."""
    m = len(shares)
    weights = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
    out = np.empty(met.shape)
    for i in range(m):
        poly = np.zeros((len(met), m))
        poly[:, 0], degree = 1.0, 0
        for j in range(m):
            if j != i:
                moved = poly[:, :degree + 1] * met[:, j:j + 1]
                poly[:, :degree + 1] *= shares[j]
                poly[:, 1:degree + 2] += moved
                degree += 1
        out[:, i] = (met[:, i] - shares[i]) * (poly @ weights)
    return out


def attribute(bins: np.ndarray, trees, width: int) -> np.ndarray:
    """Rows by features: the sum of all trees' attributions."""
    out = np.zeros((len(bins), width))
    for tree in trees:
        for value, path in leaf_paths(tree):
            if not path:
                continue
            features = list(path)
            met = np.stack([(bins[:, f] > path[f][1]) & (bins[:, f] <= path[f][2])
                            for f in features], axis=1)
            if len(features) < 63:  # a pattern is a number
                code = met @ (1 << np.arange(len(features), dtype=np.int64))
                _, first, which = np.unique(code, return_index=True, return_inverse=True)
                patterns = met[first]
            else:
                patterns, which = np.unique(met, axis=0, return_inverse=True)
            values = path_values(patterns.astype(float),
                                 np.array([path[f][0] for f in features]))
            out[:, features] += value * values[which.ravel()]
    return out


def tree_attributions(df: DataFrame, model: FittedModel, keys) -> DataFrame:
    """``(keys, feature, value, contribution_logodds)`` of boosted trees.

    A row's contributions and :func:`base_margin` add up to its margin. ``value`` is NULL
    where it was missing; such rows are attributed at the median, as they are scored.
    """
    keys, features, e = list(keys), model.features, model.extra
    trees, edges, medians = e["trees"], e["edges"], e["medians"]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = batch.columns[len(keys):]
            found = attribute(bin_rows(columns, features, edges, medians), trees, len(features))
            value = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).ravel()
            row = pa.array(np.repeat(np.arange(n), len(features)))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(row) for c in batch.columns[:len(keys)]], pa.array(features * n),
                 pa.array(value, mask=np.isnan(value)), pa.array(found.ravel())],
                names=[*keys, "feature", "value", "contribution_logodds"])

    return df.select(*keys, *as_doubles(df, features)).mapInArrow(
        run, f"{kinds + ', ' if kinds else ''}feature string, value double, "
        "contribution_logodds double")


def mean_attributions(df: DataFrame, model: FittedModel) -> DataFrame:
    """``(feature, mean_abs, mean)`` over all rows given.

    Rows of the same bins have the same attributions, so they are counted first."""
    features, e = model.features, model.extra
    trees, width = e["trees"], len(features)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16)
                n = batch.column(1).to_numpy().astype(float)
                found = attribute(bins.reshape(-1, width), trees, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features), pa.array(n @ np.abs(found)), pa.array(n @ found),
                     pa.array(np.full(width, n.sum()))], names=["feature", "size", "sum", "n"])

    counts = binned(df, features, e["edges"], e["medians"]).groupBy("bins").count()
    sums = counts.mapInArrow(run, "feature string, size double, sum double, n double")
    n = F.sum("n")
    return sums.groupBy("feature").agg((F.sum("size") / n).alias("mean_abs"),
                                       (F.sum("sum") / n).alias("mean"))
