"""Exact Jaccard links inside groups of candidate sets, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS_AT_ONCE = 4096
#: Rows of links that go back to Spark together, at least; most groups have a few.
ROWS_AT_ONCE = 8192


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Size of the intersection of every set of ``left`` with every one of ``right`` (or itself)."""
    sets = left + (right or [])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[word] > 1
    number = np.cumsum(times > 1) - 1
    word, row = number[word[shared]], row[shared]
    order = np.argsort(word, kind="stable")
    word, row = word[order], row[order]
    n = len(left)
    out = np.zeros((n, len(right) if right is not None else n), np.float32)
    width = int(word[-1]) + 1 if len(word) else 0
    for a in range(0, width, COLUMNS_AT_ONCE):
        i, j = np.searchsorted(word, [a, a + COLUMNS_AT_ONCE])
        part = np.zeros((len(sets), min(COLUMNS_AT_ONCE, width - a)), np.float32)
        part[row[i:j], word[i:j] - a] = 1
        out += part[:n] @ (part[n:] if right is not None else part).T
    return np.rint(out).astype(np.int64)


def linked(left: list, right: list | None, similarity: tuple[int, int]) -> np.ndarray:
    """True where the Jaccard similarity is at least ``similarity`` (a fraction); no self links."""
    if right is None and len(left) == 2:
        a, b = map(len, left)
        merged = np.sort(np.concatenate(left))
        shared = int((merged[1:] == merged[:-1]).sum())
        one = min(a, b) > 0 and shared * similarity[1] >= (a + b - shared) * similarity[0]
        return np.array([[False, one], [one, False]])
    both = intersections(left, right)
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (left if right is None else right)])[None, :]
    ok = both * similarity[1] >= (a + b - both) * similarity[0]
    ok &= (a > 0) & (b > 0)
    if right is None:
        np.fill_diagonal(ok, False)
    return ok


def forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    free, out = np.ones(len(ok), bool), []
    for root in range(len(ok)):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(ok[x] & free)
            free[new] = False
            out += [(x, int(y)) for y in new]
            queue += new.tolist()
    return out


def deal(members: DataFrame, block: int = 1024) -> DataFrame:
    """Spreads the pairs of each group over units of work (grp, i, j).

    ``members`` are (grp, node, ...), a node once. Groups are dealt into blocks of
    about ``block`` members by a hash; each pair of blocks is a unit, and a member
    goes to the units of its block (``own``). Groups of one are left out.
    """
    rest = [c for c in members.columns if c != "grp"]
    sizes = members.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = members.join(sizes, "grp").withColumn(
        "blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = dealt.select("grp", "own", *rest, F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return each.select("grp", F.least("own", "other").alias("i"),
                       F.greatest("own", "other").alias("j"), "own", *rest)


def _units(batches, sets_of):
    """Units of a stream sorted by (grp, i, j, own, node): (i, j), [(own, node, set)]."""
    key, held = None, []
    for batch in batches:
        heads = zip(*[batch.column(k).to_pylist() for k in range(5)])
        for (grp, i, j, own, node), items in zip(heads, sets_of(batch.column(5))):
            if (grp, i, j) != key:
                if held:
                    yield key[1:], held
                key, held = (grp, i, j), []
            if not held or held[-1][1] != node:  # rows equal in id and text come twice
                held.append((own, node, items))
    if held:
        yield key[1:], held


def verify(dealt: DataFrame, similarity: tuple[int, int], sets_of) -> DataFrame:
    """Links of dealt groups: rows (a, b, links).

    ``dealt`` are (grp, i, j, own, node, body) of :func:`deal`; ``sets_of`` turns a
    column of bodies into sorted arrays of distinct longs. With ``b`` null the row
    adds ``links`` to the links of ``a``; else it is an edge of a spanning forest of
    the links found.
    """
    spread = (dealt.select("grp", "i", "j", "own", "node", "body")
              .repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "own", "node"))

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out],
                                          names=["a", "b", "links"])

    def run(batches):
        out = [], [], []
        for (i, j), rows in _units(batches, sets_of):
            left = [r for r in rows if r[0] == i]
            right = [r for r in rows if r[0] == j] if i != j else None
            names = [r[1] for r in left + (right or [])]
            ok = linked([r[2] for r in left], right and [r[2] for r in right], similarity) \
                if right is None or right else np.zeros((0, 0), bool)
            if not ok.any():
                continue
            if right is not None:
                whole = np.zeros((len(names), len(names)), bool)
                whole[:len(left), len(left):], whole[len(left):, :len(left)] = ok, ok.T
                ok = whole
            links, edges = ok.sum(axis=1), forest(ok)
            found = np.flatnonzero(links)
            out[0].extend([names[k] for k in found] + [names[x] for x, _ in edges])
            out[1].extend([None] * len(found) + [names[y] for _, y in edges])
            out[2].extend(links[found].tolist() + [0] * len(edges))
            if len(out[0]) >= ROWS_AT_ONCE:
                yield batch(out)
                out = [], [], []
        if out[0]:
            yield batch(out)

    return spread.mapInArrow(run, "a bigint, b bigint, links bigint")
