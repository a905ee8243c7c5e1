"""Patient-level bootstrap: whole patients are drawn, not rows.

Scores are sorted once and cut into runs, one row each. A run carries its scores with
the numbers of their patients; how often an iteration draws each patient is worked out
where the run is, from hashes, so no row is ever repeated for an iteration. A run's
partial state is a few sums per iteration. Sums of the runs before it, and of the scores
it shares with its neighbours, place a run in the whole ranking; with them it gives its
part of every ranking measure, and parts add up. What is shuffled for the iterations is
runs x iterations, whatever the number of rows.

Scores that many patients share (binned, calibrated or tree scores) are counted first: every
draw is made once, sent to the scores of its patients and added up per score and iteration.
Runs are then of distinct scores with their drawn counts, and no pass draws again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.evaluation.calibration import (bin_edges, calibration_of_scores, ece_of_scores,
                                                 newton_update, starting_state)
from landmarkflow.evaluation.curves import discrimination
from landmarkflow.operators.splits import hash_bucket, rank_in_order
from landmarkflow.sources.tables import materialize, run_folder

#: Scores of a run, and (score, iteration) cells that are worked on at a time.
RUN_ROWS, CELLS = 1 << 18, 1 << 21
#: Distinct scores of all groups that are counted first, when ``TIES`` rows share one; such
#: scores in a run, patients whose draws and rows that are in memory together, and iterations
#: that are drawn by one task.
FEW_SCORES, TIES, RUN_SCORES, CHUNK, CHUNK_ROWS, DRAWN = 1 << 13, 4, 256, 1 << 15, 1 << 21, 8
CALIBRATION = ("calibration_slope", "calibration_intercept")


def mix32(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 32-bit Murmur hash."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x = x * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class Draws:
    """How often each of ``n`` patients is drawn: ``n`` draws with replacement an iteration.

    Slot ``i`` of iteration ``b`` takes patient ``h n div 2^32``, ``h`` being
    ``mix32(mix32(i) xor mix32(b + 1))``: the same on every run, engine and retry.
    """

    def __init__(self, n: int):
        self.n, self.slots = n, mix32(np.arange(n, dtype=np.uint32))

    def counts(self, iteration: int) -> np.ndarray:
        own = mix32(np.array([iteration + 1], np.uint32))[0]
        picked = mix32(self.slots ^ own).astype(np.uint64) * np.uint64(self.n)
        return np.bincount((picked >> np.uint64(32)).astype(np.int64), minlength=self.n)

    def table(self, iterations) -> np.ndarray:
        """Patients by iterations."""
        return np.stack([self.counts(b) for b in iterations], axis=1).astype(np.float64)


def numbered_patients(subjects: DataFrame, subject: str) -> DataFrame:
    """``subject`` and its number ``_idx``, counted by (hash bucket, id)."""
    return rank_in_order(subjects.select(subject).withColumn("_b", hash_bucket(subject)),
                         ["_b"], ["_b"], [F.col(subject)], "_idx").select(subject, "_idx")


def patient_scores(df: DataFrame, subject: str = "subject_id", by=(), y: str = "y", p: str = "p"
                   ) -> DataFrame:
    """Positives and negatives per (patient, group, distinct score)."""
    hit = F.col(y) == 1
    return (df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
            .groupBy(subject, *by, F.col(p).cast("double").alias("p"))
            .agg(F.sum(F.when(hit, 1).otherwise(0)).alias("pos"),
                 F.sum(F.when(hit, 0).otherwise(1)).alias("neg")))


RUN_COLUMNS = ("p", "idx", "pos", "neg")


def _pack(limit: int):
    """Rows sorted by (group, falling score) as runs of one group."""
    def run(batches):
        group, held, n = None, [], 0

        def emit():
            cols = [np.concatenate([h[k] for h in held]) for k in range(4)]
            return pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int64())]
                + [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
                   for v in cols], names=["_g", *RUN_COLUMNS])

        for batch in batches:
            g, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if n and (g[a] != group or n >= limit):
                    yield emit()
                    held, n = [], 0
                if b > a:
                    group = int(g[a])
                    held.append([v[a:b] for v in cols])
                    n += b - a
        if n:
            yield emit()
    return run


def score_runs(scores: DataFrame, by, patients: DataFrame, subject: str, folder: str
               ) -> DataFrame:
    """Written runs: ``_g`` (hash of the group), ``run``, and arrays by falling score.

    Rows with one score may be in several runs, so a score that many rows share is cut too.
    """
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    rows = scores.join(patients, subject).select(
        group.alias("_g"), "p", F.col("_idx").cast("int").alias("idx"),
        F.col("pos").cast("bigint").alias("pos"), F.col("neg").cast("bigint").alias("neg"))
    order = ["_g", F.desc("p"), "idx"]
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    packed = sorted_.mapInArrow(_pack(RUN_ROWS), "_g bigint, p array<double>, idx array<int>, "
                                                 "pos array<bigint>, neg array<bigint>")
    return materialize(packed.select("_g", F.monotonically_increasing_id().alias("run"),
                                     *RUN_COLUMNS), "runs", folder)


def _draw_chunks(n: int, iterations: int, size: int):
    """Task code: the draws of ``DRAWN`` iterations, as bytes per chunk of ``size`` patients."""
    def run(batches):
        draws = Draws(n)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                every = range(block * DRAWN, min((block + 1) * DRAWN, iterations))
                counts = np.stack([draws.counts(b) for b in every])
                counts = counts.astype(np.uint8 if counts.max() < 256 else np.uint32)
                chunks = range(0, n, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(chunks), dtype=np.int32)),
                     pa.array(np.full(len(chunks), block, np.int32)),
                     pa.array(np.full(len(chunks), counts.itemsize, np.int32)),
                     pa.array([counts[:, a:a + size].tobytes() for a in chunks], pa.binary())],
                    names=["chunk", "block", "width", "counts"])
    return run


def _weigh_chunk(iterations: int, size: int):
    """Task code: drawn positives and negatives per (score, iteration) of a chunk's patients."""
    def run(rows, drawn):
        cell, idx, pos, neg = (rows.column(c).to_numpy() for c in ("cell", "idx", "pos", "neg"))
        order = np.argsort(cell, kind="stable")
        cell, idx, pos, neg = cell[order], idx[order] % size, pos[order], neg[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
        out = np.zeros((len(first), 2, iterations))
        for k in range(drawn.num_rows if len(first) else 0):
            block, width = (drawn.column(c)[k].as_py() for c in ("block", "width"))
            lo, hi = block * DRAWN, min((block + 1) * DRAWN, iterations)
            counts = np.frombuffer(drawn.column("counts")[k].as_buffer(),
                                   np.uint8 if width == 1 else np.uint32).reshape(hi - lo, -1)
            for b in range(lo, hi):
                times = counts[b - lo].astype(np.float64)[idx]
                out[:, 0, b] = np.add.reduceat(times * pos, first)
                out[:, 1, b] = np.add.reduceat(times * neg, first)
        return pa.table({"cell": pa.array(cell[first] if len(first) else [], pa.int32()),
                         "drawn": pa.array([x.tobytes() for x in out], pa.binary())})
    return run


def _add_drawn(batches):
    total: dict = {}
    for batch in batches:
        for cell, drawn in zip(batch.column(0).to_pylist(), batch.column(1)):
            drawn = np.frombuffer(drawn.as_buffer(), np.float64)
            total[cell] = total[cell] + drawn if cell in total else drawn
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()),
         pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["cell", "drawn"])


def drawn_runs(rows: DataFrame, cells: DataFrame, n: int, n_rows: int, iterations: int,
               folder: str) -> DataFrame:
    """Written runs of distinct scores: ``_g``, ``run``, and by falling score ``p`` and
    ``drawn`` (positives, then negatives of every iteration).

    ``rows`` are (cell, idx, pos, neg), ``cells`` number the distinct (``_g``, ``p``). A draw
    is made once, and rows meet the draws of their chunk of patients, so all steps grow with
    patients and rows times iterations.
    """
    spark = rows.sparkSession
    size = max(1, min(CHUNK, CHUNK_ROWS * n // max(n_rows, 1)))
    blocks = -(-iterations // DRAWN)
    drawn = spark.range(0, blocks, 1, min(blocks, 1000)).mapInArrow(
        _draw_chunks(n, iterations, size), "chunk int, block int, width int, counts binary")
    own = rows.withColumn("chunk", F.floor(F.col("idx") / size).cast("int"))
    parts = own.groupBy("chunk").cogroup(drawn.groupBy("chunk")).applyInArrow(
        _weigh_chunk(iterations, size), "cell int, drawn binary")
    added = parts.repartition("cell").mapInArrow(_add_drawn, "cell int, drawn binary")
    return materialize(
        added.join(F.broadcast(cells), "cell").groupBy("_g", "run").agg(
            F.sort_array(F.collect_list(F.struct("p", "drawn")), asc=False).alias("_s"))
        .select("_g", "run", F.col("_s.p").alias("p"), F.col("_s.drawn").alias("drawn")),
        "drawn_runs", folder)


def cell_table(scores: DataFrame, by, folder: str) -> DataFrame:
    """``cell, _g, run, p`` for the distinct scores of every group, at most ``FEW_SCORES``:
    cells are numbered by group and falling score, and runs are cut at ``RUN_SCORES``."""
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    order = Window.orderBy("_g", F.desc("p"))
    inside = Window.partitionBy("_g").orderBy(F.desc("p"))
    cells = scores.select(group.alias("_g"), "p").distinct().select(
        (F.row_number().over(order) - 1).alias("cell"), "_g",
        F.floor((F.row_number().over(inside) - 1) / RUN_SCORES).cast("bigint").alias("run"), "p")
    return materialize(cells, "cells", folder)


def runs_of(scores: DataFrame, by, patients: DataFrame, subject: str, n: int, iterations: int,
            folder: str) -> DataFrame:
    """The runs of a score table: of distinct scores where they are few and shared by many
    rows, else of rows."""
    by = list(by)
    n_rows = scores.count()
    few = n_rows > RUN_ROWS and scores.select(*by, "p").distinct().limit(
        FEW_SCORES + 1).count() <= min(FEW_SCORES, n_rows // TIES)
    if not few:
        return score_runs(scores, by, patients, subject, folder)
    cells = cell_table(scores, by, folder)
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    rows = (scores.withColumn("_g", group).join(F.broadcast(cells.drop("run")), ["_g", "p"])
            .join(patients, subject).select("cell", F.col("_idx").cast("int").alias("idx"),
                                            F.col("pos").cast("bigint").alias("pos"),
                                            F.col("neg").cast("bigint").alias("neg")))
    return drawn_runs(rows, cells, n, n_rows, iterations, folder)


class DrawnRun:
    """A run of distinct scores whose drawn counts are known."""

    def __init__(self, row: dict):
        self.row = row
        self.p = self.scores = np.asarray(row["p"].values.to_numpy(zero_copy_only=False))
        drawn = [np.frombuffer(x.as_buffer(), np.float64) for x in row["drawn"].values]
        self.drawn = np.stack(drawn).reshape(len(self.p), 2, -1)

    def at_once(self, n: int) -> int:
        return max(1, CELLS // len(self.p))

    def weigh(self, draws, iterations) -> tuple[np.ndarray, np.ndarray]:
        own = self.drawn[:, :, np.asarray(iterations, np.int64)]
        return own[:, 0].copy(), own[:, 1].copy()


class Run:
    """One run, its distinct scores and the weights of some iterations."""

    def __init__(self, row: dict):
        self.row = row
        self.p, self.idx, self.pos, self.neg = (
            np.asarray(row[c].values.to_numpy(zero_copy_only=False)) for c in RUN_COLUMNS)
        self.first = np.flatnonzero(np.r_[True, self.p[1:] != self.p[:-1]])
        self.scores = self.p[self.first]

    def at_once(self, n: int) -> int:
        """Iterations that are worked on together."""
        return max(1, CELLS // max(len(self.p), n))

    def weigh(self, draws, iterations) -> tuple[np.ndarray, np.ndarray]:
        """Drawn positives and negatives per (distinct score, iteration)."""
        drawn = draws.table(iterations)[self.idx]
        return (np.add.reduceat(drawn * self.pos[:, None], self.first, axis=0),
                np.add.reduceat(drawn * self.neg[:, None], self.first, axis=0))


def _per_iteration(work, n: int, iterations_of, names):
    """Task code: ``work(run, pos, neg, lo, hi)`` over blocks of a run's iterations.

    It gives one array of a value per iteration for every one of ``names``.
    """
    def run(batches):
        draws = Draws(n)
        for batch in batches:
            kind = DrawnRun if "drawn" in batch.schema.names else Run
            for row in range(batch.num_rows):
                r = kind({c: batch.column(c)[row] for c in batch.schema.names})
                every = iterations_of(r)
                step = r.at_once(n)
                for lo in range(0, len(every), step):
                    hi = min(lo + step, len(every))
                    pos, neg = r.weigh(draws, every[lo:hi])
                    out = work(r, pos, neg, lo, hi)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r.row["_g"].as_py()] * (hi - lo), pa.int64()),
                         pa.array([r.row["run"].as_py()] * (hi - lo), pa.int64()),
                         pa.array(np.asarray(every[lo:hi], np.int32)),
                         *[pa.array(np.broadcast_to(v, hi - lo).astype(np.float64))
                           for v in out]],
                        names=["_g", "run", "iter", *names])
    return run, "_g bigint, run bigint, iter int, " + ", ".join(f"{c} double" for c in names)


SIDES = ("wp", "wn", "fp", "fn", "lp", "ln")


def partial_states(runs: DataFrame, n: int, iterations: int, bins: int, eps: float = 1e-9
                   ) -> DataFrame:
    """Per (group, run, iteration): first and last score, positives and negatives drawn in
    all, at the first and at the last score, squared error, and counts per score bin."""
    edges = np.array(bin_edges(bins))
    names = ("p_first", "p_last", *SIDES, "square",
             *[f"bin_{k}_{i}" for i in range(bins) for k in ("n", "pos", "sum")])

    def work(r, pos, neg, lo, hi):
        q = r.scores[:, None]
        clipped = np.clip(r.scores, eps, 1.0 - eps)
        at = np.clip(np.searchsorted(edges, clipped, "right") - 1, 0, bins - 1)
        both, out = pos + neg, []
        for i in range(bins):
            own = at == i
            out += [both[own].sum(0), pos[own].sum(0), (both[own] * clipped[own, None]).sum(0)]
        return (r.scores[0], r.scores[-1], pos.sum(0), neg.sum(0), pos[0], neg[0], pos[-1],
                neg[-1], (pos * (q - 1.0) ** 2 + neg * q ** 2).sum(0), *out)

    run, schema = _per_iteration(work, n, lambda r: range(iterations), names)
    return runs.mapInArrow(run, schema)


OFFSETS = ("above_p", "above_n", "before_p", "before_n", "after_p", "after_n", "all_p", "all_n")


def run_offsets(states: DataFrame) -> DataFrame:
    """Per (group, run, iteration) what lies around the run: drawn positives and negatives
    of higher scores, of its first score in runs before it, of its last score in runs
    after it, and of the whole group. Windows hold a row per run of one group."""
    key = ["_g", "iter"]
    order = [F.desc("p_first"), F.desc("p_last"), F.col("run")]
    back = [F.asc("p_first"), F.asc("p_last"), F.desc("run")]
    ahead = Window.partitionBy(*key).orderBy(*order)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(*key, "p_last").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    first = Window.partitionBy(*key, "p_first").orderBy(*back).rowsBetween(
        Window.unboundedPreceding, 0)
    group = Window.partitionBy(*key)
    summed = states.select(
        *key, "run", "p_first", "p_last",
        *[F.coalesce(F.sum(f"w{s}").over(before), F.lit(0.0)).alias(f"_above_{s}") for s in "pn"],
        *[F.sum(f"l{s}").over(last).alias(f"_last_{s}") for s in "pn"],
        *[F.sum(f"f{s}").over(first).alias(f"_first_{s}") for s in "pn"],
        *[F.sum(f"w{s}").over(group).alias(f"all_{s}") for s in "pn"])
    tie_before = F.lag("p_last").over(ahead) == F.col("p_first")
    tie_after = F.lead("p_first").over(ahead) == F.col("p_last")
    near = summed.select(
        "*", *[F.when(tie_before, F.lag(f"_last_{s}").over(ahead)).otherwise(0.0)
               .alias(f"before_{s}") for s in "pn"],
        *[F.when(tie_after, F.lead(f"_first_{s}").over(ahead)).otherwise(0.0)
          .alias(f"after_{s}") for s in "pn"])
    return near.select(*key, "run", *[(F.col(f"_above_{s}") - F.col(f"before_{s}"))
                                      .alias(f"above_{s}") for s in "pn"], *OFFSETS[2:])


PARTS = ("area", "precision_area", "sensitivity", "specificity")


def ranking_parts(runs: DataFrame, offsets: DataFrame, n: int, level: float) -> DataFrame:
    """Per (group, run, iteration) the run's part of the ranking measures; NaN is no value."""
    packed = offsets.groupBy("_g", "run").agg(
        F.sort_array(F.collect_list(F.struct("iter", *OFFSETS))).alias("_o"))

    def work(r, pos, neg, lo, hi):
        found = r.row["_o"].values
        o = {c: found.field(k + 1).to_numpy(zero_copy_only=False)[lo:hi]
             for k, c in enumerate(OFFSETS)}
        tp, fp = ((o[f"above_{s}"] + o[f"before_{s}"]) + np.cumsum(x, axis=0)
                  for s, x in (("p", pos), ("n", neg)))
        tied = pos.copy()
        for x, s in ((tp, "p"), (fp, "n"), (tied, "p")):
            x[-1] += o[f"after_{s}"]
        tied[0] += o["before_p"]
        area = (neg * (tp - tied / 2.0)).sum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(tp + fp > 0, tp / (tp + fp), 0.0)
            precision = (pos / o["all_p"] * share).sum(0)
            tpr, spec = tp / o["all_p"], 1.0 - fp / o["all_n"]
            return (area, precision, np.where(spec >= level, tpr, -1.0).max(0),
                    np.where(tpr >= level, spec, -1.0).max(0))

    run, schema = _per_iteration(
        work, n, lambda r: r.row["_o"].values.field(0).to_numpy(), PARTS)
    return runs.join(packed, ["_g", "run"]).mapInArrow(run, schema)


def drawn_measures(states: DataFrame, parts: DataFrame, bins: int, level: float) -> DataFrame:
    """Every measure per (group, iteration) but those of the calibration fit."""
    tag = round(level * 100)
    sums = states.groupBy("_g", "iter").agg(
        *[F.sum(c).alias(c) for c in ("wp", "wn", "square")],
        *[F.sum(f"bin_{k}_{i}").alias(f"bin_{k}_{i}") for i in range(bins)
          for k in ("n", "pos", "sum")])
    ranked = parts.groupBy("_g", "iter").agg(
        F.sum("area").alias("area"), F.sum("precision_area").alias("precision_area"),
        F.max("sensitivity").alias("sensitivity"), F.max("specificity").alias("specificity"))
    pos, neg = F.col("wp"), F.col("wn")
    total = pos + neg
    gaps = sum((F.abs(F.col(f"bin_sum_{i}") - F.col(f"bin_pos_{i}")) for i in range(1, bins)),
               F.abs(F.col("bin_sum_0") - F.col("bin_pos_0")))
    both = (pos > 0) & (neg > 0)
    return sums.join(ranked, ["_g", "iter"]).filter(total > 0).select(
        "_g", "iter", (F.col("area") / F.nullif(pos * neg, F.lit(0.0))).alias("auroc"),
        F.when(pos > 0, F.col("precision_area")).alias("auprc"),
        (pos / total).alias("prevalence"), total.alias("n"), pos.alias("n_pos"),
        F.when(both, F.greatest(F.col("sensitivity"), F.lit(0.0)))
        .alias(f"sensitivity_at_spec_{tag}"),
        F.when(both & (F.col("specificity") >= 0), F.col("specificity"))
        .alias(f"specificity_at_sens_{tag}"),
        (F.col("square") / total).alias("brier"), (gaps / total).alias("ece"))


GRADIENT = ("g0", "g1", "h00", "h01", "h11")


def drawn_calibration(runs: DataFrame, states: DataFrame, start: DataFrame, n: int, folder: str,
                      c: float = 1e6, max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """Slope and intercept per (group, iteration): Newton steps of all iterations at once.

    A step reads the runs once; ``start`` has each group's fit to all patients. The
    parameters sent to the tasks are two numbers per group and iteration.
    """
    keys = ["_g", "iter"]
    sides = states.groupBy(*keys).agg(F.sum("wp").alias("_p"), F.sum(F.col("wp") + F.col("wn"))
                                      .alias("_t"))
    fitted = sides.join(start, "_g", "left")
    state = materialize(starting_state(fitted, keys, "_sa", "_sb"), "drawn_calibration_0", folder)

    def work(r, pos, neg, lo, hi):
        found = r.row["_s"].values
        a, b = (found.field(k).to_numpy(zero_copy_only=False)[lo:hi] for k in (1, 2))
        p = np.clip(r.scores, 1e-9, 1.0 - 1e-9)
        z = np.log(p / (1.0 - p))[:, None]
        both = pos + neg
        with np.errstate(over="ignore"):
            mu = 1.0 / (1.0 + np.exp(-(a + b * z)))
        res, wt = pos - both * mu, both * mu * (1.0 - mu)
        return (res.sum(0), (res * z).sum(0), wt.sum(0), (wt * z).sum(0), (wt * z * z).sum(0))

    for step in range(1, max_iter + 1):
        still = state.filter("_open")
        if still.isEmpty():
            break
        packed = still.groupBy("_g").agg(
            F.sort_array(F.collect_list(F.struct("iter", "_a", "_b"))).alias("_s"))
        run, schema = _per_iteration(
            work, n, lambda r: r.row["_s"].values.field(0).to_numpy(), GRADIENT)
        sums = runs.join(F.broadcast(packed), "_g").mapInArrow(run, schema).groupBy(*keys).agg(
            *[F.sum(x).alias(x) for x in GRADIENT])
        state = materialize(newton_update(state, sums, keys, c, tol),
                            f"drawn_calibration_{step}", folder)
    return state.select(*keys, F.col("_b").alias("calibration_slope"),
                        F.col("_a").alias("calibration_intercept"))


def bootstrap_draws(df: DataFrame, metrics, iterations: int = 1000, subject: str = "subject_id",
                    by=(), y: str = "y", p: str = "p", bins: int = 10, level: float = 0.90
                    ) -> tuple[DataFrame, DataFrame]:
    """The measures of each group's score table, and those of every iteration.

    With ``by``, all groups share the draws; a group's scores may lack patients. An
    iteration that draws no row of a group gives it no value.
    """
    by, folder = list(by), run_folder(df.sparkSession)
    scores = materialize(patient_scores(df, subject, by, y, p), "patient_scores", folder)
    patients = materialize(numbered_patients(df.select(subject).distinct(), subject), "patients",
                           folder)
    n = patients.count()
    whole = scores.groupBy(*by, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    point = discrimination(whole, by, level)
    group = (F.xxhash64(*by) if by else F.lit(0).cast("bigint")).alias("_g")
    parts = [ece_of_scores(whole, by, bins)]
    fitted = None
    if set(CALIBRATION) & set(metrics):
        fitted = materialize(calibration_of_scores(whole, by), "calibration", folder)
        parts.append(fitted)
    keys = [*by] or ["_one"]
    point = point if by else point.withColumn("_one", F.lit(1))
    for part in parts:
        point = point.join(part if by else part.withColumn("_one", F.lit(1)), keys)
    runs = runs_of(scores, by, patients, subject, n, iterations, folder)
    states = materialize(partial_states(runs, n, iterations, bins), "states", folder)
    ranked = ranking_parts(runs, run_offsets(states), n, level)
    drawn = drawn_measures(states, ranked, bins, level)
    if fitted is not None:
        start = fitted.select(group, F.col("calibration_intercept").alias("_sa"),
                              F.col("calibration_slope").alias("_sb"))
        drawn = drawn.join(drawn_calibration(runs, states, start, n, folder), ["_g", "iter"],
                           "left")
    if by:
        groups = scores.select(*by, group).distinct()
        drawn = drawn.join(groups, "_g")
    return point.select(*by, *metrics), drawn.select(*by, "iter", *metrics)


def bootstrap_ci(df: DataFrame, metrics, iterations: int = 1000, level: float = 0.95,
                 subject: str = "subject_id", by=(), y: str = "y", p: str = "p", bins: int = 10,
                 ) -> DataFrame:
    """Point estimate and percentile interval per metric: ``(by, metric, point, ci_lower,
    ci_upper)``, over the iterations that give the metric a value."""
    by, metrics = list(by), list(metrics)
    whole, drawn = bootstrap_draws(df, metrics, iterations, subject, by, y, p, bins)
    casts = [F.col(m).cast("double").alias(m) for m in metrics]
    point = whole.select(*by, *casts).unpivot(by, metrics, "metric", "point")
    draws = drawn.select(*by, *casts).unpivot(by, metrics, "metric", "value")
    tail = (1.0 - level) / 2.0
    finite = draws.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ci = finite.groupBy(*by, "metric").agg(
        F.percentile("value", F.lit(tail)).alias("ci_lower"),
        F.percentile("value", F.lit(1.0 - tail)).alias("ci_upper"))
    return point.join(ci, [*by, "metric"], "left")
