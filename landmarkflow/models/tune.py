"""Parameter search: tree-structured Parzen proposals, fold-wise median pruning, resuming.

A study is a list of trials. What the next trial tries follows from the seed, its number
and the trials before it, so a stored study that is taken up again goes on as if it had
never stopped. Fits and measures are Spark jobs; the study itself is a few numbers.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmarkflow.config import ModelConfig
from landmarkflow.evaluation.curves import discrimination, score_table
from landmarkflow.models.train import fit_model
from landmarkflow.operators.splits import group_kfold

# --- fixed values: search ranges (name, low, high, log scale, integer) -------------
SPACES = {
    "scorecard": (("C", 1e-3, 1e1, True, False), ("target_features", 5, 10, False, True)),
    "additive": (("additive_learning_rate", 1e-3, 5e-2, True, False),
                 ("additive_pairs", 0, 20, False, True),
                 ("additive_max_bins", 128, 512, True, True),
                 ("additive_min_rows", 2, 20, False, True), ("additive_bags", 4, 8, False, True)),
    "boosted": (("tree_leaves", 15, 63, True, True), ("tree_depth", 4, 8, False, True),
                ("tree_learning_rate", 1e-2, 6e-2, True, False),
                ("tree_min_rows", 20, 120, True, True), ("tree_subsample", 0.7, 1.0, False, False),
                ("tree_column_share", 0.7, 1.0, False, False),
                ("tree_alpha", 1e-6, 5.0, True, False), ("tree_lambda", 1e-6, 5.0, True, False)),
}
#: Trials before pruning starts, and folds a trial has at least, by model.
PRUNING = {"boosted": (2, 1), "scorecard": (5, 2), "additive": (5, 2)}
# --- end of fixed values -------------------------------------------------------------


@dataclass(frozen=True)
class SearchParams:
    """The first ``startup`` trials are random; later ones take the best of ``candidates``
    draws from the better trials, the upper ``share`` of them (``most`` at most)."""

    startup: int = 10
    candidates: int = 24
    share: float = 0.1
    most: int = 25
    width: float = 0.2


@dataclass
class Trial:
    """Parameters with the AUROC and AUPRC of each fold that was fitted and had both classes."""

    number: int
    params: dict
    auroc: list
    auprc: list
    pruned: bool = False

    def mean(self, name: str = "auroc", upto: int | None = None) -> float:
        values = getattr(self, name)[:upto]
        return sum(values) / len(values) if values else -math.inf


def to_unit(spec, value) -> float:
    """Place of a value in its range, 0 to 1, on the range's scale."""
    _, lo, hi, log, _ = spec
    if log:
        return (math.log(value) - math.log(lo)) / (math.log(hi) - math.log(lo))
    return (value - lo) / (hi - lo)


def from_unit(spec, u: float):
    _, lo, hi, log, whole = spec
    v = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo))) if log else lo + u * (hi - lo)
    return min(max(round(v) if whole else v, lo), hi)


def _kernels(points: list, dims: int, params: SearchParams) -> list:
    """(centre, width) of each kernel: a wide one in the middle, then one per trial."""
    width = params.width * max(len(points), 1) ** (-1.0 / (dims + 4))
    return [([0.5] * dims, 1.0), *((p, width) for p in points)]


def log_density(x: list, kernels: list) -> float:
    """Log of the mean over kernels of products of normals cut off at 0 and 1."""
    logs = []
    for centre, w in kernels:
        total = 0.0
        for u, c in zip(x, centre, strict=True):
            inside = 0.5 * (math.erf((1 - c) / (w * math.sqrt(2)))
                            - math.erf(-c / (w * math.sqrt(2))))
            total += -0.5 * ((u - c) / w) ** 2 - math.log(w * math.sqrt(2 * math.pi) * inside)
        logs.append(total)
    top = max(logs)
    return top + math.log(sum(math.exp(v - top) for v in logs) / len(logs))


def _draw(kernels: list, rng: random.Random) -> list:
    centre, w = kernels[rng.randrange(len(kernels))]
    out = []
    for c in centre:
        u = rng.gauss(c, w)
        while not 0.0 <= u <= 1.0:
            u = rng.gauss(c, w)
        out.append(u)
    return out


def propose(space, seed: int, history: list, params: SearchParams = SearchParams()) -> dict:
    """Parameters of the next trial.

    Finished trials go by mean AUROC, pruned ones behind them. The draw that is likeliest
    among the better trials compared with the others wins; its dimensions are drawn
    together, from one trial's neighbourhood.
    """
    rng = random.Random(f"{seed}:{len(history)}:{[s[0] for s in space]}")
    if len(history) < params.startup:
        return {s[0]: from_unit(s, rng.random()) for s in space}
    ordered = sorted(history, key=lambda t: (t.pruned, -t.mean(), t.number))
    n = min(math.ceil(params.share * len(ordered)), params.most)
    points = [[to_unit(s, t.params[s[0]]) for s in space] for t in ordered]
    good, rest = (_kernels(p, len(space), params) for p in (points[:n], points[n:]))
    draws = [_draw(good, rng) for _ in range(params.candidates)]
    best = max(draws, key=lambda x: log_density(x, good) - log_density(x, rest))
    return {s[0]: from_unit(s, u) for s, u in zip(space, best, strict=True)}


def is_hopeless(trial: Trial, history: list, startup: int, warmup: int) -> bool:
    """Whether the running mean is under the median of the finished trials' at this fold."""
    step = len(trial.auroc)
    done = [t for t in history if not t.pruned and len(t.auroc) >= step]
    if step <= warmup or len(done) < startup:
        return False
    return trial.mean(upto=step) < median(t.mean(upto=step) for t in done)


def run_study(name: str, evaluate, trials: int, folds: int, seed: int = 42, space=None,
              history=(), keep=None, params: SearchParams = SearchParams()) -> list:
    """Trials up to number ``trials``, those of ``history`` included.

    ``evaluate(params, fold)`` gives AUROC and AUPRC, or None for a fold with one class.
    ``keep(trial)`` is called after each new trial. ``space`` may list parameter sets
    instead of ranges; they are tried in turn.
    """
    history = list(history)
    startup, warmup = PRUNING[name]
    given = space if space and isinstance(space[0], dict) else None
    ranges = SPACES[name] if given or not space else space
    while len(history) < (len(given) if given else trials):
        chosen = given[len(history)] if given else propose(ranges, seed, history, params)
        trial = Trial(len(history), chosen, [], [])
        for fold in range(folds):
            got = evaluate(chosen, fold)
            if got is None:
                continue
            trial.auroc.append(got[0])
            trial.auprc.append(got[1])
            if fold < folds - 1 and is_hopeless(trial, history, startup, warmup):
                trial.pruned = True
                break
        trial.pruned = trial.pruned or not trial.auroc
        history.append(trial)
        if keep:
            keep(trial)
    return history


def stored_trials(spark: SparkSession, store: str) -> list:
    """Trials of a stored study, in order; none if nothing was stored."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.json(store, schema="number int, trial string").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [Trial(**json.loads(r["trial"])) for r in sorted(rows, key=lambda r: r["number"])]


def search(df: DataFrame, features, y: str, name: str, trials: int = 20, folds: int = 5,
           cfg: ModelConfig = ModelConfig(), seed: int = 42, space=None,
           store: str | None = None, params: SearchParams = SearchParams()) -> DataFrame:
    """Search with patient-grouped folds: one row per trial with its parameters (JSON), mean
    AUROC and AUPRC and number of folds; finished ones first, best first.

    With ``store``, a folder every executor can reach, each trial is written there, and a
    study that is already in it goes on.
    """
    spark = df.sparkSession
    rows = group_kfold(df.filter(F.col(y).isNotNull()), "subject_id", folds).persist()

    def evaluate(chosen, k):
        train, held = rows.filter(F.col("fold") != k).drop("fold"), rows.filter(F.col("fold") == k)
        model = fit_model(name, train, held, features, y, cfg, params=chosen, seed=seed)
        m = discrimination(score_table(model.score(held), y=y)).first()
        return None if m["auroc"] is None else (m["auroc"], m["auprc"])

    def keep(trial):
        text = json.dumps(trial.__dict__)
        spark.createDataFrame([(trial.number, text)], "number int, trial string").write.mode(
            "append").json(store)

    try:
        history = run_study(name, evaluate, trials, folds, seed, space,
                            stored_trials(spark, store) if store else (),
                            keep if store else None, params)
    finally:
        rows.unpersist()
    out = [(t.number, json.dumps(t.params, sort_keys=True), t.mean(), t.mean("auprc"),
            len(t.auroc), t.pruned) for t in history if t.auroc]
    return spark.createDataFrame(
        out, "trial int, params string, mean_auroc double, mean_auprc double, n_folds int, "
             "pruned boolean").orderBy("pruned", F.desc("mean_auroc"), F.desc("mean_auprc"), "trial")
