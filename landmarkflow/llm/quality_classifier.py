"""Quality classifier: a sparse ensemble of rules read off shallow trees.

Trees are grown on a bounded sample of labelled documents, every path from a
root to a node becomes a conjunction over text statistics, a lasso logistic fit
keeps the conjunctions that matter, and the rest is one Spark column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmarkflow.llm.statistics import text_statistics
from landmarkflow.sources.tables import materialize, run_folder

#: Ratios the rules may speak about. Counts are damped so that short texts do not jump.
FEATURES = {
    "words": "ln(1 + n_words)",
    "word_length": "word_chars / (n_words + 1.0)",
    "symbols": "n_symbols / (word_chars + 10.0)",
    "pipes": "n_pipe / (n_words + 5.0)",
    "marks": "n_mark / (n_words + 5.0)",
    "upper": "n_upper / (n_upper + n_lower + 10.0)",
    "digits": "n_digit / (word_chars + 10.0)",
    "stops": "n_stop / (n_words + 5.0)",
    "capitals": "n_capital_words / (n_words + 5.0)",
    "dup_lines": "n_dup_lines / (n_lines + 1.0)",
    "repeats": "n_repeat_words / (n_words + 5.0)",
    "distinct": "n_distinct_words / (n_words + 5.0)",
    "longest": "ln(1 + longest_word)",
    "line_words": "ln(1 + n_words / (n_lines + 1.0))",
}


@dataclass(frozen=True)
class RuleParams:
    """``max_fit_rows`` bounds the labelled sample the model is fitted on."""

    max_fit_rows: int = 20_000
    trees: int = 24
    depth: int = 3
    penalty: float = 0.002
    seed: int = 17


@dataclass(frozen=True)
class RuleModel:
    """``rules`` are (weight, ((feature, is_upper, cut), ...))."""

    intercept: float
    rules: tuple

    def score(self) -> Column:
        """Probability of label 1 from the columns of :data:`FEATURES`."""
        total = F.lit(self.intercept)
        for weight, terms in self.rules:
            total = total + F.when(condition(terms), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(terms) -> Column:
    out = F.lit(True)
    for name, upper, cut in terms:
        out = out & ((F.col(name) > F.lit(cut)) if upper else (F.col(name) <= F.lit(cut)))
    return out


def tree_paths(text: str, names) -> list[tuple]:
    """All conjunctions on the way to the nodes of a printed tree ensemble.

    A conjunction is simplified to one lower and one upper cut per feature.
    """
    found, stack = set(), []
    for line in text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+\d.Ee]+)\)", line)
        if not m:
            if re.match(r" *Tree ", line):
                stack = []
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth]
        stack.append((depth, (names[int(m[3])], m[4] == ">", float(m[5]))))
        tight: dict = {}
        for _, (name, upper, cut) in stack:
            old = tight.get((name, upper))
            tight[name, upper] = cut if old is None else (max if upper else min)(old, cut)
        found.add(tuple((n, u, c) for (n, u), c in sorted(tight.items())))
    return sorted(found)


def features(stats: DataFrame, keep=()) -> DataFrame:
    return stats.select(*keep, *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def fit_rules(labelled: DataFrame, params: RuleParams = RuleParams(),
              label: str = "label") -> RuleModel:
    """Fit on rows with :data:`FEATURES` and a 0/1 ``label``.

    No rows, or rows of one label only, give a model without rules whose score is
    the (smoothed) share of label 1.
    """
    rows = labelled.select(F.col(label).cast("double").alias("label"), *FEATURES)
    by = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = by.get(1.0, 0), by.get(0.0, 0)
    if not good or not bad:
        share = (good + 0.5) / (good + bad + 1.0)
        return RuleModel(_logit(share), ())
    names = list(FEATURES)
    assembled = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=params.trees,
                                    maxDepth=params.depth, seed=params.seed,
                                    minInstancesPerNode=5).fit(assembled)
    paths = tree_paths(forest.toDebugString, names)
    if not paths:
        return RuleModel(_logit(good / (good + bad)), ())
    hits = rows.select("label", array_to_vector(F.array(
        *[condition(p).cast("double") for p in paths])).alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0,
                               regParam=params.penalty, standardization=False,
                               maxIter=60).fit(hits)
    weights = lasso.coefficients.toArray()
    rules = tuple((float(w), p) for w, p in zip(weights, paths) if w)
    return RuleModel(float(lasso.intercept), rules)


def _logit(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no fit sees: CRC-32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fit_quality(stats: DataFrame, labels: DataFrame, params: RuleParams = RuleParams(),
                folder: str | None = None) -> RuleModel:
    """Rules for ``labels.quality`` from at most ``max_fit_rows`` labelled, not held out rows.

    ``stats`` are :func:`text_statistics` with ``doc_id``. Labels of one document
    that disagree count by their majority; null labels and ids are ignored. Rows
    are chosen by the hash of their id, so the sample does not depend on the order
    or the partitioning of the input.
    """
    marks = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
             .filter("_id is not null and _q is not null")
             .filter(~held_out(F.col("_id")))
             .groupBy("_id").agg((F.avg("_q") >= 0.5).cast("int").alias("label")))
    some = (features(stats, keep=("doc_id",)).join(marks, F.col("doc_id") == F.col("_id"))
            .orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(params.max_fit_rows))
    rows = materialize(some.select("label", *FEATURES), "rule_sample",
                       folder or run_folder(stats.sparkSession))
    return fit_rules(rows, params)


def score_statistics(stats: DataFrame, model: RuleModel, threshold: float = 0.3,
                     keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` in 0..1 and ``predicted`` (1 if score >= threshold).

    Null and empty texts are scored like any other, by zero statistics.
    """
    scored = features(stats, keep=keep).select(*keep, model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_documents(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams(),
                     threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns.

    The model is fitted on the labelled rows of ``docs``. Columns are carried by
    position under names of their own, so no name of ``docs`` can clash.
    """
    model = fit_quality(text_statistics(docs), labels, params)
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*inner)
    stats = text_statistics(renamed, inner[docs.columns.index("text")], keep=inner)
    good = score_statistics(stats, model, threshold, keep=inner).filter("predicted = 1")
    return good.select(*inner).toDF(*docs.columns)
