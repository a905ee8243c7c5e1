"""Model fits against optimality conditions, contributions against scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landmarkflow.config import ModelConfig
from landmarkflow.explain import cases, importance, sheets
from landmarkflow.explain.contributions import binned_levels, contributions, linear_terms
from landmarkflow.models import additive, boosted, isotonic, scorecard
from landmarkflow.models.additive import fit_additive
from landmarkflow.models.base import FittedModel, calibrate
from landmarkflow.models.boosted import fit_gbt
from landmarkflow.models.design import feature_profiles
from landmarkflow.models import tune
from landmarkflow.models.train import fit_model
from landmarkflow.models.tune import search
from landmarkflow.operators.splits import group_kfold

FEATS = [f"f{i}" for i in range(4)]


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.8 * x[:, 1] + 0.3 * x[:, 2])))
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf["y"] = (rng.uniform(size=500) < p).astype(int)
    pdf["flag"] = (x[:, 0] > 0).astype(float)
    pdf["row_id"] = np.arange(500)
    pdf["subject_id"] = pdf["row_id"] // 5
    pdf.loc[::17, "f1"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("f1", F.nanvl("f1", F.lit(None))).repartition(2)
    return pdf, df.persist()


def close_to_logit(model, df, keys):
    """Contributions plus the intercept give the log-odds of the raw score."""
    plain = FittedModel(model.name, model.features, model.pipeline, extra=model.extra)
    total = contributions(df, model, keys).groupBy(*keys).agg(
        F.sum("contribution_logodds").alias("s"))
    rows = plain.score(df).join(total, list(keys)).select(
        (F.ln(F.col("p") / (1 - F.col("p"))) - F.col("s") - model.extra["intercept"]).alias("d"))
    assert rows.agg(F.max(F.abs("d"))).first()[0] < 1e-6


def test_linear_scorecard(spark, toy, tmp_path):
    pdf, df = toy
    folded = group_kfold(df, "subject_id", 2)
    model = scorecard.fit_sparse_scorecard(folded, FEATS, "y", (0.003, 0.3), 3)
    assert 1 <= len(model.features) <= 3 and "f0" in model.features
    assert model.extra["selected_C"] in (0.003, 0.3) and len(model.extra["cv"]) == 2
    # the refit satisfies w + sum((p - y) z) = 0 with C = 1
    x = pdf[model.features].fillna(pdf[model.features].median())
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    w = np.array([model.extra["coefficients"][f] for f in model.features])
    p = 1 / (1 + np.exp(-(z @ w + model.extra["intercept"])))
    assert np.abs(w + z.T @ (p - pdf["y"])).max() < 0.05
    assert abs((p - pdf["y"]).sum()) < 0.05
    close_to_logit(model, df, ["row_id"])
    sheet = sheets.linear_sheet(linear_terms(spark, model), model.extra["selected_C"])
    assert {"odds_ratio_per_sd", "odds_ratio_per_unit", "points_per_sd"} <= set(sheet.columns)
    assert sheet.agg(F.min(F.abs("points_per_sd"))).first()[0] == 1
    model.task = "aki_stage1_24h"
    model.save(str(tmp_path / "m"))
    again = FittedModel.load(str(tmp_path / "m"))
    both = model.score(df).join(again.score(df).select("row_id", F.col("p").alias("q")), "row_id")
    assert again.task == "aki_stage1_24h"
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] == 0


def test_scalar_c_wins_over_the_grid(toy):
    _, df = toy
    model = fit_model("scorecard", df, None, FEATS, "y", ModelConfig(max_iter=20),
                      params={"C": 0.03, "target_features": 2})
    assert model.extra["selected_C"] == 0.03 and len(model.features) <= 2


def test_binned_scorecard_and_sheet(spark, toy):
    pdf, df = toy
    feats = ["f0", "f1", "flag"]
    model = scorecard.fit_binned_scorecard(df, feats, {"f0": [-.5, .5], "f1": [-.5, .5]}, "y",
                                           (0.3,))
    levels = binned_levels(spark, model)
    assert levels.filter("reference").count() == 3
    counts = levels.groupBy("feature").agg(F.sum("train_n"), F.sum("train_events")).collect()
    assert {(r[1], r[2]) for r in counts} == {(500, int(pdf["y"].sum()))}
    close_to_logit(model, df, ["row_id"])
    sheet = sheets.binned_sheet(levels)
    assert sheet.filter("reference and points_vs_reference <> 0").count() == 0
    assert {"reference_level", "max_abs_points", "min_train_n"} <= set(
        sheets.sheet_summary(sheet).columns)
    with pytest.raises(ValueError, match="needs bin edges"):
        scorecard.fit_binned_scorecard(df, ["f2"], {}, "y", (0.3,))
    with pytest.raises(ValueError, match="needs no bin edges"):
        scorecard.fit_binned_scorecard(df, ["flag"], {"flag": [0.5]}, "y", (0.3,))


def plain_parts(g, h, n, least):
    """Two cuts by trying every one: the best of the whole, then the best of either part."""
    def worth(a, b):
        return g[a:b].sum() ** 2 / h[a:b].sum()

    def best(a, b):
        fits = [(worth(a, c) + worth(c, b) - worth(a, b), -c) for c in range(a + 1, b)
                if n[a:c].sum() >= least and n[c:b].sum() >= least]
        return max(fits, default=(-1.0, 0))

    gain, at = best(0, len(g))
    if gain <= 1e-12:
        return np.zeros(len(g))
    cuts = [0, -at, len(g)]
    more, at = max(best(0, cuts[1]), best(cuts[1], len(g)))
    if more > 1e-12:
        cuts = sorted([*cuts, -at])
    return np.concatenate([np.full(b - a, np.clip(g[a:b].sum() / h[a:b].sum(), -4, 4))
                           for a, b in zip(cuts[:-1], cuts[1:])])


def test_cuts_equal_trying_every_one():
    rng = np.random.default_rng(8)
    for bins in (1, 2, 3, 17):
        g, h = rng.normal(size=(30, bins)), rng.uniform(0.1, 2, (30, bins))
        n = rng.integers(0, 5, (30, bins)).astype(float)
        got = additive.three_parts(g, h, n, 3)
        for k in range(30):
            assert got[k] == pytest.approx(plain_parts(g[k], h[k], n[k], 3))
    g, h = rng.normal(size=(20, 4, 5)), rng.uniform(0.1, 2, (20, 4, 5))
    n = rng.integers(1, 5, (20, 4, 5)).astype(float)
    values, gains = additive.quadrants(g, h, n, 2)
    for k in range(20):
        def worth(*cells):
            return g[k][cells].sum() ** 2 / h[k][cells].sum()
        every = {(i, j): sum(worth(a, b) for a in (slice(0, i), slice(i, 4))
                             for b in (slice(0, j), slice(j, 5))) - worth(slice(0, 4), slice(0, 5))
                 for i in range(1, 4) for j in range(1, 5)
                 if min(n[k][a, b].sum() for a in (slice(0, i), slice(i, 4))
                        for b in (slice(0, j), slice(j, 5))) >= 2}
        assert gains[k] == pytest.approx(max(every.values()))
        i, j = max(every, key=every.get)
        assert values[k][0, 0] == pytest.approx(g[k][:i, :j].sum() / h[k][:i, :j].sum())


def planted(spark, n=4000, features=4, seed=1):
    """Two shapes, one interaction, the rest noise; the label follows their sum."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, features))
    z = 2.0 * np.sin(2.5 * x[:, 0]) + np.where(x[:, 1] > 0.3, 1.5, -0.5)
    z += 2.0 * np.where((x[:, 2] > 0) == (x[:, 3] > 0), 1.0, -1.0)
    pdf = pd.DataFrame(x, columns=[f"x{k}" for k in range(features)])
    pdf["y"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-z))).astype(int)
    pdf["fold"], pdf["row_id"] = np.arange(n) % 4, np.arange(n)
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_additive_model_finds_the_planted_functions(spark, tmp_path):
    pdf, df = planted(spark)
    names = [f"x{k}" for k in range(4)]
    params = additive.AdditiveParams(max_bins=32, pairs=1, pair_bins=8)
    model = fit_additive(df, names, "y", params, "fold")
    assert [tuple(sorted(p)) for p in model.extra["pairs"]] == [("x2", "x3")]
    close_to_logit(model, df, ["row_id"])
    shapes = importance.term_shapes(spark, model)
    assert shapes.filter("lower > score or upper < score").count() == 0
    centred = shapes.groupBy("term").agg(F.sum(F.col("score") * F.col("mass")).alias("m"))
    assert centred.agg(F.max(F.abs("m"))).first()[0] < 1e-6
    for name, true in (("x0", lambda v: 2.0 * np.sin(2.5 * v)),
                       ("x1", lambda v: np.where(v > 0.3, 1.5, -0.5))):
        rows = model.score(df).join(contributions(df, model, ["row_id"]).filter(
            F.col("feature") == name).select("row_id", "value", "contribution_logodds"), "row_id")
        got = rows.select("value", "contribution_logodds").toPandas()
        want = true(got["value"].to_numpy())
        assert np.corrcoef(got["contribution_logodds"], want)[0, 1] > 0.95
    top = [r["term"] for r in importance.global_importance(spark, model).orderBy(
        F.desc("importance")).collect()]
    assert set(top[:3]) == {"x0", "x1", *("x2 & x3", "x3 & x2")} & set(top)
    from landmarkflow.evaluation.curves import auroc
    fit = auroc(model.score(df)).first()["auroc"]
    z = 2.0 * np.sin(2.5 * pdf.x0) + np.where(pdf.x1 > 0.3, 1.5, -0.5) + 2.0 * np.where(
        (pdf.x2 > 0) == (pdf.x3 > 0), 1.0, -1.0)
    assert fit > auroc(spark.createDataFrame(pd.DataFrame(
        {"y": pdf.y, "p": 1 / (1 + np.exp(-z))}))).first()["auroc"] - 0.02
    model.save(str(tmp_path / "m"))
    again = FittedModel.load(str(tmp_path / "m"))
    both = model.score(df).join(again.score(df).select("row_id", F.col("p").alias("q")), "row_id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12


def test_planted_pair_ranks_first_among_many(spark):
    pdf, df = planted(spark, 3000, 120, 3)
    names = [f"x{k}" for k in range(120)]
    medians = dict.fromkeys(names, 0.0)
    edges = {f: [k / 8 - 1 for k in range(1, 16)] for f in names}
    blocks = additive.pack_rows(df, names, edges, medians, ["y", "fold"], "blocks",
                                additive.run_folder(spark))
    flat = [np.zeros((1, 16)) for _ in names]
    ranked = additive.rank_pairs(blocks, names, edges, flat, [0.0], additive.AdditiveParams())
    assert len(ranked) == 120 * 119 // 2 and ranked[0][1:] == ("x2", "x3")


def test_additive_passes_go_over_distinct_rows(spark, monkeypatch):
    """Each row five times in other folds and with other labels: one row of bins."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, size=(400, 2)).astype(float)
    pdf = pd.DataFrame(np.tile(x, (5, 1)), columns=["a", "b"])
    pdf["y"] = (rng.uniform(size=2000) < 1 / (1 + np.exp(1.5 - pdf["a"]))).astype(int)
    pdf["fold"] = rng.integers(0, 3, size=2000)
    df, params = spark.createDataFrame(pdf), additive.AdditiveParams(8, 1, 3, rounds=200)
    sizes, packed = [], additive.pack_counts

    def counted(*args):
        out = packed(*args)
        sizes.append(out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(additive, "pack_counts", counted)
    got = fit_additive(df, ["a", "b"], "y", params, "fold")
    assert sizes == [16]

    def single(df, features, edges, medians, y, fold, folds, name, folder):
        return additive.pack_rows(df, features, edges, medians, [y, fold], name, folder)

    monkeypatch.setattr(additive, "pack_counts", single)
    want = fit_additive(df, ["a", "b"], "y", params, "fold")
    assert got.extra["pairs"] == want.extra["pairs"]
    assert got.extra["intercept"] == pytest.approx(want.extra["intercept"], abs=1e-8)
    for a, b in zip(got.extra["shapes"], want.extra["shapes"], strict=True):
        assert a == pytest.approx(b, abs=1e-8)


def test_additive_edge_cases(spark):
    """Gaps count at the median; constant columns, one class and one feature are fine."""
    rows = [(float(k % 7) if k % 5 else None, 3.0, k % 2, k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y int, fold int")
    model = fit_additive(df, ["a", "b"], "y", additive.AdditiveParams(pairs=2, rounds=50), "fold")
    assert model.score(df).filter("p is null or p <= 0 or p >= 1").count() == 0
    same = fit_additive(df.withColumn("y", F.lit(1)), ["a"], "y",
                        additive.AdditiveParams(rounds=50))
    assert same.score(df).agg(F.min("p")).first()[0] > 0.99


def plain_trees(x, y, cfg, edges, trees):
    """Margins of trees grown one leaf at a time, by plain loops."""
    bins = np.stack([np.searchsorted(edges[f], x[f], "right") for f in FEATS], axis=1)
    up, down = len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))
    w = np.where(y == 1, up, down)
    margin = np.zeros(len(y))

    def shrunk(g):
        return np.sign(g) * max(abs(g) - cfg.tree_alpha, 0)

    def split(rows, g, h):
        def worth(r):
            return shrunk(g[r].sum()) ** 2 / (h[r].sum() + cfg.tree_lambda)
        best = None
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max()):
                low, high = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if min(len(low), len(high)) < cfg.tree_min_rows:
                    continue
                gain = worth(low) + worth(high) - worth(rows)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, low, high)
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        leaves = [(np.arange(len(y)), 0)]
        splits = [split(leaves[0][0], g, h)]
        while len(leaves) < cfg.tree_leaves:
            able = [k for k, s in enumerate(splits) if s is not None
                    and (cfg.tree_depth < 0 or leaves[k][1] < cfg.tree_depth)]
            if not able:
                break
            k = max(able, key=lambda i: splits[i][0])
            _, low, high = splits[k]
            depth = leaves[k][1] + 1
            leaves[k:k + 1] = [(low, depth), (high, depth)]
            splits[k:k + 1] = [split(low, g, h), split(high, g, h)]
        for rows, _ in leaves:
            margin[rows] += cfg.tree_learning_rate * shrunk(g[rows].sum()) / (
                h[rows].sum() + cfg.tree_lambda)
    return margin


@pytest.mark.parametrize("depth,alpha,lam", [(-1, 0.0, 0.0), (3, 0.5, 2.0)])
def test_trees_equal_a_plain_version(spark, toy, tmp_path, monkeypatch, depth, alpha, lam):
    """Leaf-wise growth, penalties, depth limit; margins written between trees."""
    monkeypatch.setattr(boosted, "CARRY", 2)
    pdf, df = toy
    cfg = ModelConfig(trees=5, tree_leaves=7, tree_depth=depth, tree_min_rows=15,
                      tree_subsample=1.0, tree_column_share=1.0, tree_alpha=alpha,
                      tree_lambda=lam, tree_learning_rate=0.3)
    model = fit_gbt(df, FEATS, "y", cfg, bins=16)
    x = pdf[FEATS].fillna(pd.Series(model.extra["medians"]))
    want = plain_trees(x, pdf["y"].to_numpy(), cfg, model.extra["edges"], 5)
    got = model.score(df).select("row_id", "p").toPandas().sort_values("row_id")["p"].to_numpy()
    assert got == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-9)
    assert sum(model.extra["importance"].values()) == pytest.approx(1.0)
    model.save(str(tmp_path / "m"))
    again = FittedModel.load(str(tmp_path / "m")).score(df).select("row_id", "p").toPandas()
    assert again.sort_values("row_id")["p"].to_numpy() == pytest.approx(got)


def test_trees_stop_early_and_keep_the_best(spark, toy):
    """Noise labels: the validation AUROC stops rising, and no later tree is kept."""
    _, df = toy
    noise = df.withColumn("y", (F.xxhash64("row_id") % 2 == 0).cast("int"))
    cfg = ModelConfig(trees=40, tree_leaves=4, tree_early_stopping=3, tree_learning_rate=0.5)
    model = fit_gbt(noise.filter("row_id < 300"), FEATS, "y", cfg, noise.filter("row_id >= 300"))
    assert 0 <= model.extra["n_trees"] < 37
    one = fit_gbt(df.withColumn("y", F.lit(1)), FEATS, "y", ModelConfig(trees=2))
    assert one.score(df).agg(F.min("p")).first()[0] > 0.99


def coalition_value(tree, bins, coalition, node=0):
    """Expected value of a tree when only the coalition's features are known."""
    a, b = tree["left"][node], tree["right"][node]
    if a < 0:
        return tree["value"][node]
    if tree["feature"][node] in coalition:
        low = bins[tree["feature"][node]] <= tree["bin"][node]
        return coalition_value(tree, bins, coalition, a if low else b)
    rows = tree["rows"]
    return (rows[a] * coalition_value(tree, bins, coalition, a)
            + rows[b] * coalition_value(tree, bins, coalition, b)) / rows[node]


def test_tree_attributions_equal_sums_over_coalitions(spark, toy):
    from itertools import combinations
    from math import factorial

    from landmarkflow.explain import attributions
    from landmarkflow.models.base import with_margin

    pdf, df = toy
    model = fit_gbt(df, FEATS, "y", ModelConfig(trees=4, tree_leaves=9, tree_min_rows=10,
                                                tree_learning_rate=0.3), bins=8)
    table = attributions.tree_attributions(df, model, ["row_id"])
    got = {(r["row_id"], r["feature"]): r["contribution_logodds"] for r in table.collect()}
    total = table.groupBy("row_id").agg(F.sum("contribution_logodds").alias("s"))
    gap = with_margin(df, model, "m").join(total, "row_id").agg(
        F.max(F.abs(F.col("m") - F.col("s") - attributions.base_margin(model)))).first()[0]
    assert gap < 1e-9
    x = pdf[FEATS].fillna(pd.Series(model.extra["medians"])).to_numpy()
    for row in range(0, 500, 50):
        bins = [int(np.searchsorted(model.extra["edges"][f], x[row, k], "right"))
                for k, f in enumerate(FEATS)]
        for i, f in enumerate(FEATS):
            others = [k for k in range(4) if k != i]
            want = sum(factorial(size) * factorial(3 - size) / factorial(4)
                       * (coalition_value(t, bins, {*c, i}) - coalition_value(t, bins, set(c)))
                       for t in model.extra["trees"] for size in range(4)
                       for c in combinations(others, size))
            assert got[row, f] == pytest.approx(want, abs=1e-9)
    mean = {r["feature"]: r["mean_abs"] for r in
            attributions.mean_attributions(df, model).collect()}
    assert set(mean) == set(FEATS) and max(mean, key=mean.get) == "f0"
    assert table.filter("value is null").count() == pdf["f1"].isna().sum()


def test_mean_attributions_work_on_distinct_rows(toy, monkeypatch, tmp_path):
    from landmarkflow.explain import attributions

    _, df = toy
    model = fit_gbt(df, FEATS, "y", ModelConfig(trees=4, tree_leaves=9, tree_min_rows=10), bins=8)
    log, plain = str(tmp_path / "rows"), attributions.attribute

    def counted(bins, trees, width):
        with open(log, "a") as f:
            f.write(f"{len(bins)}\n")
        return plain(bins, trees, width)

    monkeypatch.setattr(attributions, "attribute", counted)
    want = {r["feature"]: r for r in attributions.tree_attributions(df, model, []).groupBy(
        "feature").agg(F.avg(F.abs("contribution_logodds")).alias("mean_abs"),
                       F.avg("contribution_logodds").alias("mean")).collect()}
    open(log, "w").close()
    copies = df.unionByName(df).unionByName(df)
    for r in attributions.mean_attributions(copies, model).collect():
        assert r["mean_abs"] == pytest.approx(want[r["feature"]]["mean_abs"], abs=1e-12)
        assert r["mean"] == pytest.approx(want[r["feature"]]["mean"], abs=1e-12)
    assert sum(map(int, open(log))) <= 500


def plain_isotonic(p, pos, n):
    """Rate of every score by the minimum-maximum formula."""
    def mean(a, b):
        return pos[a:b + 1].sum() / n[a:b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, len(p))) for a in range(i + 1))
            for i in range(len(p))]


def test_isotonic_blocks_merge_to_the_plain_fit(spark, monkeypatch):
    """Violations across range borders, ties of rates, and several rounds of merging."""
    monkeypatch.setattr(isotonic, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, falling in ((1, False), (5, False), (7, True)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            p = np.sort(rng.uniform(size=60)).round(4)
            n = rng.integers(1, 9, 60)
            pos = rng.binomial(n, 1 - p if falling else p)
            scores = spark.createDataFrame(
                pd.DataFrame({"p": p, "pos": pos, "neg": n - pos}).sample(frac=1, random_state=1))
            fit = isotonic.fit_isotonic(scores)
            assert np.interp(p, fit.x, fit.y) == pytest.approx(plain_isotonic(p, pos, n))
            assert (np.diff(fit.x) > 0).all() and (np.diff(fit.y) >= 0).all()
        assert isotonic.fit_isotonic(scores.limit(0)).x == (0.0, 1.0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_boosted_trees_and_calibration(toy):
    _, df = toy
    cfg = ModelConfig(trees=5, tree_leaves=8)
    model = fit_gbt(df, FEATS, "y", cfg, df.sample(0.3, seed=1))
    raw = model.score(df).agg(F.min("p"), F.max("p")).first()
    assert 0 <= raw[0] < raw[1] <= 1
    before = model.score(df).agg(F.sum("p")).first()[0]
    for method in ("isotonic", "sigmoid"):
        calibrate(model, df, "y", method)
        after = model.score(df)
        assert after.agg(F.sum("p")).first()[0] == pytest.approx(
            df.agg(F.sum("y")).first()[0], rel=1e-3)
    assert before != after.agg(F.sum("p")).first()[0]
    with pytest.raises(ValueError):
        calibrate(model, df, "y", "other")


def test_permutation_keeps_the_column_and_ranks_it(toy):
    pdf, df = toy
    moved = importance.shuffled(df.select("row_id", "f0", "f2"), "f0", ["row_id"]).toPandas()
    assert sorted(moved["f0"]) == sorted(pdf["f0"])
    same = moved.merge(pdf[["row_id", "f0", "f2"]], on="row_id")
    assert (same["f2_x"] == same["f2_y"]).all() and (same["f0_x"] == same["f0_y"]).mean() < 0.1
    model = fit_gbt(df, FEATS, "y", ModelConfig(trees=5, tree_depth=3))
    imp = {r["feature"]: r["importance"] for r in importance.permutation_importance(
        df, model, "y", ["f0", "f3"], ("row_id",)).collect()}
    assert imp["f0"] > imp["f3"]


def test_permutation_orders_rows_once_for_all_features(toy, monkeypatch):
    _, df = toy
    model = fit_gbt(df, FEATS, "y", ModelConfig(trees=3, tree_depth=2))
    calls, ranked = [], importance.rank_in_order
    monkeypatch.setattr(importance, "rank_in_order",
                        lambda *a: calls.append(a[-1]) or ranked(*a))
    got = {r["feature"]: r["auroc_shuffled"] for r in importance.permutation_importance(
        df, model, "y", FEATS, ("row_id",)).collect()}
    assert len(calls) == 2 and set(got) == set(FEATS)
    for f in FEATS:
        alone = importance.auroc(model.score(importance.shuffled(df, f, ["row_id"])).select(
            "y", "p")).first()["auroc"]
        assert got[f] == pytest.approx(alone, abs=1e-12)


def test_fits_read_rows_that_were_joined_once(spark, sf_dir):
    from landmarkflow.plans import queries_models
    from landmarkflow.plans.registry import Context

    c = Context(spark, sf_dir)
    train = queries_models.stored(c, "train")
    assert "Join" not in train._jdf.queryExecution().toString()
    assert sorted(queries_models.stored(c).inputFiles()) == sorted(train.inputFiles())
    assert train.exceptAll(queries_models.rows(c, "train")).isEmpty()
    assert queries_models.rows(c, "train").exceptAll(train).isEmpty()


def test_profiles_cuts_and_folds_go_through_the_rows_once(spark, toy):
    pdf, _ = toy
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    pdf = pdf.assign(fold=pdf["subject_id"] % 2)
    df = spark.createDataFrame(pdf).repartition(2)
    df = df.mapInArrow(counted, df.schema)
    # values, class counts and the packing; the trees read blocks
    model = fit_gbt(df, FEATS, "y", ModelConfig(trees=2))
    assert passed.value == 3 * len(pdf)
    for f in FEATS:
        values = pdf[f].dropna().to_numpy()
        want = np.unique(np.quantile(values, np.arange(1, 255) / 255))
        assert model.extra["medians"][f] == pytest.approx(np.median(values))
        assert model.extra["edges"][f] == pytest.approx(want[want > values.min()].tolist())
    passed.value = 0
    assert scorecard.fold_profiles(df, FEATS, "fold")[0]["f0"][0] == pytest.approx(
        pdf["f0"][pdf["fold"] == 1].median())
    assert passed.value <= 2 * len(pdf)  # which folds there are, and their values
    passed.value = 0
    assert feature_profiles(df, FEATS).count() == len(FEATS)
    assert passed.value == len(pdf)


def test_search_orders_trials_and_resumes(toy, tmp_path):
    _, df = toy
    space = [{"C": 0.001, "target_features": 1}, {"C": 1.0, "target_features": 4}]
    cfg, store = ModelConfig(max_iter=20), str(tmp_path / "study")
    search(df, FEATS, "y", "scorecard", folds=2, cfg=cfg, space=space[:1], store=store)
    rows = search(df, FEATS, "y", "scorecard", folds=2, cfg=cfg, space=space, store=store).collect()
    assert len(rows) == 2 and rows[0]["mean_auroc"] >= rows[1]["mean_auroc"]
    assert {r["trial"] for r in rows} == {0, 1} and not any(r["pruned"] for r in rows)
    kept = tune.stored_trials(df.sparkSession, store)
    assert [t.params for t in kept] == space and all(len(t.auroc) == 2 for t in kept)


SPACE = (("a", 1e-3, 1e1, True, False), ("b", 0, 20, False, True))


def rated(params, fold):
    """Best at a = 0.1, b = 15; folds differ a little."""
    off = abs(np.log10(params["a"]) + 1) / 4 + abs(params["b"] - 15) / 20
    return 0.9 - 0.3 * off + 0.001 * fold, 0.5


def test_a_resumed_study_ends_like_an_unbroken_one():
    whole = tune.run_study("scorecard", rated, 40, 5, 3, SPACE)
    seen = []
    for upto in (7, 23, 40):
        seen = tune.run_study("scorecard", rated, upto, 5, 3, SPACE, history=seen)
    assert [t.__dict__ for t in seen] == [t.__dict__ for t in whole]
    assert tune.run_study("scorecard", rated, 40, 5, 4, SPACE)[0].params != whole[0].params
    for t in whole:
        assert 1e-3 <= t.params["a"] <= 10 and t.params["b"] in range(21)


def test_proposals_close_in_on_the_best():
    def best(params):
        return np.mean([max(t.mean() for t in tune.run_study(
            "scorecard", rated, 40, 5, seed, SPACE, params=params)) for seed in range(8)])

    assert best(tune.SearchParams()) > best(tune.SearchParams(startup=40)) + 0.003
    space = tune.SPACES["boosted"]
    for s in space:
        for u in (0.0, 0.3, 1.0):
            assert tune.to_unit(s, tune.from_unit(s, u)) == pytest.approx(u, abs=0.1 if s[4] else 1e-9)


def test_density_equals_a_sum_of_cut_normals():
    from statistics import NormalDist

    kernels = [([0.5, 0.5], 1.0), ([0.1, 0.9], 0.2)]
    x = [0.3, 0.7]
    want = np.mean([np.prod([NormalDist(c, w).pdf(u) / (NormalDist(c, w).cdf(1)
                                                        - NormalDist(c, w).cdf(0))
                             for u, c in zip(x, centre)]) for centre, w in kernels])
    assert tune.log_density(x, kernels) == pytest.approx(np.log(want))


def test_pruning_follows_the_median():
    done = [tune.Trial(k, {}, [v, v, v, v], [0.5] * 4) for k, v in enumerate(
        (0.7, 0.72, 0.74, 0.76, 0.78))]
    bad, good = (tune.Trial(9, {}, [v] * 3, [0.5] * 3) for v in (0.73, 0.75))
    assert tune.is_hopeless(bad, done, 5, 2) and not tune.is_hopeless(good, done, 5, 2)
    assert not tune.is_hopeless(bad, done[:4], 5, 2)
    assert not tune.is_hopeless(tune.Trial(9, {}, [0.1, 0.1], [0, 0]), done, 5, 2)
    study = tune.run_study("boosted", rated, 30, 5, 1, SPACE)
    cut = [t for t in study if t.pruned]
    assert cut and all(2 <= len(t.auroc) < 5 for t in cut)
    assert not max(study, key=tune.Trial.mean).pruned


def test_select_c_rules(spark):
    ddl = "C double, auroc double, auprc double, brier double, mean_nonzero double"
    rows = [(0.1, .80, .5, .1, 4.), (1.0, .805, .5, .1, 12.), (0.01, .70, .5, .1, 1.)]
    table = spark.createDataFrame(rows, ddl)

    def chosen(df):
        return [(r["C"], r["selection_rule"]) for r in df.collect() if r["selected"]]

    assert chosen(scorecard.select_c(table, 0.01, 10)) == [
        (0.1, "within_tolerance_and_within_budget")]
    assert chosen(scorecard.select_c(table, 0.01, 3)) == [(0.1, "within_tolerance")]
    assert chosen(scorecard.select_c(table, 0.001)) == [
        (1.0, "within_tolerance_prefer_shrinkage")]


def test_cases_without_positives_use_all_rows(spark):
    rows = [(i, i, i, 0, i / 10, 0, i) for i in range(10)]
    df = spark.createDataFrame(rows, "stay_id long, subject_id long, landmark_time long, y int, "
                                     "p double, n_missing int, hours_since_icu_admit int")
    got = cases.rank_cases(df, 0.5, None, 3).orderBy("case_rank").collect()
    assert got[0]["selection_pool"] == "all" and got[0]["stay_id"] in (4, 5) and len(got) == 3

