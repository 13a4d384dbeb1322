"""Spark ML on window features: boosted trees, tree ladders, networks, regressors, search, importances.

Training tables are read many times by one fit, so callers pass settled (checkpointed) frames. What
comes back to the driver is models, metric rows and feature names only.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import settle
from ..settings import OVERFIT_LIMITS, SEED
from .experiments import with_gaps
from .explain import staged_counts
from .ranking import confusion, metrics_of_counts, ranking_metrics


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def probability(model, rows: DataFrame, out: str = "score") -> DataFrame:
    """Score rows with a classifier: probability of class 1."""
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.drop(*[c for c in ("features", "rawPrediction", "probability", "prediction") if c not in rows.columns])


def vectors(rows: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    keep = [c for c in rows.columns if c not in features]
    return assembler(features).transform(rows.withColumn(label, F.col(label).cast("double"))).select(*keep, "features")


# ---- boosted trees -------------------------------------------------------------------------------

@dataclass
class BoostedFit:
    model: PipelineModel
    best_round: int
    history: DataFrame
    features: list[str] = field(default_factory=list)


def round_history(gbt, features: Sequence[str], train: DataFrame, val: DataFrame, limits: Sequence[tuple] = OVERFIT_LIMITS) -> DataFrame:
    """Per boosting round (variation, epoch): train and validation PR-AUC, ROC-AUC and log loss, with gap flags.

    `train` should be a probe of about the size of `val`.
    """
    def metrics(rows: DataFrame, tag: str) -> DataFrame:
        counts = settle(staged_counts(gbt, rows, features))               # loss and ranking read it
        p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
        loss = counts.groupBy(F.col("round").alias("_r")).agg(
            (-F.sum(F.col("pos") * F.log(p) + (F.col("n") - F.col("pos")) * F.log(1 - p)) / F.sum("n")).alias(f"{tag}_loss"))
        auc = metrics_of_counts(counts, by=["round"]).select(
            F.col("round").alias("epoch"), F.col("pr_auc").alias(f"{tag}_pr_auc"), F.col("roc_auc").alias(f"{tag}_roc_auc"))
        return auc.join(F.broadcast(loss), F.col("epoch") == F.col("_r")).drop("_r")      # one row per round

    both = metrics(train, "train").join(metrics(val, "val"), "epoch")
    return with_gaps(both.withColumn("variation", F.lit("boosted")), limits)


def first_trees(gbt: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first `n` trees: what a fit of `n` rounds with the same seed gives, without fitting again."""
    java, gateway = gbt._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees()[:n], gbt.treeWeights)):
        trees[i], weights[i] = tree, weight
    short = GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{gbt.uid}_{n}", trees, weights, gbt.numFeatures, gbt.numClasses))
    return gbt._copyValues(short)


def fit_boosted(train: DataFrame, val: DataFrame, features: Sequence[str], rounds: int = 3000, step: float = 0.05,
                depth: int = 8, min_child: int = 5, subsample: float = 0.8, patience: int = 100,
                weight: str | None = None, probe: DataFrame | None = None, seed: int = SEED) -> BoostedFit:
    """Boosted trees; the number of rounds is the prefix with the best validation PR-AUC. The defaults are the full-size settings.

    The loss-based stop of the trainer would favour another count, so every round of the one fit is scored and the model cut off
    at the best. `patience` rounds without a gain end the scan. `probe` holds the training rows the curves are drawn on; all by default.
    """
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=step,
                        minInstancesPerNode=min_child, subsamplingRate=subsample, seed=seed, featureSubsetStrategy="0.8")
    gbt = (gbt.setWeightCol(weight) if weight else gbt).fit(vectors(train, features))
    history = settle(round_history(gbt, features, train if probe is None else probe, val))
    curve = sorted((r["epoch"], r["val_pr_auc"]) for r in history.select("epoch", "val_pr_auc").collect())
    best, at = float("-inf"), gbt.getNumTrees
    for n, value in curve:
        if value is not None and value > best:
            best, at = value, n
        elif n - at >= patience:
            break
    return BoostedFit(PipelineModel([assembler(features), first_trees(gbt, at)]), at, history, list(features))


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession, top: int | None = None) -> DataFrame:
    """(feature, gain), strongest first; one row per feature."""
    gains = model.stages[-1].featureImportances.toArray()
    ranked = sorted(((f, float(g)) for f, g in zip(features, gains)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(ranked[:top], "feature string, gain double")


# ---- other learners ------------------------------------------------------------------------------

def depth_ladder(train: DataFrame, test: DataFrame, features: Sequence[str], depths: Sequence[int] = (2, 4, 8, 16, 30),
                 seed: int = SEED) -> DataFrame:
    """Per depth: leaves, and accuracy, balanced accuracy and PR-AUC on train and test."""
    train_v, test_v = vectors(train, features), vectors(test, features)
    out = None
    for depth in depths:
        model = DecisionTreeClassifier(labelCol="label", featuresCol="features", maxDepth=depth, minInstancesPerNode=1,
                                       seed=seed).fit(train_v)
        parts = []
        for tag, rows in (("train", train_v), ("test", test_v)):
            scored = probability(model, rows)
            c = confusion(scored, 0.5).select(F.col("accuracy").alias(f"{tag}_accuracy"),
                                              F.col("balanced_accuracy").alias(f"{tag}_balanced_accuracy"))
            parts.append(c.crossJoin(ranking_metrics(scored).select(F.col("pr_auc").alias(f"{tag}_pr_auc"))))  # one row each
        row = parts[0].crossJoin(parts[1]).select(F.lit(depth).alias("max_depth"), F.lit(model.depth).alias("depth"),
                                                  F.lit((model.numNodes + 1) // 2).alias("leaves"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def fit_network(train: DataFrame, features: Sequence[str], hidden: Sequence[int] = (64, 32), max_iter: int = 100,
                step: float = 0.03, seed: int = SEED) -> PipelineModel:
    """Feed-forward classifier on scaled features."""
    net = MultilayerPerceptronClassifier(labelCol="label", featuresCol="features", layers=[len(features), *hidden, 2],
                                         maxIter=max_iter, stepSize=step, seed=seed)
    return Pipeline(stages=[assembler(features), net]).fit(train.withColumn("label", F.col("label").cast("double")))


def fit_remaining_life(train: DataFrame, features: Sequence[str], target: str = "days_to_failure", rounds: int = 100,
                       depth: int = 5, step: float = 0.1, seed: int = SEED) -> PipelineModel:
    gbt = GBTRegressor(labelCol=target, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return Pipeline(stages=[assembler(features), gbt]).fit(train.withColumn(target, F.col(target).cast("double")))


def predict_life(model: PipelineModel, rows: DataFrame, horizon: int = 60, out: str = "prediction") -> DataFrame:
    """Predicted days, clipped to [0, horizon]."""
    clipped = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(float(horizon)))
    return model.transform(rows).withColumn(out, clipped).drop("features")


# ---- search and family studies -------------------------------------------------------------------

def grid_configs(space: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def random_configs(space: dict[str, Sequence], n_trials: int, seed: int = SEED) -> list[dict]:
    """`n_trials` distinct grid points, in a replayable random order."""
    import random
    every = grid_configs(space)
    return random.Random(seed).sample(every, min(n_trials, len(every)))


def one_knob_variations(base: dict, knobs: dict[str, Sequence]) -> list[dict]:
    """The base settings, then each knob changed alone; `variation` names the change."""
    out = [{"variation": "base", **base}]
    for name, values in knobs.items():
        out += [{"variation": f"{name}={v}", **base, name: v} for v in values if v != base.get(name)]
    return out


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], list]], at_once: int) -> list[list]:
    """The results of `tasks`, in their order, with at most `at_once` of them running.

    Each runs in a driver thread with a scheduler pool of its own, so that under FAIR scheduling the tail of one fit's stage leaves
    no executor idle while another has work.
    """
    def in_pool(task, name):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            return task()
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max(1, at_once)) as threads:
        running = [threads.submit(in_pool(task, f"fit-{i % max(1, at_once)}")) for i, task in enumerate(tasks)]
        return [r.result() for r in running]


SCORED_CONFIG = "config string, pr_auc double, roc_auc double"


def config_name(config: dict) -> str:
    return config.get("variation") or ", ".join(f"{k}={v}" for k, v in sorted(config.items()))


def search(train: DataFrame, val: DataFrame, features: Sequence[str], configs: Sequence[dict],
           seed: int = SEED, at_once: int = 4) -> DataFrame:
    """(config, pr_auc, roc_auc) on the validation drives, best first. One fit per config, `at_once` of them side by side."""
    train_v, val_v = vectors(train, features), vectors(val, features)

    def one(config: dict):
        def fit() -> list:
            args = {k: v for k, v in config.items() if k != "variation"}
            model = GBTClassifier(labelCol="label", featuresCol="features", seed=seed, **args).fit(train_v)
            found = ranking_metrics(probability(model, val_v)).select("pr_auc", "roc_auc").first()
            return [(config_name(config), found["pr_auc"], found["roc_auc"])]
        return fit

    rows = [r for part in side_by_side(train.sparkSession, [one(c) for c in configs], at_once) for r in part]
    return train.sparkSession.createDataFrame(rows, SCORED_CONFIG).orderBy(F.col("pr_auc").desc_nulls_last(), "config")


def halving_search(train: DataFrame, val: DataFrame, features: Sequence[str], configs: Sequence[dict], parts: Sequence[float] = (0.25, 0.5, 1.0),
                   drive: str = "drive", seed: int = SEED, at_once: int = 4) -> DataFrame:
    """`search` in rounds: every config on the first part of the training drives, the better half of them on the next larger one, and so on.

    A round holds whole drives, drawn by a hash, and those of the round before. Returns (round, config, pr_auc, roc_auc), last round first.
    """
    left, out = list(configs), None
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(drive)), F.lit(1_000_000))
    for i, part in enumerate(parts):
        scored = settle(search(train.where(place < int(part * 1_000_000)) if part < 1 else train, val, features, left, seed, at_once))
        best = [r["config"] for r in scored.orderBy(F.col("pr_auc").desc_nulls_last(), "config").collect()]      # a row per config
        rows = scored.select(F.lit(i + 1).alias("round"), "*")
        out = rows if out is None else out.unionByName(rows)
        left = [c for c in left if config_name(c) in best[:max(1, (len(best) + 1) // 2)]]
    return out.orderBy(F.col("round").desc(), F.col("pr_auc").desc_nulls_last(), "config")


def family_study(train: DataFrame, test: DataFrame, features: Sequence[str], families: Sequence[str],
                 family: str = "model", max_iter: int = 20, depth: int = 4, seed: int = SEED, at_once: int = 4) -> DataFrame:
    """Per family: test PR-AUC of a pooled model, of its own model, and of a model that never saw it; `at_once` fits side by side."""
    train_v, test_v = vectors(train, features), vectors(test, features)

    def one(kind: str, rows: DataFrame, tested: Sequence[str]):
        def fit() -> list:
            if rows.select("label").distinct().count() < 2:
                return []
            model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=max_iter, maxDepth=depth, seed=seed).fit(rows)
            scored = probability(model, test_v.where(F.col(family).isin(list(tested)))).withColumn("_family", F.col(family))
            return [(r["_family"], kind, r["n"], r["n_pos"], r["pr_auc"], r["roc_auc"]) for r in ranking_metrics(scored, by=["_family"]).collect()]
        return fit

    tasks = [one("pooled", train_v, families)]
    for name in families:
        tasks += [one("own", train_v.where(F.col(family) == name), [name]), one("unseen", train_v.where(F.col(family) != name), [name])]
    rows = [r for part in side_by_side(train.sparkSession, tasks, at_once) for r in part]
    return train.sparkSession.createDataFrame(rows, "family string, trained_on string, n bigint, n_pos bigint, pr_auc double, roc_auc double")


# ---- scoring hooks -------------------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]


def pipeline_scorer(model: PipelineModel, out: str = "score") -> Scorer:
    return lambda rows: probability(model, rows, out)


def batch_scorer(predict: Callable[[pd.DataFrame], "pd.Series"], features: Sequence[str], out: str = "score") -> Scorer:
    """Score with any model that takes a pandas batch; `predict` travels to the workers, rows stream through Arrow."""
    names = list(features)

    def score(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(**{out: predict(batch[names]).astype("float64")})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInPandas(run, f"{schema}, `{out}` double")

    return score
