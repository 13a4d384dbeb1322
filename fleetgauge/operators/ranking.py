"""Evaluation of scored rows as a ranking.

Input frames hold a 0/1 `label` and a `score`. Every metric that needs the global score order first
reduces the rows to one row per distinct score, then uses `totals_in_order`, so neither a hot score
nor the row count lands on one task. A NaN counts as no score, and rows without one rank last everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_index, digest, ratio
from ..functions.order import exact_quantiles, known_score, score_rank, totals_in_order

# Cut-off lists (fixed values).
DEFAULT_KS = (10, 25, 50, 100)
FRACTIONS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10)
FILE_KS = (5, 10, 25, 50, 100)


def score_counts(rows: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score: pos, n."""
    return rows.groupBy(*by, known_score(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))


def descending_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add tp and flagged: totals over all scores at or above this one."""
    return totals_in_order(counts, [F.col("score").desc_nulls_last()], {"pos": "tp", "n": "flagged"}, by)


# ---- threshold metrics ---------------------------------------------------------------------------

def confusion(rows: DataFrame, threshold: float, by: Sequence[str] = (), strict: bool = False,
              score: str = "score", label: str = "label") -> DataFrame:
    """Counts and rates at a threshold; undefined precision, recall and F1 are 0."""
    s = F.col(score)
    hit = (s > threshold) if strict else (s >= threshold)
    y = F.col(label) == 1

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("bigint"))

    got = rows.groupBy(*by).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"),
                                n(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    return got.select(
        *by, "tp", "fp", "fn", "tn", total.alias("n"), (tp + fn).alias("n_pos"),
        precision.alias("precision"), recall.alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        ratio(tp + fn, total).alias("base_rate"), ratio(tp + tn, total).alias("accuracy"),
        (0.5 * (ratio(tp, tp + fn) + ratio(tn, tn + fp))).alias("balanced_accuracy"),
        ratio(fp + tn, total).alias("always_healthy_accuracy"))


def ranking_metrics(rows: DataFrame, by: Sequence[str] = (), score: str = "score",
                    label: str = "label") -> DataFrame:
    """n, n_pos, roc_auc (mid-rank ties) and pr_auc (step sum over distinct scores); NULL with one class."""
    return metrics_of_counts(score_counts(rows, by, score, label), by)


def metrics_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`ranking_metrics` of a table with one row per distinct score: score, pos, n."""
    run = descending_totals(counts, by)
    pos, n, tp, flagged = (F.col(c).cast("double") for c in ("pos", "n", "tp", "flagged"))
    neg, fp = n - pos, flagged - tp
    # Negatives below a score are all negatives minus those at or above it; the totals come out last.
    got = run.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_pos"),
        F.sum(pos * (fp - neg / 2)).alias("_above"), F.sum(pos * tp / flagged).alias("_steps"))
    p, q = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    both = (p > 0) & (q > 0)
    return got.select(*by, "n", "n_pos", F.when(both, 1 - F.col("_above") / (p * q)).alias("roc_auc"),
                      F.when(both, F.col("_steps") / p).alias("pr_auc"))


def curve_points(rows: DataFrame) -> DataFrame:
    """One point per distinct score: recall, precision, false positive rate."""
    counts = score_counts(rows)
    total = counts.agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    run = descending_totals(counts).crossJoin(F.broadcast(total))
    return run.select("score", ratio(F.col("tp"), F.col("_p")).alias("recall"),
                      ratio(F.col("tp"), F.col("flagged")).alias("precision"),
                      ratio(F.col("flagged") - F.col("tp"), F.col("_n") - F.col("_p")).alias("fpr"))


def score_histogram(rows: DataFrame, bins: int = 50) -> DataFrame:
    """(label, bin, n, density) over [0, 1]."""
    per = rows.groupBy("label", bin_index(F.col("score"), 0, 1, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(F.col("label").alias("_l")).agg(F.sum("n").alias("_t"))
    return per.join(F.broadcast(total), F.col("label") == F.col("_l")).select(
        "label", "bin", "n", (F.col("n") * bins / F.col("_t")).alias("density"))


# ---- thresholds ----------------------------------------------------------------------------------

def _f1(tp: Column, flagged: Column, n_pos: Column) -> Column:
    return F.coalesce(ratio(2 * tp, flagged + n_pos), F.lit(0.0))


def best_threshold(rows: DataFrame) -> DataFrame:
    """One row: the score cut (>=) with the highest F1 over every distinct score; ties take the highest score."""
    counts = score_counts(rows)
    total = counts.agg(F.sum("pos").alias("_p"))
    run = descending_totals(counts).crossJoin(F.broadcast(total))
    f1 = _f1(F.col("tp"), F.col("flagged"), F.col("_p"))
    return run.agg(F.max(F.struct(f1.alias("f1"), F.col("score").alias("threshold"))).alias("b")).select("b.*")


def _at_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """tp, flagged, own counts at each given threshold; thresholds ride along as empty scores, so no cross join."""
    counts = score_counts(rows)
    marks = thresholds.select(F.col("threshold").alias("score"), F.lit(0).cast("bigint").alias("pos"),
                              F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("mark"))
    merged = counts.withColumn("mark", F.lit(0)).unionByName(marks).groupBy("score").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.max("mark").alias("mark"))
    total = counts.agg(F.sum("pos").alias("n_pos"))
    return descending_totals(merged).where("mark = 1").crossJoin(F.broadcast(total))


def best_quantile_threshold(rows: DataFrame, grid: int = 200) -> DataFrame:
    """One row: best F1 (>=) over `grid` evenly spaced score quantiles; ties take the lowest threshold."""
    probs = [i / (grid - 1) for i in range(grid)]
    quantiles = exact_quantiles(rows, ["score"], probs)
    cand = quantiles.select(F.round("value", 9).alias("threshold")).distinct()
    at = _at_thresholds(rows.withColumn("score", F.round("score", 9)), cand)
    f1 = _f1(F.col("tp"), F.col("flagged"), F.col("n_pos"))
    best = at.agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("t"), F.col("n_pos"))).alias("b"))
    return best.select(F.when(F.col("b.n_pos") > 0, -F.col("b.t")).otherwise(0.5).alias("threshold"),
                       F.when(F.col("b.n_pos") > 0, F.col("b.f1")).alias("f1"))


def grid_thresholds(rows: DataFrame, steps: int = 99) -> DataFrame:
    """precision, recall, F1 at every 0.01 step with a strict `>`; `best` marks the lowest best one. One aggregate of steps + 1 bins."""
    s = known_score("score")
    near = F.floor(s * 100)
    above = near + (s > (near + 1) / 100.0).cast("int") - (s <= near / 100.0).cast("int")        # the last step below the score
    bins = (rows.groupBy(F.least(F.greatest(F.coalesce(above, F.lit(0)), F.lit(0)), F.lit(steps)).cast("int").alias("step"))
            .agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")))
    grid = rows.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("step"))
    upward = Window.orderBy(F.desc("step"))                         # steps + 1 rows
    at = (grid.join(bins, "step", "left").fillna(0, ["pos", "n"])
          .select("step", F.sum("pos").over(upward).alias("tp"), F.sum("n").over(upward).alias("flagged"),
                  F.sum("pos").over(Window.partitionBy()).alias("n_pos")).where("step > 0"))
    tp, flagged = F.col("tp"), F.col("flagged")
    got = at.select((F.col("step") / 100.0).alias("threshold"),
                    F.coalesce(ratio(tp, flagged), F.lit(0.0)).alias("precision"),
                    F.coalesce(ratio(tp, F.col("n_pos")), F.lit(0.0)).alias("recall"),
                    _f1(tp, flagged, F.col("n_pos")).alias("f1"))
    place = F.row_number().over(Window.orderBy(F.col("f1").desc(), "threshold"))
    return got.withColumn("best", (place == 1).cast("int"))


# ---- top of the list -----------------------------------------------------------------------------

def precision_at_k(rows: DataFrame, ks: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """hits, precision, recall, best possible and lift in the top K. Only max(ks) rows are ordered."""
    key_cols = [F.col(k) for k in keys]
    order = [F.col("score").desc_nulls_last(), digest(*key_cols), *key_cols]
    top = rows.select(*keys, known_score("score").alias("score"), "label").orderBy(*order).limit(max(ks))
    place = F.row_number().over(Window.orderBy(*order))
    hits = top.withColumn("_r", place).agg(
        *[F.coalesce(F.sum(F.when(F.col("_r") <= k, F.col("label"))), F.lit(0)).cast("bigint").alias(str(k)) for k in ks])
    total = rows.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0)).alias("_p"))
    got = (hits.unpivot([], [str(k) for k in ks], "k", "hits").withColumn("k", F.col("k").cast("int"))
           .crossJoin(F.broadcast(total)))                          # one row
    k_eff = F.least(F.col("k").cast("bigint"), F.col("_n"))
    precision = ratio(F.col("hits"), k_eff)
    return got.select("k", k_eff.alias("k_effective"), "hits", precision.alias("precision"),
                      ratio(F.col("hits"), F.col("_p")).alias("recall"),
                      ratio(F.least(k_eff, F.col("_p")), k_eff).alias("best_possible"),
                      ratio(precision, ratio(F.col("_p"), F.col("_n"))).alias("lift"))


def precision_at_cuts(rows: DataFrame, keys: Sequence[str], fixed: Sequence[int] = (),
                      fractions: Sequence[float] = (), at_positives: bool = False) -> DataFrame:
    """The same at cuts that grow with the data: K values, shares of n, and n_pos; distinct K, ascending.

    Ranks come from `score_rank`, so a cut of billions of rows is never gathered.
    """
    total = rows.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0)).alias("_p"))
    ks = ([F.least(F.lit(k).cast("bigint"), F.col("_n")) for k in fixed]
          + [F.greatest(F.floor(F.col("_n") * F.lit(f)), F.lit(1).cast("bigint")) for f in fractions]
          + ([F.least(F.greatest(F.col("_p"), F.lit(1).cast("bigint")), F.col("_n"))] if at_positives else []))
    wanted = total.select("_n", "_p", F.array(*ks).alias("_ks"))
    ranked = score_rank(rows.select(*keys, "score", "label"), "score", [F.col(k) for k in keys])
    joined = ranked.crossJoin(F.broadcast(wanted))                  # one row
    slots = range(len(ks))
    hits = joined.groupBy("_n", "_p", "_ks").agg(*[
        F.sum(F.when(F.col("rank") <= F.col("_ks")[i], F.col("label")).otherwise(0)).cast("bigint").alias(f"_h{i}")
        for i in slots])
    long = hits.select("_n", "_p", F.explode(F.array_distinct(F.array(*[
        F.struct(F.col("_ks")[i].alias("k"), F.col(f"_h{i}").alias("hits")) for i in slots]))).alias("c")).select("_n", "_p", "c.*")
    precision = ratio(F.col("hits"), F.col("k"))
    return long.select("k", "hits", precision.alias("precision"), ratio(F.col("hits"), F.col("_p")).alias("recall"),
                       ratio(precision, ratio(F.col("_p"), F.col("_n"))).alias("lift"))


def drive_scores(rows: DataFrame, scores: Sequence[str] = ("score",), by: Sequence[str] = ("drive",)) -> DataFrame:
    """One row per drive: its highest window score and whether any window is positive."""
    return rows.groupBy(*by).agg(*[F.max(s).alias(s) for s in scores], F.max("label").alias("label"),
                                 F.count(F.lit(1)).alias("n_windows"))


def top_drives(drives: DataFrame, n: int = 100) -> DataFrame:
    order = [known_score("score").desc_nulls_last(), digest(F.col("drive")), F.col("drive")]
    top = drives.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))      # n rows


def ranking_quality(drives: DataFrame, ks: Sequence[int] = FILE_KS) -> DataFrame:
    """One row per usable K (K <= n, or n itself if none is): hits, precision; plus recall at n_pos and mean rank of failures.

    Empty when the truth holds one class only.
    """
    ranked = score_rank(drives.select("drive", "score", "label"), "score", [F.col("drive")])
    total = drives.agg(F.count(F.lit(1)).alias("n_drives"), F.sum(F.col("label").cast("bigint")).alias("n_failed"))
    rows = ranked.crossJoin(F.broadcast(total))                     # one row
    y, r = F.col("label").cast("bigint"), F.col("rank")
    got = rows.groupBy("n_drives", "n_failed").agg(
        *[F.sum(F.when(r <= k, y).otherwise(0)).alias(f"_k{k}") for k in ks],
        F.sum(F.when(r <= F.col("n_failed"), y).otherwise(0)).alias("_at_pos"),
        F.avg(F.when(y == 1, r.cast("double"))).alias("mean_rank_of_failures"))
    got = got.where((F.col("n_failed") > 0) & (F.col("n_failed") < F.col("n_drives")))
    listed = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"_k{k}").alias("hits")) for k in ks])
    usable = F.filter(listed, lambda c: c["k"] <= F.col("n_drives"))
    whole = F.array(F.struct(F.col("n_drives").alias("k"), F.col("n_failed").alias("hits")))
    return (got.select("*", F.explode(F.when(F.size(usable) > 0, usable).otherwise(whole)).alias("c"))
            .select("n_drives", "n_failed", "c.k", "c.hits", ratio(F.col("c.hits"), F.col("c.k")).alias("precision"),
                    ratio(F.col("_at_pos"), F.col("n_failed")).alias("recall_at_n_pos"), "mean_rank_of_failures"))


# ---- verdicts, families, two models --------------------------------------------------------------

def window_verdicts(rows: DataFrame, threshold: float) -> DataFrame:
    """Per window: risk, predicted and actual failure, whether they agree, and its place in the drive's record."""
    predicted = (F.col("score") >= threshold).cast("int")
    place = F.row_number().over(Window.partitionBy("drive").orderBy("start")) - 1
    return rows.select("drive", place.alias("window"), "start_day", "end_day", F.col("score").alias("risk"),
                       predicted.alias("predicted_fail"), F.col("label").alias("actual_fail"),
                       (predicted == F.col("label")).cast("int").alias("correct"))


def drive_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("drive").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("predicted_fail").alias("flagged"),
        F.max("actual_fail").alias("failed"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def drive_risk_histogram(verdicts: DataFrame, bins: int = 25) -> DataFrame:
    return verdicts.groupBy("drive", bin_index(F.col("risk"), 0, 1, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def family_breakdown(rows: DataFrame, threshold: float, family: str = "model") -> DataFrame:
    """Rows, drives, positives and metrics per family; metrics are NULL where a family has one class."""
    auc = ranking_metrics(rows, by=[family])
    at = confusion(rows, threshold, by=[family], strict=True).select(F.col(family).alias("_f"), "precision", "recall")
    drives = (rows.select(family, "drive").distinct().groupBy(F.col(family).alias("_g"))
              .agg(F.count(F.lit(1)).alias("drives")))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    # One row per family on every side.
    return (auc.join(at, F.col(family) == F.col("_f")).join(drives, F.col(family) == F.col("_g"))
            .select(family, "n", "drives", "n_pos", "roc_auc", "pr_auc",
                    F.when(both, F.col("precision")).alias("precision"),
                    F.when(both, F.col("recall")).alias("recall")))


def _mid_ranks(pairs: DataFrame, score: str) -> DataFrame:
    counts = pairs.groupBy(score).agg(F.sum("w").alias("n"))
    run = totals_in_order(counts, [F.col(score)], {"n": "upto"})
    return run.select(F.col(score).alias(f"_{score}"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r_{score}"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of mid-ranks. Rows are first counted per score pair, so ties cost one row."""
    pairs = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("w"))
    ra, rb = _mid_ranks(pairs, a), _mid_ranks(pairs, b)
    total = pairs.agg(F.sum("w").cast("double").alias("_n"))
    j = (pairs.join(ra, F.col(a) == F.col(f"_{a}")).join(rb, F.col(b) == F.col(f"_{b}"))
         .crossJoin(F.broadcast(total)))                            # one row
    # Ranks around 0 and of size 1, so the sums keep their digits at any row count.
    x = (F.col(f"r_{a}") - (F.col("_n") + 1) / 2) / F.col("_n")
    y = (F.col(f"r_{b}") - (F.col("_n") + 1) / 2) / F.col("_n")
    w = F.col("w").cast("double")
    s = j.agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    return s.select(ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"))


def agreement(rows: DataFrame, threshold_a: float, threshold_b: float, a: str = "score", b: str = "score_b") -> DataFrame:
    """One row: drives both models flag, only the first, only the second, and Spearman when n > 2."""
    fa, fb = F.col(a) >= threshold_a, F.col(b) >= threshold_b

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("bigint"))

    counts = rows.agg(F.count(F.lit(1)).alias("n"), n(fa & fb).alias("both"), n(fa & ~fb).alias("only_first"),
                      n(~fa & fb).alias("only_second"))
    return counts.crossJoin(F.broadcast(spearman(rows, a, b))).withColumn(
        "spearman", F.when(F.col("n") > 2, F.col("spearman")))


def alignment(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("drive", "start")) -> DataFrame:
    """One row: windows of one score set missing in the other, and label disagreements. All must be 0."""
    left = a.select(*keys, F.col("label").alias("_la"))
    right = b.select(*keys, F.col("label").alias("_lb"))
    j = left.join(right, list(keys), "full_outer")
    one = F.lit(1)
    return j.agg(F.count(one).alias("windows"), F.count(F.when(F.col("_lb").isNull(), one)).alias("only_first"),
                 F.count(F.when(F.col("_la").isNull(), one)).alias("only_second"),
                 F.count(F.when(F.col("_la") != F.col("_lb"), one)).alias("label_mismatch"))


# ---- lead time, remaining life, rates ------------------------------------------------------------

def lead_time_curve(rows: DataFrame) -> DataFrame:
    """Per lead (days before failure): mean score and flag rate of each model."""
    return rows.groupBy("lead").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("score_b").alias("mean_score_b"),
        F.avg(F.col("flag").cast("double")).alias("flag_rate"),
        F.avg(F.col("flag_b").cast("double")).alias("flag_rate_b"))


def lead_time_shares(rows: DataFrame, horizon: int = 30, week: int = 7) -> DataFrame:
    """One row: share of failing drives flagged inside the horizon, and a week or more ahead."""
    early = F.col("lead") < horizon
    flag, flag_b = F.col("flag") == 1, F.col("flag_b") == 1
    per = rows.groupBy("drive").agg(F.max((early & flag).cast("int")).alias("a"),
                                    F.max((early & flag_b).cast("int")).alias("b"),
                                    F.max((early & flag & (F.col("lead") >= week)).cast("int")).alias("w"))
    return per.agg(F.count(F.lit(1)).alias("drives"), F.avg(F.col("a").cast("double")).alias("flagged_in_horizon"),
                   F.avg(F.col("b").cast("double")).alias("flagged_in_horizon_b"),
                   F.avg(F.col("w").cast("double")).alias("flagged_week_ahead"))


def regression_metrics(rows: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """One row: MAE, RMSE, R2, and the MAE of always answering the mean."""
    mean = rows.agg(F.avg(y).alias("_m"))                           # one row
    r = rows.crossJoin(F.broadcast(mean))
    e, d = F.col(y) - F.col(prediction), F.col(y) - F.col("_m")
    got = r.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                F.sum(e * e).alias("_sse"), F.sum(d * d).alias("_sst"), F.avg(F.abs(d)).alias("baseline_mae"))
    return got.select("n", "mae", "rmse", (1 - ratio(F.col("_sse"), F.col("_sst"))).alias("r2"), "baseline_mae")


def annual_failure_rate(drives: DataFrame) -> DataFrame:
    """One row from a census: failures, drive-years, failures per drive-year."""
    got = drives.agg(F.sum("has_failure").alias("failures"), (F.sum("n_days") / F.lit(365.25)).alias("drive_years"))
    return got.withColumn("annual_failure_rate", ratio(F.col("failures"), F.col("drive_years")))


def risk_tone(score: Column, threshold: float) -> Column:
    """risk / warn / ok."""
    return (F.when(score >= max(0.5, threshold), "risk").when(score >= threshold, "warn").otherwise("ok"))
