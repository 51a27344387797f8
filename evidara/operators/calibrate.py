"""Calibration and evaluation: floors, beta fits, gap bars, AUROC, query performance predictors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.columns import let


def beta_fit(scores: DataFrame, by: str, score: str) -> DataFrame:
    """(by, floor, beta_a, beta_b): the mean, and a beta distribution by moments; (1, 1) where there are under two scores or no spread."""
    m, v, n = F.col("m"), F.col("v"), F.col("n")
    common = m * (1 - m) / v - 1
    fine = (n >= 2) & (v > 0) & (m > 0) & (m < 1) & (common > 0)
    rows = scores.groupBy(by).agg(F.avg(score).alias("m"), F.var_pop(score).alias("v"), F.count(score).alias("n"))
    return rows.select(by, m.alias("floor"), F.when(fine, m * common).otherwise(1.0).alias("beta_a"), F.when(fine, (1 - m) * common).otherwise(1.0).alias("beta_b"))


#: Levels of the continued fraction, evaluated from the innermost out; it converges within some ten times the root of the parameters.
LEVELS = 600


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of whole arrays; 0 below 0, 1 above 1, the identity for a = b = 1."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    # each side of the mean has its own fraction, of which the other side's is the complement
    turned = inside > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - inside, inside)
    logs = {v: math.lgamma(v) for v in np.unique(np.concatenate([p.ravel(), q.ravel(), (p + q).ravel()]))}
    gamma = np.vectorize(logs.__getitem__, otypes=[float])
    fraction = np.ones_like(y)
    for n in range(LEVELS, 0, -1):
        m = n // 2
        step = m * (q - m) / ((p + n - 1) * (p + n)) if n % 2 == 0 else -(p + m) * (p + q + m) / ((p + n - 1) * (p + n))
        fraction = 1 + step * y / fraction
    front = np.exp(p * np.log(y) + q * np.log1p(-y) + gamma(p + q) - gamma(p) - gamma(q)) / p if y.size else y
    value = front / fraction
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(turned, 1 - value, value)))


def beta_cdfs(a: Column | str, b: Column | str, x: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna() & x.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = beta_cdf(a.to_numpy(float)[known], b.to_numpy(float)[known], x.to_numpy(float)[known])
        return pd.Series(out).where(known, None)

    return run(a, b, x)


def absolute_values(score: Column | str, beta_a: Column | str, beta_b: Column | str, penalty: float = 0.18) -> Column:
    """What a reranker's score is worth on its own: spread by its fitted curve, less what text that says nothing costs."""
    return beta_cdfs(beta_a, beta_b, score) - penalty


def gap_bars(labelled: DataFrame, least: int = 10, mixed: float = 0.15) -> DataFrame:
    """(profile, weak_match, answered_match): the band in which answered and unanswered best cosines mix.

    labelled(profile, best_similarity, answered). The band runs from the least answered to the greatest unanswered value, rounded outward to
    thousandths; where more than `mixed` of the answered lie in it, only its lower end is kept. Profiles with fewer than `least` of either have none.
    """
    best, yes = F.col("best_similarity").cast("double"), F.col("answered")
    ends = labelled.where(yes.isNotNull()).groupBy("profile").agg(
        F.min(F.when(yes, best)).alias("lo"), F.max(F.when(~yes, best)).alias("hi"), F.sum(yes.cast("int")).alias("yes"), F.sum((~yes).cast("int")).alias("no")
    )
    ends = ends.where((F.col("yes") >= least) & (F.col("no") >= least)).select("profile", "yes", (F.floor(F.round(F.col("lo") * 1000, 6)) / 1000).alias("low"), (F.ceil(F.round(F.col("hi") * 1000, 6)) / 1000).alias("top"))
    inside = labelled.join(ends, "profile").where(yes & (best >= F.col("low")) & (best < F.col("top"))).groupBy("profile").agg(F.count("*").alias("inside"))
    rows = ends.join(inside, "profile", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    keep = (F.col("inside") <= mixed * F.col("yes")) & (F.col("top") > F.col("low"))
    return rows.select("profile", F.col("low").alias("weak_match"), F.when(keep, F.col("top")).alias("answered_match"))


def auroc(rows: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """(by, auroc): the chance that a positive row scores above a negative one, ties one half; from average ranks of distinct scores.

    Scores are counted before they are ranked, so that a group's window is over its distinct scores.
    """
    counted = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(by, score).agg(F.sum(F.col(label).cast("int")).alias("p"), F.sum((~F.col(label)).cast("int")).alias("n"))
    w = Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = counted.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    wins = below.groupBy(by).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return wins.select(by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n"))).alias("auroc"))


def predictors(questions: DataFrame, similarities: str) -> DataFrame:
    """questions with what predicts their performance: the best similarity, the lead over the second, the spread of ten, the mean of five."""
    s = F.sort_array(F.transform(similarities, lambda x: x.cast("double")), asc=False)
    ten, five = F.slice(s, 1, 10), F.slice(s, 1, 5)

    def mean(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.when(F.size(x) > 0, F.size(x))

    rows = questions.withColumns({"_ten": ten, "_five": five})
    spread = let(mean(F.col("_ten")), lambda m: F.sqrt(mean(F.transform("_ten", lambda x: (x - m) * (x - m)))))
    return rows.withColumns({"best": F.try_element_at("_ten", F.lit(1)), "lead": F.try_element_at("_ten", F.lit(1)) - F.try_element_at("_ten", F.lit(2)), "spread": spread, "mean_five": mean(F.col("_five"))}).drop("_ten", "_five")


def sampled_candidates(ranked: DataFrame, first: int = 10, last: int = 29) -> DataFrame:
    """Rows of a middle stretch of each ranking, counted from 0, as candidates for calibration."""
    return ranked.where((F.col("rank") - 1).between(first, last))
