"""Retrieval metrics and paired statistics over runs (qid, id, rank) and labels (qid, id, grade)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import checkpointed


STRETCHES = 256


def clean_labels(labels: DataFrame) -> DataFrame:
    """One row per (qid, id), with the highest grade."""
    return labels.groupBy("qid", "id").agg(F.max("grade").alias("grade"))


def per_query(runs: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Metrics at ``k`` of each query: recall, reciprocal rank, hit rate, precision, average precision, nDCG.

    A document is relevant from grade 1. Repeated ids of a run count once, at their best rank.
    Precision divides by ``k``, average precision by the number of relevant documents; a query
    without relevant documents has zeros.
    """
    y = clean_labels(labels)
    gold = y.filter("grade >= 1")
    n_gold = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    best = Window.partitionBy("qid").orderBy(F.desc("grade"), "id")
    ideal = y.filter("grade > 0").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / (F.log(F.col(r) + F.lit(1.0)) / math.log(2))
    ideal = ideal.groupBy("qid").agg(F.sum(gain(F.col("grade"), "r")).alias("idcg"))
    once = runs.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    j = once.join(y, ["qid", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("rel", (F.col("grade") >= 1).cast("int")).withColumn("found", F.sum("rel").over(upto))
    at_k = F.col("rank") <= k
    m = j.groupBy("qid").agg(
        F.sum(F.when(at_k, F.col("rel")).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("rel") == 1, F.col("found") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(at_k, gain(F.col("grade"), "rank")).otherwise(0.0)).alias("dcg"),
    )
    j = queries.select("qid").join(m, "qid", "left").join(n_gold, "qid", "left").join(ideal, "qid", "left")
    has = F.col("n_gold").isNotNull()
    or_zero = lambda c: F.round(F.coalesce(F.when(has, c), F.lit(0.0)), 9)
    return j.select(
        "qid",
        or_zero(F.col("hits") / F.col("n_gold")).alias("recall"),
        or_zero(F.lit(1.0) / F.col("first_rank")).alias("reciprocal_rank"),
        or_zero((F.col("hits") > 0).cast("double")).alias("hit_rate"),
        or_zero(F.col("hits") / F.lit(float(k))).alias("precision"),
        or_zero(F.col("ap_sum") / F.col("n_gold")).alias("average_precision"),
        or_zero(F.try_divide("dcg", "idcg")).alias("ndcg"),
    )


METRICS = ("recall", "reciprocal_rank", "hit_rate", "precision", "average_precision", "ndcg")


def means(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean of each metric, over all or by group; an empty table gives zeros."""
    g = metrics.groupBy(*by) if by else metrics.groupBy()
    return g.agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(c) for c in METRICS))


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, 95th percentile, mean, least and largest value by group, interpolated."""
    return df.groupBy(*by).agg(
        F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def rank_auc(df: DataFrame, value: str, positive: str, *by: str) -> DataFrame:
    """Chance that a positive's value is above a negative's, ties half, from rank sums: no pairs are made.

    Values are counted first, so a value that many rows share is one row. They are then numbered within
    stretches of about equal size, whose own sums are a short list, so no task holds all values.
    """
    ends = sorted(set(df.approxQuantile(value, [i / STRETCHES for i in range(1, STRETCHES)], 1 / (4 * STRETCHES))))
    v = df.groupBy(*by, value).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    v = v.withColumn("stretch", F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<double>"), lambda e: e < F.col(value))))
    sums = v.groupBy(*by, "stretch").agg(F.sum("n").alias("s"))
    before = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("earlier"))
    below = Window.partitionBy(*by, "stretch").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("inside", F.coalesce(F.sum("n").over(below), F.lit(0))).join(sums, [*by, "stretch"])
    v = v.withColumn("below", F.col("earlier") + F.col("inside"))
    g = v.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("n") * 0.5)).alias("s")
    )
    return g.select(*by, "n_pos", "n_neg", F.try_divide(F.col("s"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def threshold_sweep(df: DataFrame, value: str, group: str, taus: list[float]) -> DataFrame:
    """Share of each group at or above each threshold."""
    rows = df.select(group, value, F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    return rows.groupBy(group, "tau").agg(F.count("*").alias("n"), F.avg((F.col(value) >= F.col("tau")).cast("double")).alias("accept_rate"))


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """One row: wins, losses, ties and mean difference of two per-query results."""
    j = a.select("qid", F.col(metric).alias("a")).join(b.select("qid", F.col(metric).alias("b")), "qid")
    d = F.round(F.col("a") - F.col("b"), 9)
    return j.select(d.alias("d")).agg(
        F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"),
        F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 9).alias("mean_diff"),
    )


# Poisson weights of mean 1 by inverse distribution: a uniform number counts the sums it reaches.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(10))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact p of the sign test; ties are left out."""
    m, least = wins + losses, min(wins, losses)
    log = lambda i: math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - m * math.log(2)
    return min(1.0, 2 * sum(math.exp(log(i)) for i in range(least + 1))) if m else 1.0


@F.pandas_udf(T.DoubleType())
def _sign_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    return pd.Series([sign_test(int(w), int(x)) for w, x in zip(wins, losses)], dtype="float64")


def resampled(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = METRICS, resamples: int = 1000) -> DataFrame:
    """Per metric, the mean difference of two results with its 95 % interval, sign test and permutation test.

    Each query's weight in a resample (Poisson, mean 1) and its sign in a permutation come from a hash of
    both, so any number of tasks draws the same, and nothing is collected. Differences are rounded to 9 digits.
    Without any query the result is empty.
    """
    j = a.select("qid", *(F.col(m).alias(f"a_{m}") for m in metrics)).join(b.select("qid", *(F.col(m).alias(f"b_{m}") for m in metrics)), "qid")
    j = checkpointed(j.select("qid", *(F.round(F.col(f"a_{m}") - F.col(f"b_{m}"), 9).alias(m) for m in metrics)))
    draw = j.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("h", F.md5(F.concat_ws(":", "qid", "r")))
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32
    w = F.aggregate(F.array(*map(F.lit, POISSON)), F.lit(0), lambda n, x: n + (u >= x).cast("int"))
    sign = F.when(F.substring("h", 9, 1) >= "8", 1.0).otherwise(-1.0)
    draw = draw.select("r", w.alias("w"), sign.alias("s"), *metrics)
    sums = draw.groupBy("r").agg(
        F.sum("w").alias("w"), F.count("*").alias("n"), *(F.sum(F.col("w") * F.col(m)).alias(f"w_{m}") for m in metrics), *(F.sum(F.col("s") * F.col(m)).alias(f"s_{m}") for m in metrics)
    )
    by = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.try_divide(f"w_{m}", "w").alias("mean"), (F.col(f"s_{m}") / F.col("n")).alias("flipped")) for m in metrics)))
    sums = sums.select(by.alias("x")).select("x.*")
    seen = j.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("d")) for m in metrics))).alias("x")).groupBy("x.metric").agg(
        F.count("*").alias("n"), F.avg("x.d").alias("seen"), F.count_if(F.col("x.d") > 0).alias("wins"), F.count_if(F.col("x.d") < 0).alias("losses")
    )
    k = sums.join(F.broadcast(seen), "metric").groupBy("metric", "n", "seen", "wins", "losses").agg(  # one row a metric
        F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"), F.count_if(F.abs("flipped") >= F.abs("seen") - 1e-12).alias("hits")
    )
    r9 = lambda c: F.round(c, 9)
    return k.select(
        "metric", "n", r9(F.col("seen")).alias("mean_diff"), r9(F.col("lo")).alias("lo"), r9(F.col("hi")).alias("hi"),
        r9(_sign_p("wins", "losses")).alias("sign_p"), r9((F.col("hits") + 1) / (resamples + 1)).alias("permutation_p"),
    )
