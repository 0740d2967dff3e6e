"""Weighted scores, weights and representatives of clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_average(df: DataFrame, key: str, score: Column, weight: Column) -> DataFrame:
    """key, weighted_score, total_weight, n_weighted over positive weights; null where there are none."""
    w = weight.cast("decimal(20,6)")
    s = score.cast("decimal(10,4)")
    ok = (w > 0) & s.isNotNull()
    top = F.sum(F.when(ok, s * w)).cast("double")
    base = F.sum(F.when(ok, w)).cast("double")
    return df.groupBy(key).agg(F.round(top / F.nullif(base, F.lit(0.0)), 6).alias("weighted_score"), F.round(base, 4).alias("total_weight"), F.count_if(ok).alias("n_weighted"))


def weight_share(df: DataFrame, key: str, value: Column, name: str = "share") -> DataFrame:
    """Each row's part of its group's sum of positive values; null where value or sum isn't positive."""
    v = F.when(value > 0, value.cast("decimal(20,6)"))
    total = F.sum(v).over(W.partitionBy(key))
    return df.withColumn(name, F.round(v.cast("double") / F.nullif(total, F.lit(0).cast("decimal(30,6)")).cast("double"), 6))


def cascade(keys: Sequence[tuple[str, Column, Mapping[str, float]]], default: float) -> Column:
    """struct(score, source): the first map that has its key decides, else the default."""
    value, source = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, key, scores in reversed(keys):
        table = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
        hit = F.try_element_at(table, key)
        value, source = F.coalesce(hit.cast("double"), value), F.when(hit.isNotNull(), F.lit(name)).otherwise(source)
    return F.struct(F.coalesce(value, F.lit(default)).alias("score"), F.coalesce(source, F.lit("default")).alias("source"))


def limited_by_confidence(effect: Column, confidence: Column, severe: Column | None = None, worst: float = 1.0) -> Column:
    """An effect held within what its confidence allows: 0.1 below 0.5, 0.25 below 0.8, else 0.5; a sure and severe harm up to `worst`. No confidence counts as 0.5; no effect stays none."""
    c = F.coalesce(confidence, F.lit(0.5))
    limit = F.when(c < 0.5, 0.1).when(c < 0.8, 0.25).otherwise(0.5)
    if severe is not None:
        limit = F.when((effect > 0) & F.coalesce(severe, F.lit(False)) & (c >= 0.8), worst).otherwise(limit)
    return F.when(effect.isNotNull(), F.round(F.greatest(F.least(effect, limit), -limit), 6))


def clustered_sum(df: DataFrame, key: str, cluster: str, effect: Column, tie: Sequence[str], low: float, high: float) -> DataFrame:
    """key, total, n_clusters: the strongest effect of each cluster, added up and held within [low, high]."""
    e = effect.cast("decimal(12,6)")
    best = df.groupBy(key, cluster).agg(F.max_by(e, F.struct(F.abs(e), *tie)).alias("e"))
    return best.groupBy(key).agg(F.greatest(F.lit(low).cast("decimal(12,6)"), F.least(F.lit(high).cast("decimal(12,6)"), F.sum("e").cast("decimal(12,6)"))).alias("total"), F.count(F.lit(1)).alias("n_clusters"))


def mode_alphabetical(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each group; of equally common ones the first in the alphabet."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v")))["v"].alias("mode"))


def state_rollup(df: DataFrame, key: str, done: Column) -> DataFrame:
    """Counts and the share of what is done; a group of nothing is complete."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(done).alias("n_done"), F.bool_and(F.coalesce(done, F.lit(False))).alias("all_done"), F.round(F.count_if(done) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("share_done"))
