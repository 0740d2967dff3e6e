"""Predictions against labelled rows: pair scores, greedy one-to-one matching, metrics, failures.

Pairs are formed within a document only, and folded over indices and scores, never over whole rows. A row
without a document matches nothing and counts as missing or extra.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finstrata.functions.text import alnum_words
from finstrata.runtime import cut


def singular(words: Column) -> Column:
    """Words without a plural s (not of words that end in ss)."""
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & w.rlike("[^s]s$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def token_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.84 if the words of one are among the other's, else the share of the longer that both have."""
    na, nb = alnum_words(a), alnum_words(b)
    ta, tb = F.array_distinct(singular(F.split(na, " "))), F.array_distinct(singular(F.split(nb, " ")))
    both = F.size(F.array_intersect(ta, tb))
    share = both / F.greatest(F.size(ta), F.size(tb))
    return (
        F.when((na == "") | (nb == ""), 0.0).when(na == nb, 1.0).when((both == F.size(ta)) | (both == F.size(tb)), F.greatest(F.lit(0.84), share)).otherwise(share)
    ).cast("decimal(8,6)")


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """token_similarity, or the ratio of matching blocks where that is more. Python, by Arrow batches: filter pairs first."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)], dtype="float64")

    return F.greatest(token_similarity(a, b).cast("double"), ratio(alnum_words(a), alnum_words(b)))


def may_be_similar(a: Column, b: Column, least: float) -> Column:
    """Whether fuzzy_similarity, rounded to 4 places, can reach `least`: by words, or by the ratio that lengths allow. Names that are null or without letters can't."""
    na, nb = alnum_words(a), alnum_words(b)
    la, lb = F.length(na), F.length(nb)
    return (na != "") & (nb != "") & ((token_similarity(a, b) >= least - 5.1e-5) | (2 * F.least(la, lb) >= (least - 5.1e-5) * (la + lb)))


def candidate_pairs(gold: DataFrame, predicted: DataFrame, key: str, similarity: Column, value_ok: Column, period_ok: Column, page_ok: Column, floor: float = 0.68, least: float = 0.62) -> DataFrame:
    """gold_id, pred_id, key, similarity and score of pairs of one document that may match.

    score: 55 % similarity, 25 % value, 15 % period, 5 % page (half if unknown).
    """
    as_part = lambda c: F.when(c.isNull(), 0.5).when(c, 1.0).otherwise(0.0).cast("decimal(4,2)")
    joined = gold.join(predicted, key)
    score = similarity * F.lit(0.55).cast("decimal(4,2)") + F.when(value_ok, 0.25).otherwise(0.0).cast("decimal(4,2)") + F.when(period_ok, 0.15).otherwise(0.0).cast("decimal(4,2)") + as_part(page_ok) * F.lit(0.05).cast("decimal(4,2)")
    scored = joined.select(key, "gold_id", "pred_id", similarity.alias("similarity"), F.round(score, 6).cast("decimal(10,6)").alias("score"), F.coalesce(value_ok, F.lit(False)).alias("value_ok"), F.coalesce(period_ok, F.lit(False)).alias("period_ok"), page_ok.alias("page_ok"))
    return scored.where((F.col("similarity") >= floor) & (F.col("score") >= least))


def greedy_matches(pairs: DataFrame, key: str) -> DataFrame:
    """The pairs kept when the best score goes first and no row is used twice; ties by gold, then predicted id.

    In rounds: a pair that is the best of both its rows is kept, whatever else is; its rows' other pairs go. No document is ever
    gathered in one place.
    """
    order = F.struct((-F.col("score")).alias("s"), "gold_id", "pred_id")
    left, kept = cut(pairs), None
    while not left.isEmpty():
        ranked = left.withColumns({"_g": F.min(order).over(W.partitionBy(key, "gold_id")), "_p": F.min(order).over(W.partitionBy(key, "pred_id"))})
        best = cut(ranked.where((F.col("_g") == F.col("_p")) & (F.col("_g.gold_id") == F.col("gold_id")) & (F.col("_g.pred_id") == F.col("pred_id"))).drop("_g", "_p"))
        kept = best if kept is None else kept.unionByName(best)
        left = cut(left.join(best.select(key, "gold_id"), [key, "gold_id"], "left_anti").join(best.select(key, "pred_id"), [key, "pred_id"], "left_anti").select(*pairs.columns))
    return (left if kept is None else kept).select(key, "gold_id", "pred_id", *[c for c in pairs.columns if c not in (key, "gold_id", "pred_id")])


def outcomes(gold: DataFrame, predicted: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """key, gold_id, pred_id, failure: every gold row once, and every predicted row that no gold row has."""
    matched = matches.select("gold_id", "pred_id", F.when(~F.col("value_ok"), "wrong_value").when(~F.col("period_ok"), "wrong_period").otherwise("none").alias("failure"))
    on_gold = gold.select(key, "gold_id").join(matched, "gold_id", "left").select(key, "gold_id", "pred_id", F.coalesce("failure", F.lit("missing_segment")).alias("failure"))
    extra = predicted.select(key, "pred_id").join(matches.select("pred_id"), "pred_id", "left_anti").select(key, F.lit(None).cast("string").alias("gold_id"), "pred_id", F.lit("extra_segment").alias("failure"))
    return on_gold.unionByName(extra)


def metrics(results: DataFrame) -> DataFrame:
    """One row: precision, recall, F1 and counts; 0 where a denominator is 0."""
    counted = results.agg(F.count_if(F.col("failure") == "none").alias("correct"), F.count("pred_id").alias("n_predicted"), F.count("gold_id").alias("n_gold"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("correct"), F.col("n_predicted")), ratio(F.col("correct"), F.col("n_gold"))
    f1 = ratio(2 * F.col("correct"), F.col("n_predicted") + F.col("n_gold"))
    return counted.select("correct", "n_predicted", "n_gold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def quality(matches: DataFrame, predicted: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of what P, R and F1 don't say.

    matches: value_ok, page_ok, has_value of matched pairs. predicted: edited. documents: reconciled, issues, seconds, each null where unknown.
    Accuracies count the pairs that can be checked; rates are 0 where nothing can, seconds are null.
    """
    share = lambda hit, all_: F.round(F.coalesce(F.try_divide(F.count_if(hit), F.count_if(all_)), F.lit(0.0)), 6)
    m = matches.agg(F.count(F.lit(1)).alias("n_matched"), share(F.col("value_ok") & F.col("has_value"), F.col("has_value")).alias("value_accuracy"), share(F.col("page_ok"), F.col("page_ok").isNotNull()).alias("page_accuracy"))
    p = predicted.agg(share(F.col("edited"), F.lit(True)).alias("edit_rate"))
    d = documents.agg(share(F.col("reconciled"), F.col("reconciled").isNotNull()).alias("reconciliation_pass_rate"), F.round(F.coalesce(F.avg("issues"), F.lit(0.0)), 6).alias("issues_per_document"), F.round(F.avg("seconds"), 3).alias("seconds_per_document"))
    return m.join(p).join(d)  # three tables of one row each


def failure_examples(results: DataFrame, most: int = 5) -> DataFrame:
    """failure, n, and the first `most` ids of each failure."""
    some = results.where(F.col("failure") != "none").withColumn("example", F.coalesce("gold_id", "pred_id"))
    counts = some.groupBy("failure").agg(F.count(F.lit(1)).alias("n"))
    first = some.withColumn("k", F.row_number().over(W.partitionBy("failure").orderBy("example"))).where(F.col("k") <= most)
    return first.groupBy("failure").agg(F.array_join(F.array_sort(F.collect_list("example")), " | ").alias("examples")).join(counts, "failure")
