"""A tree of activities: loading, ancestors, candidates for a text, merged and ranked selections.

The taxonomy is a dimension; it is broadcast only while it has at most MAX_BROADCAST nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finstrata.functions.text import content_tokens, content_words
from finstrata.runtime import cut

MAX_BROADCAST = 100_000
#: From this ratio of matching blocks on, a node is a candidate without a token in common.
LEAST_RATIO = 0.45
LEVEL_BONUS = {"section": 0.00, "division": 0.03, "group": 0.05, "class": 0.07}


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_paths(nodes: DataFrame) -> DataFrame:
    """The nodes with their paths as arrays; rows of unknown levels or without a code dropped."""
    split = lambda c: F.transform(F.split(c, r"\|"), F.trim)
    return nodes.where(F.col("level").isin(*LEVEL_BONUS) & (F.trim("node_code") != "")).withColumns({"path_codes": split(F.col("hierarchy_path_codes")), "path_names": split(F.col("hierarchy_path_names"))})


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent isn't in the table."""
    return nodes.where(F.col("parent_key").isNotNull()).join(nodes.select(F.col("node_key").alias("parent_key")), "parent_key", "left_anti")


def lookup_with_ancestor(codes: DataFrame, nodes: DataFrame, code: str) -> DataFrame:
    """codes with node_name of the code itself, else of its division (the first two digits); resolved says which."""
    n = small(nodes.select(F.col("node_code").alias("_c"), F.col("node_name").alias("_n")))
    own = codes.join(n, codes[code] == F.col("_c"), "left").drop("_c").withColumnRenamed("_n", "own_name")
    division = F.regexp_extract(F.coalesce(F.col(code), F.lit("")), r"^(\d{2})", 1)
    both = own.withColumn("_d", division).join(n, F.col("_d") == F.col("_c"), "left").drop("_c", "_d").withColumnRenamed("_n", "division_name")
    return both.select(*codes.columns, F.coalesce("own_name", "division_name").alias("node_name"), F.when(F.col("own_name").isNotNull(), "code").when(F.col("division_name").isNotNull(), "division").otherwise("none").alias("resolved"))


def candidates(items: DataFrame, nodes: DataFrame, item_id: str, name: str, context: str, k: int = 30, fuzzy: bool = False) -> DataFrame:
    """item_id, node_code, score, rank: nodes that share a token with a text, scored by shares of tokens, best k.

    52 % the share of the text's tokens that the node's path has, 28 % the share of the label's tokens that the name has,
    30 points for an equal label, 12 for one that contains the name, and a bonus for depth. The items meet the nodes on
    tokens, never all with all. fuzzy: 20 % the ratio of matching blocks of name and label besides; nodes without a shared token
    are candidates if that is at least LEAST_RATIO or their label contains the name. Each distinct name is then compared with every label.
    """
    i = items.select(F.col(item_id).alias("item"), content_tokens(F.coalesce(name, F.lit(""))).alias("nt"), content_tokens(F.concat_ws(" ", name, context)).alias("qt"))
    n = with_paths(nodes).select("node_code", "level", "level_depth", "source_row_number", content_tokens(F.col("node_name")).alias("lt"), content_tokens(F.concat_ws(" ", F.array_join("path_names", " "), "node_name")).alias("pt"))
    shared = i.select("item", "nt", "qt", F.explode("qt").alias("token")).join(small(n.select("node_code", F.explode("pt").alias("token"))), "token").groupBy("item", "node_code").agg(F.count(F.lit(1)).alias("overlap"))
    if fuzzy:
        @F.pandas_udf("double")
        def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

        text = lambda c: F.array_join(content_words(F.coalesce(c, F.lit(""))), " ")
        named = items.select(F.col(item_id).alias("item"), text(F.col(name)).alias("nw"))
        ratios = cut(named.select("nw").distinct().crossJoin(small(with_paths(nodes).select("node_code", text(F.col("node_name")).alias("lw")))).select("nw", "node_code", "lw", block_ratio("nw", "lw").alias("fuzzy")))
        close = ratios.where((F.col("fuzzy") >= LEAST_RATIO) | ((F.col("nw") != "") & F.contains("lw", "nw"))).select("nw", "node_code")
        shared = shared.unionByName(named.join(close, "nw").select("item", "node_code", F.lit(0).cast("long").alias("overlap"))).groupBy("item", "node_code").agg(F.max("overlap").alias("overlap"))
        shared = shared.join(named, "item").join(ratios, ["nw", "node_code"])
    joined = shared.join(i, "item").join(small(n), "node_code")
    norm = lambda c: F.array_join(c, " ")
    exact = norm(F.col("nt")) == norm(F.col("lt"))
    inside = (F.size("nt") > 0) & F.contains(norm(F.col("lt")), norm(F.col("nt")))
    if fuzzy:  # with repeated words
        exact, inside = F.col("nw") == F.col("lw"), (F.col("nw") != "") & F.contains("lw", "nw")
    d = lambda c: c.cast("decimal(12,8)")
    ratio = lambda a, b: d(a / F.greatest(b, F.lit(1)))
    bonus = F.lit(0.0)
    for level, x in LEVEL_BONUS.items():
        bonus = F.when(F.col("level") == level, F.lit(x)).otherwise(bonus)
    score = ratio(F.col("overlap"), F.size("qt")) * F.lit(0.52).cast("decimal(4,2)") + ratio(F.size(F.array_intersect("nt", "lt")), F.size("lt")) * F.lit(0.28).cast("decimal(4,2)") + d(F.when(exact, 0.30).when(inside, 0.12).otherwise(0.0)) + d(bonus)
    if fuzzy:
        score = score + d(F.col("fuzzy")) * F.lit(0.20).cast("decimal(4,2)")
    scored = joined.select("item", "node_code", F.round(F.least(score, F.lit(1).cast("decimal(12,8)")), 4).cast("decimal(6,4)").alias("score"), "level_depth", "source_row_number")
    w = W.partitionBy("item").orderBy(F.desc("score"), F.desc("level_depth"), "source_row_number")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("item").alias(item_id), "node_code", "score", "rank")


def merge_candidates(found: DataFrame, hinted: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Both lists in one, the better score of a key kept; a hint wins a tie."""
    both = hinted.select(*keys, score, F.lit(1).alias("hint")).unionByName(found.select(*keys, score, F.lit(0).alias("hint")))
    return both.groupBy(*keys).agg(F.max(F.struct(score, "hint")).alias("b")).select(*keys, f"b.{score}", (F.col("b.hint") == 1).alias("hinted"))


def ranked_backfill(chosen: DataFrame, found: DataFrame, item: str, code: str, rank: str, k: int = 5) -> DataFrame:
    """The chosen codes in their order, filled up to k from the found ones that aren't chosen."""
    both = chosen.select(item, code, rank, F.lit(0).alias("src")).unionByName(found.select(item, code, rank, F.lit(1).alias("src")))
    once = both.groupBy(item, code).agg(F.min(F.struct("src", rank)).alias("b"))
    return once.withColumn("position", F.row_number().over(W.partitionBy(item).orderBy("b.src", f"b.{rank}", code))).where(F.col("position") <= k).select(item, code, "position", F.when(F.col("b.src") == 0, "chosen").otherwise("backfill").alias("origin"))
