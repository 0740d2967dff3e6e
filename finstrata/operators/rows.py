"""Operators over rows of a document: which rows to keep, in what groups, in what order.

Every order ends in a unique key, so results don't depend on partitioning. Null keys form a group of
their own unless stated otherwise; empty tables give empty results; columns not named pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `order`. A single aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the least `order`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in an order, numbered from 1. Spark prunes to k a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def keep_latest_year(df: DataFrame, key: str, year: str) -> DataFrame:
    """Drops rows of earlier years where a group has two years or more; rows without a year stay."""
    w = W.partitionBy(key)
    return (
        df.withColumns({"_last": F.max(year).over(w), "_first": F.min(year).over(w)})
        .where((F.col("_last") == F.col("_first")) | F.col("_last").isNull() | F.col(year).isNull() | (F.col(year) == F.col("_last")))
        .drop("_last", "_first")
    )


def keep_best_tier(df: DataFrame, key: str, tier: Column) -> DataFrame:
    """Rows of the highest tier that their group reaches."""
    return df.withColumn("_tier", tier).withColumn("_best", F.max("_tier").over(W.partitionBy(key))).where(F.col("_tier") == F.col("_best")).drop("_tier", "_best")


def keep_primary_group(df: DataFrame, key: str, page: str, period: str, is_total: Column, priority: Column, min_rows: int = 5, min_groups: int = 2) -> DataFrame:
    """Where a document shows its main table on several pages, only the best page's rows of that period, and all rows of others.

    A page's group counts if it has min_rows rows and a total; its score is half its rows, five, and the best priority
    of its rows; ties go to the earlier page. Rows without a page are dropped with the rest of the best period.
    """
    groups = (
        df.where(F.col(page).isNotNull()).groupBy(key, page, period)
        .agg(F.count(F.lit(1)).alias("n"), F.max(is_total.cast("int")).alias("t"), F.max(priority).alias("p"))
        .where((F.col("n") >= min_rows) & (F.col("t") == 1))
    )
    score = F.col("n") + 10 + 2 * F.col("p")
    best = groups.groupBy(key).agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct(score.alias("s"), (-F.col(page)).alias("m"), F.coalesce(period, F.lit("")).alias("o"), F.col(page).alias("best_page"), F.col(period).alias("best_period"))).alias("b"))
    best = best.where(F.col("groups") >= min_groups).select(F.col(key).alias("_k"), "b.best_page", "b.best_period")
    joined = df.join(best, df[key].eqNullSafe(F.col("_k")), "left")
    keep = F.col("_k").isNull() | (F.col(page) == F.col("best_page")) | ~F.col(period).eqNullSafe(F.col("best_period"))
    return joined.where(F.coalesce(keep, F.lit(False))).select(*[df[c] for c in df.columns])


def fold_keep(items: Column, conflict: Callable[[Column, Column], Column], element_type: str) -> Column:
    """Of an ordered array, the elements that don't conflict with one kept before: greedy, within the JVM."""
    return F.aggregate(
        items, F.array().cast(f"array<{element_type}>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: conflict(k, x)), kept).otherwise(F.concat(kept, F.array(x))),
    )


def dedup_neighbouring(df: DataFrame, keys: Sequence[str], page: str, order: str, width: int = 1) -> DataFrame:
    """Of rows equal in keys, those whose page is more than `width` from every one kept before, in `order`.

    Greedy and not transitive: of pages 1, 2, 3 the first and third stay. Rows without a page stay if they are
    the first without. A group is what repeats one fact; it is folded over page numbers alone, never over whole rows.
    """
    element = "struct<o:string,p:int>"
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).cast("string").alias("o"), F.col(page).cast("int").alias("p"))))
    # a null page only repeats another null page
    kept = fold_keep(ordered, lambda k, x: F.coalesce(F.abs(k["p"] - x["p"]) <= width, k["p"].isNull() & x["p"].isNull()), element)
    return df.groupBy(*keys).agg(kept.alias("_kept")).select(*keys, F.explode("_kept").alias("_x")).select(*keys, F.col("_x.o").alias(order), F.col("_x.p").alias(page))


def first_occurrences(df: DataFrame, keys: Sequence[str], order: str, exempt: Column | None = None) -> DataFrame:
    """Each row with which occurrence of its key it is, and the order value of the first. Exempt rows (totals, say) are left out and counted for none."""
    if exempt is not None:
        df = df.where(~F.coalesce(exempt, F.lit(False)))
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumns({"occurrence": F.row_number().over(w), "first_seen": F.min(order).over(W.partitionBy(*keys))})


def consecutive_bundles(df: DataFrame, key: str, page: str, most: int) -> DataFrame:
    """Runs of consecutive pages, cut every `most` pages: adds run (its first page) and bundle within the run, from 0."""
    distinct = df.select(key, page).where(F.col(page).isNotNull()).distinct()
    w = W.partitionBy(key).orderBy(page)
    islands = distinct.withColumn("_i", F.col(page) - F.row_number().over(w))
    return islands.withColumns({"run": F.min(page).over(W.partitionBy(key, "_i")), "_n": F.row_number().over(W.partitionBy(key, "_i").orderBy(page))}).select(
        key, page, "run", F.floor((F.col("_n") - 1) / most).cast("int").alias("bundle")
    )


def fixed_batches(df: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """Batches of `size` rows within each key, numbered from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def neighbour_context(rows: DataFrame, pages: DataFrame, row_id: str, key: str, page: str, text: str, reach: int = 2, most_chars: int = 8000) -> DataFrame:
    """row_id, context: the texts of the pages at most `reach` from a row's page, in page order, cut to most_chars."""
    wanted = rows.where(F.col(page).isNotNull()).select(row_id, key, F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)).alias("_p"))
    near = wanted.join(pages.select(key, F.col(page).alias("_p"), F.col(text).alias("_t")), [key, "_p"])
    # at most 2 x reach + 1 pages a row
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: F.coalesce(x["_t"], F.lit("")))
    return near.groupBy(row_id).agg(F.substring(F.array_join(parts, "\n"), 1, most_chars).alias("context"))


def near_pages(left: DataFrame, right: DataFrame, key: str, page: str, width: int = 1) -> DataFrame:
    """Rows of left with a row of right at most `width` pages away in the same document. An equi-join on the exploded band."""
    band = right.where(F.col(page).isNotNull()).select(key, F.explode(F.sequence(F.col(page) - width, F.col(page) + width)).alias(page)).distinct()
    return left.join(band, [key, page], "left_semi")


def chosen_with_neighbours(df: DataFrame, key: str, page: str, score: str, limit: int = 15, threshold: float = 4.0, factor: float = 0.35) -> DataFrame:
    """key, page, place (in order of choice), beside and score of a greedy choice of pages above 0.

    By falling score; a page of at least `threshold` brings the pages beside it that score above 0. `beside` names the
    page that brought one; such a page scores at least `factor` times what that page does. Of several rows of a page the best counts.
    Folds over (page, score) pairs of one document, which are small.
    """
    best = df.where(F.col(page).isNotNull()).groupBy(key, F.col(page).cast("int").alias("_page")).agg(F.max(score).alias("_score"))
    pairs = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("_score")).alias("neg"), F.col("_page").alias("page")))).alias("ranked"))
    scores = F.map_from_entries(F.transform(F.filter("ranked", lambda x: x["neg"].isNotNull()), lambda x: F.struct(x["page"], -x["neg"])))
    element = "array<struct<page:int,beside:int>>"

    def add(chosen: Column, number: Column, beside: Column, allowed: Column) -> Column:
        fits = allowed & (F.size(chosen) < limit) & ~F.exists(chosen, lambda c: c["page"] == number)
        return F.when(fits, F.concat(chosen, F.array(F.struct(number.alias("page"), beside.alias("beside"))).cast(element))).otherwise(chosen)

    def step(chosen: Column, x: Column) -> Column:
        own = F.lit(None).cast("int")
        around = F.array(F.struct(x["page"].alias("n"), own.alias("by"), (-x["neg"] > 0).alias("ok")), *[
            F.struct((x["page"] + k).alias("n"), x["page"].alias("by"), ((-x["neg"] >= threshold) & (F.coalesce(F.try_element_at(F.col("scores"), x["page"] + k), F.lit(0.0)) > 0)).alias("ok")) for k in (-1, 1)
        ])
        # a page that came in beside another one brings no neighbours of its own
        return F.when(F.exists(chosen, lambda c: c["page"] == x["page"]), chosen).otherwise(F.aggregate(around, chosen, lambda c, y: add(c, y["n"], y["by"], y["ok"])))

    chosen = F.aggregate("ranked", F.array().cast(element), step)
    out = pairs.withColumn("scores", scores).select(key, "scores", F.posexplode(chosen).alias("_i", "_x"))
    own, brought = F.try_element_at("scores", F.col("_x.page")), F.round(F.try_element_at("scores", F.col("_x.beside")) * factor, 3)
    return out.select(key, F.col("_x.page").alias(page), (F.col("_i") + 1).alias("place"), F.col("_x.beside").alias("beside"), F.round(F.greatest(own, brought), 3).alias("score"))


def select_with_neighbours(df: DataFrame, key: str, page: str, score: str, limit: int = 15, threshold: float = 4.0) -> DataFrame:
    """key, page of chosen_with_neighbours()."""
    return chosen_with_neighbours(df, key, page, score, limit, threshold).select(key, page)
