"""Tables changed as a whole: insert, update, upsert, replace, cascading delete, and change logs.

Each returns the new table; writing it is the caller's (append, overwrite, or dynamic partition overwrite).
Conflicts within one batch of changes are settled by the greatest of the given order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.operators.rows import latest_by


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the latest by order; of equals the new one."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, [*order, "_src"]).drop("_src")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_groups(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the groups that occur in new are replaced by its rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def update(old: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Non-null values of changes take the place of old ones; only allowed columns may be changed."""
    columns = [c for c in changes.columns if c != key]
    unknown = sorted(set(columns) - set(allowed))
    if unknown:
        raise ValueError(f"columns that may not be changed: {', '.join(unknown)}")
    renamed = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(renamed, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else c for c in old.columns])


def cascade_delete(parent: DataFrame, child: DataFrame, gone: DataFrame, parent_key: str, child_key: str, set_null: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parents without the gone ones, and their children: deleted with them, or left without a parent."""
    keys = gone.select(F.col(parent_key).alias("_gone")).distinct()
    parents = parent.join(keys, F.col(parent_key) == F.col("_gone"), "left_anti")
    if not set_null:
        return parents, child.join(keys, F.col(child_key) == F.col("_gone"), "left_anti")
    nulled = child.join(keys, F.col(child_key) == F.col("_gone"), "left")
    return parents, nulled.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == child_key else c for c in child.columns])


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent isn't there; those without a key have none to miss."""
    return child.where(F.col(child_key).isNotNull()).join(parent, child[child_key] == parent[parent_key], "left_anti")


def changes_between(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, field_changed, old_value, new_value of every field that differs, nulls compared as values. One pass over the join."""
    o = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns])
    n = new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns])
    fields = F.array(*[F.struct(F.lit(c).alias("field_changed"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in columns])
    return o.join(n, key).select(key, F.explode(F.filter(fields, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))).alias("x")).select(key, "x.*")


def evolve(df: DataFrame, schema) -> DataFrame:
    """df with the columns of a later schema: missing ones as null, known ones cast, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
