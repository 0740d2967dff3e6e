"""Quantities of different units brought to whole units of their ISO currency.

What a row states about its unit (in its value, unit columns or notes) is read; rows that state no scale
get one from a calibrated random forest trained on the rows that do, from the magnitude and form of the
number, the currency, the source, the category, and the amounts of neighbouring rows without the row itself.
Confident predictions are converted, the rest is routed to review.

Edge cases: null, empty or wordless values (n/a, a dash) hold no number and give no amount; a number in
hundredths of a currency is divided by 100; a stated minor unit without a scale is in ones; conflicting
statements go by value text, then scale column, then currency column, then notes; repeated rows are
converted alike; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstrata.functions.units import PLAIN, read_number, read_units
from finstrata.runtime import cut

#: The forest is fitted on at most this many labelled rows, picked by hash of their id.
TRAIN_ROWS = 20_000
#: A predicted scale is used if rows predicted as surely were right this often on held-out rows.
CONFIDENT = 0.95
#: Rows that share one of these are neighbours: what they amount to tells a row's scale. Columns that a table lacks are left out.
NEIGHBOURS = (("document_name",), ("company_name",), ("segment_name",), ("company_name", "segment_name"), ("document_name", "segment_name", "fiscal_period"))
#: Columns that name a row's category; the first two characters are told apart.
CATEGORIES = ("nace_code",)
SCALE_CLASSES = [1, 10**3, 10**6, 10**8, 10**9]
_READ = T.StructType([
    T.StructField("number", T.StringType()), T.StructField("currency_code", T.StringType()), T.StructField("minor", T.IntegerType()),
    T.StructField("scale_value", T.LongType()), T.StructField("is_plain", T.BooleanType()),
])


@F.pandas_udf(_READ)
def _read(value: pd.Series, currency: pd.Series, scale: pd.Series, notes: pd.Series) -> pd.DataFrame:
    rows = []
    for v, c, s, n in zip(value, currency, scale, notes):
        number, rest = read_number(v)
        if number is None:
            rows.append((None, None, None, None, False))
            continue
        (cv, mv, sv), (cc, mc, sc), (_, _, ss), (cn, mn, sn) = read_units(rest), read_units(c), read_units(s), read_units(n)
        code, minor = next(((x, m) for x, m in ((cv, mv), (cc, mc), (cn, mn)) if x), (None, 1))
        stated = next((x for x in (sv, ss, sc, sn) if x is not None), None)
        if stated is None and minor > 1:
            stated = 1
        plain = bool(PLAIN.fullmatch(v)) and code is not None and c == code and (s in ("ones", "actuals"))
        rows.append((format(number, "f"), code, minor, stated, plain))
    return pd.DataFrame(rows, columns=["number", "currency_code", "minor", "scale_value", "is_plain"])


def read_amounts(rows: DataFrame, value: str = "revenue_value", currency: str = "currency", scale: str = "scale", notes: str = "notes") -> DataFrame:
    """rows with `unit`: the number of each value, and what is stated about currency, minor unit and scale."""
    return rows.withColumn("unit", _read(value, currency, scale, notes))


def amount(number: Column, minor: Column, scale: Column) -> Column:
    """number x scale / minor, exactly."""
    exact = F.try_multiply(number.cast("decimal(30,8)"), scale.cast("decimal(10,0)")) / F.coalesce(minor, F.lit(1)).cast("decimal(3,0)")
    return F.round(exact, 0).cast("decimal(38,0)").cast("long")


def _without(total: Column, n: Column, own: Column) -> Column:
    """The mean of a group's other rows; own is null for a row that isn't counted in the group."""
    others = n - own.isNotNull().cast("int")
    return F.when(others > 0, (total - F.coalesce(own, F.lit(0.0))) / others)


def _features(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with numbers that tell scales apart, and their names: magnitude, form, source, category, and what the neighbours amount to.

    A labelled row is no neighbour of its own, so a feature says the same of rows with and without a label.
    """
    n = F.greatest(F.abs(F.col("unit.number").cast("double")), F.lit(1e-9))
    digits = F.regexp_replace(F.col("unit.number"), "[-.]", "")
    bucket = lambda c, most: F.pmod(F.xxhash64(c), F.lit(most)).cast("double")
    out = rows.withColumns({
        "f_log": F.log10(n), "f_decimals": F.length(F.regexp_extract(F.col("unit.number"), r"\.(\d+)$", 1)).cast("double"),
        "f_zeros": F.length(F.regexp_extract(digits, r"(0*)$", 1)).cast("double"), "f_digits": F.length(digits).cast("double"),
        "f_minor": F.coalesce(F.col("unit.minor"), F.lit(1)).cast("double"), "f_currency": bucket(F.coalesce("unit.currency_code", F.lit("")), 32),
    })
    names = ["f_log", "f_decimals", "f_zeros", "f_digits", "f_minor", "f_currency"]
    if "document_name" in columns:  # the kind of document: its name's words
        out = out.withColumn("f_source", bucket(F.regexp_replace(F.coalesce("document_name", F.lit("")), r"[\d\W_]+", " "), 32))
        names.append("f_source")
    for c in CATEGORIES:
        if c in columns:
            out = out.withColumn(f"f_{c}", bucket(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"\W", ""), 1, 2), 32))
            names.append(f"f_{c}")
    own = F.when(F.col("unit.scale_value").isNotNull() & (n > 1e-9), F.log10(n * F.col("unit.scale_value") / F.coalesce("unit.minor", F.lit(1))))
    out = out.withColumn("_own", own)
    for k, keys in enumerate(x for x in NEIGHBOURS if set(x) <= set(columns)):
        here = F.when(F.concat(*keys).isNotNull(), F.concat_ws("\x1f", *keys))  # a null names no neighbour
        out = out.withColumn("_key", here)
        groups = out.where(F.col("_own").isNotNull() & F.col("_key").isNotNull()).groupBy(F.col("_key").alias("_g")).agg(F.sum("_own").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        out = out.join(groups, F.col("_key") == F.col("_g"), "left").withColumn(f"f_near{k}", F.coalesce(_without(F.col("_sum"), F.col("_n"), F.col("_own")) - F.col("f_log"), F.lit(-99.0))).drop("_g", "_sum", "_n", "_key")
        names.append(f"f_near{k}")
    return out, names


def calibrated(bands: dict[int, tuple[int, int]], least: int = 20) -> dict[int, float]:
    """Band of probability -> how often it is right: neighbouring bands pooled until none is right less often than a lower one and each has `least` rows."""
    pools: list[list] = []
    for band in sorted(bands):
        pools.append([[band], *bands[band]])
        while len(pools) > 1 and (pools[-2][2] < least or pools[-1][1] * pools[-2][2] < pools[-2][1] * pools[-1][2]):
            own, right, n = pools.pop()
            pools[-1] = [pools[-1][0] + own, pools[-1][1] + right, pools[-1][2] + n]
    return {band: (right + 1) / (n + 2) for own, right, n in pools for band in own}


BANDS = 50


def predict_scales(rows: DataFrame, row_id: str, trees: int = 40, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """row id, predicted_scale, confidence of the rows with a number but no stated scale. rows: read_amounts(), read several times here.

    confidence is the accuracy of equally sure predictions on labelled rows kept out of the training.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    index = F.array_position(F.array(*[F.lit(s) for s in SCALE_CLASSES]), F.col("unit.scale_value")).cast("double") - 1
    featured, names = _features(rows.where(F.col("unit.number").isNotNull()), rows.columns)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(featured)
    hashed = vectors.where(F.col("unit.scale_value").isNotNull()).withColumn("label", index).withColumn("_h", F.xxhash64(row_id))
    share = min(1.0, 4 * train_rows / max(1, rows.count()))
    low = hashed.where((F.col("label") >= 0) & (F.col("_h") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)))
    bounded = low.orderBy("_h").limit(train_rows).select(row_id, "label", "features", F.pmod("_h", F.lit(4)).alias("fold")).persist()
    if bounded.where("fold > 0").select("label").distinct().count() < 2:  # nothing to tell apart
        bounded.unpersist()
        return vectors.where(F.lit(False)).select(row_id, F.lit(None).cast("long").alias("predicted_scale"), F.lit(0.0).alias("confidence"))
    try:
        model = RandomForestClassifier(numTrees=trees, maxDepth=12, seed=7, featureSubsetStrategy="0.5").fit(bounded.where("fold > 0"))
        sure = F.array_max(vector_to_array("probability"))
        # calibration: how often predictions of each band of probability were right on the fold kept out
        bands = calibrated({
            r.band: (r.right, r.n)
            for r in model.transform(bounded.where("fold = 0")).groupBy(F.floor(sure * BANDS).alias("band")).agg(
                F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("int")).alias("right")
            ).collect()
        })
    finally:
        bounded.unpersist()
    # a band that held no row kept out counts as the next lower one that did
    rated, last = {}, 0.0
    for band in range(BANDS + 1):
        rated[band] = last = bands.get(band, last)
    classes = F.array(*[F.lit(s).cast("long") for s in SCALE_CLASSES])
    return model.transform(vectors.where(F.col("unit.scale_value").isNull())).select(
        row_id,
        F.element_at(classes, F.col("prediction").cast("int") + 1).alias("predicted_scale"),
        F.element_at(F.array(*[F.lit(rated[b]) for b in range(BANDS + 1)]), F.floor(sure * BANDS).cast("int") + 1).alias("confidence"),
    )


def harmonise(rows: DataFrame, row_id: str = "gold_id", group: str = "document_name", confident: float = CONFIDENT) -> DataFrame:
    """row id, currency_code, amount, unit_source (stated, predicted or review), confidence, is_plain of every row that holds a number."""
    columns = list(dict.fromkeys([row_id, group, "revenue_value", "currency", "scale", "notes", *(c for x in NEIGHBOURS for c in x if c in rows.columns), *(c for c in CATEGORIES if c in rows.columns)]))
    read = cut(read_amounts(rows.select(*columns)).where(F.col("unit.number").isNotNull()))  # the texts are read once, however often the numbers are
    stated = read.where(F.col("unit.scale_value").isNotNull() & F.col("unit.currency_code").isNotNull()).select(
        row_id, F.col("unit.currency_code").alias("currency_code"), amount(F.col("unit.number"), F.col("unit.minor"), F.col("unit.scale_value")).alias("amount"),
        F.lit("stated").alias("unit_source"), F.lit(1.0).alias("confidence"), F.col("unit.is_plain").alias("is_plain"),
    )
    missing = read.where(F.col("unit.scale_value").isNull() | F.col("unit.currency_code").isNull())
    if missing.isEmpty():
        return stated
    # a currency that all rows of the group share is the group's
    codes = read.where(F.col("unit.currency_code").isNotNull()).groupBy(group).agg(F.min("unit.currency_code").alias("c0"), F.max("unit.currency_code").alias("c1"))
    only = F.when(F.col("c0") == F.col("c1"), F.col("c0"))
    with_group = missing.join(codes, group, "left")
    if missing.where(F.col("unit.scale_value").isNull()).isEmpty():
        with_group = with_group.withColumn("predicted_scale", F.lit(None).cast("long")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        # one prediction an id: rows that repeat it have the same text
        predicted = predict_scales(read, row_id).groupBy(row_id).agg(F.max_by("predicted_scale", F.struct("confidence", "predicted_scale")).alias("predicted_scale"), F.max("confidence").alias("confidence"))
        with_group = with_group.join(predicted, row_id, "left")
    code = F.coalesce(F.col("unit.currency_code"), only)
    scale = F.coalesce(F.col("unit.scale_value"), F.col("predicted_scale"))
    sure = F.coalesce(F.when(F.col("unit.scale_value").isNotNull(), F.lit(1.0)), F.col("confidence"), F.lit(0.0))
    ok = (sure >= confident) & code.isNotNull()
    return stated.unionByName(
        with_group.select(
            row_id, code.alias("currency_code"), F.when(ok, amount(F.col("unit.number"), F.col("unit.minor"), scale)).alias("amount"),
            F.when(ok, "predicted").otherwise("review").alias("unit_source"), sure.alias("confidence"), F.lit(False).alias("is_plain"),
        )
    )


def held_out(rows: DataFrame, row_id: str = "gold_id", share: int = 10, confident: float = CONFIDENT) -> DataFrame:
    """What the forest says where the unit is known: row id, stated_scale, predicted_scale, confidence, converted, of each row of one in `share`, its unit hidden.

    A row is hidden by the hash of its id; all others are training rows and neighbours.
    """
    columns = [c for c in dict.fromkeys([row_id, "revenue_value", "currency", "scale", "notes", *(c for x in NEIGHBOURS for c in x), *CATEGORIES]) if c in rows.columns]
    read = cut(read_amounts(rows.select(*columns)).where(F.col("unit.number").isNotNull() & F.col("unit.scale_value").isNotNull()))
    hidden = F.pmod(F.xxhash64(row_id, F.lit("hidden")), F.lit(share)) == 0
    asked = read.withColumn("unit", F.when(hidden, F.col("unit").withField("scale_value", F.lit(None).cast("long"))).otherwise(F.col("unit")))
    true = read.where(hidden).groupBy(row_id).agg(F.min("unit.scale_value").alias("stated_scale"))
    return predict_scales(asked, row_id).join(true, row_id).select(row_id, "stated_scale", "predicted_scale", "confidence", (F.col("confidence") >= confident).alias("converted"))
