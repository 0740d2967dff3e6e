"""Amounts of mixed units, and missing scales predicted on rows kept out of the training."""

import random

from pyspark.sql import functions as F

from finstrata.operators import units

SCHEMA = "gold_id string, document_name string, revenue_value string, currency string, scale string, notes string, confidence double, unit string"


def test_stated_units(spark):
    data = [
        ("1", "d", "(1,234.5)", "EUR", "thousands", None, 1.0, "x"), ("2", "d", "n/a", "EUR", None, None, 1.0, "x"), ("3", "d", "1234", "EUR", "ones", None, 1.0, "x"), ("4", "d", None, None, None, None, None, None),
        ("5", "d", "500", "pence", None, None, 1.0, "x"), ("6", "d", "1.5", None, None, "amounts in millions of USD", 1.0, "x"), ("6", "d", "1.5", None, None, "amounts in millions of USD", 1.0, "x"),
    ]
    got = sorted((r.gold_id, r.currency_code, r.amount, r.is_plain) for r in units.harmonise(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == [("1", "EUR", -1234500, False), ("3", "EUR", 1234, True), ("5", "GBP", 5, False), ("6", "USD", 1500000, False), ("6", "USD", 1500000, False)]


def test_empty_and_unlearnable(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert units.harmonise(empty).count() == 0
    single = spark.createDataFrame([("1", "d", "5", "EUR", None, None, None, None)], SCHEMA)
    r = units.harmonise(single).first()
    assert (r.unit_source, r.amount) == ("review", None)


def test_missing_scales_are_predicted(spark):
    rng = random.Random(1)
    data, true = [], {}
    for k in range(1500):
        doc = f"d{k % 60}"
        usual = 10 ** (6 + (k % 60) % 3)
        amount = int(usual * rng.uniform(1, 9))
        scale, factor = rng.choice([("ones", 1), ("thousands", 1000), ("millions", 10**6)])
        shown = str(amount) if factor == 1 else f"{amount / factor:.6f}"
        hidden = k % 7 == 0
        data.append((str(k), doc, shown, "EUR", None if hidden else scale, None, None, None))
        true[str(k)] = amount
    got = units.harmonise(spark.createDataFrame(data, SCHEMA)).where("unit_source <> 'stated'").collect()
    assert len(got) == 215
    sure = [r for r in got if r.unit_source == "predicted"]
    assert len(sure) >= 180
    assert sum(abs(r.amount - true[r.gold_id]) <= 1 for r in sure) >= 0.95 * len(sure)
    assert all(r.amount is None for r in got if r.unit_source == "review")


def test_training_is_bounded(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("gold_id"), F.lit("d").alias("document_name"), F.col("id").cast("string").alias("revenue_value"), F.lit("EUR").alias("currency"), F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, "ones").otherwise("millions")).alias("scale"), F.lit(None).cast("string").alias("notes"))
    read = units.read_amounts(rows)
    assert units.predict_scales(read, "gold_id", trees=3, train_rows=50).count() == 134
