"""Single values through the functions, with results stated by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finstrata.functions import classify, json_text, money, text, units


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("printed", "amount"), [
    ("(1,234.50)", "-1234.5"), ("1,234-", "-1234"), ("$1,234.56", "1234.56"), ("-", None), ("—", None), ("1.234,56", "1234.56"), ("12,5", "12.5"), ("1,234", "1234"), ("1 234 567", "1234567"), ("−42", "-42"), ("", None), (None, None), ("USD 3.5 million", "3.5"), ("n/a", None),
])
def test_parse_money(spark, printed, amount):
    got = one(spark, printed, money.parse_money)
    assert got == (Decimal(amount) if amount else None)


@pytest.mark.parametrize(("label", "period", "key"), [("Q3 2024", "Q3 2024", "2024"), ("year ended 31 December 2023", "FY2023", "2023"), ("2023 and 2024", "FY2024", "2023"), ("12M", "12M", "12m"), ("  ", None, ""), ("id 20245", "id 20245", "2024")])
def test_periods(spark, label, period, key):
    assert one(spark, label, money.period_label) == period
    assert one(spark, label, money.period_key) == key


@pytest.mark.parametrize(("ref", "page", "digits", "label"), [("p. 12", 12, 12, "p. 12"), ("pp. 12-13", 12, 1213, "pp. 12-13"), ("12–13", 12, 1213, "pp. 12-13"), ("note", None, None, None), (None, None, None, None)])
def test_page_references(spark, ref, page, digits, label):
    assert one(spark, ref, money.page_of) == page
    assert one(spark, ref, money.page_digits) == digits
    assert one(spark, ref, money.page_label) == label


@pytest.mark.parametrize(("shown", "scale"), [("in thousands", "thousands"), ("USD bn", "billions"), ("units", "actuals"), ("revenue from operations", "millions"), ("1'000", "thousands"), ("plain", None)])
def test_scales(spark, shown, scale):
    assert one(spark, shown, money.scale_of) == scale


@pytest.mark.parametrize(("shown", "code"), [("HK$ 3", "USD"), ("EUR 3", "EUR"), ("3 RMB", "CNY"), ("saudi riyals", "SAR"), ("EURO", None), (None, None)])
def test_currencies(spark, shown, code):
    assert one(spark, shown, money.currency_of) == code


@pytest.mark.parametrize(("label", "kind"), [("I alt", "total"), ("Eliminierungen", "elimination"), ("Sous-total segments", "subtotal"), ("Nicht zugeordnet", "other_reconciliation"), ("Government grant income", "other_reconciliation"), ("Insurance", "business_segment"), ("subtotal", "total"), ("", "unknown"), ("Corporate Banking", "other_reconciliation")])
def test_row_types(spark, label, kind):
    assert one(spark, label, classify.row_type) == kind


def test_normalisers_differ(spark):
    assert one(spark, " Énergie  éolienne ", text.fold_ascii) == "energie eolienne"
    assert one(spark, " Énergie  éolienne ", text.lower_squeezed) == "énergie éolienne"
    assert one(spark, "Énergie éolienne", text.alnum_words) == "nergie olienne"
    assert one(spark, "Gesamt", text.english_meaning) == "total"
    assert one(spark, None, text.fold_ascii) is None


def test_marker_language_needs_a_single_winner(spark):
    assert one(spark, "der Hund und die Katze", text.marker_language) == "de"
    assert one(spark, "the der", text.marker_language) == "unknown"
    assert one(spark, "", text.marker_language) == "unknown"


def test_balanced_json():
    assert json_text.first_balanced('say {"a": "}", "b": {"c": 1}} and {') == '{"a": "}", "b": {"c": 1}}'
    assert json_text.first_balanced("none") is None
    assert json_text.first_balanced('rows: [1, [2]] x', "[", "rows") == "[1, [2]]"
    assert json_text.first_balanced('{"a": "\\"}"}') == '{"a": "\\"}"}'


@pytest.mark.parametrize(("shown", "number"), [("4 246.5570", "4246.5570"), ("(9,9)", "-9.9"), ("−4694.6010", "-4694.6010"), ("405-", "-405"), ("9'860'000", "9860000"), ("8,895,000", "8895000"), ("847,400", "847400"), ("1.234.567,8", "1234567.8"), ("n/a", None), ("—", None), ("", None), (None, None), ("-Fr. 9.9 mn", "-9.9"), ("3 311.7760 k Euro", "3311.7760"), ("5906.5120 '000 pounds sterling", "5906.5120")])
def test_numbers_of_amounts(shown, number):
    assert units.read_number(shown)[0] == (Decimal(number) if number else None)


@pytest.mark.parametrize(("shown", "expected"), [
    ("kCHF", ("CHF", 1, 1000)), ("MSEK", ("SEK", 1, 10**6)), ("EURbn", ("EUR", 1, 10**9)), ("GBP'000", ("GBP", 1, 1000)), ("US cents", ("USD", 100, None)), ("Danish øre", ("DKK", 100, None)), ("table heading reads Swiss francs million", ("CHF", 1, 10**6)),
    ("amounts in thousands of pounds sterling", ("GBP", 1, 1000)), ("Mrd.", (None, 1, 10**9)), ("億", (None, 1, 10**8)), ("hundred millions", (None, 1, 10**8)), ("checked twice", (None, 1, None)), ("HK$", ("HKD", 1, None)), ("MXN", ("MXN", 1, None)), ("MIO", (None, 1, 10**6)), (None, (None, 1, None)),
])
def test_units(shown, expected):
    assert units.read_units(shown) == expected
