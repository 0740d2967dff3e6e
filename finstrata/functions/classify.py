"""What kind of row and segment a label stands for, by fixed vocabularies tried in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finstrata.functions.text import contains_any, english_meaning, fold_ascii, let

# Labels that name nothing, totals, and parts of labels of other row types.
UNKNOWN = ["", "-", "n/a", "na", "unknown", "not disclosed"]
TOTALS = ["total", "total revenue", "total revenues", "total income", "total net sales", "reported", "reported total", "consolidated", "consolidated total", "group", "group total", "grand total", "gesamt", "insgesamt", "summe", "umsatz gesamt", "total general", "chiffre d affaires total", "totales", "total ingresos", "totale", "totale ricavi", "totaal", "totale omzet", "samlet", "i alt", "totalt", "summa", "yhteensa"]
TOTAL_ENDS = ["total", "consolidated total", "group total", "total reportable", "reportable segments total"]
SUBTOTALS = ["subtotal", "sub total", "sub-total", "reportable segments", "operating segments", "segment total", "total segments", "sum reportable", "zwischensumme", "teilsumme", "sous total", "sous-total", "subtotal segmentos", "subtotale", "subtotaal", "delsumma"]
ELIMINATIONS = ["elimination", "eliminations", "intercompany", "inter company", "inter-company", "intragroup", "intra group", "intra-group", "intersegment", "inter segment", "intra-segment", "eliminierung", "eliminierungen", "konzernintern", "interne umsatze", "eliminacion", "eliminaciones", "eliminacao", "eliminacoes", "eliminazioni", "eliminaties", "eliminering", "elimineringar", "eliminoinnit"]
RECONCILIATIONS = ["reconciliation", "reconciling", "adjustment", "adjustments", "business interruption proceeds", "insurance proceeds", "property insurance proceeds", "government grant income", "grant income", "unallocated", "not allocated", "corporate", "head office", "central", "other items", "reclassification", "reclassifications", "hedging", "fair value", "discontinued", "incidental", "other reconciling", "uberleitung", "abstimmung", "anpassung", "nicht zugeordnet", "rapprochement", "ajustement", "non alloue", "conciliacion", "reconciliacion", "ajuste", "no asignado", "riconciliazione", "rettifica", "non allocato", "reconciliatie", "aanpassing", "niet toegewezen", "avstemming", "justering", "ikke allokeret"]
GEOGRAPHIES = ["north america", "south america", "latin america", "europe", "emea", "apac", "asia pacific", "asia", "africa", "middle east", "oceania", "international", "domestic", "united states", "usa", "canada", "china", "japan", "india", "germany", "france", "spain", "italy", "uk", "united kingdom", "denmark", "norway", "sweden", "finland", "netherlands", "benelux"]
CUSTOMERS = ["consumer", "consumers", "commercial", "enterprise", "institutional", "wholesale", "retail customers", "small business", "sme", "public sector", "government", "private clients"]
PRODUCTS = ["products", "product", "services", "solutions", "software", "hardware", "platform", "devices", "subscriptions", "equipment"]
ACTIVITIES = ["insurance", "banking", "lending", "manufacturing", "production", "generation", "distribution", "transmission", "construction", "mining", "retail", "transport", "shipping", "logistics", "software", "hosting", "telecom", "pharmaceutical", "healthcare", "steel", "cement", "chemicals", "power", "wind", "solar", "oil", "gas"]
MIXED = ["&", "/", ",", " and ", " plus ", " other", " others", " miscellaneous", " diversified", "various", "multiple"]


def row_type(name: Column, value: Column | None = None) -> Column:
    """unknown, total, elimination, subtotal, other_reconciliation or business_segment.

    "subtotal" ends in total and so is one; "central" and "corporate" make a reconciliation of any label.
    """
    negative = F.coalesce(value < 0, F.lit(False)) if value is not None else F.lit(False)
    return let(english_meaning(name), lambda n: _row_type(n, negative))


def _row_type(n: Column, negative: Column) -> Column:
    ends = F.lit(False)
    for t in TOTAL_ENDS:
        ends = ends | n.startswith(t) | n.endswith(t)
    return (
        F.when(n.isin(*UNKNOWN), "unknown").when(n.isin(*TOTALS) | ends, "total").when(contains_any(n, ELIMINATIONS), "elimination")
        .when(contains_any(n, SUBTOTALS), "subtotal").when(contains_any(n, RECONCILIATIONS) | negative, "other_reconciliation").otherwise("business_segment")
    )


def segment_type(name: Column, evidence: Column | None = None) -> Column:
    """geographic_segment, customer_segment, multi_activity, product_segment, single_activity or mixed_or_unclear."""
    about = english_meaning(evidence) if evidence is not None else F.lit(None).cast("string")
    return let(F.struct(english_meaning(name).alias("n"), about.alias("about")), lambda x: _segment_type(x["n"], F.concat_ws(" ", x["n"], x["about"])))


def _segment_type(n: Column, both: Column) -> Column:
    return (
        F.when((n == "") | n.isin("other", "others", "miscellaneous"), "mixed_or_unclear").when(contains_any(n, GEOGRAPHIES), "geographic_segment").when(contains_any(n, CUSTOMERS), "customer_segment")
        .when(contains_any(F.concat(F.lit(" "), n, F.lit(" ")), MIXED), "multi_activity").when(contains_any(n, PRODUCTS) & ~contains_any(n, ACTIVITIES), "product_segment")
        .when(contains_any(both, ACTIVITIES), "single_activity").otherwise("mixed_or_unclear")
    )


def is_total(name: Column) -> Column:
    """The validator's test: exactly a total's label, or 'total' as its first or last word."""
    n = fold_ascii(name)
    return n.isin("total", "total revenue", "total revenues", "total income", "grand total", "group total") | n.startswith("total ") | n.endswith(" total")
