"""Training-data operators on names, values and duplicate records."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finstrata.llm import canonical_values, name_variants, survivorship, symmetric_delete


def test_distance():
    d = lambda a, b: round(symmetric_delete.weighted_distance(a, b, 3.0), 2)
    assert d("same", "same") == 0
    assert d("form", "from") == symmetric_delete.SWAP
    assert d("modern", "modem") == symmetric_delete.CONFUSED
    assert d("énergie", "energie") == symmetric_delete.ACCENT
    assert d("cat", "cart") == symmetric_delete.PLAIN
    assert d("million", "milhon") == symmetric_delete.CONFUSED
    assert symmetric_delete.weighted_distance("abcdef", "uvwxyz", 2.0) > 2.0


def plain_distance(a, b):
    """Optimal string alignment, for comparison."""
    t = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    return t[-1][-1]


def test_index_finds_all_within_two_edits():
    rng = random.Random(3)
    listed = sorted({"".join(rng.choices("abcd", k=rng.randint(3, 8))) for _ in range(150)})
    index = symmetric_delete.SymmetricDeleteIndex([(w, w, 0.0) for w in listed])
    for _ in range(80):
        asked = "".join(rng.choices("abcd", k=rng.randint(3, 8)))
        found = {key for _, _, key in index.lookup(asked, 2.0)}
        assert {w for w in listed if plain_distance(w, asked) <= 2} <= found


REFERENCE = [("Wind Power", "wind"), ("Windkraft", "wind"), ("Cement and Lime", "cement"), ("Zement und Kalk", "cement"), ("Asset Management", "asset"), ("Industrial Coatings", "coatings"), ("Pharmaceuticals", "pharma"), ("Énergie éolienne", "wind"), ("Rail Systems", "rail")]


@pytest.mark.parametrize(("typed", "key"), [
    ("wind  power", "wind"), ("3. Wind Power", "wind"), ("Wind Powr", "wind"), ("WINDKRAFT*", "wind"), ("Coatings, Industrial", "coatings"), ("Asset Mgmt", "asset"), ("Cement & Lime", "cement"), ("Zement & Kalk", "cement"), ("Energie eolienne", "wind"),
    ("Pharma", "pharma"), ("Cement and Lirne", "cement"), ("Rail Systems division", "rail"), ("Project Walormo", "none"), ("n.a.", "none"), ("???", "none"), ("", "none"), ("Total", "none"), ("Rail", "none"),
])
def test_names(typed, key):
    entries = [(canonical_values.words_only(a), b, 1.0) for a, b in REFERENCE]
    assert canonical_values.best_name(typed, symmetric_delete.SymmetricDeleteIndex(entries), {a: b for a, b, _ in entries}) == key


@pytest.mark.parametrize(("typed", "code"), [("0l.14", "01.14"), ("NACE Rev. 01.14", "01.14"), ("1.14", "01.14"), ("0114", "01.14"), ("A 01.14", "01.14"), ("A01.14", "01.14"), ("l5.14", "15.14"), ("01-14", "01.14"), ("fodder rots", "01.14"), ("Fodder roots (01.14)", "01.14"), ("83.11", "none"), ("x13", "none"), ("tbd", "none"), ("NACE", "none")])
def test_codes(typed, code):
    entries = [("fodder roots", "01.14", 1.0), ("woven linen", "15.14", 1.0)]
    assert canonical_values.best_class(typed, symmetric_delete.SymmetricDeleteIndex(entries), {a: b for a, b, _ in entries}) == code


def test_both_ways_to_resolve_agree(spark):
    listed = spark.createDataFrame([(a, b, 1, "x") for a, b in REFERENCE] + [(None, "n", 1, "x"), ("Solar", None, 1, "x")], "label string, key string, frequency long, value string")
    typed = spark.createDataFrame([(x,) for x in ("Wind Powr", "Winkraft", "Cemnt and Lime", "nothing", "nothing", None, "")], "value string")
    broadcast = {r.value: r.ref_key for r in canonical_values.resolve(typed, listed).collect()}
    joined = {r.value: r.ref_key for r in canonical_values.resolve_by_join(typed.where("value is not null").distinct(), listed.where("label is not null and key is not null")).collect()}
    assert broadcast == joined == {"Wind Powr": "wind", "Winkraft": "wind", "Cemnt and Lime": "cement", "nothing": "none", "": "none"}
    assert {r.ref_key for r in canonical_values.resolve(typed, listed.limit(0)).collect()} == {"none"}
    assert canonical_values.resolve(typed.limit(0), listed).count() == 0


def test_a_long_list_is_resolved_as_a_short_one(spark, monkeypatch):
    rows = [(a, b, 1) for a, b in REFERENCE] + [("fodder roots", "01.14", 1), ("woven linen", "15.14", 1), ("woven linens", "15.15", 3)]
    listed = spark.createDataFrame(rows, "label string, key string, frequency long")
    typed = spark.createDataFrame([(x,) for x in ("A 01.14", "0114", "l5.14", "fodder roots (01.14)", "something else (01.14)", "NACE Rev. 01.14", "fodder rots", "Cem. and Lime", "wov. linen", "woven lin", "83.11", "Total", "", "woven linenx")], "value string")
    for best in (canonical_values.best_class, canonical_values.best_name):
        short = {r.value: r.ref_key for r in canonical_values.resolve(typed, listed, best).collect()}
        with monkeypatch.context() as m:
            m.setattr(canonical_values, "MAX_BROADCAST", 2)
            assert {r.value: r.ref_key for r in canonical_values.resolve(typed, listed, best).collect()} == short
    assert short["Cem. and Lime"] == "cement"


@pytest.mark.parametrize("others", [10, 60, 200])
def test_one_edit_is_linked_at_every_block_size(spark, others):
    rng = random.Random(3)
    cores = ["nationaltaxor", "nationaltaxro", "zzvoltane", "zzvo1tane"] + ["national" + "".join(rng.choices("bcdfghjk", k=7)) + "ro" for _ in range(others)]
    forms = spark.createDataFrame([(k, c, "foods", False, c) for k, c in enumerate(cores)], "form long, core string, line string, alias boolean, typed string")
    links = {(r.a, r.b) for r in name_variants.variant_links(forms).collect()}
    assert {(0, 1), (2, 3)} <= links


COMPANIES = [
    ["Nakazukel Foods S.p.A.", "Foods, Nakazukel S.p.A.", "NAKAZUKEL FOODS S.P.A.", "Nakazukel Fooas Societa per azioni", "NakazuFoo", "Nakazukel Foods S.p.A. (NakazuFoo)", "Nakzukel Foods Spa", " Nakazukel-Foods"],
    ["Nakazukel Energy Ltd", "Ltd Nakazukel Energy", "Nakazukel Energy Limited", "Nakazukel Enrgy Ltd."],
    ["Linfirmelzör Materials and Sons A/S", "Linfirmelzoer Materials & Sons AS", "Linfirmezlör Materials and Sons A/S", "Linfirmelzor Mat. + Sons a/s"],
    ["Vafolpellor Engineering Group PLC", "Vafolpellor Engg. Grp. P.L.C.", "Vafolpellor Engineering Group Public Limited Company (group)"],
    ["Records Office Omnibus"],
    ["Zorvan Mellick Mining", "Mellick Zorvan Mining Ltd", "ZMM plc", "MINING ZORVAN MELLICK"],
    ["Robert Halden Shipping (Bobal Shipping)", "Bobal Shipping Ltd", "Halden Robert Shipping AG"],
]


def test_name_variants(spark):
    rows = [(n, "e", 1) for c in COMPANIES for n in c] + [(None, "e", 1), (COMPANIES[0][0], "e", 2), ("...", "e", 1)]
    df = spark.createDataFrame(rows, "company_name string, entity string, form int")
    true = {tuple(sorted((a, b))) for c in COMPANIES for a in c for b in c if a < b}
    got = sorted((r.name_a, r.name_b) for r in name_variants.variant_pairs(df).collect())
    assert set(got) == true and len(got) == len(set(got))
    assert name_variants.company_entities(df).count() == sum(map(len, COMPANIES)) + 1
    assert name_variants.variant_pairs(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 3)]
    got = {r.node: r.label for r in name_variants.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


ROW = "row_id string, document_id string, segment_name string, revenue_raw string, normalized_value decimal(38,6), page_number int, fiscal_period string, evidence_text string, confidence double, extractor string, extracted_at timestamp, fact_id string, _a int"


def row(i, name, raw, value, page, period, evidence, confidence, day, extractor="table_rules"):
    return (i, "d", name, raw, None if value is None else Decimal(value), page, period, evidence, confidence, extractor, datetime.datetime(2024, 1, day), "old", 0)


def test_facts_and_survivors(spark):
    rows = [
        row("r1", "Wind Power", "523,431,122", 523431122, 166, "2023", None, 0.8, 3), row("r2", "WIND  POWER*", "523,400,000", 523400000, None, None, None, 0.4, 1), row("r3", "Wind Power", None, None, 166, "FY2023", "Wind Power 523.4 million", 0.6, 2, "manual_entry"),
        row("r4", "Wind Power", "400,000,000", 400000000, 166, "FY2022", None, 0.9, 9), row("r5", "Rail", None, None, None, None, None, 0.5, 1), row("r6", "Rail", "1,000,000", 1000000, 3, "FY24", None, 0.5, 2), row("r7", None, None, None, None, None, None, None, 1),
        row("r8", "Rail", None, 1000000, 4, "2024", None, 0.5, 2),
    ]
    facts = survivorship.fact_keys(spark.createDataFrame(rows, ROW))
    assert facts.columns.count("fact_id") == 1 and facts.count() == 8
    groups = sorted(sorted(r.ids) for r in facts.groupBy("fact_id").agg(F.collect_list("row_id").alias("ids")).collect())
    assert groups == [["r1", "r2", "r3"], ["r4"], ["r5", "r6", "r8"], ["r7"]]
    best = [(r.first_id, r.best_id) for r in survivorship.dominating_rows(facts, "fact_id", ["normalized_value", "page_number", "fiscal_period"]).collect()]
    assert best == [("r1", "r1")]  # the second group's two fullest rows tie in time and trust
    kept = {r.first_id: r for r in survivorship.survivors(facts, "fact_id", ["normalized_value", "page_number", "fiscal_period", "revenue_raw"]).collect()}
    assert (kept["r1"].normalized_value, kept["r1"].page_number, kept["r1"].fiscal_period, kept["r1"].n_rows) == (Decimal("523431122.000000"), 166, "FY2023", 3)
    assert kept["r7"].normalized_value is None
    empty = spark.createDataFrame([], ROW)
    assert survivorship.dominating_rows(survivorship.fact_keys(empty), "fact_id", ["page_number"]).count() == 0
