"""Operators on small rows with results stated by hand or by a plain restatement."""

import random
import re

import pytest
from pyspark.sql import functions as F

from finstrata.operators import evaluate, export, pages, rows, scoring, store, taxonomy, validate


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_latest_year_keeps_undated_rows(spark):
    df = spark.createDataFrame([("a", 2025, 1), ("a", 2024, 2), ("a", None, 3), ("b", 2020, 4), (None, 2020, 5)], "doc string, year int, id int")
    assert [x[0] for x in values(rows.keep_latest_year(df, "doc", "year"), "id")] == [1, 3, 4, 5]


def test_dedup_is_greedy_and_not_transitive(spark):
    df = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 2), ("a", "r3", 3), ("a", "r4", None), ("a", "r5", None)], "k string, id string, page int")
    kept = values(rows.dedup_neighbouring(df, ["k"], "page", "id").where("page is not null"), "id")
    assert kept == [("r1",), ("r3",)]
    assert rows.dedup_neighbouring(df, ["k"], "page", "id").count() == 3


@pytest.mark.parametrize("seed", range(4))
def test_greedy_choice_with_neighbours(spark, seed):
    rng = random.Random(seed)
    scored = {p: rng.choice([0.0, 1.0, 3.0, 4.0, 6.5]) for p in rng.sample(range(1, 40), 25)}
    chosen = []
    for p in sorted(scored, key=lambda p: (-scored[p], p)):
        if scored[p] <= 0 or len(chosen) >= 9:
            break
        if p in chosen:
            continue
        chosen.append(p)
        for q in (p - 1, p + 1) if scored[p] >= 4 else ():
            if len(chosen) < 9 and scored.get(q, 0) > 0 and q not in chosen:
                chosen.append(q)
    df = spark.createDataFrame([("d", p, s) for p, s in scored.items()], "doc string, page int, score double")
    assert sorted(chosen) == [x[0] for x in values(rows.select_with_neighbours(df, "doc", "page", "score", limit=9), "page")]


def test_bundles_of_consecutive_pages(spark):
    df = spark.createDataFrame([("d", p) for p in (1, 2, 3, 4, 7, 8, None)], "doc string, page int")
    assert values(rows.consecutive_bundles(df, "doc", "page", 3), "page", "run", "bundle") == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 1), (7, 7, 0), (8, 7, 0)]


def test_primary_group(spark):
    data = [("d", p, "FY", f"r{p}{k}") for p in (23, 178) for k in range(5)] + [("d", 40, "FY", "x"), ("d", None, "FY", "y"), ("d", 99, "FY2", "z")]
    df = spark.createDataFrame(data, "doc string, page int, period string, id string")
    kept = {x[0] for x in values(rows.keep_primary_group(df, "doc", "page", "period", F.col("id").endswith("4"), F.lit(0)), "id")}
    assert kept == {f"r23{k}" for k in range(5)} | {"z"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc string, page int, year int, id string, score double")
    assert rows.keep_latest_year(empty, "doc", "year").count() == 0
    assert rows.select_with_neighbours(empty, "doc", "page", "score").count() == 0
    assert rows.latest_by(empty, ["doc"], ["year", "id"]).count() == 0


def test_aligned_values_take_every_second_number_under_two_years(spark):
    text = "2024 2023\nRevenue\n2,927 2,800\n678 640\n-511 -490\n3,094 2,950\nend"
    df = spark.createDataFrame([("p", text), ("q", "Revenue\n1\n2"), ("r", None)], "id string, text string")
    assert [x[0] for x in sorted((r.raw, r.ordinal) for r in pages.aligned_values(df, "Revenue", 4).collect())] == sorted(["2,927", "678", "-511", "3,094"])


def test_reconciliation(spark):
    totals = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", None), ("d", 5.0)], "id string, total double")
    parts = spark.createDataFrame([("a", 60.0, None), ("a", 40.4, 0.0), ("b", 60.0, 61.0), ("c", 1.0, None)], "id string, v double, e double")
    got = {r.id: (r.status, r.total_source) for r in validate.reconcile(totals, parts, "id", "total", "v", "e").collect()}
    assert got == {"a": ("matched", "reported"), "b": ("matched", "explicit"), "c": ("not_available", "none"), "d": ("not_available", "reported")}


def test_weighted_average(spark):
    df = spark.createDataFrame([("c", 4.3, 75.0), ("c", 2.4, 25.0), ("c", 1.0, -5.0), ("e", 1.0, None)], "k string, s double, w double")
    got = {r.k: r.weighted_score for r in scoring.weighted_average(df, "k", F.col("s"), F.col("w")).collect()}
    assert got == {"c": 3.825, "e": None}


def test_matching(spark):
    gold = spark.createDataFrame([("g1", "d", "Networks", 42.0), ("g2", "d", "Retail", 5.0)], "gold_id string, doc string, gn string, gv double")
    pred = spark.createDataFrame([("p1", "d", "Network operations", 41.0), ("p2", "d", "Other", 1.0)], "pred_id string, doc string, pn string, pv double")
    pairs = evaluate.candidate_pairs(gold, pred, "doc", evaluate.token_similarity(F.col("gn"), F.col("pn")), F.col("gv") == F.col("pv"), F.lit(True), F.lit(None).cast("boolean"))
    results = evaluate.outcomes(gold, pred, evaluate.greedy_matches(pairs, "doc"), "doc")
    assert values(results, "failure") == [("extra_segment",), ("missing_segment",), ("wrong_value",)]
    m = evaluate.metrics(results).first()
    assert (m.correct, m.precision, m.recall, m.f1) == (0, 0.0, 0.0, 0.0)


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 0, "w"), ("c", 1, "n")], "k string, at int, v string")
    assert values(store.upsert(old, new, ["k"], ["at"]), "k", "v") == [("a", "z"), ("b", "y"), ("c", "n")]
    assert values(store.insert_if_absent(old, new, ["k"]), "k", "v") == [("a", "x"), ("b", "y"), ("c", "n")]
    assert values(store.update(old, new.select("k", "v"), "k", ["v"]), "k", "v") == [("a", "z"), ("b", "w")]
    with pytest.raises(ValueError, match="at"):
        store.update(old, new, "k", ["v"])
    assert values(store.changes_between(old, old.withColumn("v", F.when(F.col("k") == "a", F.col("v"))), "k", ["v"]), "k", "old_value", "new_value") == [("b", "y", None)]


def test_candidates_need_a_shared_token(spark):
    node = "level string, level_depth int, node_code string, node_name string, hierarchy_path_codes string, hierarchy_path_names string, source_row_number int"
    nodes = spark.createDataFrame([("class", 4, "01.11", "Growing of fibre crops", "A|01", "Field|Crops", 1), ("class", 4, "02.11", "Tending of vines", "A|02", "Field|Vines", 2)], node)
    items = spark.createDataFrame([("i", "growing of fibre crops", None), ("j", "nothing alike", ""), ("k", None, None)], "id string, n string, c string")
    assert values(taxonomy.candidates(items, nodes, "id", "n", "c"), "id", "node_code", "rank") == [("i", "01.11", 1)]


def test_workbook_and_letters(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([("a<b", None), ("c", 2)], "x string, y int")
    export.write_workbook(df, str(tmp_path / "w.xlsx"), ["x", "y"])
    sheet = zipfile.ZipFile(tmp_path / "w.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b" in sheet and 'r="B3"' in sheet
    assert [export.column_letters(k) for k in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    export.write_csv(df, str(tmp_path / "c"), ["y", "x"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).fillna("").collect()) == [("", "a<b"), ("2", "c")]


def test_nested_export_and_schemas(spark, tmp_path):
    import datetime
    import json

    from finstrata import schemas
    from finstrata.functions import json_text, text

    parents = spark.createDataFrame([("d", datetime.datetime(2024, 1, 2)), ("e", None)], "id string, at timestamp")
    children = spark.createDataFrame([("d", "r2", 2), ("d", "r1", 1), (None, "r3", 3)], "doc string, row_id string, n int")
    nested = export.nest(parents, children, "id", "doc", "rows", ["n"], ["row_id"])
    shown = {r.id: json.loads(r.j) for r in nested.select("id", export.as_json(["at", "rows"]).alias("j")).collect()}
    assert [x["row_id"] for x in shown["d"]["rows"]] == ["r1", "r2"] and shown["e"] == {"at": None, "rows": []}
    export.write_json(nested, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    export.write_markdown(nested.select("id"), str(tmp_path / "m.md"), "Title", ["id"])
    assert (tmp_path / "m.md").read_text().startswith("# Title\n\n| id |\n|---|\n| ")
    later = store.evolve(parents.withColumn("extra", F.lit(1)), schemas.DOCUMENT)
    assert later.columns == schemas.DOCUMENT.names and later.count() == 2
    names = schemas.EXTRACTED_ROW.names
    answers = spark.createDataFrame([(json.dumps(dict.fromkeys(names)),), ('{"segment_name": "x"}',), ("[1]",), ("no",), (None,)], "t string")
    errors = [r.e for r in answers.select(json_text.schema_errors(F.col("t"), names).alias("e")).collect()]
    assert errors[0] == [] and "missing confidence" in errors[1] and errors[2:] == [["invalid"]] * 3
    assert [r.b for r in spark.createDataFrame([(" ",), (" a ",), (None,)], "x string").select(text.blank_to_null(F.col("x")).alias("b")).collect()] == [None, "a", None]


def test_fuzzy_pairs_are_those_of_brute_force(spark, tiny):
    from difflib import SequenceMatcher

    from finstrata.plans import review

    def similarity(a, b):
        a, b = (" ".join(re.sub(r"[^a-z0-9]+", " ", x.lower()).split()) for x in (a, b))
        if not a or not b:
            return 0.0
        s, t = ({w[:-1] if len(w) > 3 and re.search("[^s]s$", w) else w for w in x.split()} for x in (a, b))
        both = len(s & t)
        words = 1.0 if a == b else max(0.84, both / max(len(s), len(t))) if both in (len(s), len(t)) else both / max(len(s), len(t))
        return round(max(words, SequenceMatcher(None, a, b).ratio()), 4)

    names = ["Ersatzteile", "Ersatzteile division", "Contract Logistics", "Contract Logistics - external", "Water", "Waters and all of the remaining activities", "Packagimg", "Packaging", "", "-", None, "abcdefgh", "abcdefghijklmno", "abcdefghijklmnop"]
    one = spark.createDataFrame(list(enumerate(names)), "i int, a string")
    pairs = one.crossJoin(one.select(F.col("i").alias("j"), F.col("a").alias("b")))
    kept = pairs.where(evaluate.may_be_similar(F.col("a"), F.col("b"), 0.68)).select("i", "j", F.round(evaluate.fuzzy_similarity(F.col("a"), F.col("b")), 4).alias("s")).where("s >= 0.68")
    expected = sorted((i, j, s) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and (s := similarity(a, b)) >= 0.68)
    assert values(kept, "i", "j", "s") == expected and (0, 1, 0.84) in expected and (2, 3, 0.84) in expected
    gold, pred = ([tuple(r) for r in df.collect()] for df in (x.select("document_id", k, n) for x, k, n in zip(review._sides(spark, tiny), ("gold_id", "pred_id"), ("g_name", "p_name"))))
    by_document = {}
    for d, i, n in pred:
        by_document.setdefault(d, []).append((i, n))
    expected = sorted((g, i, s) for d, g, a in gold for i, b in by_document.get(d, []) if a and b and (s := similarity(a, b)) >= 0.68)
    assert values(review.pair_match_fuzzy(spark, tiny), "gold_id", "pred_id", "similarity") == expected


def test_taxonomy_ratio_against_a_plain_restatement(spark):
    from difflib import SequenceMatcher

    from finstrata.plans import pipeline

    words = lambda x: [w for w in re.sub("[^a-z0-9]+", " ", x.lower()).split() if len(w) > 2 and w not in ("and", "the", "other")]
    labels = ["Forestry", "Cement and lime", "Retail trade", "Trade of forestry goods", "Real estate"]
    nodes = spark.createDataFrame([(f"n{k}", x, "class", 4, k, f"n{k}", x) for k, x in enumerate(labels)], "node_code string, node_name string, level string, level_depth int, source_row_number int, hierarchy_path_codes string, hierarchy_path_names string")
    names = ["Forrestry", "Forestry", "Cement", "Ceme", "Retial", "trade trade", "Other", "", "zzzz"]
    expected = set()
    for i, name in enumerate(names):
        for k, label in enumerate(labels):
            a, b = words(name), words(label)
            x, y = " ".join(a), " ".join(b)
            overlap, ratio, inside = set(a) & set(b), SequenceMatcher(None, x, y).ratio(), bool(x) and x in y
            if overlap or ratio >= 0.45 or inside:
                score = 0.52 * len(overlap) / max(len(set(a)), 1) + 0.28 * len(overlap) / len(set(b)) + 0.2 * ratio + (0.3 if x == y else 0.12 if inside else 0) + 0.07
                expected.add((str(i), f"n{k}", round(min(score, 1.0), 3)))
    rows_ = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "id string, segment_name string")
    got = {(r.id, r.node_code, round(float(r.score), 3)) for r in pipeline.classify(rows_, nodes, 9).collect()}
    tidy = lambda x: sorted((i, n) for i, n, _ in x)
    assert tidy(got) == tidy(expected) and ("0", "n0") in tidy(got)
    stated = {(i, n): s for i, n, s in expected}
    assert all(abs(s - stated[i, n]) < 0.002 for i, n, s in got)


def test_pages_brought_by_a_strong_page(spark):
    scored = spark.createDataFrame([("d", 5, 6.0), ("d", 5, 2.0), ("d", 6, 1.0), ("d", 4, 0.0), ("d", 9, 3.0), ("d", 10, 0.5), ("d", None, 9.0), ("e", 1, None)], "document_id string, page_number int, score double")
    got = [tuple(r) for r in rows.chosen_with_neighbours(scored, "document_id", "page_number", "score").orderBy("place").collect()]
    assert got == [("d", 5, 1, None, 6.0), ("d", 6, 2, 5, 2.1), ("d", 9, 3, None, 3.0), ("d", 10, 4, None, 0.5)]
    assert rows.chosen_with_neighbours(scored.limit(0), "document_id", "page_number", "score").count() == 0


def test_greedy_matching_in_rounds_is_the_greedy_one(spark):
    import random

    from finstrata.operators import evaluate

    rng = random.Random(6)
    pairs = [(f"d{rng.randint(0, 2)}", f"g{g}", f"p{p}", rng.randint(1, 5) / 5) for g in range(12) for p in range(12) if rng.random() < 0.5]
    pairs = [(d[:1] + str(int(g[1:]) % 2), g, p, s) for d, g, p, s in pairs]
    want, used = set(), set()
    for d, g, p, s in sorted(pairs, key=lambda x: (-x[3], x[1], x[2])):
        if (d, g) not in used and (d, "p", p) not in used:
            want.add((d, g, p))
            used |= {(d, g), (d, "p", p)}
    frame = spark.createDataFrame(pairs, "document_id string, gold_id string, pred_id string, score double")
    assert {(r.document_id, r.gold_id, r.pred_id) for r in evaluate.greedy_matches(frame, "document_id").collect()} == want
    assert evaluate.greedy_matches(frame.limit(0), "document_id").count() == 0


def test_rejections_effects_and_answers(spark):
    from finstrata.functions import json_text
    from finstrata.operators import documents, scoring

    df = spark.createDataFrame([(1, "Revenue", None, None), (2, "Wind", None, "CO2 emissions by site"), (3, "Wind", None, "Operating segments: emissions"), (4, "Net  Sales", "net sales", None), (5, "Net Sales", "by segment", "Net sales of each segment"), (6, None, None, None)], "id int, n string, m string, p string")
    none = F.lit(None).cast("string")
    assert {r.id: r.x for r in df.select("id", documents.rejection(F.col("n"), F.col("m"), none, none, F.col("p")).alias("x")).collect()} == {1: "generic_revenue", 2: "other_disclosure", 3: None, 4: "generic_revenue", 5: None, 6: None}
    effects = spark.createDataFrame([(0.9, 0.3, False), (0.9, 0.6, True), (0.9, 0.9, True), (-0.9, 0.9, True), (0.2, None, None), (None, 0.9, True)], "e double, c double, s boolean")
    assert [r.x for r in effects.select(scoring.limited_by_confidence(F.col("e"), F.col("c"), F.col("s")).alias("x")).collect()] == [0.1, 0.25, 0.9, -0.5, 0.2, None]
    answers = spark.createDataFrame([('{"c": 1.5, "t": " "}',), ('{"c": "high", "t": "x"}',), ('{"c": 1}',), ("no json",), (None,)], "a string")
    assert [r.x for r in answers.select(json_text.value_errors(F.col("a"), ["c"], ["t"]).alias("x")).collect()] == [["not a share c", "empty t"], ["not a share c"], [], [], []]
