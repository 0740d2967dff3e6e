"""The stages one after another on the smallest tables."""

import json

from pyspark.sql import functions as F

from finstrata.operators import documents
from finstrata.plans import pipeline
from finstrata.runtime import table
from finstrata.sources import providers


def test_pages_to_metrics(spark, tiny):
    parsed, docs = table(spark, tiny, "parsed_pages"), table(spark, tiny, "report_documents")
    stages = pipeline.ingest(parsed)
    assert 0 < stages["candidates"].count() <= stages["pages"].count()
    found = pipeline.extract(parsed, stages["candidates"], docs, providers.fake_provider)
    rows = found["rows"].persist()
    assert rows.count() == rows.select("id").distinct().count() > 0
    assert found["answers"].where(F.col("error").isNotNull()).count() == 0
    assert pipeline.classify(rows, table(spark, tiny, "nace_nodes")).where("rank > 5").count() == 0
    assert pipeline.check(rows, docs).count() == docs.count()
    m = pipeline.score_against(rows, rows).first()
    assert m.correct == rows.where("value is not null").count() or m.precision > 0.5


def test_fallback_reader(spark):
    df = spark.createDataFrame([("a", "d", 1), ("b", "d", 2), ("c", "d", 3), ("e", "d", None)], "id string, document_id string, page_number int")

    def reader(document, page):
        if page == 3:
            raise RuntimeError
        return "text" if page == 1 else " "

    assert sorted((r.id, r.status) for r in providers.fallback_texts(df, reader).collect()) == [("a", "applied"), ("b", "attempted_no_text"), ("c", "failed")]


def test_the_provider_is_shown_whole_pages(spark, tiny):
    schema = table(spark, tiny, "parsed_pages").select("id", "document_id", "page_number", "text", "tables").schema
    rows = lambda *names: {"rows": [["Segment", "Revenue"], *([n, "1"] for n in names)]}
    text = "Note 5\n" + "filler words " * 100 + "\nlast line\n"
    parsed = spark.createDataFrame([("a", "d", 1, text, {"tables": [rows(*"ABCDEFGH"), {"rows": []}, rows("I"), rows("J", None)]}), ("b", "d", 2, None, None)], schema)
    docs = spark.createDataFrame([("d", "EUR", "millions")], "id string, currency string, scale string")
    seen = lambda **x: {
        r.id: json.loads(r.answer)["rows"] for r in pipeline.extract(parsed, parsed.select("id"), docs, providers.fake_provider, **x)["answers"].collect()
    }
    assert [r["segment_name"] for r in seen()["a"]] == list("ABCDEFGHIJ")
    assert "last line" in {r.id: r.prompt for r in documents.page_prompts(parsed, 64_000).collect()}["a"]
    # a limit below the page: several prompts, each within it, nothing left out
    shown = pipeline.extract(parsed, parsed.select("id"), docs, providers.fake_provider, providers.Limits(200))["answers"].where("id = 'a'").collect()
    assert len(shown) > 1 and all(r.chars_in <= 200 for r in shown)
    assert sorted(x["segment_name"] for r in shown for x in json.loads(r.answer)["rows"]) == list("ABCDEFGHIJ")


def test_prompt_parts_hold_every_word():
    text = "\n".join([*(f"line {i}" for i in range(200)), " ".join(f"w{i}" for i in range(300)), "q" * 500])
    tables = ["Table 0\nSegment | Revenue\n" + "\n".join(f"S{i} | {i}" for i in range(100)), "Table 1\n" + "y " * 300]
    parts = documents.prompt_parts("Page 1", text, tables, 120)
    assert max(map(len, parts)) <= 120
    words = {w for p in parts for w in p.split()}
    assert {*" ".join(tables).split(), *text.replace("q" * 500, "").split()} <= words and sum(p.count("q") for p in parts) == 500
    assert all("Segment | Revenue" in p for p in parts if "S5 |" in p or "S99 |" in p)
