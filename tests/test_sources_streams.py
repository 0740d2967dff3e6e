"""Sources and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from finstrata import schemas
from finstrata.sources import files, providers
from finstrata.streaming import events


def test_text_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first page with quite enough letters to be read\f\fthird")
    got = {r.page_number: r.has_text for r in files.text_pages(spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert files.listed_files(spark, str(tmp_path), "*.txt").first().name == "a.txt"


def test_html(spark):
    df = spark.createDataFrame([("<html><head><title>t</title></head><body><p>Fish &amp; chips</p><script>x()</script><div>two<br>lines</div></body></html>",), (None,)], "html string")
    assert [r.text for r in files.html_pages(df).collect()] == ["Fish & chips\ntwo\nlines", None]


def test_banner_csv(spark, tmp_path):
    header = ",".join(schemas.TAXONOMY_COLUMNS)
    row = "1,section,A,\"Field, forest\",section:A,,A,n,,,,,,,A,\"Field, forest\",7"
    (tmp_path / "n.csv").write_text(f"Outline of activities\n,,,\n{header}\n{row}\n\n9,other,Z,x,k,,,,,,,,,,,,8\n")
    got = files.taxonomy(spark, str(tmp_path / "n.csv")).collect()
    assert [(r.node_code, r.node_name, r.parent_key, r.source_row_number) for r in got] == [("A", "Field, forest", None, 7)]
    (tmp_path / "bad.csv").write_text("no,header\n")
    with pytest.raises(ValueError, match="no line"):
        files.banner_csv(spark, str(tmp_path / "bad.csv"))


def test_gold(spark, tmp_path):
    (tmp_path / "g.csv").write_text("document_name,company_name,fiscal_period,segment_name,revenue_value,currency,scale,page_ref\nd,c,FY,s,1,EUR,ones,p. 1\n,,,,,,,\n")
    got = files.gold_rows(spark, str(tmp_path / "g.csv")).collect()
    assert len(got) == 1 and got[0].notes is None
    (tmp_path / "b.csv").write_text("document_name\nd\n")
    with pytest.raises(ValueError, match="currency"):
        files.gold_rows(spark, str(tmp_path / "b.csv"))


def test_exports_and_formats(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.json").write_text(json.dumps({"document": {"id": "d"}, "segment_rows": [{"id": "s", "current_values": {"segment_name": "n"}}]}))
    got = files.audit_exports(spark, str(tmp_path)).collect()
    assert [(r.document_id, r.segment_id, r.segment_name) for r in got] == [("d", "s", "n")]
    listed = spark.createDataFrame([("f/x/a.json",), ("f/x/a.csv",), ("f/y/b.csv",)], "path string")
    assert sorted(r.path for r in files.prefer_format(listed).collect()) == ["f/x/a.json", "f/y/b.csv"]
    (tmp_path / "c.json").write_text('{"a": 2, "zz": 3}')
    assert files.config(spark, str(tmp_path / "c.json"), {"a": 1.0, "b": 5.0}, {"a": (0, 3)}) == {"a": 2, "b": 5.0}
    with pytest.raises(ValueError):
        files.config(spark, str(tmp_path / "c.json"), {"a": 1.0}, {"a": (0, 1)})


def test_provider(spark):
    df = spark.createDataFrame([("1", "Segment | Revenue | Total\nInsurance | 42 | 42\nTotal | 42 | 42"), ("2", None)], "id string, prompt string")
    got = {r.id: json.loads(r.answer)["rows"] for r in providers.answers(df).collect()}
    assert [x["segment_name"] for x in got["1"]] == ["Insurance"] and got["2"] == []

    def broken(prompt: str) -> str:
        raise RuntimeError("down")

    assert {r.error for r in providers.answers(df, broken).collect()} == {"down"}


def test_streams(spark, tmp_path):
    data = [("e1", "s", "approve", "2024-01-01 00:00:00"), ("e1", "s", "approve", "2024-01-01 00:00:00"), ("e2", "s", "reject", "2024-01-02 00:00:00"), ("e3", "t", "edit", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(data, "id string, segment_id string, action string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: events.read_events(spark, str(tmp_path / "in"), df.schema)
    events.to_table(events.deduplicated(stream(), "id", "at"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    seen = {}
    state = events.current_state(stream(), ["segment_id"], "action", ["at", "id"])
    events.upsert_state(state, str(tmp_path / "c2"), lambda b, n: seen.update({r.segment_id: r.action for r in b.collect()})).awaitTermination()
    assert seen == {"s": "reject", "t": "edit"}
    events.to_table(events.tumbling(stream().withColumn("v", F.lit(1.0)), "at", "1 hour", ["action"], "v"), str(tmp_path / "w"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "w")).count() >= 1
    events.to_table(events.sessions(stream(), "at", "30 minutes", ["segment_id"]), str(tmp_path / "s"), str(tmp_path / "c5")).awaitTermination()
    assert set(spark.read.parquet(str(tmp_path / "s")).columns) == {"start", "end", "segment_id", "n"}
    failures = []
    events.run_jobs(stream(), str(tmp_path / "c4"), lambda b, n: 1 / 0, lambda b, e: failures.append(e)).awaitTermination()
    assert failures == ["division by zero"]


def test_fifo(spark):
    jobs = spark.createDataFrame([("j1", "w", "pending", 2), ("j2", "w", "pending", 1), ("j3", "w", "done", 0)], "id string, worker string, status string, created_at int")
    assert [(r.id, r.status) for r in events.claim_fifo(jobs, 1).collect()] == [("j2", "running")]
