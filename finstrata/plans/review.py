"""Queries of evaluation, change logs, stored tables, scores and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import json_text, money
from finstrata.functions.text import alnum_words
from finstrata.operators import evaluate, export, rows, scoring, store
from finstrata.runtime import table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two readings of one fact for matching: prepared rows as labels, segment rows as predictions."""
    gold = table(spark, d, "prepared_rows").select(F.col("row_id").alias("gold_id"), "document_id", F.col("segment_name").alias("g_name"), F.col("normalized_value").alias("g_value"), money.period_key(F.col("fiscal_period")).alias("g_period"), F.col("page_number").alias("g_page"))
    pred = table(spark, d, "segment_rows").select(F.col("id").alias("pred_id"), "document_id", F.col("segment_name").alias("p_name"), F.col("normalized_value").alias("p_value"), money.period_key(F.col("period_label")).alias("p_period"), money.page_of(F.col("page_ref")).alias("p_page"))
    return gold, pred


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _sides(spark, d)
    return evaluate.candidate_pairs(gold, pred, "document_id", evaluate.token_similarity(F.col("g_name"), F.col("p_name")), money.values_match(F.col("g_value"), F.col("p_value")), F.col("g_period") == F.col("p_period"), F.col("g_page") == F.col("p_page"))


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("gold_id", "pred_id", "similarity", "score")


def pair_match_greedy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.greedy_matches(_pairs(spark, d), "document_id").select("gold_id", "pred_id")


def pair_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _sides(spark, d)
    close = gold.join(pred, "document_id").where(evaluate.may_be_similar(F.col("g_name"), F.col("p_name"), 0.68))
    return close.select("gold_id", "pred_id", F.round(evaluate.fuzzy_similarity(F.col("g_name"), F.col("p_name")), 4).alias("similarity")).where("similarity >= 0.68")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _sides(spark, d)
    return evaluate.outcomes(gold, pred, evaluate.greedy_matches(_pairs(spark, d), "document_id"), "document_id")


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(_outcomes(spark, d))


def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.failure_examples(_outcomes(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered event once."""
    return rows.first_by(table(spark, d, "review_events"), ["id"], ["ingested_at", "event_at"])


def diff_to_events(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "segment_rows").select("id", "currency", "scale", "period_label")
    changed = rows.latest_by(_events(spark, d).where(F.col("field_changed") == "currency").select("segment_id", "new_value", "event_at", "id"), ["segment_id"], ["event_at", "id"]).select(F.col("segment_id").alias("id"), F.col("new_value").alias("currency"))
    return store.changes_between(old, store.update(old, changed, "id", ["currency"]), "id", ["currency", "scale", "period_label"])


def upsert_selection(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where(F.col("segment_id").isNotNull()).select("segment_id", "reviewer", "event_at")
    cutoff = F.lit("2025-01-01").cast("timestamp")
    return store.upsert(e.where(F.col("event_at") < cutoff), e.where(F.col("event_at") >= cutoff), ["segment_id"], ["event_at", "reviewer"]).select("segment_id", "reviewer")


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "segment_rows").select("document_id").distinct()
    return store.insert_if_absent(have, table(spark, d, "prepared_rows").select("document_id").distinct(), ["document_id"])


def replace_group(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "segment_rows").select("document_id", F.col("id").alias("row_id"), F.col("normalized_value").alias("value"))
    new = table(spark, d, "prepared_rows").where(F.col("extractor") == "manual_entry").select("document_id", "row_id", F.col("normalized_value").alias("value"))
    return store.replace_groups(old, new, ["document_id"])


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    docs, segments = table(spark, d, "report_documents"), table(spark, d, "segment_rows")
    parents, children = store.cascade_delete(docs, segments, docs.where(F.col("status") == "rejected"), "id", "document_id")
    _, nulled = store.cascade_delete(segments, _events(spark, d), segments.where(F.col("status") == "rejected"), "id", "segment_id", set_null=True)
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows")
    return counted(parents, "parents").unionByName(counted(children, "children")).unionByName(counted(nulled.where(F.col("segment_id").isNull()), "without parent"))


def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "report_documents").where(F.col("status") != "rejected")
    return store.orphan_rows(table(spark, d, "segment_rows"), kept, "document_id", "id").select("id", "document_id")


def replayed_field_state(spark: SparkSession, d: str) -> DataFrame:
    """The value of each field of each segment after all edits of the log."""
    e = _events(spark, d).where(F.col("segment_id").isNotNull() & F.col("field_changed").isNotNull()).select("segment_id", "field_changed", "new_value", "event_at", "id")
    return rows.latest_by(e, ["segment_id", "field_changed"], ["event_at", "id"]).select("segment_id", "field_changed", "new_value")


def review_state_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scoring.state_rollup(table(spark, d, "segment_rows"), "document_id", F.col("status").isin("approved", "edited", "rejected"))


def weighted_company_score(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows")
    return scoring.weighted_average(s, "document_id", F.col("confidence") * 4 + 1, F.col("normalized_value"))


def weight_share(spark: SparkSession, d: str) -> DataFrame:
    return scoring.weight_share(table(spark, d, "segment_rows").select("id", "document_id", "normalized_value"), "document_id", F.col("normalized_value")).select("id", "share")


def base_score_cascade(spark: SparkSession, d: str) -> DataFrame:
    keys = [("code", F.col("nace_code"), {"01.11": 4.3, "02.12": 2.4, "08.21": 3.1}), ("division", F.regexp_extract("nace_code", r"^(\d{2})", 1), {"01": 3.9, "15": 2.1, "22": 2.8}), ("currency", F.coalesce("currency", F.lit("?")), {"EUR": 3.3})]
    return table(spark, d, "gold_rows").select("gold_id", scoring.cascade(keys, 3.0).alias("s")).select("gold_id", "s.score", "s.source")


def clustered_adjustment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cluster", F.floor(F.col("value") / 50).cast("long"))
    signed = F.when(F.col("event_type") == "purchase", -F.round("value", 4)).otherwise(F.round("value", 4)) / 100
    return scoring.clustered_sum(e, "user_id", "cluster", F.round(signed, 4), ["event_id"], -0.75, 1.0).select("user_id", F.col("total").cast("decimal(12,4)").alias("total"), "n_clusters")


def mode_alpha_tie(spark: SparkSession, d: str) -> DataFrame:
    return scoring.mode_alphabetical(table(spark, d, "segment_rows"), "document_id", "language")


def nested_audit_json(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "report_documents").select("id", "company_name", "currency")
    segments = table(spark, d, "segment_rows").select("id", "document_id", "segment_name", "status").withColumnRenamed("id", "row_id")
    nested = export.nest(docs, segments, "id", "document_id", "rows", ["segment_name", "status"], ["row_id"])
    return nested.select("id", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["row_id"], F.coalesce(r["status"], F.lit("")))), ",").alias("listed"))


def wide_export_projection(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").alias("s").where(F.col("status") != "rejected")
    docs = table(spark, d, "report_documents").select(F.col("id").alias("_d"), "document_name", "company_name")
    notes = latest_note(spark, d)
    wide = s.join(docs, F.col("document_id") == F.col("_d"), "left").join(notes, F.col("id") == F.col("segment_id"), "left")
    unit = F.concat_ws(" ", F.nullif(F.col("currency"), F.lit("")), F.nullif(F.col("scale"), F.lit("")))
    return export.text_columns(wide.withColumn("unit", unit), ["id", "document_name", "company_name", "segment_name", "unit", "period_label", "page_ref", "status", "note"])


def latest_note(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where(F.col("segment_id").isNotNull() & (F.trim("note") != "")).select("segment_id", "note", "event_at", "id")
    return rows.latest_by(e, ["segment_id"], ["event_at", "id"]).select("segment_id", "note")


def string_agg_summary(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").where(F.col("segment_type").isNotNull()).select("document_id", "segment_type").distinct()
    return s.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("segment_type")), " | ").alias("types"))


def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "segment_rows").select("document_id").distinct()
    b = table(spark, d, "prepared_rows").select("document_id").distinct()
    tag = lambda df, t: df.select("document_id", F.lit(t).alias("part"))
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "first")).unionByName(tag(b.exceptAll(a), "second")).unionByName(tag(a.union(b).distinct(), "any"))


def exact_dup_documents(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.sha2(alnum_words(F.coalesce("text", F.lit(""))), 256).alias("h"))
    groups = w.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return w.join(groups, "h").select("doc_id", "first_doc", "copies")


def inner_child_parent(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").select(F.col("id").alias("segment_id"), "document_id")
    return _events(spark, d).select("id", "segment_id").join(s, "segment_id").select("id", "segment_id", "document_id")


def semi_anti_bundle_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows").select("id", "document_id", money.page_of(F.col("page_ref")).alias("page_number"))
    p = table(spark, d, "parsed_pages").select("document_id", "page_number")
    on = ["document_id", "page_number"]
    return s.join(p, on, "left_semi").select("id", F.lit("found").alias("part")).unionByName(s.join(p, on, "left_anti").select("id", F.lit("elsewhere").alias("part")))


def json_strict_schema(spark: SparkSession, d: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{\"x\": 1, "), F.substring("props", 2, 1000))).when(F.col("event_id") % 7 == 0, F.lit("{}")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(json_text.schema_errors(broken, ["k"])), "; ").alias("errors"), F.get_json_object(broken, "$.k").alias("k"))


def json_recover(spark: SparkSession, d: str) -> DataFrame:
    fence = F.lit("```")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n"), fence, F.lit("json\n"), "props", F.lit("\n"), fence)).otherwise(F.concat(F.lit("The answer is "), F.col("props"), F.lit(" as asked {")))
    return table(spark, d, "events").select("event_id", json_text.recover_json(answer).alias("body"))


def column_letters(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 800).select("id", export.column_letters_expr(F.col("id")).alias("letters"))


def usage_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def events_session(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def fifo_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the order in which a worker each would take them: by creation, then id."""
    from pyspark.sql import Window as W

    w = W.partitionBy("worker").orderBy("created_at", "id")
    docs = table(spark, d, "report_documents").where(F.col("status") == "new").select("id", "created_at", (F.substring("id", -1, 1).cast("int") % 4).alias("worker"))
    return docs.withColumn("turn", F.row_number().over(w).cast("long")).where("turn <= 5").select("id", "worker", "turn")


QUERIES = {
    f.__name__: f for f in (
        pair_scores, pair_match_greedy, pair_match_fuzzy, eval_metrics, failure_taxonomy, diff_to_events, upsert_selection, insert_if_absent, replace_group, cascade_delete, orphan_check, replayed_field_state,
        review_state_rollup, weighted_company_score, weight_share, base_score_cascade, clustered_adjustment, mode_alpha_tie, nested_audit_json, wide_export_projection, string_agg_summary, set_algebra,
        exact_dup_documents, inner_child_parent, semi_anti_bundle_split, json_strict_schema, json_recover, column_letters, usage_tokens, events_tumbling, events_session, fifo_batches,
    )
}

_KEY = "CASE WHEN regexp_matches(lower(trim(coalesce({0}, ''))), '(19|20)\\d{{2}}') THEN regexp_extract(lower(trim(coalesce({0}, ''))), '((?:19|20)\\d{{2}})', 1) ELSE regexp_replace(lower(trim(coalesce({0}, ''))), '[^a-z0-9]+', '', 'g') END"
_ALNUM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SING = "list_distinct(list_transform(string_split({}, ' '), lambda w: CASE WHEN length(w) > 3 AND regexp_matches(w, '[^s]s$') THEN substr(w, 1, length(w) - 1) ELSE w END))"
_PAIRS = f"""g AS (SELECT row_id AS gold_id, document_id, {_ALNUM.format('segment_name')} AS ga, normalized_value AS gv, {_KEY.format('fiscal_period')} AS gp, page_number AS gg FROM prepared_rows),
p AS (SELECT id AS pred_id, document_id, {_ALNUM.format('segment_name')} AS pa, normalized_value AS pv, {_KEY.format('period_label')} AS pp, CAST(nullif(regexp_extract(page_ref, '(\\d+)', 1), '') AS INT) AS pg FROM segment_rows),
j AS (SELECT gold_id, pred_id, document_id, ga, pa, {_SING.format('ga')} AS gt, {_SING.format('pa')} AS pt, coalesce(abs(gv - pv) <= 1 OR abs(gv - pv) <= greatest(abs(gv), abs(pv), 1) * 0.005, false) AS v, gp = pp AS q, gg = pg AS h FROM g JOIN p USING (document_id)),
k AS (SELECT *, len(list_intersect(gt, pt)) AS b, len(list_intersect(gt, pt)) / greatest(len(gt), len(pt)) AS sh FROM j),
m AS (SELECT gold_id, pred_id, document_id, v, q, h, CAST(CASE WHEN ga = '' OR pa = '' THEN 0 WHEN ga = pa THEN 1 WHEN b = len(gt) OR b = len(pt) THEN greatest(0.84, sh) ELSE sh END AS DECIMAL(8,6)) AS similarity FROM k),
pairs AS (SELECT *, CAST(round(similarity * 0.55 + CASE WHEN v THEN 0.25 ELSE 0 END + CASE WHEN q THEN 0.15 ELSE 0 END + CASE WHEN h IS NULL THEN 0.025 WHEN h THEN 0.05 ELSE 0 END, 6) AS DECIMAL(10,6)) AS score FROM m WHERE similarity >= 0.68)"""
_MATCH = _PAIRS + """, pp AS (SELECT * FROM pairs WHERE score >= 0.62),
l AS (SELECT document_id, list(gold_id || '|' || pred_id ORDER BY score DESC, gold_id, pred_id) AS xs FROM pp GROUP BY 1),
f AS (SELECT document_id, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(xs, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: split_part(y, '|', 1) = split_part(x[1], '|', 1) OR split_part(y, '|', 2) = split_part(x[1], '|', 2))) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS kept FROM l),
mt AS (SELECT split_part(u, '|', 1) AS gold_id, split_part(u, '|', 2) AS pred_id FROM (SELECT unnest(kept) AS u FROM f))"""
_OUT = _MATCH + """, o AS (SELECT g.document_id, g.gold_id, mt.pred_id, CASE WHEN mt.pred_id IS NULL THEN 'missing_segment' WHEN NOT pp.v THEN 'wrong_value' WHEN NOT coalesce(pp.q, false) THEN 'wrong_period' ELSE 'none' END AS failure FROM g LEFT JOIN mt USING (gold_id) LEFT JOIN pp ON pp.gold_id = mt.gold_id AND pp.pred_id = mt.pred_id
UNION ALL SELECT document_id, NULL, pred_id, 'extra_segment' FROM p WHERE pred_id NOT IN (SELECT pred_id FROM mt))"""
_EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, event_at) AS dk FROM review_events) WHERE dk = 1)"
SQL = {
    "pair_scores": f"WITH {_PAIRS} SELECT gold_id, pred_id, similarity, score FROM pairs WHERE score >= 0.62",
    "pair_match_greedy": f"WITH {_MATCH} SELECT gold_id, pred_id FROM mt",
    "eval_metrics": f"WITH {_OUT}, c AS (SELECT count(*) FILTER (failure = 'none') AS correct, count(pred_id) AS n_predicted, count(gold_id) AS n_gold FROM o) SELECT correct, n_predicted, n_gold, round(coalesce(correct / nullif(n_predicted, 0), 0), 6) AS precision, round(coalesce(correct / nullif(n_gold, 0), 0), 6) AS recall, round(coalesce(2 * correct / nullif(n_predicted + n_gold, 0), 0), 6) AS f1 FROM c",
    "failure_taxonomy": f"WITH {_OUT}, x AS (SELECT failure, coalesce(gold_id, pred_id) AS e FROM o WHERE failure <> 'none'), y AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY e) AS k, count(*) OVER (PARTITION BY failure) AS n FROM x) SELECT failure, string_agg(e, ' | ' ORDER BY e) AS examples, any_value(n) AS n FROM y WHERE k <= 5 GROUP BY failure",
    "diff_to_events": f"WITH {_EV}, c AS (SELECT segment_id, new_value FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY event_at DESC, id DESC) AS k FROM ev WHERE field_changed = 'currency') WHERE k = 1) SELECT s.id, 'currency' AS field_changed, currency AS old_value, coalesce(new_value, currency) AS new_value FROM segment_rows s LEFT JOIN c ON segment_id = s.id WHERE currency IS DISTINCT FROM coalesce(new_value, currency)",
    "upsert_selection": f"WITH {_EV} SELECT segment_id, reviewer FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY event_at DESC, reviewer DESC) AS k FROM ev WHERE segment_id IS NOT NULL) WHERE k = 1",
    "insert_if_absent": "SELECT document_id FROM segment_rows UNION SELECT document_id FROM prepared_rows",
    "replace_group": "WITH n AS (SELECT document_id, row_id, normalized_value AS value FROM prepared_rows WHERE extractor = 'manual_entry') SELECT document_id, id AS row_id, normalized_value AS value FROM segment_rows WHERE document_id NOT IN (SELECT document_id FROM n) UNION ALL SELECT * FROM n",
    "cascade_delete": f"WITH {_EV}, r AS (SELECT id FROM report_documents WHERE status = 'rejected'), q AS (SELECT id FROM segment_rows WHERE status = 'rejected') SELECT 'parents' AS part, count(*) AS n_rows FROM report_documents WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'children', count(*) FROM segment_rows WHERE document_id NOT IN (SELECT id FROM r) UNION ALL SELECT 'without parent', count(*) FROM ev WHERE segment_id IS NULL OR segment_id IN (SELECT id FROM q)",
    "orphan_check": "SELECT id, document_id FROM segment_rows s WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM report_documents r WHERE r.id = s.document_id AND r.status <> 'rejected')",
    "replayed_field_state": f"WITH {_EV} SELECT segment_id, field_changed, new_value FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, field_changed ORDER BY event_at DESC, id DESC) AS k FROM ev WHERE segment_id IS NOT NULL AND field_changed IS NOT NULL) WHERE k = 1",
    "review_state_rollup": "SELECT document_id, count(*) AS n_rows, count(*) FILTER (status IN ('approved', 'edited', 'rejected')) AS n_done, bool_and(coalesce(status IN ('approved', 'edited', 'rejected'), false)) AS all_done, round(count(*) FILTER (status IN ('approved', 'edited', 'rejected')) / count(*), 4) AS share_done FROM segment_rows GROUP BY 1",
    "weighted_company_score": "WITH a AS (SELECT document_id, CAST(confidence * 4 + 1 AS DECIMAL(10,4)) AS s, CAST(normalized_value AS DECIMAL(20,6)) AS w FROM segment_rows), b AS (SELECT document_id, s, w, w > 0 AND s IS NOT NULL AS ok FROM a) SELECT document_id, round(CAST(sum(CASE WHEN ok THEN CAST(s AS DECIMAL(12,4)) * w END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN ok THEN w END) AS DOUBLE), 0), 6) AS weighted_score, round(CAST(sum(CASE WHEN ok THEN w END) AS DOUBLE), 4) AS total_weight, count(*) FILTER (ok) AS n_weighted FROM b GROUP BY 1",
    "weight_share": "WITH a AS (SELECT id, document_id, CASE WHEN normalized_value > 0 THEN CAST(normalized_value AS DECIMAL(20,6)) END AS v FROM segment_rows) SELECT id, round(CAST(v AS DOUBLE) / nullif(CAST(sum(v) OVER (PARTITION BY document_id) AS DOUBLE), 0), 6) AS share FROM a",
    "base_score_cascade": "SELECT gold_id, CASE WHEN nace_code = '01.11' THEN 4.3 WHEN nace_code = '02.12' THEN 2.4 WHEN nace_code = '08.21' THEN 3.1 WHEN regexp_extract(nace_code, '^(\\d{2})', 1) = '01' THEN 3.9 WHEN regexp_extract(nace_code, '^(\\d{2})', 1) = '15' THEN 2.1 WHEN regexp_extract(nace_code, '^(\\d{2})', 1) = '22' THEN 2.8 WHEN currency = 'EUR' THEN 3.3 ELSE 3.0 END::DOUBLE AS score, CASE WHEN nace_code IN ('01.11', '02.12', '08.21') THEN 'code' WHEN regexp_extract(nace_code, '^(\\d{2})', 1) IN ('01', '15', '22') THEN 'division' WHEN currency = 'EUR' THEN 'currency' ELSE 'default' END AS source FROM gold_rows",
    "clustered_adjustment": "WITH a AS (SELECT user_id, event_id, CAST(floor(value / 50) AS BIGINT) AS c, CAST(round(CASE WHEN event_type = 'purchase' THEN -round(value, 4) ELSE round(value, 4) END / 100, 4) AS DECIMAL(12,6)) AS e FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY abs(e) DESC, event_id DESC) AS k FROM a) SELECT user_id, CAST(greatest(-0.75, least(1.0, sum(e))) AS DECIMAL(12,4)) AS total, count(*) AS n_clusters FROM b WHERE k = 1 GROUP BY 1",
    "mode_alpha_tie": "SELECT document_id, language AS mode FROM (SELECT document_id, language, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, language) AS k FROM segment_rows WHERE language IS NOT NULL GROUP BY 1, 2) WHERE k = 1",
    "nested_audit_json": "SELECT d.id, count(s.id) AS n_rows, coalesce(string_agg(s.id || ':' || coalesce(s.status, ''), ',' ORDER BY s.id), '') AS listed FROM report_documents d LEFT JOIN segment_rows s ON s.document_id = d.id GROUP BY d.id",
    "wide_export_projection": f"WITH {_EV}, n AS (SELECT segment_id, note FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY event_at DESC, id DESC) AS k FROM ev WHERE segment_id IS NOT NULL AND trim(note) <> '') WHERE k = 1) SELECT s.id, coalesce(document_name, '') AS document_name, coalesce(company_name, '') AS company_name, coalesce(segment_name, '') AS segment_name, concat_ws(' ', nullif(s.currency, ''), nullif(s.scale, '')) AS unit, coalesce(period_label, '') AS period_label, coalesce(page_ref, '') AS page_ref, s.status, coalesce(note, '') AS note FROM segment_rows s LEFT JOIN report_documents d ON d.id = s.document_id LEFT JOIN n ON n.segment_id = s.id WHERE s.status <> 'rejected'",
    "string_agg_summary": "SELECT document_id, string_agg(segment_type, ' | ' ORDER BY segment_type) AS types FROM (SELECT DISTINCT document_id, segment_type FROM segment_rows WHERE segment_type IS NOT NULL) GROUP BY 1",
    "set_algebra": "WITH a AS (SELECT DISTINCT document_id FROM segment_rows), b AS (SELECT DISTINCT document_id FROM prepared_rows) SELECT document_id, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT document_id, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT document_id, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT document_id, 'any' FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "exact_dup_documents": f"WITH w AS (SELECT doc_id, {_ALNUM.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS k FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_doc, count(*) OVER (PARTITION BY k) AS copies FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1",
    "inner_child_parent": f"WITH {_EV} SELECT ev.id, segment_id, s.document_id FROM ev JOIN segment_rows s ON s.id = segment_id",
    "semi_anti_bundle_split": "WITH s AS (SELECT id, document_id, CAST(nullif(regexp_extract(page_ref, '(\\d+)', 1), '') AS INT) AS p FROM segment_rows) SELECT id, CASE WHEN EXISTS (SELECT 1 FROM parsed_pages t WHERE t.document_id = s.document_id AND t.page_number = s.p) THEN 'found' ELSE 'elsewhere' END AS part FROM s",
    "json_strict_schema": "WITH a AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{\"x\": 1, ' || substr(props, 2) WHEN event_id % 7 = 0 THEN '{}' ELSE props END AS b FROM events) SELECT event_id, array_to_string(list_sort(list_concat(list_transform(list_filter(['k'], lambda x: NOT list_contains(json_keys(b), x)), lambda x: 'missing ' || x), list_transform(list_filter(json_keys(b), lambda x: x <> 'k'), lambda x: 'extra ' || x))), '; ') AS errors, json_extract_string(b, '$.k') AS k FROM a",
    "json_recover": "SELECT event_id, props AS body FROM events",
    "column_letters": "SELECT i AS id, CASE WHEN i <= 26 THEN chr(CAST(64 + i AS INT)) WHEN i <= 702 THEN chr(CAST(64 + (i - 1) // 26 AS INT)) || chr(CAST(65 + (i - 1) % 26 AS INT)) ELSE chr(CAST(64 + (i - 27) // 676 AS INT)) || chr(CAST(65 + ((i - 27) // 26) % 26 AS INT)) || chr(CAST(65 + (i - 1) % 26 AS INT)) END AS letters FROM range(1, 800) t(i)",
    "usage_tokens": "SELECT source, CAST(sum(greatest(1, ceil(length(coalesce(text, '')) / 4))) AS BIGINT) AS tokens, count(*) AS calls FROM documents GROUP BY 1",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2",
    "events_session": "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k",
    "fifo_batches": "SELECT id, CAST(right(id, 1) AS INT) % 4 AS worker, k AS turn FROM (SELECT id, row_number() OVER (PARTITION BY CAST(right(id, 1) AS INT) % 4 ORDER BY created_at, id) AS k FROM report_documents WHERE status = 'new') WHERE k <= 5",
}
