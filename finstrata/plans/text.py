"""Queries of the text, money, period and page-reference functions over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import money, text
from finstrata.runtime import table

_NUM = "DECIMAL(38,6)"
# the SQL's own way of dropping what isn't ASCII and squeezing blanks
_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def fold_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_rows").select("id", text.fold_ascii(F.col("segment_name_original")).alias("folded"), text.lower_squeezed(F.col("segment_name_original")).alias("squeezed"), text.alnum_words(F.col("segment_name_original")).alias("words"))


def synonym_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_rows").select("id", text.english_meaning(F.col("segment_name_original")).alias("meaning"))


def tokenise_stopwords(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.content_tokens(F.col("text"))
    return table(spark, d, "documents", spread=True).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


def language_by_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", spread=True).select("doc_id", text.marker_language(F.col("text")).alias("marker_language"))


def language_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_rows").select("id", text.label_language(F.col("segment_name_original")).alias("hint"))


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    noted = F.concat(F.lit("call with api_"), F.col("id"), F.lit(" by "), F.coalesce("reviewer", F.lit("?")))
    return table(spark, d, "review_events").select("id", text.redact(noted, ["reviewer_01"]).alias("shown")).distinct()


def money_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_rows").select("id", money.parse_money(F.col("revenue_raw")).alias("amount"))


def scale_currency_resolve(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat_ws(" ", "revenue_raw", "currency", "scale")
    row_scale = F.coalesce(money.scale_of(F.col("revenue_raw")), money.scale_of(F.col("scale")))
    return table(spark, d, "segment_rows").select(
        "id", money.currency_of(shown).alias("currency_found"), row_scale.alias("scale_found"),
        money.scaled(F.col("revenue_value"), row_scale).alias("scaled_strict"), money.scaled(F.col("revenue_value"), row_scale, 1).alias("scaled_lenient"),
    )


def period_label_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.coalesce("period_label", F.lit(""))
    return table(spark, d, "segment_rows").select("id", money.period_label(raw).alias("label"), money.period_key(F.col("period_label")).alias("key"), money.latest_year(raw).cast("int").alias("year"))


def page_ref_parse(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("page_ref")
    return table(spark, d, "segment_rows").select("id", money.page_of(ref).alias("page"), money.page_digits(ref).alias("digits"), money.page_label(ref).alias("label"))


def value_tolerance(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_rows")
    return s.select("id", money.values_match(F.col("normalized_value"), money.scaled(F.col("revenue_value"), F.col("scale"), 1)).alias("agrees"))


_MEANINGS_SQL = "trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(strip_accents(segment_name_original)), '[—–]', ' ', 'g'), 'ß', 'ss'), '[^a-z0-9&/,+.\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
for _f, _e in text.MEANINGS.items():
    _MEANINGS_SQL = f"regexp_replace({_MEANINGS_SQL}, '\\b{_f}\\b', '{_e}', 'g')"
_MEANINGS_SQL = _SQUEEZE.format(_MEANINGS_SQL)


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


_CURRENCY_SQL = "CASE " + " ".join(
    f"WHEN contains(s, '{m}') THEN '{c}'" if m in "$€£" else f"WHEN regexp_matches(upper(s), '(^|[^A-Z]){m.replace('$', chr(92) + '$')}([^A-Z]|$)') THEN '{c}'" for m, c in money.CURRENCY_MARKS
) + " WHEN regexp_matches(upper(s), '\\bUS\\s+DOLLARS?\\b|\\bU\\.S\\.\\s+DOLLARS?\\b') THEN 'USD' WHEN regexp_matches(upper(s), '\\bSAUDI\\s+(ARABIAN\\s+)?RIYALS?\\b') THEN 'SAR' END"


def _scale_sql(c: str) -> str:
    t = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return (
        f"CASE WHEN regexp_matches({t}, '\\b(actuals?|ones|units?)\\b|\\bin\\s+(whole\\s+)?(dollars?|euros?|pounds?)\\b') THEN 'actuals'"
        f" WHEN regexp_matches({t}, '\\b(thousands?|000s?|k)\\b|[''`]000|\\$000|eur000|gbp000|usd000') THEN 'thousands'"
        f" WHEN regexp_matches({t}, '\\b(millions?|mn)\\b|m\\b') THEN 'millions' WHEN regexp_matches({t}, '\\b(billions?|bn)\\b|b\\b') THEN 'billions' END"
    )


_TIMES = "CASE {s} WHEN 'actuals' THEN 1 WHEN 'ones' THEN 1 WHEN 'thousands' THEN 1000 WHEN 'millions' THEN 1000000 WHEN 'billions' THEN 1000000000 ELSE {e} END"
_MONEY_SQL = f"""
WITH a AS (SELECT id, trim(regexp_replace(revenue_raw, '[–—−]', '-', 'g')) AS t FROM segment_rows),
b AS (SELECT id, regexp_matches(t, '^\\(.*\\)$') AS br, CASE WHEN regexp_matches(t, '^\\(.*\\)$') THEN substr(t, 2, length(t) - 2) ELSE t END AS t FROM a),
c AS (SELECT id, br, trim(regexp_replace(regexp_replace(t, '(?i)\\b(usd|eur|gbp|chf|dkk|sek|nok|cad|aud|jpy|cny|rmb|hkd|sar|millions?|billions?|thousands?|actuals?|mn|bn)\\b', '', 'g'), '[$€£''' || chr(160) || ']', '', 'g')) AS t FROM b),
e AS (SELECT id, br OR starts_with(t, '-') OR regexp_matches(t, '\\d.*-$') AS neg, regexp_replace(t, '[^0-9,.]', '', 'g') AS n FROM c),
f AS (SELECT id, neg, CASE WHEN contains(n, ',') AND contains(n, '.') THEN CASE WHEN length(n) - strpos(reverse(n), ',') > length(n) - strpos(reverse(n), '.') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END
  WHEN contains(n, ',') AND regexp_matches(n, ',\\d{{1,2}}$') AND NOT regexp_matches(n, ',\\d{{3}}(,|$)') THEN replace(n, ',', '.') ELSE replace(n, ',', '') END AS n FROM e)
SELECT id, CAST(CASE WHEN neg THEN -TRY_CAST(nullif(n, '') AS {_NUM}) ELSE TRY_CAST(nullif(n, '') AS {_NUM}) END AS {_NUM}) AS amount FROM f"""

QUERIES = {f.__name__: f for f in (fold_ascii, synonym_normalise, tokenise_stopwords, language_by_markers, language_first_hit, redact_secrets, money_parse, scale_currency_resolve, period_label_norm, page_ref_parse, value_tolerance)}
_STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS_SQL = f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL})))"
SQL = {
    "fold_ascii": f"SELECT id, trim(regexp_replace(lower(regexp_replace(strip_accents(segment_name_original), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g')) AS folded, {_SQUEEZE.format('lower(segment_name_original)')} AS squeezed, trim(regexp_replace(lower(segment_name_original), '[^a-z0-9]+', ' ', 'g')) AS words FROM segment_rows",
    "synonym_normalise": f"SELECT id, {_MEANINGS_SQL} AS meaning FROM segment_rows",
    "tokenise_stopwords": f"SELECT doc_id, CAST(len({_TOKENS_SQL}) AS BIGINT) AS n_tokens, array_to_string(list_sort({_TOKENS_SQL}), ' ') AS tokens FROM documents",
    "language_by_markers": "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS ws FROM documents), "
    "c AS (SELECT doc_id, [" + ", ".join(f"{{'n': len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in words)}))), 'c': '{c}'}}" for c, words in text.MARKERS.items()) + "] AS k FROM w), "
    "m AS (SELECT doc_id, k, list_max(list_transform(k, lambda x: x.n)) AS top FROM c) "
    "SELECT doc_id, CASE WHEN top > 0 AND len(list_filter(k, lambda x: x.n = top)) = 1 THEN list_filter(k, lambda x: x.n = top)[1].c ELSE 'unknown' END AS marker_language FROM m",
    "language_first_hit": "WITH a AS (SELECT id, " + _MEANINGS_SQL + " AS m, trim(regexp_replace(lower(strip_accents(segment_name_original)), '\\s+', ' ', 'g')) AS p FROM segment_rows) "
    "SELECT id, CASE WHEN m = '' THEN NULL " + " ".join(f"WHEN {_any('p', hints)} THEN '{c}'" for c, hints in text.LANGUAGE_HINTS) + " ELSE 'en' END AS hint FROM a",
    "redact_secrets": "SELECT DISTINCT id, replace(regexp_replace('call with api_' || id || ' by ' || coalesce(reviewer, '?'), '(?i)\\b(sk|pk|api|key|token)[-_][A-Za-z0-9_\\-]{8,}', '[redacted]', 'g'), 'reviewer_01', '[redacted]') AS shown FROM review_events",
    "money_parse": _MONEY_SQL,
    "scale_currency_resolve": f"""WITH a AS (SELECT id, concat_ws(' ', revenue_raw, currency, scale) AS s, coalesce({_scale_sql('revenue_raw')}, {_scale_sql('scale')}) AS k, revenue_value AS v FROM segment_rows)
SELECT id, {_CURRENCY_SQL} AS currency_found, k AS scale_found, CAST(v * {_TIMES.format(s='k', e='NULL')} AS {_NUM}) AS scaled_strict, CAST(v * {_TIMES.format(s='coalesce(k, '')', e='1')} AS {_NUM}) AS scaled_lenient FROM a""",
    "period_label_norm": """WITH a AS (SELECT id, period_label, trim(regexp_replace(coalesce(period_label, ''), '\\s+', ' ', 'g')) AS t FROM segment_rows),
b AS (SELECT *, list_max(list_transform(list_filter(regexp_extract_all(t, '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d{2}')), lambda x: CAST(x AS INT))) AS y, regexp_extract(lower(trim(coalesce(period_label, ''))), '((?:19|20)\\d{2})', 1) AS f FROM a)
SELECT id, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '(?i)\\b(Q[1-4])\\s*(FY)?\\s*((19|20)\\d{2})\\b') THEN upper(regexp_extract(t, '(?i)\\b(Q[1-4])', 1)) || ' ' || regexp_extract(t, '(?i)\\bQ[1-4]\\s*(?:FY)?\\s*((?:19|20)\\d{2})\\b', 1) WHEN y IS NOT NULL THEN 'FY' || y ELSE t END AS label,
CASE WHEN f <> '' THEN f ELSE regexp_replace(lower(trim(coalesce(period_label, ''))), '[^a-z0-9]+', '', 'g') END AS key, CAST(y AS INT) AS year FROM b""",
    "page_ref_parse": """WITH a AS (SELECT id, page_ref, list_transform(regexp_extract_all(page_ref, '\\d+'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)) AS n FROM segment_rows)
SELECT id, CAST(n[1] AS INT) AS page, CAST(nullif(regexp_replace(page_ref, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits,
CASE WHEN len(n) >= 2 AND regexp_matches(page_ref, '(?i)\\b(pp|pages?)\\b|[-–—]') THEN 'pp. ' || n[1] || '-' || n[2] WHEN len(n) >= 1 THEN 'p. ' || n[1] END AS label FROM a""",
    "value_tolerance": f"""WITH a AS (SELECT id, CAST(normalized_value AS {_NUM}) AS a, CAST(revenue_value * {_TIMES.format(s="lower(trim(coalesce(scale, '')))", e='1')} AS {_NUM}) AS b FROM segment_rows)
SELECT id, coalesce(abs(a - b) <= 1 OR abs(a - b) <= greatest(abs(a), abs(b), 1) * 0.005, false) AS agrees FROM a""",
}
