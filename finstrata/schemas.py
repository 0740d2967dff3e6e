"""Schemas of the entities, as Spark types. Amounts are decimal(38,6), times are UTC timestamps."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B, _TS, _M = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.DecimalType(38, 6)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BBOX = _struct(x0=_D, y0=_D, x1=_D, y1=_D)
BLOCKS = _struct(
    page=_struct(width=_D, height=_D, rotation=_I),
    blocks=T.ArrayType(_struct(block_index=_S, block_type=_S, bbox=BBOX, text=_S, parser_source=_S)),
    text_fallback=_struct(status=_S, provider_name=_S, parser_source=_S, reason=_S, error=_S, warnings=T.ArrayType(_S)),
)
TABLES = _struct(tables=T.ArrayType(_struct(table_index=_I, source=_S, bbox=BBOX, rows=T.ArrayType(T.ArrayType(_S)))), errors=T.ArrayType(_S))
DOCUMENT = _struct(id=_S, company_name=_S, document_name=_S, source_path=_S, fiscal_period=_S, status=_S, reported_total=_M, currency=_S, scale=_S, created_at=_TS, updated_at=_TS, analysis_notes=_S)
PARSED_PAGE = _struct(id=_S, document_id=_S, page_number=_I, text=_S, blocks=BLOCKS, tables=TABLES, language=_S, parser_sources=T.ArrayType(_S), has_text=_B)
EXTRACTED_ROW = _struct(segment_name=_S, revenue_raw=_S, revenue_value=_M, currency=_S, scale=_S, period_label=_S, page_ref=_S, section_ref=_S, metric_basis=_S, evidence_text=_S, confidence=_D, extraction_notes=_S)
REVIEW_EVENT = _struct(id=_S, document_id=_S, segment_id=_S, reviewer=_S, action=_S, field_changed=_S, old_value=_S, new_value=_S, note=_S, event_at=_TS, ingested_at=_TS)
GOLD = _struct(document_name=_S, company_name=_S, fiscal_period=_S, segment_name=_S, revenue_value=_S, currency=_S, scale=_S, page_ref=_S, nace_code=_S, notes=_S)
GOLD_REQUIRED = ["document_name", "company_name", "fiscal_period", "segment_name", "revenue_value", "currency", "scale", "page_ref"]
TAXONOMY_COLUMNS = ["level_depth", "level", "node_code", "node_name", "node_key", "parent_key", "section_code", "section_name", "division_code", "division_name", "group_code", "group_name", "class_code", "class_name", "hierarchy_path_codes", "hierarchy_path_names", "source_row_number"]
