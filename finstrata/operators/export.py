"""Rows as flat tables and nested documents, and their files: CSV, JSON, Markdown, a workbook.

Tables are written by Spark. The workbook and Markdown are reports for people: their rows are streamed
through the driver one partition at a time.
"""

from __future__ import annotations

import zipfile
from collections.abc import Sequence
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in a fixed order, as texts, nulls empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def nest(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """parent with an array of its children in order. The children are gathered before the join; a parent has few."""
    rows = child.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    joined = parent.join(rows, parent[parent_key] == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)))


def as_json(columns: Sequence[Column | str]) -> Column:
    """A struct as JSON text with every field present."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    text_columns(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def column_letters(index: int) -> str:
    """A, B, ..., Z, AA, ... for 1, 2, ..."""
    letters = ""
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def column_letters_expr(index: Column) -> Column:
    """column_letters() for a column of numbers up to 18,278."""
    a, b, c = (index - 1) % 26, F.floor((index - 1 - 26) / 26), F.floor((index - 1 - 26 - 676) / 676)
    letter = lambda x: F.char(F.lit(65) + x)
    return F.when(index <= 26, letter(a)).when(index <= 702, F.concat(letter(b % 26), letter(a))).otherwise(F.concat(letter(c % 26), letter(b % 26), letter(a)))


def write_workbook(df: DataFrame, path: str, columns: Sequence[str], sheet: str = "rows") -> None:
    """One sheet with a header and inline texts."""
    def row(number: int, values: Sequence[str]) -> str:
        cells = "".join(f'<c r="{column_letters(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(values, 1))
        return f'<row r="{number}">{cells}</row>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{row(1, columns)}'.encode())
            for n, r in enumerate(text_columns(df, columns).toLocalIterator(), 2):
                f.write(row(n, list(r)).encode())
            f.write(b"</sheetData></worksheet>")


def write_markdown(df: DataFrame, path: str, title: str, columns: Sequence[str]) -> None:
    """A small table as Markdown."""
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(v.replace("|", "\\|") for v in r) + " |" for r in text_columns(df, columns).toLocalIterator()]
    Path(path).write_text("\n".join(lines) + "\n")
