"""Files as tables: pages of plain-text documents, labelled rows, predictions, a taxonomy below banner rows, config.

Listing and reading are Spark's; nothing here walks a folder on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finstrata import schemas
from finstrata.functions.text import low_text_count


def listed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, length, modified of the files below a folder, each path once. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def text_pages(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per page of text files whose pages are parted by form feeds; short pages are marked for a fallback."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    split = files.select(F.element_at(F.split("path", "/"), -1).alias("document_id"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("at", "text"))
    return split.select(F.concat_ws("#", "document_id", (F.col("at") + 1).cast("string")).alias("id"), "document_id", (F.col("at") + 1).alias("page_number"), "text", (low_text_count(F.col("text")) >= 30).alias("has_text"))


def html_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML to text: scripts, styles and tags out, block ends as line ends, the commonest entities as characters."""
    t = F.regexp_replace(F.col(html), r"(?is)<(script|style|head)\b.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n"), r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.regexp_replace(F.regexp_replace(t, r"[^\S\n]+", " "), r" ?\n[ \n]*", "\n")
    return pages.withColumn("text", F.regexp_replace(lines, r"^\s+|\s+$", ""))


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows of a CSV or JSON-lines file or folder; blank rows dropped, required columns checked, absent optional ones null."""
    reader = spark.read.option("header", True) if not path.rstrip("/").endswith((".json", ".jsonl")) else spark.read
    raw = reader.csv(path) if not path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.option("primitivesAsString", True).json(path)
    require_columns(raw, schemas.GOLD_REQUIRED)
    shaped = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast("string").alias(f.name) for f in schemas.GOLD.fields])
    return shaped.where(F.array_max(F.array(*[F.length(F.trim(F.coalesce(c, F.lit("")))) for c in shaped.columns])) > 0)


def banner_csv(spark: SparkSession, path: str, columns: Sequence[str] = tuple(schemas.TAXONOMY_COLUMNS)) -> DataFrame:
    """A CSV whose header stands below rows of title text: the header is the first line with all columns.

    The file is a dimension; its lines keep their order through one partition.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    parsed = lines.withColumn("cells", F.from_csv("line", ", ".join(f"c{i} string" for i in range(64)), {"mode": "PERMISSIVE"}))
    cells = F.array(*[F.trim(F.col(f"cells.c{i}")) for i in range(64)])
    header = parsed.select("no", cells.alias("cells")).where(F.size(F.array_except(F.array(*[F.lit(c) for c in columns]), F.col("cells"))) == 0).orderBy("no").limit(1).collect()
    if not header:
        raise ValueError(f"no line of {path} has all of the columns: {', '.join(columns)}")
    at = {name: k for k, name in enumerate(header[0]["cells"]) if name in columns}
    body = parsed.where((F.col("no") > header[0]["no"]) & (F.trim("line") != ""))
    return body.select(*[F.nullif(F.trim(F.col(f"cells.c{at[c]}")), F.lit("")).alias(c) for c in columns])


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    nodes = banner_csv(spark, path)
    levels = nodes.where(F.col("level").isin("section", "division", "group", "class") & F.col("node_code").isNotNull())
    return levels.withColumns({"level_depth": F.col("level_depth").cast("int"), "source_row_number": F.col("source_row_number").cast("int")})


def audit_exports(spark: SparkSession, path: str) -> DataFrame:
    """Predicted rows of nested exports below a folder, one per segment row, with the document's fields."""
    schema = "document struct<id:string,document_name:string,company_name:string,fiscal_period:string>, segment_rows array<struct<id:string,current_values:struct<segment_name:string,revenue_value:string,currency:string,scale:string,page_ref:string,status:string>>>, export_timestamp string"
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    flat = read.select("document.*", "export_timestamp", F.explode("segment_rows").alias("r"))
    return flat.select(F.col("id").alias("document_id"), "document_name", "company_name", "fiscal_period", "export_timestamp", F.col("r.id").alias("segment_id"), "r.current_values.*")


def prefer_format(files: DataFrame, ranks: Sequence[str] = ("json", "csv")) -> DataFrame:
    """Of the files of a folder, those of the best format that it has. files: path."""
    f = files.withColumns({"_dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "_r": F.array_position(F.array(*[F.lit(x) for x in ranks]), F.lower(F.element_at(F.split("path", r"\."), -1)))}).where("_r > 0")
    return f.withColumn("_best", F.min("_r").over(W.partitionBy("_dir"))).where("_r = _best").drop("_dir", "_r", "_best")


def config(spark: SparkSession, path: str, defaults: dict[str, float], bounds: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Numbers of a JSON object over the defaults, each within its bounds."""
    rows = spark.read.option("multiLine", True).json(path).limit(1).collect()
    found = defaults | {k: v for k, v in (rows[0].asDict() if rows else {}).items() if k in defaults and v is not None}
    for k, (low, high) in bounds.items():
        if not low <= found[k] <= high:
            raise ValueError(f"{k} is {found[k]}, not within {low} and {high}")
    return found
