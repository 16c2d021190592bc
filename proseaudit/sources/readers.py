"""Readers for extraction output and cached term lists, and adapters to the common page shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import naming, visual
from proseaudit.functions import text as tx
from proseaudit.sources import schemas


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One JSON object per file, named by the file; or, for large collections, one per line, named by its ``doc_id``.

    Broken objects keep their text in ``_corrupt_record``."""
    if lines:
        return spark.read.schema(f"doc_id long, {schema}").option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))
    return (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("doc_id", F.regexp_replace(naming.stem(F.col("path")), "%20", " "))
    )


def normalized_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, schemas.NORMALIZED_DOCUMENT, lines)


def slide_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, schemas.SLIDE_DOCUMENT, lines)


def page_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, schemas.PAGE_DOCUMENT, lines)


def _format(name=None, size=None, bold=None, italic=None, colour=None, level=None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if name is None else name).cast("string").alias("font_name"),
        (none if size is None else size).cast("double").alias("font_size"),
        (none if bold is None else bold).cast("boolean").alias("is_bold"),
        (none if italic is None else italic).cast("boolean").alias("is_italic"),
        (none if colour is None else colour).cast("string").alias("color"),
        (none if level is None else level).cast("int").alias("hierarchy_level"),
    )


def slide_element(e: Column) -> Column:
    """Raw slide element to the unified element; six formatting fields survive."""
    loc, fmt = e["locator"], e["formatting"]
    return F.struct(
        e["text"].alias("text"),
        F.struct(
            loc["slide_index"].alias("page_or_slide_index"),
            visual.element_type(loc["element_type"]).alias("element_type"),
            loc["element_index"].alias("element_index"),
            loc["paragraph_index"].alias("sub_index"),
            visual.slide_position(loc["paragraph_index"]).alias("position"),
        ).alias("locator"),
        _format(
            fmt["font_name"], fmt["font_size"], fmt["is_bold"], fmt["is_italic"], fmt["font_color"], loc["bullet_level"]
        ).alias("formatting"),
        F.lit(1.0).alias("confidence"),
        F.lit("pptx").alias("source_type"),
    )


def page_element(e: Column) -> Column:
    """Raw page element to the unified element; formatting is unknown."""
    loc = e["locator"]
    return F.struct(
        e["text"].alias("text"),
        F.struct(
            loc["page_index"].alias("page_or_slide_index"),
            visual.element_type(loc["element_type"]).alias("element_type"),
            loc["paragraph_index"].alias("element_index"),
            F.lit(None).cast("int").alias("sub_index"),
            loc["position"].alias("position"),
        ).alias("locator"),
        _format().alias("formatting"),
        F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence"),
        F.lit("pdf").alias("source_type"),
    )


def page_title(elements: Column) -> Column:
    """Text of the first heading, else the first element when short and without a closing period."""
    heading = F.get(F.filter(elements, lambda e: e["locator"]["element_type"] == "heading"), F.lit(0))["text"]
    first = F.get(elements, F.lit(0))["text"]
    return F.coalesce(heading, F.when((F.length(first) < 100) & ~first.endswith("."), first))


def from_slides(raw: DataFrame) -> DataFrame:
    """Raw slide documents in the normalized shape."""
    page = F.transform(
        "slides",
        lambda s: F.struct(
            s["slide_index"].alias("index"), s["title"].alias("title"), s["notes"].alias("notes"),
            s["layout_name"].alias("layout_info"), F.size(s["content_elements"]).alias("element_count"),
            F.transform(F.coalesce(s["content_elements"], F.array()), slide_element).alias("elements"),
        ),
    )
    return raw.select("doc_id", F.lit("pptx").alias("document_type"), page.alias("pages"))


def from_pages(raw: DataFrame) -> DataFrame:
    """Raw page documents in the normalized shape."""
    page = F.transform(
        "pages",
        lambda p: F.struct(
            p["page_index"].alias("index"), page_title(p["elements"]).alias("title"),
            F.lit(None).cast("string").alias("notes"),
            F.concat(F.lit("Page size: "), F.coalesce(p["page_size"], F.lit("Unknown"))).alias("layout_info"),
            F.size(p["elements"]).alias("element_count"),
            F.transform(F.coalesce(p["elements"], F.array()), page_element).alias("elements"),
        ),
    )
    return raw.select("doc_id", F.lit("pdf").alias("document_type"), page.alias("pages"))


def _texts(pages: Column, field: str, extra: tuple[str, ...] = ()) -> Column:
    """Squeezed texts of at least three characters, in reading order."""
    def of_page(p: Column) -> Column:
        parts = F.transform(F.coalesce(p[field], F.array()), lambda e: tx.squeeze(F.coalesce(e["text"], F.lit(""))))
        for key in extra:
            parts = F.concat(parts, F.array(tx.squeeze(F.coalesce(p[key], F.lit("")))))
        return F.filter(parts, lambda t: F.length(t) >= 3)

    empty = F.expr("cast(array() as array<string>)")
    return F.coalesce(F.flatten(F.transform(pages, of_page)), empty)


OPEN_DOCUMENT = (
    "pages array<struct<elements:array<struct<text:string>>>>, "
    "slides array<struct<title:string,notes:string,content_elements:array<struct<text:string>>>>"
)


def document_texts(df: DataFrame, json_column: str) -> DataFrame:
    """Texts of a document given as JSON of any shape: pages first, else slides (with title and notes)."""
    parsed = df.withColumn("_doc", F.from_json(F.col(json_column), OPEN_DOCUMENT))
    from_page = _texts(F.col("_doc.pages"), "elements")
    from_slide = _texts(F.col("_doc.slides"), "content_elements", ("title", "notes"))
    return (
        parsed.withColumn("_p", from_page).withColumn("_s", from_slide)
        .withColumn("texts", F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.col("_s")))
        .drop("_doc", "_p", "_s")
    )


def accept_uploads(
    df: DataFrame, name: str = "original_filename", size: str = "file_size_bytes", max_bytes: int = 50 * 1024 * 1024
) -> DataFrame:
    """Adds ``document_type`` and ``reject_reason`` (null when accepted): by suffix, then by size."""
    ext = naming.extension(F.col(name))
    return df.withColumn("document_type", F.when(ext.isin(".pptx", ".pdf"), F.substring(ext, 2, 10))).withColumn(
        "reject_reason",
        F.when(F.col("document_type").isNull(), "unsupported_type").when(F.col(size) > max_bytes, "too_large"),
    )


def protection_terms(df: DataFrame, json_column: str) -> DataFrame:
    """``(doc_id, kind, pos, term)`` from a JSON object per document.

    All six kinds are known; a scalar counts as a one-element list, blanks are dropped, duplicates
    (ignoring case and spacing) keep the first.
    """
    raw = F.from_json(F.col(json_column), "map<string,string>")
    def items(value: Column) -> Column:
        as_list = F.from_json(value, "array<string>")
        return F.when(value.rlike(r"^\s*\["), as_list).when(value.isNotNull(), F.array(value))
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), items(F.try_element_at(F.col("_raw"), F.lit(k))).alias("terms"))
        for k in lx.PROTECTION_KINDS
    ])
    return (
        df.withColumn("_raw", raw)
        .select("doc_id", F.inline(kinds))
        .select("doc_id", "kind", F.posexplode("terms").alias("pos", "raw"))
        .select("doc_id", "kind", "pos", tx.squeeze("raw").alias("term"))
        .where("term <> ''")
        .groupBy("doc_id", "kind", F.lower("term").alias("key"))
        .agg(F.min(F.struct("pos", "term")).alias("first"))
        .select("doc_id", "kind", "first.pos", "first.term")
    )


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Template catalogue: one JSON file per template, named by its lower-cased stem."""
    return (
        spark.read.schema("document_type string").option("multiLine", True).json(path)
        .select(
            F.lower(F.replace(F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.json$", ""), F.lit("%20"), F.lit(" "))).alias("template"),
            F.col("_metadata.file_path").alias("path"),
        )
    )


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, modified, length`` of every file under a folder; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def result_history(spark: SparkSession, path: str, keep: int = 10) -> DataFrame:
    """Newest result files first: file number, name, time processed, issue and page counts. Only the ``keep`` newest files are parsed."""
    schema = (
        "analysis_metadata struct<timestamp:string>, summary struct<total_issues:long>, "
        "document_metadata struct<total_pages:long>"
    )
    name = F.element_at(F.split("path", "/"), -1)
    newest = [r.path for r in file_listing(spark, path).orderBy(F.desc("modified"), name).limit(keep).collect()]
    found = spark.read.schema(schema).option("multiLine", True).json(newest) if newest else spark.createDataFrame([], schema).withColumn("_metadata", F.lit(None).cast("struct<file_name:string,file_modification_time:timestamp>"))
    return (
        found.select(
            F.regexp_extract("_metadata.file_name", r"^[^_.]*", 0).alias("file_id"),
            F.col("_metadata.file_name").alias("filename"),
            F.col("analysis_metadata.timestamp").alias("processed_at"),
            F.coalesce("summary.total_issues", F.lit(0)).alias("total_issues"),
            F.col("document_metadata.total_pages").alias("total_pages"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        .orderBy(F.desc("modified"), "filename").limit(keep).drop("modified")
    )


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Word weights from a folder of JSON lines: ``word`` (lower case, trimmed) and ``weight``. Of a word given twice the smaller weight counts; rows
    without a word or a weight are left out."""
    rows = spark.read.schema("word string, weight double").json(path)
    return rows.select(F.lower(tx.strip("word")).alias("word"), "weight").where("word <> '' AND weight IS NOT NULL").groupBy("word").agg(F.min("weight").alias("weight"))
