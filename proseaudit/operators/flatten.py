"""Nested documents -> pages, elements, tables; run and theme formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx
from proseaudit.functions import visual


def pages(docs: DataFrame) -> DataFrame:
    """One row per page; ``page_rank`` is the position in the document (0-based)."""
    return docs.select("doc_id", F.posexplode("pages").alias("page_rank", "page")).select(
        "doc_id", "page_rank", F.col("page.index").alias("page_index"), "page.title", "page.notes", "page.layout_info",
        F.coalesce(F.size("page.elements"), F.lit(0)).alias("element_count"),
    )


def elements(docs: DataFrame) -> DataFrame:
    """One row per element, with its position in the page (``ord``) and the page's in the document."""
    page = docs.select("doc_id", F.posexplode("pages").alias("page_rank", "page"))
    item = page.select("doc_id", "page_rank", "page.layout_info", "page.index", F.posexplode("page.elements").alias("ord", "e"))
    return item.select(
        "doc_id",
        F.coalesce("e.locator.page_or_slide_index", "index", F.col("page_rank") + 1).alias("page_index"),
        "page_rank", "ord", "layout_info",
        F.col("e.locator.element_index").alias("element_index"),
        F.coalesce("e.locator.element_type", F.lit("content")).alias("element_type"),
        F.col("e.locator.sub_index").alias("sub_index"),
        F.col("e.locator.position").alias("position"),
        F.coalesce("e.text", F.lit("")).alias("text"),
        F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"),
        F.col("e.source_type").alias("source_type"),
        F.col("e.formatting").alias("fmt"),
    )


def note_elements(page_table: DataFrame) -> DataFrame:
    """Speaker notes as pseudo-elements placed after the last element of their page."""
    return page_table.where(F.coalesce(tx.strip("notes") != "", F.lit(False))).select(
        "doc_id", "page_index", "page_rank", F.col("element_count").alias("ord"),
        (F.col("element_count") + 1).alias("element_index"), F.lit("notes").alias("element_type"),
        F.col("notes").alias("text"),
    )


def with_notes(element_table: DataFrame, page_table: DataFrame, include: bool = False) -> DataFrame:
    if not include:
        return element_table
    return element_table.unionByName(note_elements(page_table), allowMissingColumns=True)


def location(page: Column, element: Column, separator: str = " - ") -> Column:
    return F.concat(F.lit("slide "), page.cast("string"), F.lit(f"{separator}element "), element.cast("string"))


def table_cells(raw_slides: DataFrame) -> DataFrame:
    """Cells of the slide tables with their table's size."""
    tables = raw_slides.select("doc_id", F.explode("slides").alias("s")).select("doc_id", F.explode("s.tables").alias("t"))
    return tables.select("doc_id", "t.slide_index", "t.table_index", "t.rows", "t.columns", F.explode("t.cells").alias("c")).select(
        "doc_id", "slide_index", "table_index", "rows", "columns", "c.row_index", "c.col_index", tx.strip("c.text").alias("text"),
    )


def header_tables(cell_paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose first row is a header: bold paragraphs in row 0 number at least half the columns."""
    return cell_paragraphs.groupBy(*keys).agg(
        (F.count_if((F.col("row_index") == 0) & F.col("is_bold")) >= F.floor(F.max("columns") / 2)).alias("has_header")
    )


def paragraph_format(runs: DataFrame, keys: list[str], order: str = "run_index") -> DataFrame:
    """Roll run formatting up to the paragraph.

    First known font and size; bold, italic and underline are true when any run says so and null
    when none says anything; first colour that is not the default. All are mergeable aggregates.
    """
    o = F.col(order)

    def first_known(c: str, keep: Column | None = None) -> Column:
        known = F.col(c).isNotNull() if keep is None else keep
        return F.min(F.when(known, F.struct(o.alias("o"), F.col(c).alias("v"))))["v"].alias(c)

    return runs.groupBy(*keys).agg(
        first_known("font_name"),
        first_known("font_size"),
        F.bool_or("is_bold").alias("is_bold"),
        F.bool_or("is_italic").alias("is_italic"),
        F.bool_or("is_underline").alias("is_underline"),
        first_known("color", F.coalesce(F.col("color") != "default", F.lit(False))),
    )


def resolve_theme_colours(df: DataFrame, themes: DataFrame, colour: str = "color") -> DataFrame:
    """``theme:SLOT`` to the document's RGB. ``themes`` is ``(doc_id, slot, rgb)``.

    Joined on document and slot; the strategy is left to the optimizer because themes grow with the
    number of documents.
    """
    slot = visual.lookup(F.regexp_extract(F.coalesce(F.col(colour), F.lit("")), r"^theme:(.+)$", 1), lx.THEME_SLOTS)
    left = df.withColumn("slot", slot)
    return left.join(themes.select("doc_id", "slot", "rgb"), ["doc_id", "slot"], "left").withColumn(
        "rgb", F.when(F.col(colour).startswith("#"), F.col(colour)).otherwise(F.col("rgb"))
    )


def collected_texts(element_table: DataFrame, order: list[str], keys: list[str] | None = None, sep: str = "\n\n---PAGE BREAK---\n\n") -> DataFrame:
    """Per document: squeezed texts of three or more characters in order, and all of them joined.

    The result holds one document's text per row, as its input documents do.
    """
    keys = keys or ["doc_id"]
    kept = element_table.withColumn("_t", tx.squeeze("text")).where(F.length("_t") >= 3)
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col("_t").alias("t"))))
    texts = F.transform(rows, lambda r: r["t"])
    return kept.groupBy(*keys).agg(F.size(rows).cast("long").alias("n_texts"), F.array_join(texts, sep).alias("combined"))


def layouts(page_table: DataFrame) -> DataFrame:
    """Distinct layouts per document. De-duplicated before the collect, so a set stays small."""
    return (
        page_table.select("doc_id", F.coalesce("layout_info", F.lit("Unknown")).alias("layout")).distinct()
        .groupBy("doc_id").agg(F.sort_array(F.collect_list("layout")).alias("layouts"))
    )


def dedupe_terms(terms: DataFrame, keys: list[str], term: str = "term", order: str = "pos") -> DataFrame:
    """First of each term per key, ignoring case and spacing.

    A minimum over (position, term) instead of a window: it combines before the shuffle, so a term
    repeated across a third of all rows costs one row per task.
    """
    clean = terms.withColumn("_t", tx.squeeze(term)).where("_t <> ''")
    return (
        clean.groupBy(*keys, F.lower("_t").alias("term_key"))
        .agg(F.min(F.struct(F.col(order).alias("pos"), F.col("_t").alias("term"))).alias("first"))
        .select(*keys, "term_key", F.col("first.pos").alias(order), F.col("first.term").alias(term))
    )


def metadata(docs: DataFrame, filepath: str | None = None, original: str | None = None) -> DataFrame:
    """Document metadata with fallbacks for path and page count."""
    m = "metadata."
    path = F.col(m + "file_path")
    return docs.select(
        "doc_id",
        (path if filepath is None else F.coalesce(F.col(filepath), path)).alias("file_path"),
        (F.lit(None).cast("string") if original is None else F.col(original)).alias("original_filename"),
        "document_type", F.col(m + "title").alias("title"), F.col(m + "author").alias("author"),
        F.col(m + "creator").alias("creator"), F.col(m + "creation_date").alias("creation_date"),
        F.coalesce(F.nullif(F.col(m + "total_pages"), F.lit(0)), F.col("extraction_info.total_pages")).alias("total_pages"),
        "normalized_at",
    )
