"""The review job: documents -> elements -> issues -> suggestions -> report and score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseaudit.operators import filenames, flatten, formatting, protect, rules, score, segment, suggest


def document_pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every document as one page of text."""
    return documents.select("doc_id", F.lit(1).alias("page_index"), F.col(text).alias("raw_text"))


def document_issues(
    documents: DataFrame, text: str = "text", which: Iterable[str | rules.Rule] = rules.REVIEW_RULES
) -> DataFrame:
    """All rule issues of a document table in one scan, without a shuffle."""
    units = rules.text_units(segment.elements_from_pages(document_pages(documents, text)))
    return rules.detect(units, which)


def review(
    documents: DataFrame, text: str = "text", which: Iterable[str | rules.Rule] = rules.REVIEW_RULES,
    actionable_only: bool = False,
) -> DataFrame:
    """Issues with suggestions. ``actionable_only`` drops tone and usage issues that have none."""
    issues = suggest.add_suggestions(document_issues(documents, text, which))
    return suggest.keep_actionable(issues) if actionable_only else issues


def scores(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Score of each document; one small shuffle of per-document counts."""
    base = documents.select("doc_id", F.lit(1).alias("total_pages"))
    return score.quality_scores(base, score.category_counts(issues))


def worst_documents(documents: DataFrame, text: str = "text", which: Iterable[str | rules.Rule] = rules.REVIEW_RULES) -> DataFrame:
    """Which documents score worst, and in which category. The flagship question."""
    return scores(documents, document_issues(documents, text, which))


def full_review(documents: DataFrame, files: DataFrame | None = None, protected: DataFrame | None = None, which: Iterable[str | rules.Rule] = rules.REVIEW_RULES) -> DataFrame:
    """Issues of all families of multi-page documents, with suggestions and a location.

    ``documents`` has the common page shape (``doc_id, pages``), ``files`` names them (``doc_id, original_filename``), and ``protected``
    (``doc_id, term``) holds strings that no rewrite may touch. The pages are read once for the rules and once for the formatting checks.
    """
    elements = flatten.elements(documents)
    terms = None
    if protected is not None:
        elements, terms = protect.attach_terms(elements, protected), "terms"
    found = suggest.add_suggestions(rules.detect(rules.text_units(elements), which, terms=terms))
    wanted = ["doc_id", "page_index", "ord", *rules.ISSUE_FIELDS]
    parts = [found.select(*wanted), formatting.slide_issues(elements, flatten.pages(documents)).select(*wanted)]
    if files is not None:
        parts.append(filenames.name_issues(files).withColumnRenamed("element_index", "ord").select(*wanted))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("location", F.when(F.col("page_index") >= 0, flatten.location(F.col("page_index"), F.col("ord"))).otherwise("file"))


def full_scores(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Score of each multi-page document, with its own number of pages."""
    return score.quality_scores(documents.select("doc_id", F.size("pages").alias("total_pages")), score.category_counts(issues))
