"""Reports over the issue table. Every aggregate combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "suggestion", "info")
CATEGORIES = ("grammar", "word-list", "tone", "filename", "formatting", "usage")


def family(category: Column) -> Column:
    """Report family; null for anything unknown, which the report drops."""
    return F.when(category.isin("grammar", "word-list"), "grammar").when(
        category.isin("tone", "usage", "formatting", "filename"), category
    )


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("unknown"))


def breakdowns(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by severity, by category and by rule in one pass: ``(keys..., dimension, label, n)``.

    Issues shrink to one row per combination first, and only those combinations are regrouped.
    """
    base = issues.groupBy(*keys, _known("severity").alias("severity"), _known("category").alias("category"), _known("rule_name").alias("rule")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sides = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in ("severity", "category", "rule")])
    return base.select(*keys, "_n", F.inline(sides)).groupBy(*keys, "dimension", "label").agg(F.sum("_n").alias("n"))


def breakdown_maps(issues: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document with the three breakdowns as maps."""
    rows = breakdowns(issues, keys)

    def as_map(d: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("dimension") == d, F.struct("label", "n"))))).alias(f"{d}_breakdown")

    return rows.groupBy(*keys).agg(as_map("severity"), as_map("category"), as_map("rule"))


def tallies(issues: DataFrame, keys: list[str], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Counts of fixed values of some columns in one pass, zero where nothing was found."""
    return issues.groupBy(*keys).agg(*[
        F.count_if(F.col(column) == v).alias(v.replace("-", "_")) for column, values in columns.items() for v in values
    ])


def content_statistics(elements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pages, elements, text length and mean elements per page (at least one page)."""
    keys = keys or ["doc_id"]
    per_page = elements.groupBy(*keys, "page_index").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length("text")).alias("_len")
    )
    return per_page.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("_n").alias("total_elements"), F.sum("_len").alias("total_text_length"),
        F.round(F.sum("_n") / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("avg_elements_per_page"),
    )


def element_type_counts(elements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return elements.groupBy(*(keys or ["doc_id"]), F.coalesce("element_type", F.lit("unknown")).alias("element_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def summary(issues: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals per family and how many issues carry a suggestion."""
    f = F.col("_family")
    counted = issues.withColumn("_family", family(F.col("category"))).where("_family is not null")
    return counted.groupBy(*(keys or ["doc_id"])).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(f == x).alias(f"{x}_issues") for x in ("grammar", "tone", "usage", "formatting", "filename")],
        F.count_if(F.coalesce(F.col("suggestion") != "", F.lit(False))).alias("issues_with_suggestions"),
    )


def by_slide(issues: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per page; file-level issues are page -1."""
    return issues.groupBy(*(keys or ["doc_id"]), F.coalesce("page_index", F.lit(-1)).alias("page_index")).agg(F.count(F.lit(1)).alias("n"))


def by_rule_lists(issues: DataFrame, keys: list[str] | None = None, parts: int = 8) -> DataFrame:
    """Nested lists per family and rule: ``(keys..., family, rule_name, part, issues)``.

    Every list comes in up to ``parts`` parts by a hash of the issue, at any size, so one document with a large share of all issues
    never ends up in one task.
    """
    keys = keys or ["doc_id"]
    item = F.struct("page_index", "element_index", "severity", "found_text", "suggestion")
    known = issues.withColumn("family", family(F.col("category"))).where("family is not null").withColumn("part", F.pmod(F.xxhash64(item), F.lit(parts)))
    return known.groupBy(*keys, "family", "rule_name", "part").agg(F.sort_array(F.collect_list(item)).alias("issues"))


def top_rules(issues: DataFrame, k: int = 10) -> DataFrame:
    counts = issues.groupBy(_known("rule_name").alias("rule_name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "rule_name").limit(k)


def top_rules_per(issues: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    counts = issues.groupBy(*keys, _known("rule_name").alias("rule_name")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "rule_name")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def severity_share(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each severity in percent. The window runs over at most one row per severity."""
    counts = issues.groupBy(*keys, _known("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 1))


def finding_filter(severity: str = "all", category: str = "all") -> Column:
    """Condition for a findings table; ``all`` does not filter."""
    test = F.lit(True)
    if severity != "all":
        test = test & (F.col("severity") == severity)
    if category != "all":
        test = test & (F.col("category") == category)
    return test


def filter_findings(issues: DataFrame, severity: str = "all", category: str = "all") -> DataFrame:
    return issues.where(finding_filter(severity, category))


def document_summary(pages: DataFrame) -> DataFrame:
    """Pages, pages with content, elements. ``pages`` has ``element_count``."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if(F.col("element_count") > 0).alias("pages_with_content"),
        F.sum("element_count").alias("total_elements"),
    )


def nested_report(documents: DataFrame, issues: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report as two tables: totals, one row per document, with or without issues; and nested issue lists, ``(doc_id, part, issues_by_category)``."""
    totals = summary(issues)
    maps = breakdown_maps(issues, ["doc_id"])
    whole = documents.join(stats, "doc_id", "left").join(totals, "doc_id", "left").join(maps, "doc_id", "left")
    nested = by_rule_lists(issues).groupBy("doc_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("family", "rule_name", "issues"))).alias("issues_by_category")
    )
    return whole.fillna(0, [c for c in totals.columns if c != "doc_id"]), nested
