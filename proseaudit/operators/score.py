"""Quality score, grades, and the simple score of the user interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx

BASE_DEDUCTION = 1.0


def _grade(score: Column, index: int, last: str) -> Column:
    out = None
    for band in lx.GRADE_BANDS:
        out = F.when(score >= band[0], band[index]) if out is None else out.when(score >= band[0], band[index])
    return out.otherwise(last)


def grade(score: Column) -> Column:
    return _grade(score, 1, "F")


def status(score: Column) -> Column:
    return _grade(score, 2, "Poor")


def category_counts(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, one count per category, and the total: the scorer's whole input.

    Conditional counts instead of one row per category: the shuffle carries one small row per
    document and task, and everything after it stays inside that row.
    """
    c = F.col("category")
    return issues.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(c == name).alias(_slot(name)) for name in lx.CATEGORY_WEIGHTS],
    )


def _slot(category: str) -> str:
    return "n_" + category.replace("-", "_")


def quality_scores(documents: DataFrame, counts: DataFrame, key: str = "doc_id", pages: str = "total_pages") -> DataFrame:
    """Score, grade and per-category detail of every document, also of those without issues.

    Weights of the categories that occur are scaled to sum to 100. A category loses one point per
    issue, times ``1 + 0.1 * issues per page``, at most all of its 100. A document whose issues are
    all of unknown categories is judged with all default weights and so scores 100.
    """
    joined = documents.select(key, pages).join(counts, key, "left").fillna(0)
    n = {name: F.col(_slot(name)) for name in lx.CATEGORY_WEIGHTS}
    weight_sum = F.lit(0.0)
    for name, w in lx.CATEGORY_WEIGHTS.items():
        weight_sum = weight_sum + F.when(n[name] > 0, w).otherwise(0.0)
    per_page = F.col("total_issues") / F.greatest(F.col(pages), F.lit(1))
    staged = joined.withColumns({"_weights": weight_sum, "_per_page": per_page, "_factor": F.lit(1.0) + per_page * 0.1})

    def lost(name: str) -> Column:
        return F.least(n[name] * BASE_DEDUCTION * F.col("_factor"), F.lit(100.0))

    weighted = F.lit(0.0)
    for name, w in lx.CATEGORY_WEIGHTS.items():
        weighted = weighted + F.when(
            n[name] > 0, (100.0 - lost(name)) * (F.lit(w) / F.col("_weights") * 100.0 / 100.0)
        ).otherwise(0.0)
    staged = staged.withColumn("_score", F.when(F.col("_weights") == 0, 100.0).otherwise(weighted))
    details = [
        F.when(n[name] > 0, F.round(100.0 - lost(name), 1)).alias("score_" + _slot(name)[2:])
        for name in lx.CATEGORY_WEIGHTS
    ]
    return staged.select(
        key, F.col(pages), "total_issues",
        F.round("_score", 1).alias("overall_score"), grade(F.col("_score")).alias("grade"), status(F.col("_score")).alias("status"),
        F.round("_per_page", 2).alias("issues_per_page"), F.round("_factor", 2).alias("complexity"), *details,
    )


def deductions(documents: DataFrame, counts: DataFrame, key: str = "doc_id", pages: str = "total_pages") -> DataFrame:
    """Long form: ``(key, category, issues, weight, deduction, category_score)`` per category that occurs."""
    joined = documents.select(key, pages).join(counts, key)
    factor = F.lit(1.0) + F.col("total_issues") / F.greatest(F.col(pages), F.lit(1)) * 0.1
    rows = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(_slot(c)).alias("issues"), F.lit(w).alias("_w")) for c, w in lx.CATEGORY_WEIGHTS.items()
    ])
    weight_sum = sum((F.when(F.col(_slot(c)) > 0, w).otherwise(0.0) for c, w in lx.CATEGORY_WEIGHTS.items()), F.lit(0.0))
    long = joined.select(key, factor.alias("_f"), weight_sum.alias("_ws"), F.inline(rows)).where("issues > 0")
    loss = F.least(F.col("issues") * F.col("_f"), F.lit(100.0))
    return long.select(
        key, "category", "issues", F.round(F.col("_w") / F.col("_ws") * 100.0, 2).alias("weight"),
        F.round(-loss, 1).alias("deduction"), F.round(100.0 - loss, 1).alias("category_score"),
    )


def simple_score(total: Column) -> Column:
    """A tenth of a point per issue."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - total / 10.0)


def simple_band(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 70, "Good").otherwise("Needs Improvement")
