"""Declared style rules as data, and the generic pattern scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseaudit.functions import spans
from proseaudit.functions import text as tx
from proseaudit.operators import rules


@dataclass(frozen=True)
class CatalogueRule:
    name: str
    category: str
    severity: str
    section: str
    description: str
    pattern: str | None = None
    incorrect: str = ""
    correct: str = ""


# Names, categories, severities and what each pattern accepts. Patterns are
# case-sensitive here, unlike the rules in ``rules``.
CATALOGUE = (
    CatalogueRule("active_voice", "voice", "warning", "II.A", "Active instead of passive voice"),
    CatalogueRule("positive_language", "voice", "suggestion", "II.B", "Positive instead of negative statements"),
    CatalogueRule(
        "avoid_mushy_language", "voice", "warning", "II.A", "Direct statements",
        rf"{tx.BEFORE}are{tx.WS}+(?:looking{tx.WS}+for|seeking|trying{tx.WS}+to)",
    ),
    CatalogueRule(
        "specificity", "usage", "suggestion", "III.A", "Specific terms and dates",
        tx.any_word(["currently", "at this time", "presently", "right now", "people"]),
    ),
    CatalogueRule(
        "inclusivity", "usage", "warning", "III.B", "Inclusive terms",
        tx.any_word(["waitress", "guys", "chairman", "mankind", "he", "she", "his", "her", "him", "disabled"]),
    ),
    CatalogueRule("acronym_expansion", "grammar", "critical", "IV.A", "Full phrase before the acronym", tx.word("[A-Z]{2,}")),
    CatalogueRule("bullet_formatting", "formatting", "warning", "IV.B", "No period at the end of a bullet"),
    CatalogueRule(
        "oxford_comma", "grammar", "critical", "VI", "Comma before the last item of a list",
        rf"({tx.WORD}+),{tx.WS}({tx.WORD}+){tx.WS}and{tx.WS}({tx.WORD}+)",
    ),
    CatalogueRule("en_dash_usage", "grammar", "suggestion", "IV.D", "En dashes", "—|--"),
    CatalogueRule(
        "numeral_spelling", "grammar", "suggestion", "IV.E", "Numbers below 100 in words",
        rf"{tx.BEFORE}[1-9][0-9]?{tx.AFTER}(?!{tx.WS}*(?:percent|%|million|billion))",
    ),
    CatalogueRule("single_space_after_period", "formatting", "warning", "IV.F", "One space after a period", rf"\.{tx.WS}{{2,}}"),
    CatalogueRule("title_case", "formatting", "critical", "IV.H", "Title case for titles"),
    CatalogueRule("avoid_contractions", "grammar", "critical", "VI", "No contractions", rf"{tx.BEFORE}{tx.WORD}+'(?:t|re|ll|ve|d){tx.AFTER}"),
    CatalogueRule("avoid_and_or", "grammar", "warning", "VI", "No 'and/or'", tx.word("and/or")),
    CatalogueRule("avoid_ampersand", "formatting", "warning", "VI", "No '&'", rf"{tx.WS}&{tx.WS}"),
    CatalogueRule(
        # The word boundary after an optional dot: 'etc' not followed by a word character, or 'etc.' followed by one.
        "avoid_etc", "grammar", "suggestion", "VI", "No 'etc.'", rf"{tx.BEFORE}etc(?:\.(?={tx.WORD})|{tx.AFTER})",
    ),
    CatalogueRule("avoid_second_person", "grammar", "critical", "VI", "No second person", tx.any_word(["you", "your", "yours"])),
    CatalogueRule(
        "avoid_unnecessary_gerunds", "grammar", "suggestion", "VI", "No needless -ing forms",
        tx.any_word(["avoid using", "start using", "begin using"]),
    ),
    CatalogueRule("no_hanging_words", "formatting", "warning", "VI", "No single word alone on the last line"),
)

BY_NAME = {r.name: r for r in CATALOGUE}


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, for joins and filters."""
    rows = [(r.name, r.category, r.severity, r.section, r.description, r.pattern) for r in CATALOGUE]
    return spark.createDataFrame(
        rows, "rule_name string, category string, severity string, section string, description string, pattern string"
    )


def select_rules(df: DataFrame, category: str | None = None, critical: bool = False, with_pattern: bool = False) -> DataFrame:
    out = df
    if category is not None:
        out = out.where(F.col("category") == category)
    if critical:
        out = out.where(F.col("severity") == "critical")
    if with_pattern:
        out = out.where(F.col("pattern").isNotNull())
    return out


def pattern_hits(df: DataFrame, text: str = "text", names: list[str] | None = None) -> DataFrame:
    """One row per (input row, catalogue rule that matches) with the number of matches.

    Patterns are unrolled as literals into one projection; they are never a column, so each is
    compiled once. A cheap ``rlike`` goes first, most texts match few rules.
    """
    chosen = [r for r in CATALOGUE if r.pattern and (names is None or r.name in names)]
    c = F.col(text)
    found = F.array(*[
        F.when(c.rlike(r.pattern), F.struct(F.lit(r.name).alias("rule_name"), spans.count_matches(c, r.pattern).alias("hits")))
        for r in chosen
    ])
    keep = [k for k in df.columns if k != text]
    return df.select(*keep, F.inline(F.filter(found, lambda x: x.isNotNull())))


def as_rule(name: str) -> rules.Rule:
    """A catalogue entry as a detection-only rule of the review projection."""
    r = BY_NAME[name]
    return rules.Rule(r.name, r.category, r.severity, r.description, lambda c, low: c.rlike(r.pattern), tags=(r.section,))


def bullet_ends_with_period(element_type: Column, text: Column) -> Column:
    return (element_type == "bullet") & tx.strip(text).endswith(".")


def breaks_title_case(element_type: Column, text: Column) -> Column:
    """A title or heading with a word of four or more letters that starts in lower case."""
    return element_type.isin("title", "heading") & text.rlike(rf"(?:^|{tx.WS})\p{{Ll}}\p{{L}}{{3,}}")


def has_hanging_word(text: Column) -> Column:
    """More than one line, the last of them a single word."""
    return text.rlike(rf"\n[ \t]*[^\s]+[ \t]*\z")


def first_acronym_uses(df: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """First use of each acronym per document and whether it is expanded there, as ``phrase (ACR)``."""
    pattern = BY_NAME["acronym_expansion"].pattern
    hits = df.where(F.col(text).rlike(pattern)).select(
        "doc_id", F.col(order).alias("ord"), text, F.explode(F.array_distinct(spans.matches(F.col(text), pattern))).alias("acronym")
    )
    return (
        hits.select(
            "doc_id", "acronym", "ord",
            F.contains(F.col(text), F.concat(F.lit("("), F.col("acronym"), F.lit(")"))).alias("expanded"),
        )
        .groupBy("doc_id", "acronym")
        .agg(F.min(F.struct("ord", "expanded")).alias("first"))
        .select("doc_id", "acronym", F.col("first.ord").alias("first_ord"), F.col("first.expanded").alias("expanded"))
    )
