"""Colours, positions and roles of text on a slide or page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx


def lookup(c: Column, table: dict) -> Column:
    """Literal map lookup; null for unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def colour_name(c: Column) -> Column:
    up = F.upper(c)
    return (
        F.when(c.isNull() | (c == ""), "unknown")
        .when(lookup(c, lx.COLOUR_NAMES).isNotNull(), lookup(c, lx.COLOUR_NAMES))
        .when(c.startswith("#") & lookup(up, lx.HEX_NAMES).isNotNull(), lookup(up, lx.HEX_NAMES))
        .when(up.contains("LIGHT") | up.contains("WHITE"), "white")
        .when(up.contains("TEXT") | up.contains("DARK"), "dark_gray")
        .otherwise(c)
    )


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def rgb_int_hex(value: Column) -> Column:
    return F.format_string("#%06X", value.cast("int"))


def element_type(c: Column) -> Column:
    return F.coalesce(lookup(c, lx.ELEMENT_TYPES), F.lit("paragraph"))


def slide_position(paragraph_index: Column) -> Column:
    i = F.coalesce(paragraph_index, F.lit(0))
    return F.when(i == 0, "top").when(i <= 2, "middle").otherwise("bottom")


def page_position(index: Column, total: Column) -> Column:
    return (
        F.when(total <= 1, "middle")
        .when(index < total * 0.3, "top")
        .when(index > total * 0.7, "bottom")
        .otherwise("middle")
    )


def title_role(text: Column, position: Column) -> Column:
    """``struct<role, size>`` of a title-slide element, or null. First match wins."""
    low, s = F.lower(text), tx.strip(text)
    tokens = tx.words(text)
    names = F.size(F.filter(tokens, lambda w: w.rlike(r"^\p{Lu}")))
    joined = low.contains(",") | low.contains(" and ") | low.contains("&") | low.contains(";")
    months = "|".join(lx.MONTHS + lx.MONTH_ABBREVIATIONS)

    def role(name: str, size: float) -> Column:
        return F.struct(F.lit(name).alias("role"), F.lit(size).alias("size"))

    return (
        F.when(F.length(s) < 2, None)
        .when((position <= 1) & (F.length(text) > 20), role("Title", 40.0))
        .when(low.rlike(tx.word(months)) | text.rlike(tx.word(r"(?:19|20)[0-9]{2}")), role("Month and Year", 14.0))
        .when(low.contains("technical lead") | low.contains("tech lead") | low.contains("tl:"), role("Technical Lead", 17.0))
        .when(names.between(2, 3) & ~joined & (F.size(tokens) <= 4), role("Technical Lead", 17.0))
        .when(
            low.contains("project manager") | low.contains("pm:") | low.contains("lead:") | low.contains("manager:"),
            role("Project Manager", 28.0),
        )
        .when(joined & (names >= 3), role("Project Manager", 28.0))
    )
