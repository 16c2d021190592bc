"""File, folder and template names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx

_S = r"\s+"
_MON = r"-[a-z]{3}"


def extension(name: Column) -> Column:
    """Lower-cased last suffix with its dot, '' without one. A leading dot is not a suffix."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    """Base name without the last suffix."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]+$", "")


def naming_class(name: Column, lead: str = lx.LEAD_WORD) -> Column:
    """``working``, ``final``, ``draft``, ``external`` or null. Suffix-free names, case-sensitive."""
    word = tx.quote(lead)
    dated = rf".+{_S}{_MON}{_S}\d{{1,2}}{_S}\d{{4}}"
    return (
        F.when(name.rlike(rf"^{word}{_S}{dated}{_S}-[a-z]{{2,3}}$"), "working")
        .when(name.rlike(rf"^{word}{_S}.+{_S}{_MON}{_S}\d{{4}}{_S}-final$"), "final")
        .when(name.rlike(rf"^draft{_S}{word}{_S}{dated}{_S}-[a-z]{{2,3}}$"), "draft")
        .when(name.rlike(rf"^[a-z\s]+{dated}$"), "external")
    )


_MONTH_WORD = "|".join(lx.MONTHS + lx.MONTH_ABBREVIATIONS)


def naming_defects(name: Column, lead: str = lx.LEAD_WORD) -> Column:
    """Codes of the policy points the name breaks, in a fixed order."""
    word = tx.quote(lead)
    checks = (
        ("lead_word_case", name.rlike(rf"(?i)^(?:draft\s+)?{word}\b") & ~name.rlike(rf"^(?:[dD][rR][aA][fF][tT]\s+)?{word}\b")),
        ("no_hyphen_before_date", name.rlike(rf"(?i)[^-](?:\s|^)(?:{_MONTH_WORD})\s+(?:\d{{1,2}}\s+)?\d{{4}}")),
        ("day_in_final", name.rlike(r"(?i)-[a-z]{3}\s+\d{1,2}\s+\d{4}\s+-final$")),
        ("draft_not_first", name.rlike(r"(?i)\bdraft\b") & ~name.rlike(r"(?i)^draft\b")),
        ("dash_between_words", name.rlike(r"(?i)[a-z]-[a-z]")),
        ("person_phrase", name.rlike(r"(?i)\b(?:for|by)\s+[a-z]+")),
        ("version_text", name.rlike(r"(?i)\bv\d+\b|\bversion\b")),
        ("joined_initials", name.rlike(r"(?i)-[a-z]{2,3}\+[a-z]{2,3}")),
        ("initials_case", name.rlike(r"-[A-Z]{2,3}(?:\s|$)")),
    )
    return F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in checks]), lambda c: c.isNotNull())


def folder_defects(name: Column) -> Column:
    """Empty for ``NN - Name``; otherwise what is wrong with the number or the dash."""
    ok = name.rlike(r"^\d{2} - .+")
    checks = (
        ("decimal_number", name.rlike(r"^\d+\.\d+")),
        ("one_digit_number", name.rlike(r"^\d(?:\D|$)") & ~name.rlike(r"^\d+\.\d+")),
        ("no_number", ~name.rlike(r"^\d")),
        ("no_spaced_dash", name.rlike(r"^\d+-|^\d+\s+-\S|^\d+-\s")),
    )
    codes = F.filter(
        F.array(*[F.when(~ok & test, F.lit(code)) for code, test in checks]), lambda c: c.isNotNull()
    )
    return F.when(ok, F.expr("cast(array() as array<string>)")).otherwise(
        F.when(F.size(codes) == 0, F.array(F.lit("malformed"))).otherwise(codes)
    )


def name_parts(name: Column, lead: str = lx.LEAD_WORD) -> Column:
    """``struct<title, month, day, year, initials>`` read leniently from any spelling of a name."""
    flat = tx.squeeze(F.regexp_replace(F.regexp_replace(stem(name), r"[_+\-]", " "), r"(?i)\b(?:for|by)\s+\p{L}+", " "))
    date = rf"(?i)\b({_MONTH_WORD})\s+(?:(\d{{1,2}})\s+)?(\d{{4}})\b"
    before = F.regexp_replace(flat, date + r".*$", "")
    tail = F.regexp_extract(flat, date + r"(.*)$", 4)
    title = tx.squeeze(
        F.regexp_replace(
            before, rf"(?i)\b(?:{tx.quote(lead)}|draft|final|version\s*\d*|v\d+)\b", " "
        )
    )
    return F.struct(
        F.lower(title).alias("title"),
        F.lower(F.substring(F.regexp_extract(flat, date, 1), 1, 3)).alias("month"),
        F.regexp_extract(flat, date, 2).alias("day"),
        F.regexp_extract(flat, date, 3).alias("year"),
        F.lower(F.regexp_extract(tail, r"^\s+(?!(?i:final)\b)([A-Za-z]{2,3})\b", 1)).alias("initials"),
    )


def name_options(parts: Column, lead: str = lx.LEAD_WORD, editor: str = "xx") -> Column:
    """Draft, working, edited and final spelling of a parsed name, in that order.

    Missing parts are shown as ``[month]``, ``[day]``, ``[year]``, ``[initials]``.
    """
    def spell(p: Column) -> Column:
        def part(field: str) -> Column:
            return F.when(p[field] == "", F.lit(f"[{field}]")).otherwise(p[field])

        head = F.concat(F.lit(lead + " "), p["title"])
        day = F.concat(F.lit(" -"), part("month"), F.lit(" "), part("day"), F.lit(" "), part("year"))
        owner = F.concat(F.lit(" -"), part("initials"))
        return F.array(
            F.concat(F.lit("draft "), head, day, owner),
            F.concat(head, day, owner),
            F.concat(head, day, owner, F.lit(f" -{editor}")),
            F.concat(head, F.lit(" -"), part("month"), F.lit(" "), part("year"), F.lit(" -final")),
        )

    return tx.let(parts, spell)


def is_one_of(name: Column, options: Column) -> Column:
    """Case-insensitive, trimmed equality with any option."""
    key = F.lower(tx.strip(name))
    return F.coalesce(F.exists(options, lambda o: F.lower(tx.strip(o)) == key), F.lit(False))


def option_lines(options: Column) -> Column:
    return F.array_join(
        F.transform(options, lambda o, i: F.concat(F.lit("Option "), (i + 1).cast("string"), F.lit(": "), o)), "\n"
    )


def display_name(original: Column, path: Column) -> Column:
    """Original name, else base name of the path, else null."""
    base = F.regexp_extract(path, r"[^/]+$", 0)
    return F.coalesce(F.when(original != "", original), F.when(base != "", base))


def matching_name(name: Column) -> Column:
    """Stem in lower case, separators as spaces, filler words removed wherever they occur."""
    out = F.translate(F.lower(stem(name)), "_-", "  ")
    for filler in lx.NAME_FILLERS:
        out = F.replace(out, F.lit(filler), F.lit(""))
    return tx.squeeze(out)


def storage_name(name: Column, number: Column) -> Column:
    """``NNN_clean_stem.ext``: letters, digits and ``" -_"`` only, spaces as ``_``, stem cut to 50."""
    clean = F.replace(tx.strip(F.regexp_replace(stem(name), r"[^\p{L}\p{N} \-_]", "")), F.lit(" "), F.lit("_"))
    padded = F.when(number >= 1000, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))
    return F.concat(padded, F.lit("_"), F.substring(clean, 1, 50), extension(name))
