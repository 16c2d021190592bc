"""Find all matches, decide per match, rebuild the text: the core of every rewriting rule.

``split`` gives the gaps around the matches and ``regexp_extract_all`` the matches themselves, so a
text is ``gap[0] match[0] gap[1] ... gap[n]``. Both arrays are zipped once, shifted by one for the
neighbours, and each decision sees its own zipped entry only; the cost stays linear in the text.
Nothing leaves the JVM.

Patterns are literals, and gaps are cut at one plain character (``text.split_at``), so each is compiled once per task. Callers guard with ``rlike`` so that the
array work only runs on texts that match at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseaudit.functions import text as tx

_ALL = 1_000_000_000


@dataclass(frozen=True)
class Span:
    """One match and its surroundings, as columns inside a lambda."""

    text: Column
    before: Column      # gap on the left
    after: Column       # gap on the right
    previous: Column    # match before this one, '' for the first
    following: Column   # match after this one, '' for the last
    is_first: Column


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    return tx.split_at(text, pattern)


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(matches(text, pattern)).cast("long")


def join_spans(gap_array: Column, piece_array: Column) -> Column:
    """Interleave gaps with pieces; the last gap has no piece."""
    return F.array_join(
        F.zip_with(gap_array, piece_array, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), ""
    )


def zipped(text: Column, pattern: str) -> Column:
    """One struct per gap: ``g`` gap, ``m`` match after it (null at the end), ``n`` next gap, ``p``
    previous match ('' for the first, null never), ``f`` following match, ``i`` position."""
    ms, gs = matches(text, pattern), gaps(text, pattern)
    none = F.array(F.lit(""))
    return F.arrays_zip(
        gs.alias("g"),
        ms.alias("m"),
        F.slice(gs, 2, _ALL).alias("n"),
        F.concat(none, ms).alias("p"),
        F.concat(F.slice(ms, 2, _ALL), none).alias("f"),
    )


def rewrite(text: Column, pattern: str, fn: Callable[[Span], Column]) -> Column:
    """Text with every match replaced by ``fn(span)``; a null decision leaves the match alone."""

    def piece(s: Column, i: Column) -> Column:
        span = Span(s["m"], s["g"], s["n"], s["p"], F.coalesce(s["f"], F.lit("")), i == 0)
        return F.concat(s["g"], F.when(s["m"].isNull(), "").otherwise(F.coalesce(fn(span), s["m"])))

    return F.array_join(F.transform(zipped(text, pattern), piece), "")


def located(text: Column, pattern: str) -> Column:
    """Matches with their character offsets: ``array<struct<start,end,text>>`` (0-based, end exclusive)."""
    pairs = F.arrays_zip(gaps(text, pattern).alias("g"), matches(text, pattern).alias("m"))
    zero = F.struct(
        F.lit(0).cast("int").alias("at"),
        F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"),
    )

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["g"])
        end = start + F.coalesce(F.length(s["m"]), F.lit(0))
        found = F.struct(start.alias("start"), end.alias("end"), s["m"].alias("text"))
        return F.struct(
            end.alias("at"),
            F.when(s["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"),
        )

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def protected_by(span: Column, terms: Column | None) -> Column:
    """True when any protected term (case-sensitive) occurs inside the span. Blank terms never protect."""
    if terms is None:
        return F.lit(False)
    return F.coalesce(F.exists(terms, lambda t: (t != "") & F.contains(span, t)), F.lit(False))


def replace_unprotected(
    text: Column, pattern: str, terms: Column | None, fn: Callable[[Column], Column], template: str | None = None
) -> Column:
    """Replace each unprotected match by ``fn(match)``.

    Without a term array a ``$1``-style template, when given, does the same in one regex pass.
    """
    if terms is None and template is not None:
        return F.regexp_replace(text, pattern, template)
    return rewrite(text, pattern, lambda s: F.when(~protected_by(s.text, terms), fn(s.text)))
