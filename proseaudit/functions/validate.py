"""Checks a suggested rewrite must pass. Each returns the first reason that fails, or ``valid``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseaudit.functions import gates
from proseaudit.functions import lexicons as lx
from proseaudit.functions import spans
from proseaudit.functions import text as tx

# A letter is looked for before what stands in front of it, and a run of letters is not tried again in parts.
LONG_WORD = rf"[a-z](?<!{tx.WORD}[a-z])[a-z]{{3,}}+{tx.AFTER}"
# Ten byte searches cost more than one pass.
WEAK = f"{tx.first_of(lx.WEAKNESS_MARKS)}(?:{'|'.join(tx.quote(x) for x in lx.WEAKNESS_MARKS)})"


def overlap(original: Column, suggestion: Column) -> Column:
    """Share of the original's longer words found in the suggestion; 1.0 when either has none."""
    a = F.array_distinct(spans.matches(F.lower(original), LONG_WORD))
    b = F.array_distinct(spans.matches(F.lower(suggestion), LONG_WORD))
    share = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    return tx.let(a, lambda x: tx.let(b, lambda y: share(x, y)))


def is_real(found: Column, suggestion: Column) -> Column:
    """There is a suggestion and it says something else than the text found."""
    return F.coalesce((suggestion != "") & (tx.comparable(suggestion) != tx.comparable(found)), F.lit(False))


# Three characters or more are left when outer space is gone.
_INK = tx.WS.replace("[", "[^", 1)
NOT_BLANK = rf"(?s){_INK}.+?{_INK}"

# One of the last three word characters on a line is another one than at its place on the line above. No sigma is taken, as its lower
# case depends on its neighbours.
_CHAR, _GAP = rf"[{tx.W}&&[^σς]]", rf"[^\n{tx.W}]*+"
_ABOVE = rf"\A[^\n]*({_CHAR}){_GAP}({_CHAR}){_GAP}({_CHAR}){_GAP}\n[^\n]*"
OTHER_END = rf"{_ABOVE}(?:(?!\1){_CHAR}{_GAP}{_CHAR}{_GAP}{_CHAR}|(?!\2){_CHAR}{_GAP}{_CHAR}|(?!\3){_CHAR}){_GAP}\z"

FEW = 5


def _same(a: Column, b: Column) -> Column:
    """Nothing but case, marks and outer space differ. Texts that end in other word characters are not compared as a whole.

    The ends are cut by bytes, so the text before is not counted through; what is left of a character cut in two is no word character.
    """
    end = lambda c: F.substring(c.cast("binary"), -12, 12).cast("string")
    ends = F.lower(F.concat(end(a), F.lit("\n"), end(b)))
    return ~ends.rlike(OTHER_END) & (tx.comparable(a) == tx.comparable(b))


def _unrelated(a: Column, low: Column) -> Column:
    """``overlap`` below 0.2, with the suggestion in lower case. If none of its few longer words occurs in the original, those of the original are not taken out."""
    def little(whole: Column, y: Column) -> Column:
        none = (F.size(y) <= FEW) & ~F.exists(y, lambda w: F.contains(whole, w))
        share = lambda x, of: F.size(F.array_intersect(x, y)) / F.size(of)
        small = lambda x: F.when(F.size(x) > 0, (share(x, x) < 0.2) & (share(x, F.array_distinct(x)) < 0.2))  # noqa: E731  repeated words only matter below
        return F.when(none, whole.rlike(LONG_WORD)).otherwise(tx.let(spans.matches(whole, LONG_WORD), small))

    return tx.let(spans.matches(low, LONG_WORD), lambda y: (F.size(y) > 0) & tx.let(F.lower(a), lambda whole: little(whole, y)))


def _judge(original: Column, suggestion: Column, rule: Column | None, passed: Callable[[Column], Column]) -> Column:
    """The first reason that fails, else ``passed`` of the suggestion in lower case. Only a text of fitting length is put in lower case."""
    def compared(low: Column) -> Column:
        out = F.when(_unrelated(original, low), "unrelated_content")
        if rule is not None:
            out = (
                out.when(
                    (rule == "positive_language") & gates.has_negation(suggestion) & ~gates.has_negation(original),
                    "introduced_negation",
                )
                .when(
                    (rule == "active_voice") & gates.is_passive(suggestion) & ~gates.is_passive(original),
                    "still_passive",
                )
                .when(
                    (rule == "active_voice") & gates.has_hedging(suggestion) & ~gates.has_hedging(original),
                    "still_mushy",
                )
            )
        return out.otherwise(passed(low))

    # A character has one to four bytes; characters are only counted where the bytes don't tell.
    bytes_a, bytes_b = F.octet_length(original), F.octet_length(suggestion)
    return (
        F.when(suggestion.isNull() | (suggestion == "") | ~suggestion.rlike(NOT_BLANK), "empty_or_too_short")
        .when(_same(original, suggestion), "identical")
        .when((bytes_b > bytes_a * 0.625) & (F.length(suggestion) > F.length(original) * 2.5), "too_long")
        .when((bytes_b < bytes_a) & (F.length(suggestion) < F.length(original) * 0.25), "too_short")
        .otherwise(tx.let(F.lower(suggestion), compared))
    )


def reason(original: Column, suggestion: Column, rule: Column | None = None) -> Column:
    """Ordered checks; ``rule`` adds the ones for ``positive_language`` and ``active_voice``."""
    return _judge(original, suggestion, rule, lambda low: F.lit("valid"))


def _lost(low: Column, fact_array: Column) -> Column:
    def lost(fact: Column) -> Column:
        keys = spans.matches(F.lower(fact), f"{_INK}{{4,}}+")
        return tx.let(keys, lambda k: (F.size(k) > 0) & ~F.exists(k, lambda w: F.contains(low, w)))

    return F.size(F.filter(fact_array, lost))


def missing_facts(suggestion: Column, fact_array: Column) -> Column:
    """How many facts have none of their longer words in the suggestion."""
    return tx.let(F.lower(suggestion), lambda s: _lost(s, fact_array))


def _two_of(low: Column, marks) -> Column:
    """Two marks or more occur; those after the second are not looked for."""
    out = F.lit(False)
    for i, mark in reversed([*enumerate(marks)][:-1]):
        out = F.when(F.contains(low, F.lit(mark)), tx.mentions(low, marks[i + 1 :])).otherwise(out)
    return out


def constrained_reason(
    original: Column, suggestion: Column, fact_array: Column, context: Column, rule: Column | None = None, applies: Column | None = None
) -> Column:
    """``reason`` plus: at most one fact lost, and a weakness must not be turned into a strength. Rows where ``applies`` is false get the plain reason.

    Facts and context are taken as expressions, so that they are only worked out for rows that passed the plain checks.
    """
    def constrained(lost: Column, low: Column) -> Column:
        flipped = _two_of(low, lx.STRENGTH_MARKS) & ~low.rlike(WEAK)
        return (
            F.when(lost >= 2, F.concat(F.lit("missing_facts_"), lost.cast("string")))
            .when(context.isin("weakness", "threat") & flipped, "flipped_weakness_to_strength")
            .otherwise("valid")
        )

    # The plain reason decides for almost all rows; the costlier checks only see what passed it.
    def passed(low: Column) -> Column:
        judged = tx.let(_lost(low, fact_array), lambda lost: constrained(lost, low))
        return judged if applies is None else F.when(~applies, "valid").otherwise(judged)

    return _judge(original, suggestion, rule, passed)
