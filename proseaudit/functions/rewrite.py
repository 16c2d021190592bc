"""Rule-based rewrites, masking, and the facts a rewrite must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import spans
from proseaudit.functions import text as tx


def phrase(p: str) -> str:
    """A literal phrase as a case-insensitive pattern; each space stands for a white-space run. The first character is tested first, as the cheapest."""
    return tx.ci(tx.first_of([p]) + tx.word(f"{tx.WS}+".join(tx.quote(part) for part in p.split(" "))))


def fold(c: Column, steps) -> Column:
    """Apply ``(pattern, replacement)`` steps one after the other."""
    return reduce(lambda acc, step: F.regexp_replace(acc, step[0], step[1]), steps, c)


def _unless_same(new: Column, old: Column) -> Column:
    """Keep the old text when the new one is blank or says the same."""
    return tx.let(
        new, lambda n: F.when((tx.strip(n) != "") & (tx.comparable(n) != tx.comparable(old)), n).otherwise(old)
    )


def _first_words(phrases) -> list[str]:
    return sorted({p.split(" ")[0] for p in phrases})


def positive(c: Column, context: Column | None = None) -> Column:
    """Turn negated phrasing around, but only spacing and a typo in a weakness statement."""
    spaces = (f"{tx.WS}{{2,}}", " ")
    words = ["can't", "vey", *_first_words(p for p, _ in lx.POSITIVE_REWRITES)]
    touched = tx.let(F.lower(c), lambda low: tx.mentions(low, words)) | c.rlike(spaces[0])
    new = fold(c, [(phrase(p), r) for p, r in lx.POSITIVE_REWRITES] + [spaces])
    if context is not None:
        weak = fold(c, [(phrase("vey"), "very"), spaces])
        new = F.when(context.isin("weakness", "threat"), weak).otherwise(new)
    return F.when(touched, _unless_same(new, c)).otherwise(c)


_HEDGE_STARTS = _first_words(p for p, _ in lx.HEDGE_STEPS)


def active(c: Column) -> Column:
    """Drop hedges, replace a handful of passive forms, collapse spaces."""
    steps = [
        (phrase(p), r) if r is not None else (tx.ci(tx.first_of([p]) + tx.BEFORE + f"{tx.WS}+".join(p.split(" ")) + f"{tx.WS}+"), "") for p, r in lx.HEDGE_STEPS
    ]
    steps += [
        (tx.ci("(?=[iIaAwW])" + tx.word(rf"(?:is|are|was|were){tx.WS}+{done}")), does) for done, does in lx.PASSIVE_REWRITES
    ]
    steps.append((tx.ci(rf"(?=[bB]){tx.BEFORE}being{tx.WS}+({tx.WORD}+ed|made|done){tx.AFTER}"), "$1"))
    words = [*_HEDGE_STARTS, "being", *(done for done, _ in lx.PASSIVE_REWRITES)]
    touched = tx.let(F.lower(c), lambda low: tx.mentions(low, words)) | c.rlike(f"{tx.WS}{{2,}}|(?! ){tx.WS}|^{tx.WS}|{tx.WS}$")
    return F.when(touched, _unless_same(tx.squeeze(fold(c, steps)), c)).otherwise(c)


def specific(c: Column) -> Column:
    """Only the first replacement that changes anything is made."""
    out, low = c, F.lower(c)
    for p, r in reversed(lx.SPECIFICITY_REWRITES):
        pattern = tx.ci(tx.any_word([p]))
        out = F.when(low.contains(p) & c.rlike(pattern), F.regexp_replace(c, pattern, r)).otherwise(out)
    return out


def may_exclude(c: Column) -> Column:
    """Cheap test that holds for every text ``inclusive`` changes."""
    return tx.let(F.lower(c), lambda low: tx.mentions(low, [p for p, _ in lx.INCLUSIVE_REWRITES]))


def inclusive(c: Column) -> Column:
    """All replacements are made, in order."""
    new = fold(c, [(tx.ci(tx.any_word([p])), r) for p, r in lx.INCLUSIVE_REWRITES])
    return F.when(may_exclude(c), _unless_same(new, c)).otherwise(c)


# --- masking ------------------------------------------------------------------------------------

# "1-3 digits, then groups of up to 3 digits or commas" accepts the same runs as this flat form,
# which cannot backtrack on long digit runs. The end is a word boundary: after a digit no word
# character may follow, after a comma one must.
_EDGE = rf"(?:(?<=[0-9]){tx.AFTER}|(?<=[,.])(?={tx.WORD}))"
NUMBER = (
    rf"(?:{tx.BEFORE}[0-9][0-9,]*(?:\.[0-9]+)?|(?<={tx.WORD})\$[0-9][0-9,.]*){_EDGE}"
)
_MONTH = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    "Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
DATE = tx.word(rf"(?:{_MONTH}){tx.WS}+[0-9]{{1,2}},{tx.WS}+[0-9]{{4}}|[0-9]{{4}}")
LINK = tx.ci(rf"(?:(?:mailto:)?[{tx.W}.\-]+@[{tx.W}.\-]+\.{tx.WORD}+|https?://[^\s]+)")


MASKS = (("NUM", NUMBER), ("DATE", DATE), ("LINK", LINK))


def placeholders(found: Column, tag: str, offset: Column) -> Column:
    """``[TAG_n]`` for each match, numbered from ``offset``."""
    return F.transform(
        found, lambda m, i: F.concat(F.lit(f"[{tag}_"), (offset + i).cast("string"), F.lit("]"))
    )


def unmask(c: Column, keys: Column, values: Column) -> Column:
    """Put the masked strings back, last mask first: a link may have swallowed a masked number."""
    pairs = F.reverse(F.arrays_zip(keys.alias("k"), values.alias("v")))
    return F.aggregate(pairs, c, lambda acc, p: F.replace(acc, p["k"], p["v"]))


NAMES = rf"{tx.BEFORE}[A-Z][a-z]+(?:{tx.WS}+[A-Z][a-z]+)*{tx.AFTER}"
FIGURES = rf"{tx.BEFORE}[0-9]+(?:%(?={tx.WORD})|{tx.AFTER})"
ACRONYMS = tx.any_word(lx.TECH_TERMS)


def facts(c: Column, names: int | None = None, figures: int | None = None, terms: int | None = None, most: int | None = None) -> Column:
    """Names, figures and technical terms, distinct, in this order; each kind and all together may be limited to the first ones."""
    def first(found: Column, n: int | None) -> Column:
        return found if n is None else F.slice(found, 1, n)

    kinds = ((NAMES, names), (FIGURES, figures), (ACRONYMS, terms))
    return first(F.array_distinct(F.concat(*[first(spans.matches(c, pattern), n) for pattern, n in kinds])), most)

