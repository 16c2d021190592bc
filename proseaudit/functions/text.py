"""Character classes and plain string helpers.

The classes are spelled out instead of using ``\\w``, ``\\s`` and ``\\b``: those are ASCII-only by
default on the JVM, and ``\\b`` differs between JDK releases. The explicit forms mean the same in
every regex engine, so results do not depend on the runtime.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character (letters, numbers, underscore), as the inside of a bracket class.
W = r"\p{L}\p{N}_"
WORD = rf"[{W}]"
NOT_WORD = rf"[^{W}]"
# A white-space character, including the Unicode separators and the C0/C1 separators.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

# The same white-space set as characters, for trimming without a regex.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Word starts and word ends. Lookarounds keep the neighbours out of the match.
BEFORE = rf"(?<!{WORD})"
AFTER = rf"(?!{WORD})"


def word(pattern: str) -> str:
    """``pattern`` between word boundaries."""
    return f"{BEFORE}(?:{pattern}){AFTER}"


def any_word(terms) -> str:
    """One alternation over literal terms, longest first so that a prefix never shadows a term.

    The look-ahead on the possible first characters comes first: it is the cheapest test and fails
    at most positions.
    """
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return f"{first_of(ordered)}{word('|'.join(quote(t) for t in ordered))}"


def first_of(terms) -> str:
    """Look-ahead for the first character of any term, in either case."""
    chars = sorted({c for t in terms for c in (t[0].lower(), t[0].upper())})
    return "(?=[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "])"


def mentions(low: Column, literals) -> Column:
    """Any of the literals occurs. A byte search, an order of magnitude cheaper than a regex pass,
    so it goes in front of one. A literal that holds another one need not be looked for."""
    out, literals = None, list(dict.fromkeys(literals))
    for literal in (x for x in literals if not any(y != x and y in x for y in literals)):
        test = low.contains(literal)
        out = test if out is None else out | test
    return F.lit(True) if out is None else out


def quote(literal: str) -> str:
    """Backslash-escape a literal for use inside a regex."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-/" else ch for ch in literal)


def ci(pattern: str) -> str:
    """Case-insensitive. Every pattern here spells its letters in ASCII, so ASCII folding does."""
    return "(?i)" + pattern


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim every white-space character at both ends (``trim`` alone only drops U+0020)."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def squeeze(c: Column | str) -> Column:
    """Collapse white-space runs to one space and trim. A single space is no match, as it stays what it is."""
    return strip(F.regexp_replace(col(c), f"{WS}{{2,}}|(?! ){WS}", " "))


CUT = "\ue000"  # of the private use area


def split_at(c: Column | str, pattern: str) -> Column:
    """All parts between the matches of a pattern that matches no empty text.

    ``split`` compiles its pattern for every row, unless it is one plain character. So the matches become such a character first; only a
    text that holds that character itself is split by the pattern.
    """
    c = col(c)
    return F.when(c.contains(CUT), F.split(c, pattern, -1)).otherwise(F.split(F.regexp_replace(c, pattern, CUT), CUT, -1))


def words(c: Column | str) -> Column:
    """White-space separated tokens; empty array for blank text."""
    return F.filter(split_at(strip(c), f"{WS}+"), lambda t: t != "")


def comparable(c: Column | str) -> Column:
    """Lower-case, drop everything but word and white-space characters, trim."""
    return strip(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]", ""))


def finalize_sentence(c: Column | str) -> Column:
    """Collapse spaces, strip outer quotes, close with '.' unless it already ends in ``.!?:``."""
    bare = F.btrim(F.btrim(squeeze(c), F.lit('"')), F.lit("'"))
    return let(bare, lambda s: F.when((s == "") | s.rlike(r"[.!?:]$"), s).otherwise(F.concat(s, F.lit("."))))


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def upper_first(c: Column) -> Column:
    """Upper-case the first character, lower-case the rest."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def is_all_upper(c: Column) -> Column:
    """At least one upper-case letter and no lower-case one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def is_title_shaped(c: Column) -> Column:
    """Every letter run starts with a capital and goes on in lower case."""
    return c.rlike(r"\p{L}") & ~c.rlike(r"(?:^|[^\p{L}])\p{Ll}") & ~c.rlike(r"\p{L}\p{Lu}")


def ellipsis(c: Column | str, width: int = 80) -> Column:
    """Cut to ``width`` characters and mark the cut."""
    c = col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)
