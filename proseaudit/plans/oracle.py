"""SQL fragments shared by the twins of the registered queries.

The twins run on an engine whose regexes have no lookaround and an ASCII-only ``\\b``. Word
boundaries are therefore made visible first: ``mark`` wraps every word run in ``‹ ›``, patterns are
written against the marked text, and ``unmark`` takes the marks off again.
"""

from __future__ import annotations

import re

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TRIM = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mark(x: str) -> str:
    return f"regexp_replace({x}, '({W}+)', '‹\\1›', 'g')"


def unmark(x: str) -> str:
    return f"regexp_replace({x}, '[‹›]', '', 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {TRIM})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {lit(pattern)})) AS BIGINT)"


def sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"


def m(phrase: str, space: str = " ") -> str:
    """A literal phrase as a pattern on marked text."""
    out = []
    for token in re.findall(r"\w+|\s+|[^\w\s]", phrase):
        if token.isspace():
            out.append(space)
        elif re.match(r"\w", token):
            out.append(f"‹{token}›")
        else:
            out.append(re.escape(token))
    return "".join(out)


def any_m(phrases, space: str = " ") -> str:
    return "(?:" + "|".join(m(p, space) for p in sorted(phrases, key=lambda t: (-len(t), t))) + ")"


def fold(x: str, steps) -> str:
    """Steps on marked text, re-marked in between because a later step may match earlier output."""
    for pattern, replacement in steps:
        x = unmark(sub(mark(x), pattern, replacement))
    return x


def comparable(x: str) -> str:
    return strip(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]', '', 'g')")


def finalize(x: str) -> str:
    s = f"trim(trim({squeeze(x)}, '\"'), '''')"
    return f"CASE WHEN {s} = '' OR regexp_matches({s}, '[.!?:]$') THEN {s} ELSE {s} || '.' END"


def cases(mapping: dict, x: str, otherwise: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + f" ELSE {otherwise} END"
