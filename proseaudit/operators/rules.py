"""The rule registry and the one-scan rule projection.

A rule is a named test on a text column, optionally with a rewrite. ``detect`` builds one array of
nullable structs over all rules and inlines it once, so a corpus is scanned once however many rules
are active. Rules of sentence scope see sentences, rules of element scope see whole elements; both
kinds of text come out of one ``explode``.

User rules are added with ``register`` or passed in a list; they look exactly like the ones here.
"""

from __future__ import annotations

import contextlib
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseaudit.functions import gates, spans
from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx
from proseaudit.operators import segment


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    severity: str
    description: str
    test: Callable[[Column, Column], Column]    # text, lower-case text
    rewrite: Callable[[Column, Column | None], Column] | None = None
    reason: Callable[[Column], Column] | None = None
    score: Callable[[Column], Column] | None = None
    confidence: float = 1.0
    scope: str = "element"
    tags: tuple[str, ...] = field(default=())
    hint: Callable[[Column, Column], Column] | None = None    # cheap; holds for any text with a sentence for which the test holds


REGISTRY: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    REGISTRY[rule.name] = rule
    return rule


# --- grammar ---------------------------------------------------------------------------------------

CONTRACTION = tx.ci(tx.any_word(lx.CONTRACTIONS))
AND_OR = tx.ci(tx.word("and/or"))
AMPERSAND = rf"{tx.WS}+&{tx.WS}+"
SHORT_NUMBER = r"(?=[0-9])(?<![0-9.,])[0-9]{1,2}(?![0-9.,])"
OPENING = rf"(?:{tx.WS}|[\"'“‘(\[{{])*+"
# A short number that opens a sentence; a test only, the span code decides.
OPENING_NUMBER = rf"(?:^|[.!?:;]){OPENING}[0-9]{{1,2}}(?![0-9.,])"
LONG_NUMBER = r"(?=[0-9])(?<![0-9.])[0-9]{4,}"
PERIOD_SPACES = r"([.!?]) {2,}"
QUOTE = "[\"'’”]"
# One pattern for both directions, so that matches never overlap.
QUOTE_ORDER = rf"{QUOTE}{tx.WS}*[.,]|[;:]{QUOTE}"
DASHES = "—|-{2,}"


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def expand_contractions(c: Column, terms: Column | None = None) -> Column:
    table = _map(lx.CONTRACTIONS)

    def expand(m: Column) -> Column:
        long_form = F.try_element_at(table, F.lower(m))
        return F.when(tx.starts_upper(m), tx.upper_first(long_form)).otherwise(long_form)

    return spans.replace_unprotected(c, CONTRACTION, terms, expand)


def replace_and_or(c: Column, terms: Column | None = None) -> Column:
    return spans.replace_unprotected(c, AND_OR, terms, lambda m: F.lit("or"), "or")


def replace_ampersand(c: Column, terms: Column | None = None) -> Column:
    return spans.replace_unprotected(c, AMPERSAND, terms, lambda m: F.lit(" and "), " and ")


def single_space(c: Column, terms: Column | None = None) -> Column:
    return spans.replace_unprotected(
        c, PERIOD_SPACES, terms, lambda m: F.concat(F.substring(m, 1, 1), F.lit(" ")), "$1 "
    )


def order_quotes(c: Column, terms: Column | None = None) -> Column:
    """Commas and periods inside the closing quote, semicolons and colons outside."""
    def swap(m: Column) -> Column:
        last = F.right(m, F.lit(1))
        return F.concat(last, F.left(m, F.lit(1)))

    return spans.replace_unprotected(c, QUOTE_ORDER, terms, swap)


def en_dashes(c: Column, terms: Column | None = None) -> Column:
    return spans.replace_unprotected(c, DASHES, terms, lambda m: F.lit("–"), "–")


def in_code_token(s: spans.Span) -> Column:
    """Letters (at most one hyphen between) right before, or a letter or hyphen right after. One line
    break may stand between the letters and the number."""
    return s.before.rlike(r"[A-Za-z]-?[A-Za-z]\n?\z") | s.after.rlike(r"^[A-Za-z\-]")


def is_page_ref(s: spans.Span) -> Column:
    """``p``, ``p.``, ``pp`` or ``pp.`` in the three characters before."""
    left = F.right(F.concat(s.previous, s.before), F.lit(3))
    return left.rlike(rf"(?i)(?:^|{tx.WS})pp?\.?\n?\z")


def in_range(s: spans.Span) -> Column:
    return s.before.rlike(r"[-–]\z") | s.after.rlike("^[-–]")


def before_decimal(s: spans.Span) -> Column:
    return s.after.rlike(r"^\.[0-9]")


def at_sentence_start(s: spans.Span) -> Column:
    """Only spaces and opening marks between here and the start of the text or a closing mark."""
    return s.before.rlike(rf"[.!?:;]{OPENING}\z") | (s.is_first & s.before.rlike(rf"^{OPENING}\z"))


def counts_in_scale(s: spans.Span) -> Column:
    """The next word is a scale word."""
    return F.concat(s.after, s.following).rlike(
        tx.ci(rf"^{tx.NOT_WORD}*(?:percent|million|billion|trillion){tx.AFTER}")
    )


def is_probable_year(number: Column) -> Column:
    return number.cast("decimal(38,0)").between(1900, 4000)


def spell_out_numbers(c: Column, terms: Column | None = None) -> Column:
    table = _map({str(n): lx.number_word(n).capitalize() for n in range(1, 100)})

    def spell(s: spans.Span) -> Column:
        keep = (
            spans.protected_by(s.text, terms) | in_range(s) | in_code_token(s) | is_page_ref(s) | counts_in_scale(s)
        )
        value = F.regexp_replace(s.text, "^0+", "")
        return F.when(at_sentence_start(s) & ~keep, F.try_element_at(table, value))

    return spans.rewrite(c, SHORT_NUMBER, spell)


def group_digits(c: Column, terms: Column | None = None) -> Column:
    """Thousands separators, by position and so for any length; leading zeros are dropped."""
    def group(s: spans.Span) -> Column:
        keep = spans.protected_by(s.text, terms) | before_decimal(s) | in_code_token(s) | is_page_ref(s)
        plain = F.regexp_replace(s.text, r"^0+(?=[0-9])", "")
        year = (F.length(plain) == 4) & plain.between("1900", "4000")
        return F.when(~keep & ~year, F.regexp_replace(plain, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ","))

    return spans.rewrite(c, LONG_NUMBER, group)


def _grammar(name, severity, description, pattern, rewrite, confidence=1.0, marks=(), also=None):
    def test(c: Column, low: Column) -> Column:
        hit = tx.mentions(low, marks) & c.rlike(pattern)
        return hit if also is None else hit & c.rlike(also)

    return register(Rule(name, "grammar", severity, description, test, rewrite, confidence=confidence))


_grammar("contractions", "warning", "Write contractions out in formal text", CONTRACTION, expand_contractions, marks=("'",))
_grammar("and_or", "warning", "Choose one of 'and' and 'or'", AND_OR, replace_and_or, marks=("and/or",))
_grammar("ampersand", "warning", "Write 'and' for '&'", AMPERSAND, replace_ampersand, 0.9, marks=("&",))
_grammar("numerals_spell_out", "suggestion", "Spell out numbers below 100 that open a sentence", SHORT_NUMBER, spell_out_numbers, 0.85, also=OPENING_NUMBER)
_grammar("numerals_commas", "suggestion", "Group the digits of long numbers", LONG_NUMBER, group_digits, 0.95)
_grammar("period_spacing", "suggestion", "One space after a sentence", PERIOD_SPACES, single_space, marks=("  ",))
_grammar("quotation_marks", "suggestion", "Commas and periods inside quotes, semicolons and colons outside", QUOTE_ORDER, order_quotes, 0.9, marks=("\"", "'", "’", "”"))
_grammar("hyphens", "suggestion", "Use en dashes", DASHES, en_dashes, marks=("—", "--"))

# --- word list -----------------------------------------------------------------------------------------

PREFERRED = tx.ci(tx.any_word(lx.PREFERRED_TERMS))
ABBREVIATION = tx.ci(rf"{tx.BEFORE}(?:e\.g\.|i\.e\.)(?!{tx.WS}*,)")


def prefer_terms(c: Column, terms: Column | None = None) -> Column:
    table = _map(lx.PREFERRED_TERMS)
    return spans.replace_unprotected(c, PREFERRED, terms, lambda m: F.try_element_at(table, F.lower(m)))


def comma_after_abbreviation(c: Column, terms: Column | None = None) -> Column:
    return spans.replace_unprotected(c, ABBREVIATION, terms, lambda m: F.concat(F.lower(m), F.lit(",")))


def apply_word_list(c: Column, terms: Column | None = None) -> Column:
    """Both word-list rewrites as one suggestion. Neither can create a match for the other."""
    preferred = F.when(c.rlike(PREFERRED), prefer_terms(c, terms)).otherwise(c)
    return F.when(c.rlike(ABBREVIATION), comma_after_abbreviation(preferred, terms)).otherwise(preferred)


register(Rule(
    "word_list", "word-list", "suggestion", "Use the preferred term",
    lambda c, low: (tx.mentions(low, lx.PREFERRED_TERMS) & c.rlike(PREFERRED))
    | (tx.mentions(low, ("e.g.", "i.e.")) & c.rlike(ABBREVIATION)),
    apply_word_list,
))

# --- tone, per sentence -------------------------------------------------------------------------------------

def sentiment(c: Column, weights: dict[str, float] = lx.SENTIMENT_WEIGHTS, boosters: dict[str, float] | None = None, negators: Iterable[str] = ()) -> Column:
    """Sum of word weights squashed to (-1, 1) by ``s / sqrt(s*s + 15)``.

    ``weights`` is any lexicon. A booster directly before a word of it adds its own weight in the word's direction; a negator directly
    before the word, or before its booster, turns the word around and weakens it by a quarter. Neither is used by default.
    """
    before = "|".join(tx.quote(w) for w in [*(boosters or {}), *negators])
    lead = rf"(?:{tx.BEFORE}(?:{before}){tx.WS}+){{0,2}}" if before else ""
    table, boost = _map(weights), _map(boosters) if boosters else None

    def weight(m: Column) -> Column:
        if not before:
            return F.try_element_at(table, m)
        parts = F.split(m, f"{tx.WS}+")
        own, first = F.try_element_at(table, F.element_at(parts, -1)), F.slice(parts, 1, F.size(parts) - 1)
        if boost is not None:
            more = F.aggregate(first, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(boost, w), F.lit(0.0)))
            own = own + F.signum(own) * more
        return F.when(F.exists(first, lambda w: w.isin(*negators)), own * -0.75).otherwise(own) if negators else own

    total = F.aggregate(
        spans.matches(F.lower(c), lead + tx.any_word(weights)), F.lit(0.0),
        lambda acc, m: acc + F.coalesce(weight(m), F.lit(0.0)),
    )
    return total / F.sqrt(total * total + F.lit(lx.SENTIMENT_ALPHA))


def tone_gate(c: Column) -> Column:
    return ~gates.is_heading_like(c) & gates.is_sentence_like(c) & ~gates.is_quoted(c)


def is_negative(c: Column, low: Column, weights: dict[str, float] = lx.SENTIMENT_WEIGHTS, **modifiers) -> Column:
    """Negated phrasing, else a low sentiment score without a neutral domain word. The lexicon and its modifiers are those of ``sentiment``.

    A negated phrase always contains a negation, so the neutral-word exception can only apply to
    the sentiment branch.
    """
    harsh = tx.mentions(low, weights) & (sentiment(c, weights, **modifiers) <= lx.SENTIMENT_THRESHOLD)
    excused = gates.has_neutral_domain_word(c) & ~gates.has_negation(c)
    return (low.contains("no") & gates.has_negative_phrase(c)) | (harsh & ~excused)


#: Words without which no score is low.
HARSH = [w for w, weight in lx.SENTIMENT_WEIGHTS.items() if weight < 0]

register(Rule(
    "positive_language", "tone", "warning", "Say it positively",
    lambda c, low: is_negative(c, low) & tone_gate(c),
    score=lambda c: F.when(~gates.has_negative_phrase(c), sentiment(c)), scope="sentence",
    hint=lambda c, low: (low.contains("no") & gates.has_negative_phrase(c)) | tx.mentions(low, HARSH),
))
register(Rule(
    "active_voice", "tone", "info", "Use the active voice and commit to the statement",
    lambda c, low: (gates.is_passive(c) | (tx.mentions(low, lx.HEDGES) & gates.has_hedging(c))) & tone_gate(c), scope="sentence",
    hint=lambda c, low: gates.is_passive(c) | tx.mentions(low, lx.HEDGES),
))

# --- usage, per element ------------------------------------------------------------------------------------------

VAGUE_TIME = tx.ci(tx.any_word(lx.VAGUE_TIMES))
GENERIC_PEOPLE = tx.ci(rf"(?=[pP]){tx.BEFORE}people{tx.AFTER}(?!{tx.WS}+(?:{'|'.join(lx.PEOPLE_QUALIFIERS)}))")
GENDERED = tx.ci(tx.any_word(lx.GENDERED_TERMS))
PRONOUN = tx.ci(
    rf"{tx.first_of(lx.GENDERED_PRONOUNS)}{tx.BEFORE}(?:{'|'.join(sorted(lx.GENDERED_PRONOUNS, key=len, reverse=True))}){tx.AFTER}(?!{tx.WS}+or (?:she|he))"
)
DISABILITY = tx.ci(tx.any_word(lx.DISABILITY_PHRASES))


def _first_reason(c: Column, parts) -> Column:
    """``label: match`` for each sub-rule that fires, joined."""
    found = [
        F.when(c.rlike(p), F.concat(F.lit(label + ": "), F.lower(F.regexp_extract(c, p, 0)))) for label, p, _ in parts
    ]
    return F.concat_ws("; ", *found)


# (label, pattern, literals one of which must occur)
SPECIFICITY_PARTS = (
    ("vague time", VAGUE_TIME, lx.VAGUE_TIMES),
    ("generic group", GENERIC_PEOPLE, ("people",)),
)
INCLUSIVITY_PARTS = (
    ("gendered term", GENDERED, lx.GENDERED_TERMS),
    ("gendered pronoun", PRONOUN, ()),
    ("disability phrase", DISABILITY, lx.DISABILITY_PHRASES),
)


def _any_part(c: Column, low: Column, parts) -> Column:
    out = F.lit(False)
    for _, pattern, literals in parts:
        out = out | (tx.mentions(low, literals) & c.rlike(pattern))
    return out


register(Rule(
    "specificity", "usage", "suggestion", "Say when, and say who is meant",
    lambda c, low: _any_part(c, low, SPECIFICITY_PARTS) & ~gates.is_heading_like(c, swot=False),
    reason=lambda c: _first_reason(c, SPECIFICITY_PARTS),
))
register(Rule(
    "inclusivity", "usage", "warning", "Use inclusive language",
    lambda c, low: _any_part(c, low, INCLUSIVITY_PARTS) & ~gates.is_heading_like(c, swot=False),
    reason=lambda c: _first_reason(c, INCLUSIVITY_PARTS),
))

REVIEW_RULES = tuple(REGISTRY)

# --- projection ---------------------------------------------------------------------------------------------------------

ISSUE_FIELDS = (
    "rule_name", "severity", "category", "description", "found_text", "suggestion", "score", "confidence", "method",
)


def text_units(elements: DataFrame) -> DataFrame:
    """Each element once as a whole (``sent_index`` -1) and once per sentence, headings excepted.

    One ``explode`` serves both scopes, so the input is scanned once.
    """
    whole = F.array(F.struct(F.lit("element").alias("scope"), F.lit(-1).alias("sent_index"), F.col("text").alias("unit")))
    parts = F.transform(
        segment.sentence_array(F.col("text")),
        lambda s, i: F.struct(F.lit("sentence").alias("scope"), i.alias("sent_index"), s.alias("unit")),
    )
    both = F.when(gates.is_heading_like(F.col("text")), whole).otherwise(F.concat(whole, parts))
    keep = [c for c in elements.columns if c != "text"]
    return elements.where(gates.long_enough(F.col("text"))).select(*keep, F.inline(both))


def _candidate(rule: Rule, unit: Column, low: Column, scope: Column | None, terms: Column | None) -> Column:
    hit = rule.test(unit, low)
    if scope is not None:
        hit = (scope == rule.scope) & hit
    description = F.lit(rule.description)
    if rule.reason is not None:
        description = F.concat(description, F.lit(": "), rule.reason(unit))
    none = F.lit(None)
    return F.when(hit, F.struct(
        F.lit(rule.name).alias("rule_name"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.category).alias("category"),
        description.alias("description"),
        unit.alias("found_text"),
        (rule.rewrite(unit, terms) if rule.rewrite else none.cast("string")).alias("suggestion"),
        (rule.score(unit) if rule.score else none).cast("double").alias("score"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit("rule-based").alias("method"),
    ))


#: Category of the rows that say a rule gave no verdict on a text.
FAILED = "rule-error"


@contextlib.contextmanager
def _lenient(spark: SparkSession):
    """Expressions analysed within it give null where they would fail: a division by zero, a bad cast, an index that is not there."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _guarded(rule: Rule, unit: Column, candidate: Column, scope: Column | None, low: Column) -> Column:
    """The candidate of a user's rule, or an error row where its test is null."""
    silent = rule.test(unit, low).isNull()
    if scope is not None:
        silent = (scope == rule.scope) & silent
    none = F.lit(None)
    return F.when(silent, F.struct(
        F.lit(rule.name).alias("rule_name"), F.lit("error").alias("severity"), F.lit(FAILED).alias("category"), F.lit("The rule gave no verdict on this text").alias("description"),
        unit.alias("found_text"), none.cast("string").alias("suggestion"), none.cast("double").alias("score"), F.lit(1.0).alias("confidence"), F.lit("rule-based").alias("method"),
    )).otherwise(candidate)


def may_hold(text: Column, rules: Iterable[str | Rule]) -> Column:
    """Cheap test that holds for every text with a sentence that one of the rules finds; always true if one of them has no hint."""
    hints = [(REGISTRY[r] if isinstance(r, str) else r).hint for r in rules]
    if None in hints:
        return F.lit(True)
    return tx.let(F.lower(text), lambda low: reduce(or_, [hint(text, low) for hint in hints]))


def detect(
    units: DataFrame,
    rules: Iterable[str | Rule] = REVIEW_RULES,
    text: str = "unit",
    scope: str | None = "scope",
    terms: str | None = None,
) -> DataFrame:
    """Issues of all rules in one projection.

    ``terms`` names an array column of protected strings. A rewriting rule whose every match is
    protected or excused by context leaves the text as it is and yields no issue.

    A rule that cannot be built, or that does not fit the columns, is reported as a warning and left out; the others run. A rule of
    the user that fails on a single text (a division by zero, a bad cast), or whose test is null there, gives an error row for that text, of the
    category ``rule-error``, and all other issues stand. An error that a rule raises itself (``raise_error``, a UDF) still ends the job.
    """
    chosen = [REGISTRY[r] if isinstance(r, str) else r for r in rules]
    unit, lowered = F.col(text), units.withColumn("_low", F.lower(F.col(text)))
    own, users = [], []
    scope_column, terms_column = F.col(scope) if scope else None, F.col(terms) if terms else None
    with _lenient(units.sparkSession):
        for r in chosen:
            try:
                candidate = _candidate(r, unit, F.col("_low"), scope_column, terms_column)
                if REGISTRY.get(r.name) is r:
                    own.append(candidate)
                    continue
                candidate = _guarded(r, unit, candidate, scope_column, F.col("_low"))
                lowered.select(candidate)  # analysed here, so a bad rule fails alone
                users.append(candidate)
            except Exception as ex:  # noqa: BLE001 - whatever a rule of the user raises
                warnings.warn(f"rule {r.name} is left out: {str(ex)[:200]}", stacklevel=2)
        if users:  # analysed here, so what fails on a value gives null
            lowered = lowered.withColumn("_users", F.array(*users))
    candidates = F.array(*own)
    if users:
        candidates = F.concat(candidates, F.col("_users")) if own else F.col("_users")
    # an element's own confidence makes way for the issue's
    drop = {text, scope, terms, *ISSUE_FIELDS}
    keep = [c for c in units.columns if c not in drop]
    return (
        lowered.select(*keep, F.inline(F.filter(candidates, lambda x: x.isNotNull())))
        .where(~F.col("suggestion").eqNullSafe(F.col("found_text")))
    )


def eligible_for_usage(elements: DataFrame, terms: str | None = None) -> DataFrame:
    """Non-blank, not heading-like, not protected."""
    c = F.col("text")
    out = elements.where((tx.strip(c) != "") & ~gates.is_heading_like(c, swot=False))
    return out if terms is None else out.where(~gates.text_protected(c, F.col(terms)))
