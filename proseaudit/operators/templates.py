"""Best matching template for a file name: exact, keyword, fuzzy, default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import naming
from proseaudit.functions import text as tx


def edit_ratio(a: Column, b: Column) -> Column:
    """1 for equal texts, less by each edit in proportion to the longer one."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _common_length(a: Column, b: Column) -> Column:
    """Length of the longest text that stands in both. If one of some length does, so does a shorter one, so the length is built up from its binary digits."""
    most = F.least(F.length(a), F.length(b))
    digits = F.array(*[F.lit(1 << i) for i in range(15, -1, -1)])

    def step(found: Column, digit: Column) -> Column:
        n = found + digit
        starts = F.sequence(F.lit(1), F.length(a) - n + 1)
        return F.when((n <= most) & F.exists(F.when(n <= most, starts), lambda i: F.contains(b, F.substr(a, i, n))), n).otherwise(found)

    return F.aggregate(digits, F.lit(0), step)


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over all characters; 1 for two empty texts.

    The first block is the longest text that stands in both (the earliest in ``a``, then in ``b``); the parts before it and the parts after it are
    matched in the same way. The pairs of parts still to be matched are the stack of one fold, which no pair of texts of less than 65,536 characters outgrows.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    zero = F.struct(F.array(pair(a, b)).alias("open"), F.lit(0).alias("n"))

    def split(top: Column, rest: Column, total: Column) -> Column:
        def at(n: Column) -> Column:
            def block(i: Column) -> Column:
                x, y = top["a"], top["b"]
                j = F.position(F.substr(x, i, n), y)
                before = pair(F.substr(x, F.lit(1), i - 1), F.substr(y, F.lit(1), j - 1))
                after = pair(F.substr(x, i + n, F.length(x)), F.substr(y, j + n, F.length(y)))
                both = F.filter(F.array(before, after), lambda p: (p["a"] != "") & (p["b"] != ""))
                return F.struct(F.concat(rest, both).alias("open"), (total + n).alias("n"))

            first = F.array_position(F.transform(F.sequence(F.lit(1), F.length(top["a"]) - n + 1), lambda i: F.contains(top["b"], F.substr(top["a"], i, n))), True)
            return F.when(n > 0, tx.let(first.cast("int"), block)).otherwise(F.struct(rest.alias("open"), total.alias("n")))

        return tx.let(_common_length(top["a"], top["b"]), at)

    def step(state: Column, _: Column) -> Column:
        left = F.size(state["open"])
        return F.when(left == 0, state).otherwise(split(F.element_at(state["open"], -1), F.slice(state["open"], F.lit(1), left - 1), state["n"]))

    rounds = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)  # a block opens two pairs at most
    every = F.length(a) + F.length(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(2.0 * F.aggregate(rounds, zero, step, lambda state: state["n"]) / every)


def keyword_template(clean: Column, lead: str = lx.LEAD_WORD, available: list[str] | None = None) -> Column:
    """First template whose keyword occurs in the cleaned name, in priority order."""
    out = None
    for suffix, words in lx.TEMPLATE_KEYWORDS:
        name = f"{lead} {suffix}"
        if available is not None and name not in available:
            continue
        test = F.lit(False)
        for w in words:
            test = test | clean.contains(w)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(None).cast("string") if out is None else out


def default_template(available: list[str], lead: str = lx.LEAD_WORD) -> str | None:
    for name in (f"{lead} standard template", "standard template", f"{lead} standard", "standard"):
        if name in available:
            return name
    return min(available) if available else None


def best_by_ratio(names: DataFrame, available: list[str], clean: str = "clean", ratio: Callable[[Column, Column], Column] = edit_ratio) -> DataFrame:
    """``(clean, template, ratio)``: the best template per distinct name by ``ratio``, ties to the first by name.

    Templates are a short list of literals, so candidates are an array in the row, not a join.
    """
    pairs = names.select(clean).distinct().select(clean, F.explode(F.array(*[F.lit(t) for t in available])).alias("template"))
    scored = pairs.withColumn("ratio", ratio(F.col(clean), F.col("template")))
    best = scored.groupBy(clean).agg(F.min(F.struct((-F.col("ratio")).alias("neg"), F.col("template").alias("t"))).alias("b"))
    return best.select(clean, F.col("b.t").alias("template"), (-F.col("b.neg")).alias("ratio"))


def match_templates(
    files: DataFrame, available: list[str], name: str = "filename", threshold: float = 0.6, lead: str = lx.LEAD_WORD
) -> DataFrame:
    """Adds ``clean``, ``template`` and ``strategy`` (exact, keyword, fuzzy, default).

    A fuzzy match needs a ``block_ratio`` of ``threshold``.
    """
    named = files.withColumn("clean", naming.matching_name(F.col(name))).withColumns({
        "_exact": F.when(F.col("clean").isin(*available), F.col("clean")),
    }).withColumn("_keyword", keyword_template(F.col("clean"), lead, available))
    open_names = named.where(F.col("_exact").isNull() & F.col("_keyword").isNull())
    fuzzy = best_by_ratio(open_names, available, ratio=block_ratio).where(F.col("ratio") >= threshold).select(
        "clean", F.col("template").alias("_fuzzy")
    )
    default = F.lit(default_template(available, lead)).cast("string")
    out = named.join(fuzzy, "clean", "left")
    return out.withColumns({
        "strategy": F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_keyword").isNotNull(), "keyword")
        .when(F.col("_fuzzy").isNotNull(), "fuzzy").otherwise("default"),
        "template": F.coalesce("_exact", "_keyword", "_fuzzy", default),
    }).drop("_exact", "_keyword", "_fuzzy")


def template_key(name: Column) -> Column:
    """Look-up key: lower case, without the file suffix."""
    return F.replace(F.lower(name), F.lit(".json"), F.lit(""))
