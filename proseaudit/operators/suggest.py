"""From a detected issue to a validated suggestion.

Works on issue rows, which are few compared with the texts they came from. Each stage is its own
projection, so a long expression is computed once and not once per use; none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseaudit.functions import gates, rewrite, spans, validate
from proseaudit.functions import text as tx
from proseaudit.operators.stage import settle
from proseaudit.sources import sinks

REWRITTEN = ("positive_language", "active_voice", "specificity", "inclusivity")


def mask_text(df: DataFrame, text: str = "text", prefix: str = "mask") -> DataFrame:
    """Adds ``<prefix>_text``, ``<prefix>_keys`` and ``<prefix>_values``.

    Numbers, then dates, then links; placeholders are numbered over all passes.
    """
    empty = F.expr("cast(array() as array<string>)")
    out = df.withColumns({f"{prefix}_text": F.col(text), f"{prefix}_keys": empty, f"{prefix}_values": empty})
    for tag, pattern in rewrite.MASKS:
        t = F.col(f"{prefix}_text")
        out = out.withColumn("_found", spans.matches(t, pattern)).withColumn(
            "_names", rewrite.placeholders(F.col("_found"), tag, F.size(f"{prefix}_keys"))
        )
        out = out.withColumns({
            f"{prefix}_text": F.when(F.size("_found") > 0, spans.join_spans(spans.gaps(t, pattern), F.col("_names"))).otherwise(t),
            f"{prefix}_keys": F.concat(f"{prefix}_keys", "_names"),
            f"{prefix}_values": F.concat(f"{prefix}_values", "_found"),
        }).drop("_found", "_names")
    return settle(out, [f"{prefix}_text", f"{prefix}_keys", f"{prefix}_values"])


def rule_rewrite(rule: Column, body: Column, context: Column) -> Column:
    return (
        F.when(rule == "positive_language", rewrite.positive(body, context))
        .when(rule == "active_voice", rewrite.active(body))
        .when(rule == "specificity", rewrite.specific(body))
        .when(rule == "inclusivity", rewrite.inclusive(body))
    )


def parse_candidates(responses: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Candidates from free-form responses: ``(keys..., line, candidate)``.

    Numbered lines win, and the first use of a number counts; without any, plain lines are taken in
    order. Outer quotes go; ``NO_CHANGE`` means no candidate but uses up its number.
    """
    numbered = r"^\s*(\d+)[.)]\s*(.+)$"
    lines = responses.select(
        *keys, F.col(content).rlike("(?m)" + numbered).alias("_numbered"),
        F.posexplode(F.filter(F.split(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")), "\n"), lambda s: tx.strip(s) != "")).alias("_pos", "_line"),
    )
    lines = lines.select(
        *keys, "_pos",
        F.when(F.col("_numbered"), F.when(F.col("_line").rlike(numbered), F.regexp_extract("_line", numbered, 1).try_cast("int")))  # a cast that fails is slow
        .otherwise(F.col("_pos") + 1).alias("line"),
        F.when(F.col("_numbered"), F.regexp_extract("_line", numbered, 2)).otherwise(F.col("_line")).alias("_raw"),
    ).where("line is not null")
    raw = tx.strip("_raw")
    clean = F.when(F.upper(raw) != "NO_CHANGE", F.btrim(F.btrim(raw, F.lit('"')), F.lit("'")))
    return (
        lines.withColumn("candidate", F.nullif(clean, F.lit("")))
        .groupBy(*keys, "line").agg(F.min(F.struct("_pos", "candidate"))["candidate"].alias("candidate"))
        .where("candidate is not null")
    )


def parse_reported(responses: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``(keys..., line, reason)`` from responses that hold a JSON object with an ``issues`` list."""
    block = F.regexp_extract(F.col(content), r"(?s)\{.*\}", 0)
    parsed = F.from_json(block, "struct<issues:array<struct<line:int,reason:string>>>")
    return responses.select(*keys, F.inline(parsed["issues"])).select(
        *keys, "line", F.coalesce("reason", F.lit("")).alias("reason")
    )


def number_lines(items: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``batch`` (0-based) and ``line`` (1-based in the batch) per queue, both long, ordered by the columns ``order``.

    A queue may hold most rows, so it is never ordered as a whole. Rows are dealt out by range of queue and order into a table, ranked within their
    part of it, and shifted by the rows of the queue in the parts before. A window sees one part, or one row per part.
    """
    placed = items.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    rows = sinks.written(placed, "numbered")
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    index = F.col("_shift") + F.col("_rank") - 1
    return rows.withColumn("_rank", rank).join(shifts, [*keys, "_part"]).select(
        *items.columns, F.floor(index / size).cast("long").alias("batch"), (F.pmod(index, F.lit(size)) + 1).cast("long").alias("line"))


def add_suggestions(issues: DataFrame, candidate: str | None = None) -> DataFrame:
    """Fills ``suggestion`` and ``method`` of the tone and usage issues.

    An external candidate that validates wins; else the rule rewrite if it validates and says
    something new; else ``no_improvement``. ``reject_reason`` tells why the last try failed.
    """
    rule = F.col("rule_name")
    mine = rule.isin(*REWRITTEN)
    text = F.col("found_text")
    staged = issues.withColumns({
        "_heading": F.when(mine, gates.heading_part(text)),
        "_body": F.when(mine, gates.body_part(text)),
        "_context": F.when(mine, F.coalesce(gates.rewrite_context(text), F.lit("neutral"))),
    })
    staged = staged.withColumn("_original", gates.reattach(F.col("_heading"), F.col("_body")))
    if candidate is not None:
        given = F.col(candidate).isNotNull()
        staged = staged.withColumn(
            "_candidate", F.when(mine & given, tx.finalize_sentence(gates.reattach(F.col("_heading"), F.col(candidate))))
        )
        judged = validate.constrained_reason(
            F.col("_original"), F.col("_candidate"), rewrite.facts(F.col("_body")), gates.constraint_context(F.col("_body")),
            rule, applies=rule.isin("positive_language", "active_voice"),
        )
        staged = staged.withColumn("_cand_reason", F.when(given, F.when(mine, judged)).otherwise("llm_no_parse"))
    else:
        staged = staged.withColumns({"_candidate": F.lit(None).cast("string"), "_cand_reason": F.lit("empty_response")})
    use_candidate = mine & F.coalesce(F.col("_cand_reason") == "valid", F.lit(False))
    # A rewrite by rule is only made where no candidate is taken.
    open_ = mine & ~use_candidate
    staged = staged.withColumn(
        "_fallback", F.when(open_ & (F.col("_body") != ""), rule_rewrite(rule, F.col("_body"), F.col("_context")))
    )
    staged = staged.withColumn("_fallback", F.when(open_, tx.finalize_sentence(gates.reattach(F.col("_heading"), F.col("_fallback")))))
    staged = staged.withColumn("_fall_reason", F.when(open_, validate.reason(F.col("_original"), F.col("_fallback"), rule)))
    use_fallback = mine & (F.col("_fall_reason") == "valid")
    done = staged.withColumns({
        "method": F.when(use_candidate, "external").when(use_fallback, "fallback").when(mine, "no_improvement").otherwise(F.col("method")),
        "suggestion": F.when(use_candidate, F.col("_candidate")).when(use_fallback, F.col("_fallback")).when(~mine, F.col("suggestion")),
        "reject_reason": F.when(mine & ~use_candidate & ~use_fallback, F.col("_fall_reason")),
        "candidate_reject": F.when(mine & ~use_candidate, F.col("_cand_reason")),
    }).drop(
        "_heading", "_body", "_context", "_fallback", "_original", "_candidate", "_cand_reason", "_fall_reason"
    )
    return settle(done, ["method", "suggestion", "reject_reason", "candidate_reject"])


def keep_actionable(issues: DataFrame) -> DataFrame:
    """Drops tone and usage issues without a real suggestion; other categories stay."""
    real = validate.is_real(F.col("found_text"), F.col("suggestion"))
    return issues.where(~F.col("category").isin("tone", "usage") | real)


def rejection_tally(issues: DataFrame) -> DataFrame:
    """How often each reason was given, for candidates and for rule rewrites."""
    both = F.array(
        F.when(F.col("candidate_reject").isin("empty_response", "llm_no_parse"), F.col("candidate_reject"))
        .when(F.col("candidate_reject").isNotNull(), F.concat(F.lit("reject_"), F.col("candidate_reject"))),
        F.when(F.col("reject_reason").isNotNull(), F.concat(F.lit("fallback_"), F.col("reject_reason"))),
    )
    return issues.select(F.explode(both).alias("reason")).where("reason is not null").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )
