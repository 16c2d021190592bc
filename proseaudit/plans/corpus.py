"""The document model read out of the given tables, whole.

``documents``      one page of text per document; its lines are the elements of the rule queries.
``conversations``  documents of several pages: conversation, turn, role.
``customer``       users, and the names in the sentences below.
``orders``         uploaded documents; ``lineitem`` their analyses and stored issues.
``events``         sessions, progress, logs and audit rows.

The prose in ``documents`` is invented, so many rules never fire on it. ``SEEDS`` are sentences with
a name and a number from each customer row spliced in; rule queries run over both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseaudit.functions import naming
from proseaudit.operators import stage
from proseaudit.sources import readers

SEEDS = (
    "{name} can't ship and won't wait.  It's late",
    "Use {name} & partners and/or staff -- e.g. teams",
    "{k99} people currently use health care tools",
    "The chairman said he is disabled. The plan was created",
    "It might be late and is not ready for {name}.",
    "He said \"{name}\". Total {k10000} units; use \"x;\" now",
    "{name}",
    "DON'T go. We're {name}; they're “late” , ok?",
    "In 2024 we sold {k1000} units, ID{k10000} and 5000GB at 10000.50 for {name}",
    "See p. {k99} now. {k99} percent of {name}; {k99}-10 items: 3rd place. ({k99} left)",
    "Cyber Security and machine learning are user friendly, i.e. built in — for {name}",
    "Weaknesses:",
    "Key Strengths",
    "Project Scope: the team at {name} does not have staff and is not able to wait",
    "Weakness: we do not have vey  good staff at {name}",
    "We are looking for people first or guys at {name}, etc. Then you should begin using AI, ML and API",
    "{name} failed. The worst risk is bad governance!",
    "“Quality is not negotiable” – {name}",
    "People who suffer are suffering from manpower gaps at present; she or he and his/her team",
    "• {name} ships, tests and waits.",
    "{k99}. Do this for {name}.",
    "See Figure {k99} below.",
    "CHAPTER {k99}",
    "Mail a.b@{k99}.example.com or https://x.org/{k99} by May 2, 2025 for $5,000 or 50%x",
)


def splice(template: str, name: Column, key: Column) -> Column:
    """Fill ``{name}``, ``{k99}`` (1..99), ``{k1000}`` and ``{k10000}`` (key plus the number)."""
    values = {
        "name": name, "k99": (key % 99 + 1).cast("string"),
        "k1000": (key + 1000).cast("string"), "k10000": (key + 10000).cast("string"),
    }
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        parts += [F.lit(head), values[slot]]
    return F.concat(*parts, F.lit(rest))


def splice_sql(template: str, name: str, key: str) -> str:
    values = {
        "name": name, "k99": f"CAST({key} % 99 + 1 AS VARCHAR)",
        "k1000": f"CAST({key} + 1000 AS VARCHAR)", "k10000": f"CAST({key} + 10000 AS VARCHAR)",
    }
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        parts += ["'" + head.replace("'", "''") + "'", values[slot]]
    return "concat(" + ", ".join([*parts, "'" + rest.replace("'", "''") + "'"]) + ")"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return readers.table(spark, sf, "documents").select("doc_id", "text")


def seeded(spark: SparkSession, sf: str) -> DataFrame:
    """A file of one row group is read by one task, and a customer becomes many sentences; so the short rows are dealt out first."""
    c = stage.dealt_out(readers.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    texts = F.array(*[splice(t, F.col("c_name"), F.col("c_custkey")) for t in SEEDS])
    return c.select(
        F.lit("seed").alias("src"), F.col("c_custkey").alias("key"), F.posexplode(texts).alias("ord", "text")
    )


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split(F.col("text"), "\n", -1)
    return documents(spark, sf).select(F.lit("doc").alias("src"), F.col("doc_id").alias("key"), F.posexplode(lines).alias("ord", "text"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(src, key, ord, text)``: every line of every document and every seeded sentence."""
    both = document_lines(spark, sf).unionByName(seeded(spark, sf))
    return both.withColumn("ord", F.col("ord").cast("long"))


LINES_SQL = (
    "lines AS (SELECT 'doc' AS src, doc_id AS key, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ord, "
    "unnest(string_split(text, chr(10))) AS text FROM documents "
    f"UNION ALL SELECT 'seed', c_custkey, CAST(generate_subscripts(s, 1) - 1 AS BIGINT), unnest(s) FROM "
    f"(SELECT c_custkey, [{', '.join(splice_sql(t, 'c_name', 'c_custkey') for t in SEEDS)}] AS s FROM customer))"
)


# --- multi-page documents: conversations ------------------------------------------------------------

def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as pages with their text."""
    return readers.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_index"), "role", F.col("text").alias("raw_text")
    )


# --- relational tables ----------------------------------------------------------------------------------

def users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as users; the last event is the last login."""
    last = readers.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_login"))
    return readers.table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("user_id"), "left").select(
        F.col("c_custkey").alias("id"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("display_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"), "last_login",
    )


USERS_SQL = (
    "users AS (SELECT c_custkey AS id, concat(lower(c_name), '@example.org') AS email, c_name AS display_name, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role, c_acctbal >= 0 AS is_active, last_login "
    "FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_login FROM events GROUP BY user_id) e ON c_custkey = e.user_id)"
)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event opens a session of 24 hours; some users are not customers."""
    e = readers.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") * 11).alias("user_id"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"), F.col("event_type").alias("ip_address"),
        F.repeat(F.col("props"), 12).alias("user_agent"),
    )


SESSIONS_SQL = (
    "sessions AS (SELECT event_id AS id, user_id * 11 AS user_id, ts AS created_at, ts + INTERVAL 24 HOUR AS expires_at, "
    "event_type AS ip_address, repeat(props, 12) AS user_agent FROM events)"
)


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as uploaded documents, with every kind of suffix and a range of sizes."""
    k = F.col("o_orderkey")
    name = F.concat(
        F.lit("Deck ("), F.col("o_orderpriority"), F.lit(") v"), (k % 7).cast("string"),
        F.element_at(F.array(*[F.lit(x) for x in (".pptx", ".PDF", ".docx", "", ".tar.pdf")]), (k % 5 + 1).cast("int")),
    )
    return readers.table(spark, sf, "orders").select(
        k.alias("id"), name.alias("original_filename"), F.col("o_custkey").alias("user_id"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * 2).alias("file_size_bytes"), F.col("o_orderdate").alias("uploaded_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 1 day")).alias("processed_at"),
        naming.extension(name).alias("document_type"),
    )


UPLOADS_SQL = (
    "uploads AS (SELECT o_orderkey AS id, concat('Deck (', o_orderpriority, ') v', CAST(o_orderkey % 7 AS VARCHAR), "
    "['.pptx', '.PDF', '.docx', '', '.tar.pdf'][CAST(o_orderkey % 5 + 1 AS INTEGER)]) AS original_filename, o_custkey AS user_id, "
    "CAST(round(o_totalprice * 100) AS BIGINT) * 2 AS file_size_bytes, o_orderdate AS uploaded_at, "
    "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS processed_at, "
    "['.pptx', '.pdf', '.docx', '', '.pdf'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS document_type FROM orders)"
)


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as analysis results; several per document, some of documents that are gone."""
    q = F.col("l_quantity").cast("long")
    return readers.table(spark, sf, "lineitem").select(
        (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("document_id"),
        q.alias("total_issues"), (q % 7).alias("grammar_issues"), (q % 5).alias("tone_issues"),
        F.col("l_extendedprice").alias("processing_time_seconds"),
    )


ANALYSES_SQL = (
    "analyses AS (SELECT CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS id, l_orderkey AS document_id, "
    "CAST(l_quantity AS BIGINT) AS total_issues, CAST(l_quantity AS BIGINT) % 7 AS grammar_issues, "
    "CAST(l_quantity AS BIGINT) % 5 AS tone_issues, l_extendedprice AS processing_time_seconds FROM lineitem)"
)

_CATEGORY_CYCLE = ("grammar", "word-list", "tone", "usage", "formatting", "filename", "tone-issue", "misc")
_SEVERITY_CYCLE = ("error", "warning", "suggestion", "info", "odd")


def stored_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as issue rows: category, severity and rule from the keys, page from the line."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    return readers.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).cast("long").alias("page_index"),
        pick(_CATEGORY_CYCLE, F.col("l_partkey")).alias("category"),
        F.when(F.col("l_tax") > 0, pick(_SEVERITY_CYCLE, F.col("l_suppkey"))).alias("severity"),
        F.concat(F.lit("rule_"), (F.col("l_partkey") % 13).cast("string")).alias("rule_name"),
        F.when(F.col("l_returnflag") == "R", F.lit("")).when(F.col("l_returnflag") == "A", F.lit("do this")).alias("suggestion"),
    )


STORED_ISSUES_SQL = (
    "issues AS (SELECT l_orderkey AS doc_id, CAST(CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS BIGINT) AS page_index, "
    f"{list(_CATEGORY_CYCLE)}[CAST(l_partkey % {len(_CATEGORY_CYCLE)} + 1 AS INTEGER)] AS category, "
    f"CASE WHEN l_tax > 0 THEN {list(_SEVERITY_CYCLE)}[CAST(l_suppkey % {len(_SEVERITY_CYCLE)} + 1 AS INTEGER)] END AS severity, "
    "concat('rule_', CAST(l_partkey % 13 AS VARCHAR)) AS rule_name, "
    "CASE WHEN l_returnflag = 'R' THEN '' WHEN l_returnflag = 'A' THEN 'do this' END AS suggestion FROM lineitem)"
)
