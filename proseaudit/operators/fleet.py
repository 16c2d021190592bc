"""Fleet analytics over the relational tables. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import visual


def at(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def megabytes(size: Column) -> Column:
    return F.when(size > 0, F.round(size / 1048576.0, 2)).otherwise(0.0)


def overview(users: DataFrame, sessions: DataFrame, documents: DataFrame, analyses: DataFrame, now: str) -> DataFrame:
    """One row of totals. One pass per table; the four one-row results are joined side by side."""
    t = at(now)
    n = F.count(F.lit(1))
    u = users.agg(
        n.alias("users_total"), F.count_if("is_active").alias("users_active"),
        (n - F.count_if("is_active")).alias("users_inactive"),
        F.count_if(F.col("role") == "admin").alias("admins"), F.count_if(F.col("role") == "user").alias("regular_users"),
        F.count_if(F.col("last_login") >= t - F.expr("interval 24 hours")).alias("logins_24h"),
        F.count_if(F.col("last_login") >= t - F.expr("interval 7 days")).alias("logins_7d"),
    )
    s = sessions.agg(F.count_if(F.col("expires_at") > t).alias("sessions_active"))
    d = documents.agg(
        n.alias("documents_total"), F.count("processed_at").alias("documents_processed"),
        (n - F.count("processed_at")).alias("documents_pending"),
    )
    a = analyses.agg(n.alias("analyses_total"), F.coalesce(F.sum("total_issues"), F.lit(0)).cast("long").alias("issues_total"))
    one = F.lit(1).alias("_one")
    out = u.select(one, "*")
    for frame in (s, d, a):
        out = out.join(frame.select(one, "*"), "_one")
    return out.drop("_one")


def user_page(users: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Users by last login, newest first, never-logged-in last; ``total`` is the count of all users."""
    total = users.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("_one"))
    page = users.orderBy(F.desc_nulls_last("last_login"), "id").limit(limit + offset)
    rest = page.orderBy(F.desc_nulls_last("last_login"), "id").offset(offset)
    return rest.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def recent_logins(users: DataFrame, limit: int = 20) -> DataFrame:
    return users.orderBy(F.desc_nulls_last("last_login"), "id").limit(limit).select(
        "id", "email", "display_name", "role", "last_login", "is_active"
    )


def with_user(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Session with its user's mail and name, ``Unknown`` when the user is gone."""
    u = users.select(F.col("id").alias("user_id"), F.col("email").alias("_e"), F.col("display_name").alias("_n"))
    return sessions.join(u, "user_id", "left").withColumns({
        "user_email": F.coalesce("_e", F.lit("Unknown")), "user_name": F.coalesce("_n", F.lit("Unknown")),
    }).drop("_e", "_n")


def active_sessions(sessions: DataFrame, users: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """Newest live sessions. The top-k comes first, so only ``limit`` rows meet the users, and those
    few rows are the side that is broadcast."""
    live = sessions.where(F.col("expires_at") > at(now)).orderBy(F.desc("created_at"), "id").limit(limit)
    return _lookup_user(live, users).select(
        F.col("id").alias("session_id"), F.coalesce("_email", F.lit("Unknown")).alias("user_email"),
        F.coalesce("_name", F.lit("Unknown")).alias("user_name"), "created_at", "expires_at", "ip_address",
        F.substring("user_agent", 1, 100).alias("user_agent"),
    )


def _lookup_user(few: DataFrame, users: DataFrame) -> DataFrame:
    """Left join of a few rows to the user table: the users are first cut to those that are wanted
    by a semi join against the few rows, then joined."""
    wanted = F.broadcast(few.select(F.col("user_id").alias("id")).distinct())
    found = users.join(wanted, "id", "left_semi").select(
        F.col("id").alias("user_id"), F.col("email").alias("_email"), F.col("display_name").alias("_name")
    )
    return few.join(found, "user_id", "left")


def first_analysis(analyses: DataFrame, columns: list[str]) -> DataFrame:
    """The analysis with the smallest id of each document. A minimum over a struct combines before
    the shuffle, where a ranking window would move every row."""
    return analyses.groupBy("document_id").agg(
        F.min(F.struct("id", *columns)).alias("a")
    ).select("document_id", F.col("a.id").alias("analysis_id"), *[F.col(f"a.{c}").alias(c) for c in columns])


def recent_documents(documents: DataFrame, users: DataFrame, analyses: DataFrame, limit: int = 50) -> DataFrame:
    """Newest uploads with uploader and first analysis; top-k before both joins."""
    top = documents.orderBy(F.desc_nulls_last("uploaded_at"), F.desc("id")).limit(limit)
    wanted = F.broadcast(top.select(F.col("id").alias("document_id")))
    mine = first_analysis(
        analyses.join(wanted, "document_id", "left_semi"), ["total_issues", "grammar_issues", "tone_issues", "processing_time_seconds"]
    ).withColumnRenamed("document_id", "id")
    return _lookup_user(top, users).join(mine, "id", "left").select(
        "id", "original_filename", "document_type", F.col("file_size_bytes").alias("size_bytes"),
        megabytes(F.col("file_size_bytes")).alias("size_mb"), "uploaded_at", "processed_at",
        F.col("processed_at").isNotNull().alias("is_processed"),
        F.col("_email").alias("uploader_email"), F.col("_name").alias("uploader_name"),
        "total_issues", "grammar_issues", "tone_issues", "processing_time_seconds",
    )


def stored_vocabulary(issues: DataFrame) -> DataFrame:
    """Adds the stored severity and category; unknown ones become medium and grammar.

    The mapping loses ``usage`` and ``word-list``, so the analyzer's own category stays beside it.
    """
    return issues.withColumns({
        "stored_severity": F.coalesce(visual.lookup(F.coalesce("severity", F.lit("medium")), lx.STORED_SEVERITY), F.lit("medium")),
        "stored_category": F.coalesce(visual.lookup(F.coalesce("category", F.lit("grammar")), lx.STORED_CATEGORY), F.lit("grammar")),
    })


def children(parents: DataFrame, kids: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Number of children of each parent, zero included. Children are counted before the join."""
    n = kids.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias("n_children"))
    return parents.join(n, parent_key, "left").fillna(0, ["n_children"])


def orphans(kids: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is gone."""
    return kids.where(F.col(child_key).isNotNull()).join(
        parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti"
    )


def cascade_delete(kids: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children left after their deleted parents take theirs along."""
    return kids.join(deleted.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def set_null_on_delete(kids: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    gone = deleted.select(F.col(parent_key).alias(child_key)).distinct().withColumn("_gone", F.lit(True))
    return kids.join(gone, child_key, "left").withColumn(
        child_key, F.when(F.col("_gone").isNull(), F.col(child_key))
    ).drop("_gone")


def unprocessed(incoming: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return incoming.join(done.select(key).distinct(), key, "left_anti")


def already_processed(incoming: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return incoming.join(done.select(key), key, "left_semi")


def mark_processed(incoming: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """All incoming rows with ``is_processed``, in one join."""
    seen = done.select(key).distinct().withColumn("is_processed", F.lit(True))
    return incoming.join(seen, key, "left").withColumn("is_processed", F.coalesce("is_processed", F.lit(False)))


def member_role(groups: Column, admin_group: str) -> Column:
    return F.when(F.coalesce(F.array_contains(groups, admin_group), F.lit(False)), "admin").otherwise("user")


def has_access(groups: Column, admin_group: str, user_group: str) -> Column:
    """In either group; an empty list is let in."""
    g = F.coalesce(groups, F.expr("cast(array() as array<string>)"))
    return (F.size(g) == 0) | F.array_contains(g, admin_group) | F.array_contains(g, user_group)


def upsert_users(existing: DataFrame, logins: DataFrame) -> DataFrame:
    """Merge login rows ``(oid, email, display_name, role, ts)`` into ``(oid, ..., created_at, last_login, is_active)``.

    A login updates mail, name, role and last login and re-activates; an unknown user is created.
    Both sides shrink to one row per user before they are joined.
    """
    latest = logins.groupBy("oid").agg(
        F.max(F.struct("ts", "email", "display_name", "role")).alias("l"), F.min("ts").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    old = existing.select(
        "oid", F.col("email").alias("_email"), F.col("display_name").alias("_name"), F.col("role").alias("_role"),
        F.col("created_at").alias("_created"), F.col("last_login").alias("_login"), F.col("is_active").alias("_active"),
    )
    known = F.col("_created").isNotNull()
    # A user created by their only login has no last login yet.
    seen_again = known | (F.col("_n") > 1)
    return old.join(latest, "oid", "full_outer").select(
        "oid", F.coalesce("l.email", "_email").alias("email"), F.coalesce("l.display_name", "_name").alias("display_name"),
        F.coalesce("l.role", "_role").alias("role"), F.coalesce("_created", "_first").alias("created_at"),
        F.coalesce(F.when(seen_again, F.col("l.ts")), F.col("_login")).alias("last_login"),
        F.when(F.col("l").isNotNull(), True).otherwise(F.col("_active")).alias("is_active"),
    )


def apply_status(users: DataFrame, changes: DataFrame, actor: str | Column) -> DataFrame:
    """New snapshot of ``is_active`` from ``(id, is_active)`` changes; nobody deactivates themselves."""
    actor = F.lit(actor) if not isinstance(actor, Column) else actor
    new = changes.groupBy("id").agg(F.bool_and("is_active").alias("_new"))
    allowed = (F.col("id") != actor) | F.col("_new")
    return users.join(new, "id", "left").withColumn(
        "is_active", F.coalesce(F.when(allowed, F.col("_new")), F.col("is_active"))
    ).drop("_new")


def live_sessions(sessions: DataFrame, now: str) -> DataFrame:
    """What a purge keeps."""
    return sessions.where(~(F.col("expires_at") < at(now)))


def purge_count(sessions: DataFrame, now: str) -> DataFrame:
    return sessions.agg(
        F.count_if(F.col("expires_at") < at(now)).alias("purged"), F.count_if(~(F.col("expires_at") < at(now))).alias("kept")
    )


def session_expiry(created: Column, hours: int = 24) -> Column:
    return created + F.expr(f"interval {hours} hours")


def session_windows(events: DataFrame, user: str, at_column: str, gap: str) -> DataFrame:
    """``(user, started_at, expires_at, n_events)``: a session lasts until ``gap`` after its last event; an event at that very time opens a new one.

    Works on tables and, with a watermark on the time, on streams; there, late events within the watermark join or bridge sessions.
    Events without a user make sessions of their own, those without a time none.
    """
    timed = events.withColumn(at_column, F.col(at_column).cast("timestamp")) if not events.isStreaming else events
    found = timed.groupBy(user, F.session_window(at_column, gap).alias("_s")).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(user, F.col("_s.start").alias("started_at"), F.col("_s.end").alias("expires_at"), "n_events")
