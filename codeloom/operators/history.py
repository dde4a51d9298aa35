"""The decision log and the state tables kept as append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import rules, text, vocab
from codeloom.operators.queue import queue_stats
from codeloom.operators.totals import side_by_side
from codeloom.sources.tables import flag_filter, optional_eq


# ------------------------------------------------------------------ state from logs
def current_state(log: DataFrame, keys: list[str], ts: str, tie: str, created: str | None = None) -> DataFrame:
    """Latest version per key; ``created`` keeps the time of the first version."""
    rest = [c for c in log.columns if c not in keys and c != created]
    aggs = [F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_s")]
    if created:
        aggs.append(F.min(created).alias(created))
    return log.groupBy(*keys).agg(*aggs).select(*keys, "_s.*", *([created] if created else []))


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(table.select(*keys), keys, "left_anti")


def coalesce_update(table: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """New values where the patch has one, old values elsewhere."""
    changed = [c for c in patch.columns if c not in keys]
    new = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changed])
    return table.join(new, keys, "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns]
    )


def mark_read(notifications: DataFrame, username: str | None = None, notification_id: str | None = None) -> DataFrame:
    """Set ``read`` on one notification or on all of a user's."""
    hit = F.lit(True)
    if username is not None:
        hit = hit & F.coalesce(F.col("username") == username, F.lit(False))
    if notification_id is not None:
        hit = hit & (F.col("id") == notification_id)
    return notifications.withColumn("read", F.when(hit, True).otherwise(F.col("read")))


def delete_by_id(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return table.join(doomed.select(key), key, "left_anti")


def deleted_count(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return table.join(doomed.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n_deleted"))


def set_status(ids: DataFrame, status: str, ts: Column | None = None) -> DataFrame:
    """Status event rows for the log; ``current_state`` makes them effective."""
    return ids.select("id", F.lit(status).alias("status"), (F.current_timestamp() if ts is None else ts).alias("ts"))


# ------------------------------------------------------------------ sessions, projects, jobs
def session_checkpoints(checkpoints: DataFrame, session_id=None) -> DataFrame:
    """Checkpoints of one session, or of all, newest first within each."""
    rows = optional_eq(checkpoints, "session_id", session_id)
    order = [F.desc("created_at"), F.desc("checkpoint_id")]
    return rows.select("session_id", "checkpoint_id", "agent_type", "created_at").orderBy(
        *([] if session_id is not None else [F.asc("session_id")]), *order
    )


def projects_for(projects: DataFrame, manager=None) -> DataFrame:
    return optional_eq(projects, "manager", manager).orderBy(F.desc("created_at"), F.desc("project_id"))


def session_counts(sessions: DataFrame, username=None) -> DataFrame:
    """Sessions per user, or the number for one."""
    if username is not None:
        return sessions.filter(F.col("username") == username).agg(F.count(F.lit(1)).alias("n_sessions"))
    return sessions.groupBy("username").agg(F.count(F.lit(1)).alias("n_sessions"))


def session_detail(sessions: DataFrame, finding: str = "map<string,string>") -> DataFrame:
    """JSON columns parsed and counted."""
    parsed = {
        "findings": F.from_json(F.coalesce("findings", F.lit("[]")), f"array<{finding}>"),
        "pending_reviews": F.from_json(F.coalesce("pending_reviews", F.lit("[]")), "array<string>"),
    }
    return sessions.withColumns(parsed).withColumns(
        {"findings_count": F.size("findings"), "pending_count": F.size("pending_reviews")}
    )


def job_list(jobs: DataFrame, username=None) -> DataFrame:
    return (
        optional_eq(jobs, "username", username)
        .select(
            "job_id", "status", "action_type", text.clip(F.col("description")).alias("description"),
            "created_at", "completed_at",
        )
        .orderBy(F.desc("created_at"), F.desc("job_id"))
    )


def job_status_counts(jobs: DataFrame, by: str | None = None) -> DataFrame:
    counts = [F.count(F.lit(1)).alias("total")] + [
        F.count_if(F.col("status") == status).alias(name)
        for status, name in (("running", "running"), ("done", "done"), ("error", "errors"))
    ]
    return jobs.groupBy(by).agg(*counts) if by else jobs.agg(*counts)


def attach_results(reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job of each review, if any."""
    return reviews.join(
        jobs.select(F.col("review_id").alias("id"), "job_id", F.col("status").alias("job_status")), "id", "left"
    )


# ------------------------------------------------------------------ reviewers
def decided(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("was_approved").isNotNull())


def reviewers(decisions: DataFrame) -> DataFrame:
    """Distinct reviewers with a decision, sorted."""
    return decided(decisions).filter(F.col("reviewer").isNotNull()).select("reviewer").distinct().orderBy("reviewer")


def reviewer_page(
    decisions: DataFrame, limit: int = vocab.REVIEWER_PAGE, reviewer=None, action_type: str | None = None
) -> DataFrame:
    """Newest decisions per reviewer, at most ``limit`` each; the limit is the page size.

    The rank filter runs before the shuffle too, so a busy reviewer moves few rows.
    """
    rows = optional_eq(optional_eq(decided(decisions), "reviewer", reviewer), "action_type", action_type)
    newest = Window.partitionBy("reviewer").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        rows.filter(F.col("reviewer").isNotNull())
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
    )


def reviewer_history(
    decisions: DataFrame, limit: int = vocab.REVIEWER_PAGE, reviewer=None, action_type: str | None = None,
    with_entries: bool = False,
) -> DataFrame:
    """Totals over each reviewer's page, and the page itself (``limit`` entries at most)."""
    page = reviewer_page(decisions, limit, reviewer, action_type)
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if("was_approved").alias("approved")]
    if with_entries:
        entry = F.struct("rank", *[c for c in page.columns if c not in ("rank", "reviewer")])
        aggs.append(F.sort_array(F.collect_list(entry)).alias("history"))
    return page.groupBy("reviewer").agg(*aggs).withColumns(
        {
            "rejected": F.col("total") - F.col("approved"),
            "approval_rate": rules.share_2dp(F.col("approved"), F.col("total")),
        }
    )


def action_stats(decisions: DataFrame, by: str | None = "action_type", with_total: bool = True) -> DataFrame:
    """Counts, approval rate and mean confidence of decided actions.

    Per ``by`` value and, in the same pass, over all (null key).  Without any decision the
    total row is all zeros.
    """
    rows = decided(decisions)
    approved = F.col("was_approved")
    aggs = [
        F.count(F.lit(1)).alias("total"), F.count_if(approved).alias("approved"),
        F.count_if(~approved).alias("rejected"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"),
    ]
    if by is None:
        counted = rows.agg(*aggs)
    else:
        counted = (rows.rollup(by) if with_total else rows.groupBy(by)).agg(*aggs)
    return counted.withColumn("approval_rate", rules.share_2dp(F.col("approved"), F.col("total")))


# ------------------------------------------------------------------ notifications
def notifications_page(
    notifications: DataFrame, username=None, unread_only: bool = False, limit: int = vocab.NOTIFICATION_PAGE
) -> DataFrame:
    """Newest notifications per user; the limit is the page size."""
    rows = flag_filter(optional_eq(notifications, "username", username), unread_only, ~F.col("read"))
    newest = Window.partitionBy("username").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def unread_counts(page: DataFrame) -> DataFrame:
    return page.groupBy("username").agg(
        F.count(F.lit(1)).alias("n_shown"), F.count_if(~F.col("read")).alias("unread_count")
    )


def notify(reviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """One notification per session that has reviews waiting.

    Sessions have (session_id, project_id, project_name, findings_count, username).
    """
    waiting = reviews.groupBy("session_id").agg(F.count(F.lit(1)).alias("pending_count"))
    message = F.concat(
        F.col("pending_count").cast("string"), F.lit(" action(s) need your review in '"), F.col("project_name"), F.lit("'")
    )
    return sessions.join(waiting, "session_id").select(
        text.natural_id("notification", F.col("session_id")).alias("id"), "project_id", "project_name", "session_id",
        message.alias("message"), "pending_count", "findings_count", F.lit(False).alias("read"), "username",
    )


# ------------------------------------------------------------------ log rows
def learning_rows(decided_reviews: DataFrame) -> DataFrame:
    """Learning rows of approve / reject decisions."""
    return decided_reviews.select(
        text.natural_id("learned", F.col("id"), F.col("review_timestamp")).alias("id"), "action_type",
        text.context_hash(F.col("action_type"), F.col("risk_level")).alias("context_hash"),
        (F.col("status") != "rejected").alias("was_approved"), "confidence", "review_notes",
        F.col("review_timestamp").alias("created_at"),
    )


def audit_rows(decided_reviews: DataFrame) -> DataFrame:
    """Audit rows of decisions, the payload as JSON."""
    approved = F.col("status") != "rejected"
    prefix = F.when(approved, "approved_").otherwise("rejected_")
    return decided_reviews.select(
        text.natural_id("audit", F.col("id"), F.col("review_timestamp")).alias("id"),
        F.concat(prefix, F.col("id")).alias("checkpoint_id"), "action_type",
        F.to_json(F.struct("target", "description")).alias("action_data"), "confidence", "risk_level",
        approved.alias("was_approved"), "reviewer", "review_notes", F.col("review_timestamp").alias("created_at"),
    )


def job_audit_rows(jobs: DataFrame) -> DataFrame:
    """Audit rows of finished background jobs."""
    return jobs.select(
        text.natural_id("audit_job", F.col("job_id")).alias("id"),
        F.concat(F.lit("async_job_"), F.col("job_id")).alias("checkpoint_id"), "action_type",
        F.to_json(F.struct("target", "description", "job_id")).alias("action_data"),
        F.lit(True).alias("was_approved"), F.lit("async_executor").alias("reviewer"),
        F.concat(F.lit("Executed via background job "), F.col("job_id"), F.lit(" (dry_run="),
                 F.initcap(F.col("dry_run").cast("string")), F.lit(")")).alias("review_notes"),
        F.col("completed_at").alias("created_at"),
    )


def tool_call_stats(calls: DataFrame) -> DataFrame:
    """Calls and duration per tool."""
    return calls.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.percentile_approx("duration_ms", 0.5).alias("median_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


# ------------------------------------------------------------------ dashboard
def dashboard(reviews: DataFrame, decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of queue totals, decision totals and the session count."""
    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])

    return side_by_side(
        prefixed(queue_stats(reviews), "queue_"),
        prefixed(action_stats(decisions, by=None), "actions_"),
        sessions.agg(F.count(F.lit(1)).alias("total_sessions")),
    )
