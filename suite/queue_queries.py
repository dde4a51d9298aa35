"""Queries over the review queue, routing and execution steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import rules, text
from codeloom.operators import coordinate, queue, routing
from codeloom.schemas import IMPACT
from suite.registry import query



@query("queue", """
    SELECT id, risk_level, CAST(CASE risk_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS BIGINT) AS risk_rank
    FROM queue""")
def risk_of(t):
    return t.queue.select("id", "risk_level", rules.risk_rank(F.col("risk_level")).cast("long").alias("risk_rank"))


@query("queue", "SELECT id, CAST(action_order AS BIGINT) AS action_order, file FROM queue")
def action_order(t):
    return queue.with_file(t.queue).select("id", F.col("action_order").cast("long"), "file")


def _entity_findings(t):
    """Queue rows as findings: the entity is the order."""
    impact = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in IMPACT.fields])
    return t.queue.select(
        F.lit("r").alias("repo"), F.lit("orders").alias("file_path"), F.lit("function").alias("entity_type"),
        text.target_file(F.col("target")).alias("entity_name"), "id", "action_type", "confidence",
        F.col("id").alias("title"), F.concat(F.lit("About "), F.col("id")).alias("description"),
        F.lit("why").alias("reasoning"), impact.alias("impact"), F.lit(None).cast("string").alias("suggested_fix"),
        F.lit(None).cast("string").alias("code_snippet"), F.lit(1).alias("line_number"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("finding_ord"), F.lit(0).alias("agent_ord"),
    )


_PRIO = (
    "CASE action_type WHEN 'fix_security' THEN 0 WHEN 'delete_import' THEN 2 WHEN 'delete_function' THEN 3 "
    "WHEN 'refactor_code' THEN 4 WHEN 'add_docstring' THEN 5 WHEN 'restructure' THEN 6 ELSE 7 END"
)


@query("queue", f"""
    WITH p AS (SELECT *, {_PRIO} AS prio FROM queue),
    g AS (SELECT file, count(*) AS n_findings, max(confidence) AS confidence, min(prio) AS prio,
                 arg_min(id, (prio, created_at, id)) AS pid, bool_or(action_type = 'refactor_code') AS r,
                 bool_or(action_type = 'add_docstring') AS d FROM p GROUP BY file),
    l AS (SELECT file, string_agg(action_type, ',' ORDER BY c, i) AS merged FROM (
              SELECT file, action_type, min(created_at) AS c, arg_min(id, (created_at, id)) AS i FROM p GROUP BY file, action_type) GROUP BY file)
    SELECT g.file AS entity_name, CASE prio WHEN 0 THEN 'fix_security' WHEN 2 THEN 'delete_import' WHEN 3 THEN 'delete_function'
               WHEN 4 THEN 'refactor_code' WHEN 5 THEN 'add_docstring' WHEN 6 THEN 'restructure' ELSE 'move_file' END AS action_type,
           n_findings::BIGINT AS n_findings, confidence, 'merged_' || pid AS finding_id, merged AS merged_actions,
           CASE WHEN prio = 4 AND d THEN 'refactor_code,add_docstring' ELSE '' END AS sub_actions,
           CASE WHEN prio = 4 AND d THEN 'Execute 2 actions on function ''' || g.file || ''': refactor_code → add_docstring'
                WHEN n_findings > 1 THEN 'About ' || pid || ' [merged ' || n_findings || ' findings]' ELSE 'About ' || pid END AS description
    FROM g JOIN l ON l.file = g.file""")
def group_entities(t):
    actions = coordinate.merge_to_action(coordinate.group_entities(_entity_findings(t)))
    return actions.select(
        "entity_name", "action_type", F.col("n_findings").cast("long"), "confidence", "finding_id",
        F.array_join("merged_actions", ",").alias("merged_actions"), F.array_join("sub_actions", ",").alias("sub_actions"),
        "description",
    )


@query("queue", f"""
    SELECT id, row_number() OVER (PARTITION BY file ORDER BY
        CASE WHEN action_type LIKE 'delete%' THEN 0 ELSE 1 END,
        CASE WHEN action_type LIKE 'delete%' THEN -owner ELSE {_PRIO} END, created_at, id) AS exec_order FROM queue""")
def execution_order(t):
    rows = t.queue.select(
        "id", "action_type", text.target_file(F.col("target")).alias("file_path"), F.col("owner").alias("current_line"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("first_ord"),
    )
    return coordinate.execution_order(rows).select("id", "exec_order")


@query("queue", f"""
    WITH g AS (SELECT file, arg_min(action_type, action_order) AS primary_type, max(CASE risk_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS worst,
                      count(DISTINCT action_type) AS n FROM queue GROUP BY file)
    SELECT file, CASE WHEN n > 1 THEN ['low', 'medium', 'high', 'critical'][worst + 1]
        ELSE CASE primary_type WHEN 'restructure' THEN 'critical' WHEN 'delete_function' THEN 'high' WHEN 'move_file' THEN 'high'
             WHEN 'fix_security' THEN 'high' WHEN 'refactor_code' THEN 'medium' ELSE 'low' END END AS effective_risk FROM g""")
def effective_risk(t):
    grouped = queue.with_file(t.queue).groupBy("file").agg(
        F.min_by("risk_level", "action_order").alias("risk"), F.collect_set("action_type").alias("subs")
    )
    return grouped.select("file", rules.effective_risk(F.col("risk"), F.col("subs")).alias("effective_risk"))


@query("queue decisions", """
    WITH rate AS (SELECT action_type, count(*) FILTER (NOT was_approved) / count(*) AS r FROM (
        SELECT *, row_number() OVER (PARTITION BY action_type, context_hash ORDER BY created_at DESC, id DESC) AS rn
        FROM decisions WHERE was_approved IS NOT NULL) WHERE rn <= 10 GROUP BY action_type)
    SELECT id, CASE WHEN risk_level = 'critical' OR confidence < 0.7 OR (risk_level = 'high' AND confidence < 0.85)
                     OR q.action_type IN ('fix_security', 'refactor_code') OR coalesce(rate.r, 0) > 0.5 THEN 'review' ELSE 'auto' END AS decision,
        CASE WHEN risk_level = 'critical' THEN 'Critical risk: ' || q.action_type
             WHEN confidence < 0.7 THEN 'low' WHEN risk_level = 'high' AND confidence < 0.85 THEN 'high'
             WHEN q.action_type = 'fix_security' THEN 'Security fixes always require manager approval'
             WHEN q.action_type = 'refactor_code' THEN 'Code refactoring always requires manager approval'
             WHEN coalesce(rate.r, 0) > 0.5 THEN 'history' ELSE 'auto' END AS why
    FROM queue q LEFT JOIN rate ON rate.action_type = q.action_type""")
def route(t):
    rows = t.queue.withColumn("sub_actions", F.array().cast("array<string>"))
    rates = routing.rejection_rate(t.decisions.filter(F.col("was_approved").isNotNull()))
    reason = F.col("reason")
    why = (
        F.when(F.startswith(reason, F.lit("Low conf")), "low").when(F.startswith(reason, F.lit("HIGH risk")), "high")
        .when(F.startswith(reason, F.lit("Historical")), "history").when(F.startswith(reason, F.lit("Auto")), "auto")
        .otherwise(reason)
    )
    return routing.route(rows, rates).select("id", "decision", why.alias("why"))


@query("queue", "SELECT id, CASE WHEN action_type = 'delete_import' AND confidence >= 0.7 THEN 'auto' ELSE 'review' END AS decision FROM queue WHERE action_type IN ('delete_import', 'fix_security')")
def route_task_mode(t):
    rows = t.queue.filter(F.col("action_type").isin("delete_import", "fix_security"))
    rows = rows.withColumn("sub_actions", F.array().cast("array<string>"))
    return routing.route(rows, mode="task", auto_approve=True).select("id", "decision")


@query("queue", """
    SELECT id, first_value(id) OVER w AS review_id, first_value(id) OVER w <> id AS is_duplicate FROM queue
    WINDOW w AS (PARTITION BY action_type, target ORDER BY created_at, id)""")
def dedup_pending(t):
    return queue.dedup_pending(t.queue).select("id", "review_id", "is_duplicate")


@query("queue", """
    SELECT id, action_type, target FROM queue QUALIFY row_number() OVER (PARTITION BY action_type, target ORDER BY created_at, id) = 1""")
def unique_pending(t):
    return queue.unique_pending(t.queue).select("id", "action_type", "target")


@query("queue", """
    SELECT q.id, EXISTS (SELECT 1 FROM queue o WHERE o.file = q.file AND o.action_order < q.action_order) AS is_blocked FROM queue q""")
def is_blocked(t):
    return queue.is_blocked(t.queue).select("id", "is_blocked")


@query("queue", """
    SELECT id, file, CAST(action_order AS BIGINT) AS action_order,
           CAST(CASE risk_level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS risk_rank FROM queue""")
def pending_sorted(t):
    rows = queue.pending_sorted(t.queue)
    return rows.select("id", "file", F.col("action_order").cast("long"), F.col("risk_rank").cast("long"))


@query("queue", """
    WITH b AS (SELECT *, min(action_order) OVER (PARTITION BY file) < action_order AS is_blocked FROM queue)
    SELECT id, file, is_blocked, bool_or(is_blocked) OVER (PARTITION BY file) AS has_blocked, count(*) OVER (PARTITION BY file) AS group_total,
        CASE WHEN is_blocked THEN 'Complete ''' || first_value(action_type) OVER (PARTITION BY file ORDER BY action_order, created_at, id) || ''' first'
             ELSE '' END AS block_reason FROM b""")
def pending_grouped(t):
    return queue.pending_grouped(t.queue).select("id", "file", "is_blocked", "has_blocked", "group_total", "block_reason")


@query("queue", """
    SELECT file, count(*)::BIGINT AS total, count(*) FILTER (b)::BIGINT AS blocked, count(*) FILTER (NOT b)::BIGINT AS ready
    FROM (SELECT file, min(action_order) OVER (PARTITION BY file) < action_order AS b FROM queue) GROUP BY ROLLUP (file)""")
def group_counts(t):
    return queue.group_counts(t.queue)


@query("queue", """
    WITH b AS (SELECT *, min(action_order) OVER (PARTITION BY file) < action_order AS is_blocked FROM queue)
    SELECT id, CASE WHEN is_blocked AND first_value(action_order) OVER w < action_order
        THEN 'Complete ''' || first_value(action_type) OVER w || ''' first' ELSE '' END AS block_reason
    FROM b WINDOW w AS (PARTITION BY file, owner ORDER BY action_order, created_at, id)""")
def block_reason(t):
    return queue.block_reason(t.queue, by_owner=True).select("id", "block_reason")


@query("queue", """
    WITH r AS (SELECT id, file || CASE action_type WHEN 'fix_security' THEN '@variable:v' WHEN 'delete_import' THEN '@import:v'
                        WHEN 'restructure' THEN '@structure:v' ELSE '@function:v' END || l AS target, action_type, o_totalprice, o_orderstatus, l
               FROM (SELECT *, split_part(target, ':', 2) AS l FROM queue) JOIN orders ON o_orderkey = CAST(file AS BIGINT))
    SELECT id, CASE action_type WHEN 'restructure' THEN 'loc' ELSE 'symbol' END AS why FROM r
    WHERE (action_type = 'restructure' AND floor(o_totalprice / 1000) <= 450)
       OR (action_type = 'fix_security' AND (o_orderstatus = 'F' OR CAST(l AS BIGINT) % 3 = 0))
       OR (action_type IN ('delete_import', 'delete_function', 'refactor_code', 'add_docstring') AND CAST(l AS BIGINT) % 3 = 0)""")
def invalidate_stale(t):
    """Orders stand for files: their price is the size, one part in three has gone."""
    kind = F.when(F.col("action_type") == "fix_security", "variable").when(F.col("action_type") == "delete_import", "import").when(
        F.col("action_type") == "restructure", "structure").otherwise("function")
    part = text.target_entity(F.col("target"))
    reviews = t.queue.withColumn("target", F.concat(text.target_file(F.col("target")), F.lit("@"), kind, F.lit(":v"), part))
    reviews = reviews.withColumns({"status": F.lit("pending"), "review_notes": F.lit("")})
    loc = t.orders.select(
        F.col("o_orderkey").cast("string").alias("path"), F.floor(F.col("o_totalprice") / 1000).alias("loc"))
    bucket = F.when(kind == "variable", "assignment").otherwise(kind)
    latest = (
        t.queue.select(text.target_file(F.col("target")).alias("path"), bucket.alias("bucket"), part.alias("p"))
        .filter(F.col("p").cast("long") % 3 != 0).distinct()
        .join(t.orders.select(F.col("o_orderkey").cast("string").alias("path"), "o_orderstatus"), "path")
        .select("path", "bucket", F.concat(F.lit("v"), "p").alias("name"),
                F.when(F.col("o_orderstatus") == "F", 'x = os.getenv("X")').otherwise("x = 1").alias("line_text"))
    )
    stale = queue.invalidate_stale(reviews, loc, latest)
    why = F.when(F.startswith("reason", F.lit("File now has")), "loc").otherwise("symbol")
    return stale.select("id", why.alias("why"))


def _reviews(t):
    return t.decisions.select(
        F.col("id"), "action_type", F.col("confidence"), F.lit("pending").alias("status"), F.lit("n").alias("review_notes"),
        "was_approved", F.col("reviewer").alias("decided_by"), "created_at",
    )


@query("decisions", """
    SELECT id, CASE WHEN was_approved THEN 'approved' WHEN NOT was_approved THEN 'rejected' ELSE 'pending' END AS status,
           CASE WHEN was_approved THEN 'fine' WHEN NOT was_approved THEN 'Rejected' ELSE 'n' END AS review_notes,
           CASE WHEN was_approved IS NOT NULL THEN reviewer END AS reviewer FROM decisions""")
def apply_decisions(t):
    rows = _reviews(t)
    said = F.when(F.col("was_approved"), "approve").otherwise("reject")
    first = rows.filter(F.col("was_approved").isNotNull()).select(
        F.col("id").alias("review_id"), said.alias("decision"), F.col("decided_by").alias("reviewer"),
        F.when(F.col("was_approved"), "fine").alias("notes"), F.col("created_at").alias("decided_at"),
    )
    later = first.withColumns({"decision": F.lit("reject"), "decided_at": F.col("decided_at") + F.expr("INTERVAL 1 DAY")})
    done = queue.apply_decisions(rows, first.unionByName(later))
    return done.select("id", "status", "review_notes", "reviewer")


@query("", """
    SELECT o_orderkey AS id, CASE WHEN ok > 0 AND ok < n THEN 'partially_approved' ELSE 'approved' END AS status,
           'n | execution: ' || ok || '/' || n || ' steps succeeded | job:' || o_orderkey AS review_notes
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def execution_outcome(t):
    reviews = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("approved").alias("status"), F.lit("n").alias("review_notes"))
    # An order has a handful of steps in its job record; here they are rebuilt from counts.
    counts = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("ok"))
    steps = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct((i <= F.col("ok")).alias("success")))
    jobs = counts.select(
        F.col("l_orderkey").cast("string").alias("job_id"), F.col("l_orderkey").alias("review_id"), F.lit("partial").alias("status"),
        F.lit(False).alias("success"), steps.alias("steps"))
    return queue.execution_outcome(reviews, jobs).select("id", "status", "review_notes")


@query("", """
    SELECT l_orderkey AS job_id, CASE WHEN bool_and(l_returnflag <> 'R' OR l_linestatus = 'F') THEN 'done' ELSE 'partial' END AS status,
           count(*) FILTER (l_returnflag <> 'R' OR l_linestatus = 'F') AS n_ok, count(*) AS n_steps FROM lineitem GROUP BY l_orderkey""")
def job_outcome(t):
    steps = t.lineitem.select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_returnflag") != "R").alias("success"),
        (F.col("l_linestatus") == "F").alias("skipped"))
    return queue.job_outcome(steps, "job_id")


_STATUS = "CASE WHEN was_approved THEN 'approved' WHEN NOT was_approved THEN CASE WHEN id % 4 = 0 THEN 'invalidated' ELSE 'rejected' END ELSE 'pending' END"


@query("decisions", f"""
    SELECT count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s <> 'pending') AS completed, count(*) FILTER (s = 'approved') AS approved,
           count(*) FILTER (s NOT IN ('pending', 'approved')) AS rejected, count(*) FILTER (s = 'invalidated') AS n_invalidated,
           floor((200 * count(*) FILTER (s = 'approved') + count(*) FILTER (s <> 'pending')) / (2 * count(*) FILTER (s <> 'pending'))) / 100.0::DOUBLE AS approval_rate
    FROM (SELECT {_STATUS} AS s FROM decisions)""")
def queue_stats(t):
    status = F.when(F.col("was_approved"), "approved").when(
        ~F.col("was_approved"), F.when(F.col("id") % 4 == 0, "invalidated").otherwise("rejected")).otherwise("pending")
    stats = queue.queue_stats(t.decisions.withColumn("status", status))
    return stats.select("pending", "completed", "approved", "rejected", "n_invalidated", "approval_rate")
