"""Queries over decision logs, state tables and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import history, routing
from codeloom.operators.skew import interval_join
from codeloom.sources import tables as stored
from codeloom.streaming import watch
from suite.registry import query

GAP_SECONDS = 6 * 3600
_RATE = "floor((200 * {0} + {1}) / (2 * {1})) / 100.0::DOUBLE"


@query("decisions", """
    SELECT id, action_type, row_number() OVER (PARTITION BY action_type, context_hash ORDER BY created_at DESC, id DESC) AS rank
    FROM decisions WHERE was_approved IS NOT NULL QUALIFY rank <= 10""")
def recent_decisions(t):
    rows = routing.recent_decisions(t.decisions.filter(F.col("was_approved").isNotNull()))
    return rows.select("id", "action_type", F.col("rank").cast("long"))


@query("decisions", """
    SELECT action_type, context_hash, count(*) AS n_decisions, count(*) FILTER (NOT was_approved) AS n_rejected,
           count(*) FILTER (NOT was_approved) / count(*) AS rejection_rate
    FROM (SELECT * FROM decisions WHERE was_approved IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY action_type, context_hash ORDER BY created_at DESC, id DESC) <= 10)
    GROUP BY action_type, context_hash""")
def rejection_rate(t):
    return routing.rejection_rate(t.decisions.filter(F.col("was_approved").isNotNull()))


@query("decisions", f"""
    SELECT reviewer, count(*) AS total, count(*) FILTER (was_approved) AS approved, count(*) FILTER (NOT was_approved) AS rejected,
           {_RATE.format('count(*) FILTER (was_approved)', 'count(*)')} AS approval_rate
    FROM (SELECT * FROM decisions WHERE was_approved IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY reviewer ORDER BY created_at DESC, id DESC) <= 5) GROUP BY reviewer""")
def reviewer_history(t):
    return history.reviewer_history(t.decisions, limit=5)


@query("decisions", """
    SELECT reviewer, string_agg(id, ',' ORDER BY rank) AS ids FROM (
        SELECT *, row_number() OVER (PARTITION BY reviewer ORDER BY created_at DESC, id DESC) AS rank FROM decisions
        WHERE was_approved IS NOT NULL AND action_type = 'fix_security') WHERE rank <= 10 GROUP BY reviewer""")
def reviewer_entries(t):
    rows = history.reviewer_history(t.decisions, limit=10, action_type="fix_security", with_entries=True)
    return rows.select("reviewer", F.array_join(F.transform("history", lambda e: e["id"].cast("string")), ",").alias("ids"))


@query("decisions", "SELECT DISTINCT reviewer FROM decisions WHERE was_approved IS NOT NULL AND reviewer IS NOT NULL")
def reviewers(t):
    return history.reviewers(t.decisions)


@query("decisions", f"""
    SELECT action_type, count(*) AS total, count(*) FILTER (was_approved) AS approved, count(*) FILTER (NOT was_approved) AS rejected,
           round(avg(confidence), 3) AS avg_confidence, {_RATE.format('count(*) FILTER (was_approved)', 'count(*)')} AS approval_rate
    FROM decisions WHERE was_approved IS NOT NULL GROUP BY ROLLUP (action_type)""")
def action_stats(t):
    return history.action_stats(t.decisions)


@query("", f"""
    SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS approved,
           {_RATE.format('count(*) FILTER (quality = 1)', 'count(*)')} AS approval_rate
    FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def approval_by_repo(t):
    verdicts = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        "source", (F.col("quality") == 1).alias("was_approved"), F.lit(1.0).alias("confidence"))
    return history.action_stats(verdicts, "source", with_total=False).select("source", "total", "approved", "approval_rate")


@query("", """
    SELECT user_id, min(ts) AS created_at, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id""")
def current_state(t):
    log = t.events.select("user_id", "event_type", "value", "ts", "event_id", F.col("ts").alias("created_at"))
    return history.current_state(log, ["user_id"], "ts", "event_id", "created_at").select(
        "user_id", "created_at", "event_type", "value")


@query("", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def insert_if_absent(t):
    known = t.orders.filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return history.insert_if_absent(known, t.customer, ["c_custkey"]).select("c_custkey", "c_name")


@query("", """
    SELECT c_custkey, coalesce(p.status, c_mktsegment) AS c_mktsegment, c_name FROM customer LEFT JOIN (
        SELECT o_custkey, arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, (o_orderdate, o_orderkey)) AS status
        FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        GROUP BY o_custkey) p ON p.o_custkey = c_custkey""")
def coalesce_update(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"))
    patch = last.select("c_custkey", F.when(F.col("s") != "P", F.col("s")).alias("c_mktsegment"))
    return history.coalesce_update(t.customer, patch, ["c_custkey"]).select("c_custkey", "c_mktsegment", "c_name")


@query("", """
    SELECT event_id, user_id = 7 OR value > 100 AS read FROM events""")
def mark_read(t):
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("username"), (F.col("value") > 100).alias("read"))
    return history.mark_read(rows, username=7).select(F.col("id").alias("event_id"), "read")


@query("", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_id(t):
    doomed = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return history.delete_by_id(t.customer, doomed, "c_custkey").select("c_custkey")


@query("", "SELECT count(*) AS n_deleted FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def deleted_count(t):
    doomed = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return history.deleted_count(t.customer, doomed, "c_custkey")


@query("", """
    SELECT o_custkey AS session_id, o_orderkey AS checkpoint_id, o_orderpriority AS agent_type, o_orderdate AS created_at FROM orders""")
def session_checkpoints(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("checkpoint_id"),
        F.col("o_orderpriority").alias("agent_type"), F.col("o_orderdate").alias("created_at"))
    return history.session_checkpoints(rows)


@query("", "SELECT c_custkey AS project_id, c_nationkey AS manager FROM customer WHERE c_nationkey = 3")
def projects_for(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("manager"), F.col("c_acctbal").alias("created_at"))
    return history.projects_for(rows, 3).select("project_id", "manager")


@query("", "SELECT o_custkey AS username, count(*) AS n_sessions FROM orders GROUP BY o_custkey")
def session_counts(t):
    return history.session_counts(t.orders.select(F.col("o_custkey").alias("username")))


@query("", """
    SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
           substr(repeat(o_orderpriority || ' ', 12), 1, 80) AS description FROM orders""")
def job_list(t):
    return history.job_list(_jobs(t)).select("job_id", "status", "description")


def _jobs(t):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    return t.orders.select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("action_type"),
        F.repeat(F.concat("o_orderpriority", F.lit(" ")), 12).alias("description"), F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.col("o_custkey").alias("username"),
        (F.col("o_orderkey") % 1000).alias("review_id"))


@query("", """
    SELECT o_custkey AS username, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS running,
           count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS errors FROM orders GROUP BY o_custkey""")
def job_status_counts(t):
    return history.job_status_counts(_jobs(t), by="username")


@query("", """
    SELECT c_custkey AS id, o_orderkey AS job_id FROM customer LEFT JOIN orders ON o_orderkey % 1000 = c_custkey""")
def attach_results(t):
    return history.attach_results(t.customer.select(F.col("c_custkey").alias("id")), _jobs(t)).select("id", "job_id")


@query("", """
    SELECT username, count(*) AS n_shown, count(*) FILTER (value > 100) AS unread_count FROM (
        SELECT user_id AS username, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100)
    GROUP BY username""")
def notifications(t):
    rows = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("username"), F.col("ts").alias("created_at"),
        (F.col("value") <= 100).alias("read"))
    return history.unread_counts(history.notifications_page(rows))


@query("", """
    SELECT o_custkey AS session_id, count(*) AS pending_count, count(*) || ' action(s) need your review in ''' || c_name || '''' AS message
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY o_custkey, c_name""")
def notify(t):
    reviews = t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("session_id"))
    sessions = t.customer.select(
        F.col("c_custkey").alias("session_id"), F.lit("p").alias("project_id"), F.col("c_name").alias("project_name"),
        F.lit(0).alias("findings_count"), F.lit("u").alias("username"))
    return history.notify(reviews, sessions).select("session_id", "pending_count", "message")


@query("decisions", """
    SELECT 'audit' AS kind, action_type, was_approved, NULL AS context_hash, '{"target":"t' || id || '","description":"d"}' AS action_data,
           CASE WHEN was_approved THEN 'approved_' ELSE 'rejected_' END || id AS checkpoint_id FROM decisions WHERE was_approved IS NOT NULL
    UNION ALL SELECT 'learning', action_type, was_approved, context_hash, NULL, NULL FROM decisions WHERE was_approved IS NOT NULL""")
def record_decisions(t):
    from codeloom.functions import rules

    rows = t.decisions.filter(F.col("was_approved").isNotNull()).select(
        F.col("id").cast("string").alias("id"), "action_type", rules.risk_of(F.col("action_type")).alias("risk_level"),
        F.when(F.col("was_approved"), "approved").otherwise("rejected").alias("status"), "confidence", F.lit("n").alias("review_notes"),
        F.col("created_at").alias("review_timestamp"), "reviewer", F.concat(F.lit("t"), F.col("id").cast("string")).alias("target"),
        F.lit("d").alias("description"))
    none = F.lit(None).cast("string")
    audit = history.audit_rows(rows).select(
        F.lit("audit").alias("kind"), "action_type", "was_approved", none.alias("context_hash"), "action_data", "checkpoint_id")
    learned = history.learning_rows(rows).select(
        F.lit("learning").alias("kind"), "action_type", "was_approved", "context_hash", none.alias("action_data"), none.alias("checkpoint_id"))
    return audit.unionByName(learned)


@query("", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return stored.with_json(t.events.select("event_id", "props"), {"props": "k BIGINT"}).select("event_id", "props.k")


@query("", """
    SELECT o_orderkey AS session_id, (o_orderkey % 4)::BIGINT AS findings_count, (o_orderkey % 3)::BIGINT AS pending_count FROM orders""")
def session_detail(t):
    def listed(column, item, n):
        return F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(item), (column % n).cast("int")), ","), F.lit("]"))

    key = F.col("o_orderkey")
    sessions = t.orders.select(
        key.alias("session_id"), listed(key, '{"title":"x"}', 4).alias("findings"), listed(key, '"r1"', 3).alias("pending_reviews"))
    rows = history.session_detail(sessions)
    return rows.select("session_id", F.col("findings_count").cast("long"), F.col("pending_count").cast("long"))


@query("decisions", """
    SELECT id, 'orders@' || id AS target FROM decisions WHERE was_approved IS NULL AND id % 5 <> 0""")
def read_queue(t):
    body = F.concat(F.lit('{"action_type":"'), F.col("action_type"), F.lit('","target":"orders@'), F.col("id").cast("string"), F.lit('"}'))
    rows = t.decisions.select(
        "id", F.when(F.col("id") % 5 == 0, "not json").otherwise(body).alias("action_data"), "created_at",
        F.when(F.col("was_approved").isNull(), "pending").otherwise("completed").alias("status"))
    good, _ = stored.read_queue(rows)
    return good.select("id", "action.target")


@query("", """
    SELECT l_partkey AS original, arg_max(l_orderkey || '-' || l_linenumber, (l_shipdate, l_orderkey || '-' || l_linenumber)) AS backup,
           max(l_shipdate) AS timestamp, count(*) AS versions FROM lineitem GROUP BY l_partkey""")
def latest_backup(t):
    log = t.lineitem.select(
        F.col("l_partkey").alias("original"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("backup"),
        F.col("l_shipdate").alias("timestamp"))
    return stored.latest_backup(log)


@query("", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def lookup_rows(t):
    keys = t.orders.filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return stored.lookup_rows(t.customer, "c_custkey", keys=keys).select("c_custkey", "c_name")


@query("", """
    SELECT event_type AS tool_name, count(*) AS n_calls, max(CAST(floor(value) AS BIGINT)) AS max_ms FROM events GROUP BY event_type""")
def tool_call_stats(t):
    calls = t.events.select(F.col("event_type").alias("tool_name"), F.floor("value").alias("duration_ms"))
    return history.tool_call_stats(calls).select("tool_name", "n_calls", "max_ms")


@query("decisions", f"""
    SELECT count(*) FILTER (was_approved IS NULL) AS queue_pending, count(was_approved) AS queue_completed,
           count(*) FILTER (was_approved) AS queue_approved, count(was_approved) AS actions_total,
           round(avg(confidence) FILTER (was_approved IS NOT NULL), 3) AS actions_avg_confidence,
           (SELECT count(*) FROM customer) AS total_sessions FROM decisions""")
def dashboard(t):
    status = F.when(F.col("was_approved").isNull(), "pending").when(F.col("was_approved"), "approved").otherwise("rejected")
    rows = history.dashboard(t.decisions.withColumn("status", status), t.decisions, t.customer)
    return rows.select(
        "queue_pending", "queue_completed", "queue_approved", "actions_total", "actions_avg_confidence", "total_sessions")


# ------------------------------------------------------------------ change events
_SESSIONS = f"""
    marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {GAP_SECONDS} SECOND THEN 1 ELSE 0 END AS opens
               FROM file_events WHERE kind <> 'deleted' WINDOW w AS (PARTITION BY project_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS s FROM marked),
    sessions AS (SELECT project_id, s, min(ts) AS session_start, max(ts) + INTERVAL {GAP_SECONDS} SECOND AS fires_at,
                        count(*) AS n_events FROM numbered GROUP BY project_id, s)"""


def _bursts(t):
    changes = watch.python_changes(t.file_events)
    return watch.debounce_table(changes, GAP_SECONDS, "event_id")


@query("file_events", f"WITH {_SESSIONS} SELECT project_id, session_start, fires_at, n_events FROM sessions")
def debounce(t):
    rows = _bursts(t)
    return rows.select(
        "project_id", F.col("session_start").cast("timestamp_ntz"), F.col("fires_at").cast("timestamp_ntz"), "n_events")


@query("file_events", f"""
    WITH {_SESSIONS}
    SELECT e.event_id, min(x.session_start) AS session_start FROM file_events e LEFT JOIN sessions x
        ON x.project_id = e.project_id AND x.session_start <= e.ts AND e.ts <= x.fires_at GROUP BY e.event_id""")
def parent_interval(t):
    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    points = t.file_events.select("event_id", "project_id", micros("ts").alias("at"))
    spans = _bursts(t).select("project_id", micros("session_start").alias("a"), micros("fires_at").alias("b"))
    found = interval_join(points, spans, ["project_id"], "at", "a", "b", GAP_SECONDS * 1_000_000)
    start = F.timestamp_micros(F.min("a")).cast("timestamp_ntz")
    return found.groupBy("event_id").agg(start.alias("session_start"))


@query("file_events", "SELECT event_id, kind FROM file_events WHERE kind <> 'deleted'")
def python_changes(t):
    return watch.python_changes(t.file_events).select("event_id", "kind")


@query("file_events", """
    SELECT event_id FROM file_events WHERE kind <> 'deleted' AND project_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)""")
def watched(t):
    projects = t.customer.select(
        F.col("c_custkey").alias("project_id"), F.when(F.col("c_nationkey") < 10, "watching").otherwise("idle").alias("status"))
    return watch.watched(watch.python_changes(t.file_events), projects).select("event_id")
