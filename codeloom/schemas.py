"""Column lists of the stored tables and of the tables derived from file text."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "checkpoints": _table(
        id=_L, checkpoint_id=_S, session_id=_S, agent_type=_S, state_data=_S, created_at=_TS),
    "tool_calls": _table(
        id=_L, checkpoint_id=_S, tool_name=_S, arguments=_S, result=_S, duration_ms=_I, created_at=_TS),
    "agent_actions": _table(
        id=_S, checkpoint_id=_S, action_type=_S, action_data=_S, confidence=_D, risk_level=_S,
        was_approved=_B, reviewer=_S, review_notes=_S, created_at=_TS),
    "learning_data": _table(
        id=_S, action_type=_S, context_hash=_S, was_approved=_B, confidence=_D, review_notes=_S, created_at=_TS),
    "projects": _table(
        project_id=_S, name=_S, repo_path=_S, manager=_S, status=_S, last_analysis=_TS, created_at=_TS),
    "users": _table(id=_L, username=_S, email=_S, role=_S, is_active=_B, created_at=_TS),
    "analysis_sessions": _table(
        session_id=_S, status=_S, repo_path=_S, original_path=_S, project_id=_S, findings=_S,
        pending_reviews=_S, started_at=_TS, completed_at=_TS, error=_S, username=_S),
    "background_jobs": _table(
        job_id=_S, status=_S, action_type=_S, target=_S, description=_S, dry_run=_B, review_id=_S,
        execution_result=_S, steps=_S, total_steps=_I, current_step=_I, current_step_label=_S,
        created_at=_TS, completed_at=_TS, attached=_B, username=_S),
    "notifications": _table(
        id=_S, project_id=_S, project_name=_S, session_id=_S, message=_S, pending_count=_I,
        findings_count=_I, read=_B, username=_S, created_at=_TS),
    "reviews": _table(
        id=_S, action_data=_S, status=_S, review_notes=_S, created_at=_TS, project_id=_S,
        session_id=_S, username=_S),
}

FILES = _table(repo=_S, path=_S, content=_S, checksum=_S, parse_error=_S, snapshot_ts=_TS)
FILE_EVENTS = _table(project_id=_S, path=_S, kind=_S, is_dir=_B, ts=_TS)

# One row per entity found in a file; columns that do not apply are null.
SYMBOLS = _table(
    repo=_S, path=_S, bucket=_S, name=_S, kind=_S, start_line=_I, end_line=_I, col_offset=_I,
    has_docstring=_B, doc_len=_I, complexity=_I, is_async=_B, nested=_B, owner_class=_S, args_count=_I,
    module=_S, alias=_S, imported=_S, annotation=_S, value_repr=_S, stmt_kind=_S,
    mentions=_L, line_text=_S, blank_before=_B, walk_ord=_I, error=_S)

# Line counts by tokens, one row per file.
RAW_METRICS = _table(
    repo=_S, path=_S, loc=_L, lloc=_L, sloc=_L, comments=_L, single_comments=_L, multi=_L, blank=_L, error=_S)

IMPACT = _table(
    breaking_changes=_B, files_affected=_L, test_impact=_S, cross_file_check=_S, complexity=_I,
    entity_type=_S, parent_class=_S, security_risk=_S, credential_line=_S, loc=_L,
    n_importers=_L)

ACTION = _table(
    id=_S, finding_id=_S, action_type=_S, description=_S, target=_S, confidence=_D, risk_level=_S,
    reasoning=_S, suggested_changes=_S)

STEP = _table(action=_S, success=_B, skipped=_B)
