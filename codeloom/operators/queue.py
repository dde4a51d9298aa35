"""The review queue: duplicates, order, blocking, staleness, decisions and counts.

Reviews carry (id, action_type, target, risk_level, owner, created_at, status, review_notes).
A file may hold any share of the queue, so per-file facts are aggregated first and joined
back; nothing ranks or collects a whole file in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import rules, text, vocab
from codeloom.schemas import STEP


def with_file(reviews: DataFrame) -> DataFrame:
    """Add the file part of the target and the order of the action within a file."""
    return reviews.withColumns(
        {"file": text.target_file(F.col("target")), "action_order": rules.action_order(F.col("action_type"))}
    )


def _join_back(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their group; a null key is a group of its own, so no row is lost."""
    named = facts.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys])
    return rows.join(named, same).drop(*[f"_of_{key}" for key in keys])


def dedup_pending(reviews: DataFrame) -> DataFrame:
    """Every review with the id that stands for its (action type, target).

    The oldest one stays; ``is_duplicate`` marks the others.
    """
    first = reviews.groupBy("action_type", "target").agg(F.min(F.struct("created_at", "id")).alias("_first"))
    return _join_back(reviews, first, ["action_type", "target"]).select(
        *reviews.columns, F.col("_first.id").alias("review_id"), (~F.col("_first.id").eqNullSafe(F.col("id"))).alias("is_duplicate")
    )


def unique_pending(reviews: DataFrame) -> DataFrame:
    """Only the reviews that stay; one combined aggregate, no join back."""
    rest = [c for c in reviews.columns if c not in ("action_type", "target")]
    kept = reviews.groupBy("action_type", "target").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")
    )
    return kept.select("action_type", "target", "r.*").select(*reviews.columns)


def is_blocked(reviews: DataFrame) -> DataFrame:
    """Add ``is_blocked``: a pending review of the same file has a lower order."""
    rows = with_file(reviews)
    lowest = rows.groupBy("file").agg(F.min("action_order").alias("_lowest"))
    return _join_back(rows, lowest, ["file"]).select(
        *reviews.columns, "file", "action_order", (F.col("_lowest") < F.col("action_order")).alias("is_blocked")
    )


def _reason(first_visible: Column) -> Column:
    """Blocking text.  An order belongs to one action type, so the number is enough."""
    names = F.array(*[F.lit(name) for name in vocab.FILE_ACTION_ORDER])
    blocker = F.get(names, F.when(first_visible < F.col("action_order"), first_visible))
    text_ = F.concat(F.lit("Complete '"), blocker, F.lit("' first"))
    return F.coalesce(F.when(F.col("is_blocked"), text_), F.lit(""))


def _visible(owner: str | None) -> Column:
    return F.lit(True) if owner is None else F.coalesce(F.col("owner") == owner, F.lit(False))


def _blocking(reviews: DataFrame, owner: str | None) -> DataFrame:
    """Visible rows with blocking, reason and group facts.

    One aggregate of plain numbers per file, combined before the shuffle, and one join.
    """
    rows = with_file(reviews).withColumn("_seen", _visible(owner))
    seen_order = F.when(F.col("_seen"), F.col("action_order"))
    facts = rows.groupBy("file").agg(
        F.min("action_order").alias("_lowest"), F.min(seen_order).alias("_first"), F.max(seen_order).alias("_last"),
        F.count_if("_seen").alias("group_total"),
    )
    return (
        _join_back(rows.filter("_seen"), facts, ["file"])
        .withColumn("is_blocked", F.col("_lowest") < F.col("action_order"))
        .withColumn("has_blocked", F.col("_lowest") < F.col("_last"))
        .withColumn("block_reason", _reason(F.col("_first")))
        .select(*reviews.columns, "file", "action_order", "is_blocked", "has_blocked", "group_total", "block_reason")
    )


def block_reason(reviews: DataFrame, owner: str | None = None, by_owner: bool = False) -> DataFrame:
    """Blocking with its reason.

    Blocking looks at the whole queue, the reason only at rows the viewer sees: all rows,
    those of one owner, or (``by_owner``) for every row those of its own owner.
    """
    if not by_owner:
        return _blocking(reviews, owner).drop("has_blocked", "group_total")
    rows = is_blocked(reviews)
    first = rows.groupBy("file", "owner").agg(F.min("action_order").alias("_first"))
    return _join_back(rows, first, ["file", "owner"]).withColumn("block_reason", _reason(F.col("_first"))).drop("_first")


def pending_sorted(reviews: DataFrame, owner: str | None = None) -> DataFrame:
    """Queue by file, action order and risk.  A range sort on all keys spreads hot files."""
    rows = reviews if owner is None else reviews.filter(F.col("owner") == owner)
    ranked = with_file(rows).withColumn("risk_rank", rules.queue_risk_rank(F.col("risk_level")))
    return ranked.orderBy("file", "action_order", "risk_rank", "created_at", "id")


def group_counts(reviews: DataFrame, owner: str | None = None) -> DataFrame:
    """Total, blocked and ready reviews per file, and over all files (file is null).

    Counting per (file, order) first keeps a hot file down to eight rows.
    """
    per_order = (
        with_file(reviews)
        .withColumn("_seen", _visible(owner))
        .groupBy("file", "action_order")
        .agg(F.count_if("_seen").alias("n"))
    )
    per_file = per_order.groupBy("file").agg(
        F.sum("n").alias("total"),
        F.min(F.struct("action_order", "n")).alias("_lowest"),
    )
    shown = per_file.filter(F.col("total") > 0).select(
        "file", "total", F.col("_lowest.n").alias("ready"), (F.col("total") - F.col("_lowest.n")).alias("blocked")
    )
    return shown.rollup("file").agg(
        F.sum("total").alias("total"), F.sum("blocked").alias("blocked"), F.sum("ready").alias("ready")
    )


def pending_grouped(reviews: DataFrame, owner: str | None = None) -> DataFrame:
    """Reviews grouped by file, files without blocked rows first.

    One row per review with its group's columns, in display order: a file's list may be
    of any length, so it is not packed into a single row.
    """
    return (
        _blocking(reviews, owner)
        .withColumn("file_name", text.file_name(F.col("file")))
        .orderBy("has_blocked", "file", "action_order", "created_at", "id")
    )


# ------------------------------------------------------------------ staleness
def invalidate_stale(
    reviews: DataFrame, loc: DataFrame, latest: DataFrame, limit: int = vocab.LARGE_FILE_LINES
) -> DataFrame:
    """Reviews that the current snapshot has made pointless, with the reason.

    ``loc`` has (path, loc) of the files that still exist; reviews of other files stay.
    Class targets are looked up among classes, function targets among functions.
    """
    target = text.decode_target(F.col("target"))
    rows = reviews.withColumns(
        {
            "_path": target["file"], "_kind": target["entity_type"],
            "_name": text.target_entity(F.col("target")),
        }
    )
    action = F.col("action_type")
    bucket = (
        F.when(action.isin("delete_function", "refactor_code", "add_docstring"),
               F.when(F.col("_kind") == "class", "class").otherwise("function"))
        .when(action == "delete_import", "import")
        .when((action == "fix_security") & (F.col("_kind") == "variable"), "assignment")
    )
    rows = rows.withColumn("_bucket", bucket)
    symbols = latest.select(
        F.col("path").alias("_path"), F.col("bucket").alias("_bucket"), F.col("name").alias("_name"),
        F.col("line_text").alias("_text"), F.lit(True).alias("_found"),
    )
    sizes = loc.select(F.col("path").alias("_path"), F.col("loc").alias("_loc"))
    joined = rows.join(sizes, "_path").join(symbols, ["_path", "_bucket", "_name"], "left")
    file, name = text.file_name(F.col("_path")), F.col("_name")
    gone = F.col("_found").isNull() & (name != "")

    def because(kind: str, rest: str) -> Column:
        return F.concat(F.lit(f"{kind} '"), name, F.lit("' "), F.lit(rest.split("{}")[0]), file, F.lit(rest.split("{}")[1]))

    reason = (
        F.when((action == "restructure") & (F.col("_loc") <= limit),
               F.concat(F.lit("File now has "), F.col("_loc").cast("string"),
                        F.lit(f" LOC (≤ {limit}) after deletions — restructuring no longer needed")))
        .when((F.col("_bucket") == "class") & gone, because("Class", "no longer exists in {} — already deleted or renamed"))
        .when((F.col("_bucket") == "function") & gone, because("Function", "no longer exists in {} — already deleted or renamed"))
        .when((F.col("_bucket") == "import") & gone, because("Import", "no longer exists in {} — already removed"))
        .when((F.col("_bucket") == "assignment") & gone,
              because("Variable", "no longer exists in {} — credential removed or renamed"))
        .when((F.col("_bucket") == "assignment") & text.uses_environment(F.coalesce("_text", F.lit(""))),
              because("Variable", "already uses os.getenv in {} — security fix already applied"))
    )
    notes = F.concat(F.coalesce("review_notes", F.lit("")), F.lit(" | INVALIDATED: "), F.col("_reason"))
    return (
        joined.withColumn("_reason", reason)
        .filter(F.col("_reason").isNotNull())
        .withColumns({"status": F.lit("invalidated"), "review_notes": notes})
        .select(*reviews.columns, F.col("_reason").alias("reason"))
    )


# ------------------------------------------------------------------ decisions
def apply_decisions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set status, reviewer, notes and time of decided reviews.

    The first decision of a review counts; later ones find it no longer pending.
    """
    first = decisions.groupBy(F.col("review_id").alias("id")).agg(
        F.min_by(F.struct("decision", "reviewer", "notes", "decided_at"), "decided_at").alias("d")
    )
    decided = (F.col("status") == "pending") & F.col("d").isNotNull()
    rejected = F.col("d.decision") == "reject"
    notes = F.when(rejected, F.coalesce("d.notes", F.lit("Rejected"))).otherwise(F.col("d.notes"))
    rest = [c for c in reviews.columns if c not in ("status", "review_notes")]
    return reviews.join(first, "id", "left").select(
        *rest,
        F.when(decided, F.when(rejected, "rejected").otherwise("approved")).otherwise(F.col("status")).alias("status"),
        F.when(decided, notes).otherwise(F.col("review_notes")).alias("review_notes"),
        F.when(decided, F.col("d.reviewer")).alias("reviewer"),
        F.when(decided, F.col("d.decided_at")).alias("review_timestamp"),
    )


def execution_outcome(reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """Attach finished jobs to their reviews.

    Jobs have (job_id, review_id, status, success, steps).  Some steps failed:
    partially approved; all or none failed: as decided.
    """
    finished = jobs.filter(F.col("status").isin("done", "error", "partial")).select(
        F.col("review_id").alias("id"), "job_id", "success", "steps"
    )
    rows = reviews.join(finished, "id")
    n, ok = F.size("steps"), F.size(F.filter("steps", lambda s: s["success"]))
    counted = F.concat(ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" steps succeeded"))
    plain = F.when(F.col("success"), "success").otherwise("failed")
    suffix = F.concat(
        F.lit(" | execution: "), F.when(n > 0, counted).otherwise(plain),
        F.coalesce(F.concat(F.lit(" | job:"), F.col("job_id")), F.lit("")),
    )
    partial = (n > 0) & (ok > 0) & (ok < n)
    return rows.withColumns(
        {
            "status": F.when(partial, "partially_approved").otherwise(F.col("status")),
            "review_notes": F.concat(F.coalesce("review_notes", F.lit("")), suffix),
        }
    ).select(*reviews.columns, "job_id")


def queue_stats(reviews: DataFrame) -> DataFrame:
    """Queue totals; everything completed and not approved counts as rejected.

    The other statuses are also counted on their own.
    """
    status = F.col("status")
    counted = reviews.agg(
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status != "pending").alias("completed"),
        F.count_if(status == "approved").alias("approved"),
        *[F.count_if(status == s).alias(f"n_{s}") for s in ("rejected", "partially_approved", "invalidated")],
    )
    return counted.withColumns(
        {
            "rejected": F.col("completed") - F.col("approved"),
            "approval_rate": rules.share_2dp(F.col("approved"), F.col("completed")),
        }
    )


# ------------------------------------------------------------------ jobs
def job_outcome(steps: DataFrame, key: str) -> DataFrame:
    """Per job: done when every step succeeded or was skipped, else partial."""
    ok = F.col("success") | F.coalesce("skipped", F.lit(False))
    return steps.groupBy(key).agg(
        F.when(F.bool_and(ok), "done").otherwise("partial").alias("status"),
        F.count_if(ok).alias("n_ok"),
        F.count(F.lit(1)).alias("n_steps"),
    )


STEPS_JSON = f"array<{STEP.simpleString()}>"
