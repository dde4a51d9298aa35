"""Which actions run at once and which wait for a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import rules, text, vocab


def recent_decisions(decisions: DataFrame, k: int = vocab.HISTORY_ROWS) -> DataFrame:
    """Last k decisions of every (action type, context).

    The rank filter is pushed below the shuffle, so a context moves at most k rows per
    input partition however many decisions it has.
    """
    newest = Window.partitionBy("action_type", "context_hash").orderBy(F.desc("created_at"), F.desc("id"))
    return decisions.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)


def rejection_rate(decisions: DataFrame, k: int = vocab.HISTORY_ROWS) -> DataFrame:
    """Share of rejections among the last k decisions per context."""
    rejected = F.count_if(~F.col("was_approved"))
    return (
        recent_decisions(decisions, k)
        .groupBy("action_type", "context_hash")
        .agg(F.count(F.lit(1)).alias("n_decisions"), rejected.alias("n_rejected"))
        .withColumn("rejection_rate", F.col("n_rejected") / F.col("n_decisions"))
    )


def needs_review(threshold: float = vocab.CONFIDENCE_THRESHOLD) -> Column:
    """struct<needs_review, reason> from the ordered rules; first hit wins.

    Reads action_type, confidence, effective_risk, sub_actions and rejection_rate.
    """
    action, confidence, risk, subs = (F.col(c) for c in ("action_type", "confidence", "effective_risk", "sub_actions"))
    shown = F.format_string("%.2f", confidence)

    def includes(kind: str) -> Column:
        return (action == kind) | F.coalesce(F.array_contains(subs, kind), F.lit(False))

    percent = F.format_string("%.0f%%", F.col("rejection_rate") * 100)
    reason = (
        F.when(risk == "critical", F.concat(F.lit("Critical risk: "), action))
        .when(confidence < threshold, F.concat(F.lit("Low confidence: "), shown, F.lit(f" < {threshold}")))
        .when((risk == "high") & (confidence < vocab.HIGH_RISK_CONFIDENCE),
              F.concat(F.lit("HIGH risk requires ≥0.85 confidence — got "), shown))
        .when(includes("fix_security"), F.lit("Security fixes always require manager approval"))
        .when(includes("refactor_code"), F.lit("Code refactoring always requires manager approval"))
        .when(includes("restructure"), F.lit("File restructuring requires human planning"))
        .when(F.col("rejection_rate") > vocab.REJECTION_LIMIT,
              F.concat(F.lit("Historical rejection rate "), percent, F.lit(" > 50% — escalating")))
    )
    listed = F.when(
        F.size(subs) > 1,
        F.concat(F.lit(" | "), F.size(subs).cast("string"), F.lit(" sub-actions: "), F.array_join(subs, " → ")),
    ).otherwise("")
    auto = F.concat(F.lit("Auto-approved: "), risk, F.lit(" risk, confidence="), shown, listed)
    return F.struct(reason.isNotNull().alias("needs_review"), F.coalesce(reason, auto).alias("reason"))


def route(
    actions: DataFrame,
    rates: DataFrame | None = None,
    threshold: float = vocab.CONFIDENCE_THRESHOLD,
    auto_approve: bool = False,
    mode: str = "pipeline",
) -> DataFrame:
    """Add effective risk, ``decision`` (auto / review) and its reason.

    ``mode='pipeline'``: an override sends everything to auto.  ``mode='task'``: an action
    that needs no review still waits in the queue unless auto_approve is set.
    ``rates`` is cut to one row per (action type, risk) context, the highest rate where there
    are more: at most 36, so it is broadcast.
    """
    rows = actions.withColumn("effective_risk", rules.effective_risk(F.col("risk_level"), F.col("sub_actions")))
    rows = rows.withColumn("context_hash", text.context_hash(F.col("action_type"), F.col("risk_level")))
    if rates is None:
        rows = rows.withColumn("rejection_rate", F.lit(None).cast("double"))
    else:
        known = rates.join(context_keys(rates), ["action_type", "context_hash"], "left_semi")
        small = known.groupBy("action_type", "context_hash").agg(F.max("rejection_rate").alias("rejection_rate"))
        rows = rows.join(F.broadcast(small), ["action_type", "context_hash"], "left")
    rows = rows.withColumn("_d", needs_review(threshold))
    if mode == "task":
        review = F.col("_d.needs_review") if auto_approve else F.lit(True)
        reason = F.col("_d.reason")
    elif auto_approve:
        review, reason = F.lit(False), F.lit("auto_approve override enabled")
    else:
        review, reason = F.col("_d.needs_review"), F.col("_d.reason")
    return rows.select(
        *actions.columns, "effective_risk",
        F.when(review, "review").otherwise("auto").alias("decision"), reason.alias("reason"),
    )


def context_keys(df: DataFrame) -> DataFrame:
    """All (action type, risk) contexts that exist: nine types by four risks."""
    spark = df.sparkSession
    types = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in vocab.ACTION_TYPES])).alias("action_type"))
    both = types.select("action_type", F.explode(F.array(*[F.lit(r) for r in vocab.RISK_RANK])).alias("risk"))
    return both.select("action_type", text.context_hash(F.col("action_type"), F.col("risk")).alias("context_hash"))


def auto_actions(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("decision") == "auto")


def review_actions(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("decision") == "review")
