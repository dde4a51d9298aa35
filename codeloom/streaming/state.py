"""Streams with keyed state: bursts closed by a timer, one open review per target, last decisions per context.

State is bounded by what is open now - running bursts, undecided reviews, a few decisions per
context - and never by the number of batches.  A batch's rows of one key are taken chunk by chunk, so
a busy key costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.functions import vocab
from codeloom.operators import routing

Burst = tuple[int, int, int]


# ------------------------------------------------------------------ bursts
def joined_bursts(bursts: Iterable[Burst], gap: int) -> list[Burst]:
    """Bursts (first, last, events) that are at most ``gap`` apart made one, in order."""
    out: list[Burst] = []
    for first, last, n in sorted(bursts):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def bursts_of(times: np.ndarray, gap: int) -> list[Burst]:
    ordered = np.sort(times)
    first = np.flatnonzero(np.concatenate([[True], np.diff(ordered) > gap]))
    last = np.concatenate([first[1:], [len(ordered)]])
    return [(int(ordered[a]), int(ordered[b - 1]), int(b - a)) for a, b in zip(first, last)]


def debounce_timed(events: DataFrame, gap_seconds: float, idle_seconds: float | None = None) -> DataFrame:
    """One row per project and burst; the last one is closed by a timer, without a later event.

    A burst ends when an event comes more than ``gap_seconds`` after it, or when none has come for
    ``idle_seconds`` on the clock (the gap itself, unless a replay of old events sets it).  A pause of exactly the
    gap goes on with the burst.  An event that is late by more than the gap is a burst of its own.
    """
    gap = int(gap_seconds * 1_000_000)
    idle = int((gap_seconds if idle_seconds is None else idle_seconds) * 1000)

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = [state.get] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            done = known
        else:
            for chunk in chunks:
                known = joined_bursts([*known, *bursts_of(chunk["us"].to_numpy(), gap)], gap)
            done = known[:-1]
            state.update(known[-1])
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(key[0], first, last + gap, n) for first, last, n in done], columns=["project_id", "first", "fires", "n_events"])

    kind = events.schema["project_id"].dataType.simpleString()
    rows = events.select("project_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).filter("us is not null")
    closed = rows.groupBy("project_id").applyInPandasWithState(
        run, f"project_id {kind}, first long, fires long, n_events long", "first long, last long, n long", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return closed.select(
        "project_id", F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("fires").alias("fires_at"), "n_events"
    )


def open_bursts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bursts that ``debounce_timed`` has not closed yet, read from the stream's state."""
    held = spark.read.format("statestore").load(checkpoint).select("key.project_id", "value.groupState.*")
    return held.select(
        "project_id", F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("last").alias("last_event"), F.col("n").alias("n_events")
    )


# ------------------------------------------------------------------ open reviews
OPEN_BUCKETS = 4096
_NO_TIME = 2**63 - 1


def open_reviews(reviews: DataFrame, decisions: DataFrame, buckets: int = OPEN_BUCKETS) -> DataFrame:
    """The reviews that are taken up: one per (action_type, target) until it is decided.

    ``reviews`` has id, action_type, target and created_at, ``decisions`` review_id, action_type, target and created_at; both may
    be streams.  Rows of a batch count in order of time, at one time decisions first, then by id; only
    a decision on the open review clears it, and its state with it.

    Most targets have a row or two, and a call of Python for each would be nearly all the work, so the targets of a
    hash bucket are taken together.  The state of a bucket is its open reviews, the first one apart from the others;
    a batch writes anew the buckets it changes.
    """
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = {}
        if state.exists:
            id_, action, target, ids, actions, targets = state.get
            now[action, target] = id_
            now.update(zip(zip(actions, targets), ids))
        # The order of a target's rows in a batch decides, so they are sorted together: an id, a flag and a time each.
        rows = pd.concat(list(chunks), ignore_index=True).sort_values(["us", "is_review", "id"], kind="stable")
        rows = rows.astype(object).where(rows.notna(), None)
        taken = []
        for place, (id_, action, target, is_review) in enumerate(zip(rows["id"], rows["action_type"], rows["target"], rows["is_review"])):
            held = now.get((action, target))
            if is_review and held is None:
                taken.append(place)
                if id_ is not None:
                    now[action, target] = id_
            elif not is_review and held is not None and held == id_:
                del now[action, target]
        if now:
            (first, id_), *others = now.items()
            state.update((id_, *first, [i for _, i in others], [a for (a, _), _ in others], [t for (_, t), _ in others]))
        elif state.exists:
            state.remove()
        if taken:
            yield rows.iloc[taken][["id", "action_type", "target", "us"]]

    def tagged(rows: DataFrame, id_name: str, is_review: bool) -> DataFrame:
        when = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(_NO_TIME))
        return rows.select(
            F.col(id_name).cast("string").alias("id"), "action_type", "target", F.lit(is_review).alias("is_review"), when.alias("us")
        )

    both = tagged(reviews, "id", True).unionByName(tagged(decisions, "review_id", False))
    bucket = F.pmod(F.xxhash64("action_type", "target"), F.lit(buckets)).cast("int")
    taken = both.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        run, "id string, action_type string, target string, us long",
        "id string, action_type string, target string, ids array<string>, action_types array<string>, targets array<string>",
        "append", GroupStateTimeout.NoTimeout,
    )
    return taken.select("id", "action_type", "target", F.timestamp_micros(F.nullif("us", F.lit(_NO_TIME))).alias("created_at"))


# ------------------------------------------------------------------ last decisions
DECISION_PARTS = 8


def last_decisions(decisions: DataFrame, k: int = vocab.HISTORY_ROWS, parts: int = DECISION_PARTS) -> DataFrame:
    """Stream that keeps the newest ``k`` decisions of every context as state, whatever order they come in.

    A context is kept in ``parts`` pieces by hash of the id, so that a busy one isn't one task; each piece holds its
    newest k.  Rows out are the pieces that changed, with their number of decisions; ``current_rates`` reads the state.
    """
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for chunk in chunks:
            new = chunk.nlargest(k, ["us", "id"]) if len(chunk) > k else chunk
            kept = sorted({*kept, *zip(new["us"].tolist(), new["id"].tolist(), new["was_approved"].tolist())}, reverse=True)[:k]
        state.update(tuple(list(column) for column in zip(*kept)))
        yield pd.DataFrame([(*key, len(kept))], columns=["action_type", "context_hash", "part", "n_decisions"])

    rows = decisions.filter(F.col("was_approved").isNotNull()).select(
        "action_type", "context_hash", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "was_approved",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("action_type", "context_hash", "part").applyInPandasWithState(
        run, "action_type string, context_hash string, part int, n_decisions int",
        f"us array<long>, id array<{kind}>, was_approved array<boolean>", "update", GroupStateTimeout.NoTimeout,
    )


def kept_decisions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The decisions that ``last_decisions`` holds now, read from the stream's state."""
    held = spark.read.format("statestore").load(checkpoint).select("key.*", "value.groupState.*")
    each = F.explode(F.arrays_zip("us", "id", "was_approved"))
    return held.select("action_type", "context_hash", each.alias("d")).select(
        "action_type", "context_hash", "d.id", "d.was_approved", F.timestamp_micros("d.us").alias("created_at")
    )


def current_rates(spark: SparkSession, checkpoint: str, k: int = vocab.HISTORY_ROWS) -> DataFrame:
    """Rejection rates over the newest ``k`` decisions of every context, from the stream's state."""
    return routing.rejection_rate(kept_decisions(spark, checkpoint), k)
