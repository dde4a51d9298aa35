"""Lookups and ladders over action types, risks and rates, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import vocab


def lookup(table: dict, key: Column, default) -> Column:
    """A small literal map; cheaper than a join and safe in any plan."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def risk_of(action_type: Column) -> Column:
    return lookup(vocab.RISK_OF_ACTION, action_type, vocab.DEFAULT_RISK)


def risk_rank(risk: Column) -> Column:
    """Low 0 to critical 3."""
    return lookup(vocab.RISK_RANK, risk, 0)


def queue_risk_rank(risk: Column) -> Column:
    """Display rank of the queue: critical first."""
    return lookup(vocab.QUEUE_RISK_RANK, risk, vocab.QUEUE_DEFAULT_RISK_RANK)


def action_priority(action_type: Column) -> Column:
    table = {name: i for i, name in enumerate(vocab.ACTION_PRIORITY)}
    return lookup(table, action_type, vocab.LAST_ORDER)


def action_order(action_type: Column) -> Column:
    return lookup(vocab.FILE_ACTION_ORDER, action_type, vocab.LAST_ORDER)


def effective_risk(risk: Column, sub_actions: Column) -> Column:
    """Worst risk of an action and its sub-actions; only a list of two or more counts."""
    known = F.filter(sub_actions, lambda a: a.isin(vocab.ACTION_TYPES))
    worst = F.greatest(
        risk_rank(risk), F.coalesce(F.array_max(F.transform(known, lambda a: risk_rank(risk_of(a)))), F.lit(0))
    )
    names = F.array(*[F.lit(r) for r in vocab.RISK_RANK])
    return F.when(F.size(sub_actions) > 1, F.get(names, worst)).otherwise(risk)


def complexity_grade(complexity: Column) -> Column:
    grade = F.lit(vocab.COMPLEXITY_LAST_GRADE)
    for bound, letter in reversed(vocab.COMPLEXITY_GRADES):
        grade = F.when(complexity <= bound, letter).otherwise(grade)
    return grade


def is_private(name: Column) -> Column:
    return F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("__"))


def is_special(name: Column) -> Column:
    return F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))


def is_public(name: Column) -> Column:
    return ~F.startswith(name, F.lit("_"))


def is_external(module: Column) -> Column:
    """Standard library or well-known third-party root."""
    return F.split_part(module, F.lit("."), F.lit(1)).isin(vocab.STDLIB_ROOTS + vocab.THIRD_PARTY_ROOTS)


def share_2dp(part: Column, whole: Column) -> Column:
    """part / whole rounded half-up to two places, in whole-number arithmetic.

    Zero when the whole is empty.  Counting in integers makes the result the same
    on every engine, whatever the order in which rows arrive.
    """
    return F.when(
        whole > 0, F.floor((part * 200 + whole) / (whole * 2)).cast("double") / F.lit(100.0)
    ).otherwise(F.lit(0.0))
