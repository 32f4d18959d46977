"""The rows behind the numbers of a contract: which rows break which rules."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tablecheck.functions.columns import quoted
from tablecheck.operators.frequency import frequencies
from tablecheck.operators.rules import RowCheck, SurplusCheck
from tablecheck.operators.schema import check_drift
from tablecheck.plans.contract import _analyse, _Entry, require_approval

NOT_A_ROW = "tells nothing about single rows"


class Violations(NamedTuple):
    """``rows`` that break a rule, as they are, with the list of rules they break; the metrics
    ``row_count`` and ``v<ordinal>`` of all rows, there after the first action on ``rows``; and why
    other rules are not among them, by ordinal."""

    rows: DataFrame
    observation: Observation
    left_out: dict[int, str]


def violating_rows(df: DataFrame, contract: dict[str, Any], into: str = "broken_rules") -> Violations:
    """The rows of ``df`` that break rules of an approved contract.

    ``into`` is added: an array of ``ordinal, rule_id, column_name`` in contract order. Counting is
    part of the pass that writes the rows, so an action on them costs no second scan. Rules on rows
    are filters and change no partition; of a value that must be unique every row is listed that has
    a copy, found by joining the values that occur twice (long ones as digests). Rules about the
    whole table, and dates as text whose format is chosen by the whole column, are left out and
    named, as are entries that cannot be evaluated. A registered rule that raises fails the action.
    """
    require_approval(contract)
    check_drift(df, contract.get("columns"), contract.get("dataset"))
    if into in df.columns:
        raise ValueError(f"the table has a column '{into}': name another one with into=")
    entries = [_Entry(i, spec, df) for i, spec in enumerate(contract["rules"])]
    _analyse(df, entries)

    rows, breaks, left_out = df, {}, {}
    for e in entries:
        if isinstance(e.measurement, RowCheck):
            breaks[e.ordinal] = F.coalesce(e.measurement.violates, F.lit(False))
        elif isinstance(e.measurement, SurplusCheck):
            rows, breaks[e.ordinal] = _with_copies(rows, df, e.measurement.column, f"__copies_{e.ordinal}")
        else:
            left_out[e.ordinal] = e.error or NOT_A_ROW
    observation = Observation()
    rows = rows.observe(
        observation, F.count(F.lit(1)).alias("row_count"), *[F.count_if(c).alias(f"v{i}") for i, c in breaks.items()]
    )
    named = [
        F.when(c, F.struct(
            F.lit(i).alias("ordinal"), F.lit(entries[i].rule_id).alias("rule_id"),
            F.lit(entries[i].params.get("column")).cast("string").alias("column_name"),
        ))
        for i, c in breaks.items()
    ]
    kind = "array<struct<ordinal:int,rule_id:string,column_name:string>>"
    broken = F.array_compact(F.array(*named)).cast(kind) if named else F.array().cast(kind)
    found = rows.select(*[quoted(c) for c in df.columns], broken.alias(into))
    return Violations(found.where(F.size(F.col(into)) > 0), observation, left_out)


def _with_copies(rows: DataFrame, df: DataFrame, column: str, mark: str) -> tuple[DataFrame, Column]:
    """The rows with a mark on those whose value in the column occurs more than once."""
    counted = frequencies(df, [column])[0]
    repeated = counted.frame.where(counted.valued > 1).select(F.col("v").alias(mark))
    return rows.join(repeated, counted.key(column) == F.col(mark), "left"), F.col(mark).isNotNull()
