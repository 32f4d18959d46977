"""Run an approved contract on a DataFrame: one result row per rule.

Everything that can be decided from the schema is decided before the plan is built. What is
left becomes few aggregations: all row-level and table-level rules in one pass over the
columns they mention, and all uniqueness rules in one pass per type of column. The result
is lazy; nothing reads data until an action on it.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecheck.functions.columns import chunks
from tablecheck.operators.bitmaps import distinct_values
from tablecheck.operators.rules import (
    CountCheck,
    Measurement,
    RowCheck,
    SurplusCheck,
    TableCheck,
    get_rule,
    read_params,
)
from tablecheck.operators.schema import check_drift

RESULT_SCHEMA = (
    "ordinal int, rule_id string, column_name string, passed boolean, violation_rate double,"
    " violation_count bigint, row_count bigint, error string, severity string"
)

EMPTY_TABLE = "cannot evaluate: dataset is empty"

# Counted expressions per aggregation, to keep the generated code small.
RULES_PER_SCAN = 64


class ContractNotApprovedError(ValueError):
    """The contract has no ``approved_at``; none of its rules may run."""


# What the parts of a run deliver per rule: its constants, and what was counted. A rule
# without a row count was rejected before any data was read.
_COUNTED = (
    "struct<ordinal:int,rule_id:string,column_name:string,severity:string,error:string,"
    "table_level:boolean,max_rate:double,row_count:bigint,violation_count:bigint,"
    "table_rate:double>"
)
_ON_EMPTY = f"CASE WHEN row_count = 0 AND NOT table_level THEN '{EMPTY_TABLE}' ELSE error END"
_RATE = (
    "CASE WHEN error IS NULL THEN"
    " coalesce(table_rate, CASE WHEN row_count > 0 THEN violation_count / row_count END) END"
)


class _Entry:
    """One rule of the contract: its constants, and a measurement or an error."""

    def __init__(self, ordinal: int, spec: dict[str, Any], df: DataFrame):
        self.ordinal = ordinal
        self.rule_id: str = spec["rule_id"]
        self.params: dict[str, Any] = spec.get("params") or {}
        self.severity: str | None = spec.get("severity")
        self.measurement: Measurement | None = None
        self.error: str | None = None
        self.measured: Column | None = None
        # an invalid entry is wrong on any table; other errors give way to "empty table"
        self.invalid = False
        try:
            self.rule = get_rule(self.rule_id)
        except KeyError as exc:
            self.error, self.invalid = exc.args[0], True
            return
        self.severity = self.severity or self.rule.severity
        values, wrong = read_params(self.rule_id, self.params)
        if wrong:
            self.error, self.invalid = "; ".join(wrong), True
            return
        try:
            self.measurement = self.rule.measure(df, values)
        except Exception as exc:  # whatever one rule raises must not stop the others
            self.error = str(exc)

    @property
    def is_counted(self) -> bool:
        """Whether the violations are an aggregate of their own over the rows."""
        return isinstance(self.measurement, (RowCheck, CountCheck))

    def analyse(self, df: DataFrame) -> None:
        """Turn an expression that Spark rejects into an error; runs no job."""
        try:
            if isinstance(self.measurement, SurplusCheck):
                distinct_values(df, [self.measurement.column])[0].surplus().schema
            else:
                df.agg(self.measurement.count).schema
        except Exception as exc:
            self.measurement, self.error = None, str(exc)

    def row(self, n: Column | None = None, count: Column | None = None) -> Column:
        table_level = isinstance(self.measurement, TableCheck)
        values = [
            self.ordinal,
            self.rule_id,
            _text(self.params.get("column")),
            self.severity,
            self.error,
            not self.invalid and self.rule.is_table_level,
            self.measurement.max_rate if self.measurement else None,
            n,
            self.measurement.count(n) if table_level else count,
            self.measurement.rate(n) if table_level else None,
        ]
        cells = [v if isinstance(v, Column) else F.lit(v) for v in values]
        return F.struct(*cells).cast(_COUNTED)


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def require_approval(contract: dict[str, Any]) -> None:
    if contract.get("approved_at") is None:
        raise ContractNotApprovedError(
            f"contract for dataset '{contract.get('dataset')}' is not approved: "
            "no rule runs without an approved contract"
        )


def run_contract(df: DataFrame, contract: dict[str, Any]) -> DataFrame:
    """Results of an approved contract, in contract order.

    ``contract`` has ``dataset``, ``approved_at``, optionally ``approved_by`` and
    ``columns`` (the schema it was approved for), and ``rules``: a list of ``{"rule_id",
    "params", "severity"}``. Raises :class:`ContractNotApprovedError` or
    ``SchemaDriftError`` before anything is planned. A rule that cannot be evaluated
    yields a row with its ``error`` and no rate, and never affects the other rules.
    """
    require_approval(contract)
    check_drift(df, contract.get("columns"), contract.get("dataset"))
    entries = [_Entry(i, spec, df) for i, spec in enumerate(contract["rules"])]
    if not entries:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    _analyse(df, entries)

    rejected = [e for e in entries if e.invalid]
    isolated = [e for e in entries if e.measurement is not None and not e.rule.total]
    together = [e for e in entries if not e.invalid and e not in isolated]
    surplus = [e for e in together if isinstance(e.measurement, SurplusCheck)]
    counted = [e for e in together if e not in surplus]

    parts = [_counted_rows(df, group) for group in chunks(counted, RULES_PER_SCAN)]
    parts += _surplus_rows(df, surplus)
    literal = [e.row() for e in rejected] + _isolated_rows(df, isolated)
    if literal:
        parts.append(df.sparkSession.range(1).select(F.inline(F.array(*literal))))
    return _results(reduce(DataFrame.union, parts))


def _results(counted: DataFrame) -> DataFrame:
    results = (
        counted.withColumn("error", F.expr(_ON_EMPTY))
        .withColumn("violation_rate", F.expr(_RATE))
        .select(
            "ordinal",
            "rule_id",
            "column_name",
            F.expr("coalesce(violation_rate <= max_rate, false)").alias("passed"),
            "violation_rate",
            F.expr("CASE WHEN error IS NULL THEN violation_count END").alias("violation_count"),
            "row_count",
            "error",
            "severity",
        )
    )
    # every part is a handful of rows behind its own aggregation, so one task orders them
    return results.coalesce(1).orderBy("ordinal")


def _analyse(df: DataFrame, entries: list[_Entry]) -> None:
    """Find the rules whose expressions Spark rejects: all at once, singly if any is."""
    counted = [e for e in entries if e.is_counted]
    surplus = [e for e in entries if isinstance(e.measurement, SurplusCheck)]
    try:
        df.agg(F.count(F.lit(1)), *[e.measurement.count for e in counted]).schema
        columns = list(dict.fromkeys(e.measurement.column for e in surplus))
        for part in distinct_values(df, columns) if columns else []:
            part.surplus().schema
    except Exception:
        for e in counted + surplus:
            e.analyse(df)


def _counted_rows(df: DataFrame, entries: list[_Entry]) -> DataFrame:
    """All row-level and table-level rules in one aggregation."""
    n = F.col("n")
    counts, rows = [F.count(F.lit(1)).alias("n")], []
    for e in entries:
        name = f"v{e.ordinal}"
        if e.is_counted:
            counts.append(e.measurement.count.alias(name))
        rows.append(e.row(n, F.col(name) if e.is_counted else None))
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def _surplus_rows(df: DataFrame, entries: list[_Entry]) -> list[DataFrame]:
    """All uniqueness rules, one aggregation per type of column."""
    columns = list(dict.fromkeys(e.measurement.column for e in entries))
    parts = []
    for counted in distinct_values(df, columns) if columns else []:
        slots = {f.name: slot for slot, f in counted.columns}
        rows = [
            e.row(F.col("n"), F.col(f"s{slots[e.measurement.column]}"))
            for e in entries
            if e.measurement.column in slots
        ]
        parts.append(counted.surplus().select(F.inline(F.array(*rows))))
    return parts


def _isolated_rows(df: DataFrame, entries: list[_Entry]) -> list[Column]:
    """Measure rules that may fail, now, so that a failure stays with its rule.

    All are measured in one job; if it fails its rules are measured in two halves, until each
    failing rule stands alone. So k rules without failures cost one job, and each failing one
    adds about twice the logarithm of k. Uniqueness rules shuffle anyway and have a job each.
    """
    alone = [e for e in entries if isinstance(e.measurement, SurplusCheck)]
    together = [e for e in entries if e not in alone]
    for e in alone:
        _measure(df, [e])
    for group in chunks(together, RULES_PER_SCAN):
        _measure(df, group)
    return [e.row() if e.measured is None else e.measured for e in entries]


def _measure(df: DataFrame, entries: list[_Entry]) -> None:
    try:
        if isinstance(entries[0].measurement, SurplusCheck):
            n, *counts = distinct_values(df, [entries[0].measurement.column])[0].surplus().first()
        else:
            counted = [e.measurement.count.alias(f"v{e.ordinal}") for e in entries if e.is_counted]
            n, *counts = df.agg(F.count(F.lit(1)).alias("n"), *counted).first()
        found = iter(counts)
        for e in entries:
            of_rows = e.is_counted or isinstance(e.measurement, SurplusCheck)
            e.measured = e.row(F.lit(n), F.lit(next(found)) if of_rows else None)
    except Exception as exc:
        if len(entries) == 1:  # the rule's own failure, reported as its error
            entries[0].measurement, entries[0].error = None, str(exc)
            return
        half = len(entries) // 2
        _measure(df, entries[:half])
        _measure(df, entries[half:])


def blocking_failures(results: DataFrame) -> DataFrame:
    """The rows on which a pipeline should stop: failed rules of severity ``error``."""
    return results.where((F.col("severity") == "error") & ~F.col("passed"))


def contract_rules(spark: SparkSession, contract: dict[str, Any]) -> DataFrame:
    """The rules of a contract as rows ``ordinal, rule_id, column_name, params, severity``;
    ``params`` holds the parameters as text."""
    rows = [
        (
            i,
            spec["rule_id"],
            _text((spec.get("params") or {}).get("column")),
            {k: _text(v) for k, v in (spec.get("params") or {}).items()},
            spec.get("severity"),
        )
        for i, spec in enumerate(contract["rules"])
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, rule_id string, column_name string, params map<string,string>,"
        " severity string",
    )
