"""Propose rules from a column profile, and a contract from the proposals."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.functions.text import EMAIL_PATTERN
from tablecheck.operators.rules import get_rule, param_errors
from tablecheck.operators.schema import snapshot

def _proposal(applies: Column, rule_id: str, reason: str, **params: Column | str) -> Column:
    """A struct where the condition holds, else null."""
    given = {"column": F.col("name")} | {
        k: v if isinstance(v, Column) else F.lit(v) for k, v in params.items()
    }
    pairs = [x for k, v in given.items() for x in (F.lit(k), v)]
    return F.when(
        applies,
        F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.create_map(*pairs).alias("params"),
            F.lit(reason).alias("reason"),
        ),
    )


def suggest_rules(columns: DataFrame) -> DataFrame:
    """``ordinal, column_name, rule_id, params map<string,string>, reason``: the rules that
    a column profile speaks for. Lists of values need a profile that is not redacted.
    """
    hint, inferred = F.col("semantic_hint"), F.col("inferred_dtype")
    is_id = F.coalesce(hint == "id", F.lit(False))
    expected = F.when(inferred == "Int64", "int").when(inferred == "Float64", "float").when(
        inferred == "Date", "date"
    )
    listed = F.transform("top_values", lambda t: t["value"])
    shown = F.aggregate("top_values", F.lit(0).cast("bigint"), lambda n, t: n + t["count"])
    enumerable = (
        (F.col("dtype") == "string")
        & (shown == F.col("non_null_count"))
        & (F.col("distinct_count") < F.col("non_null_count"))
    )
    proposals = [
        _proposal(is_id, "unique_check", "the name marks an identifier"),
        _proposal(F.col("null_rate") == 0, "null_check", "no value is null"),
        _proposal(
            is_id & (F.col("null_rate") > 0), "null_check", "the name marks an identifier"
        ),
        _proposal(hint == "email", "regex_match", "most values are e-mail addresses",
                  pattern=EMAIL_PATTERN),
        _proposal(inferred.isNotNull(), "type_conformance", "most texts encode this type",
                  expected_type=expected),
        _proposal(enumerable, "allowed_values", "the column has only these values",
                  values=F.to_json(listed)),
        _proposal(~is_id & (F.col("min_num") >= 0), "range_check", "no value is negative",
                  min_val="0.0"),
    ]
    made = F.filter(F.array(*proposals), lambda p: p.isNotNull())
    return columns.select("ordinal", F.col("name").alias("column_name"), F.inline(made))


def draft_contract(df: DataFrame, dataset: str, suggestions: DataFrame) -> dict[str, Any]:
    """A contract of the suggested rules with the schema of ``df``, not yet approved.

    Fetches the suggestions, a few per column. Raises ``ValueError`` for an unknown rule or
    invalid parameters, so that no draft is made that could not run.
    """
    rules = []
    for row in suggestions.orderBy("ordinal", "rule_id").collect():
        try:
            spec = get_rule(row["rule_id"]).parameters
        except KeyError:
            raise ValueError(f"invalid proposal: unknown rule '{row['rule_id']}'") from None
        params = {
            k: spec[k].parse(v) if k in spec else v for k, v in row["params"].items()
        }
        wrong = param_errors(row["rule_id"], params)
        if wrong:
            raise ValueError("invalid proposal: " + "; ".join(wrong))
        rules.append({"rule_id": row["rule_id"], "params": params})
    return {"dataset": dataset, "approved_at": None, "columns": snapshot(df), "rules": rules}
