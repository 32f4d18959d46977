"""Contract results made legible, as rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablecheck.operators.rules import catalogue
from tablecheck.plans.contract import contract_rules


def summary(results: DataFrame, dataset: str) -> DataFrame:
    """One row: how many rules ran, passed and failed, and the same as a sentence."""
    counts = results.agg(
        F.count(F.lit(1)).alias("rules"), F.count_if("passed").alias("passed_rules")
    ).withColumn("failed_rules", F.col("rules") - F.col("passed_rules"))
    noun = F.when(F.col("rules") == 1, "rule").otherwise("rules")
    sentence = (
        F.when(F.col("rules") == 0, "No rules in contract.")
        .when(F.col("failed_rules") == 0, F.format_string("All %d %s passed.", "rules", noun))
        .when(F.col("passed_rules") == 0, F.format_string("All %d %s failed.", "rules", noun))
        .otherwise(
            F.format_string(
                "%d of %d rules passed, %d failed.", "passed_rules", "rules", "failed_rules"
            )
        )
    )
    return counts.select(
        F.lit(dataset).alias("dataset"), "rules", "passed_rules", "failed_rules",
        sentence.alias("summary"),
    )


def report_rows(results: DataFrame, contract: dict[str, Any]) -> DataFrame:
    """One row per result, passed rules first: ``section, ordinal, name, tag,
    context, detail``.

    ``tag`` is the severity where it is not ``error``; ``context`` is the column or the
    wanted number of rows; ``detail`` is the error, the violation rate or "not evaluated".
    """
    spark = results.sparkSession
    # both sides are as long as the contract and the catalogue, not as the data
    names = catalogue(spark).select("rule_id", "name")
    params = contract_rules(spark, contract).select("ordinal", "params")
    joined = results.join(F.broadcast(names), "rule_id", "left").join(
        F.broadcast(params), "ordinal", "left"
    )
    context = F.when(F.col("column_name").isNotNull(), F.col("column_name")).when(
        F.col("params")["min_rows"].isNotNull(),
        F.concat(F.lit("min "), F.col("params")["min_rows"], F.lit(" rows")),
    )
    detail = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error"))
        .when(
            F.col("violation_rate").isNotNull(),
            F.format_string("%.1f%% violation rate", F.col("violation_rate") * 100),
        )
        .otherwise("not evaluated")
    )
    rows = joined.select(
        F.when(F.col("passed"), "PASSED").otherwise("FAILED").alias("section"),
        "ordinal",
        F.coalesce("name", "rule_id").alias("name"),
        F.when(F.col("severity") != "error", F.col("severity")).alias("tag"),
        context.alias("context"),
        detail.alias("detail"),
    )
    return rows.coalesce(1).orderBy(F.desc("section"), "ordinal")
