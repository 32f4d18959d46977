"""Score contract results against the failures that were expected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

ISSUE_SCHEMA = "rule_id string, column_name string"

_STATUS = ("caught", "missed", "spurious")


def expected_issues(spark, issues: Iterable[tuple[str, str | None]]) -> DataFrame:
    """Issue keys as rows; a table-level rule has the column None."""
    return spark.createDataFrame(list(issues), ISSUE_SCHEMA)


def issue_status(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``rule_id, column_name, status`` per issue that was expected or found.

    A result is found when it failed and was measured: an error is a broken rule and not
    a finding. Several results with one key are one issue.
    """
    found = results.where(~F.col("passed") & F.col("error").isNull())
    both = found.select("rule_id", "column_name", F.lit(0).alias("e"), F.lit(1).alias("f")).union(
        expected.select("rule_id", "column_name", F.lit(1), F.lit(0))
    )
    # grouping, unlike an equality join, lets the null columns of table rules meet
    keys = both.groupBy("rule_id", "column_name").agg(
        F.max("e").alias("e"), F.max("f").alias("f")
    )
    status = (
        F.when(F.col("e") + F.col("f") == 2, "caught")
        .when(F.col("e") == 1, "missed")
        .otherwise("spurious")
    )
    return keys.select("rule_id", "column_name", status.alias("status"))


def score(results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row ``caught, missed, spurious`` (sorted issue lists) and ``recall, precision``.

    Recall is 1 when nothing was expected, precision is 1 when nothing failed.
    """
    issue = F.struct("rule_id", "column_name")
    lists = [
        F.sort_array(F.collect_list(F.when(F.col("status") == s, issue))).alias(s)
        for s in _STATUS
    ]
    counted = issue_status(results, expected).agg(*lists)
    caught = F.size("caught")

    def share(others: str):
        total = caught + F.size(others)
        return F.when(total > 0, caught / total).otherwise(1.0)

    return counted.select(
        *_STATUS, share("missed").alias("recall"), share("spurious").alias("precision")
    )
