"""Files: tables written in other formats and read back, and what Parquet footers say of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

import tablecheck as tc
from example_queries.base import query, table


def as_csv(df: DataFrame, name: str) -> str:
    """The table as CSV files where all executors see them; the path."""
    conf = df.sparkSession.conf
    folder = conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, quoteAll=True, escape='"', **kept).csv(path)
    return path


@query("csv_line_breaks", """
    SELECT doc_id, replace(coalesce(text, ''), ' ', ' "' || chr(10)) AS text, coalesce(lang, '') AS lang FROM documents
""")
def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a quote and a line break after every blank, through CSV."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(' "\n'))
    documents = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    found = tc.load_csv_ranges(spark, as_csv(documents, "csv"), "doc_id bigint, text string, lang string")
    return found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))


ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def statistics_sql(columns: list[str], extremes: list[str]) -> str:
    def ends(name: str) -> str:
        ends = (f"{f}({name})::VARCHAR" if name in extremes else "CAST(NULL AS VARCHAR)" for f in ("min", "max"))
        return "{} AS min_value, {} AS max_value".format(*ends)

    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*)::BIGINT AS row_count,"
        f" (count(*) - count({name}))::BIGINT AS null_count, {ends(name)} FROM orders"
        for name in columns
    )


@query("footer_statistics", statistics_sql(ORDERS_COLUMNS, ["o_orderkey", "o_custkey"]))
def footer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls and extremes of the orders, without reading a column."""
    return tc.footer_statistics(spark, f"{sf_dir}/orders.parquet", ORDERS_COLUMNS)
