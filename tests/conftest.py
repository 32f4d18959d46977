from __future__ import annotations

import datetime
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import tablecheck as tc  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

# The fixture table: twenty orders with one issue per column.
ROWS = 20
STATUSES = ["shipped", "delivered", "pending", "cancelled"]
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablecheck-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


# The twenty orders, as they stand in the example file.
ORDERS = """
1001 C001 alice@example.com 99.99 shipped 2026-05-15 +1-555-0101
1001 C002 bob@example.com 149.50 delivered 2026-05-16 +1-555-0102
1003 C003 carol@example.com 25.00 pending 2026-05-17 +1-555-0103
1004 C004 dan@example.com 200.00 cancelled 2026-05-18 +1-555-0104
1005 null eve@example.com 75.00 shipped 2026-05-19 +1-555-0105
1006 C006 frank@example.com 50.00 delivered 2026-05-20 +1-555-0106
1007 C007 grace@example.com 300.00 pending 2026-05-21 +1-555-0107
1008 null henry@example.com 120.00 shipped 2026-05-22 +1-555-0108
1009 C009 iris@example.com 89.99 delivered 2026-05-23 +1-555-0109
1010 C010 jack@example.com 45.00 cancelled 2026-05-24 +1-555-0110
1011 C011 kate@example.com -50.00 shipped 2026-05-25 +1-555-0111
1012 C012 liam@example.com 175.00 pending 2026-05-26 +1-555-0112
1013 C013 mia@example.com null delivered 2026-05-27 +1-555-0113
1014 C014 noah@example.com 60.00 cancelled 2026-05-28 +1-555-0114
1015 C015 not-an-email 90.00 shipped 2026-05-29 +1-555-0115
1016 C016 pam@example.com 130.00 delivered 2026-05-30 +1-555-0116
1017 C017 quinn@example.com 55.00 refunded 2026-05-31 +1-555-0117
1018 C018 rosa@example.com 210.00 pending 2026-06-01 +1-555-0118
1019 C019 sam@example.com 40.00 shipped 2020-01-15 +1-555-0119
1020 C020 tina@example.com 95.00 delivered 2026-06-05 +1-555-0120
"""


def order_rows() -> list[tuple]:
    rows = []
    for line in ORDERS.split("\n")[1:-1]:
        number, customer, email, amount, status, day, phone = line.split()
        rows.append((
            int(number), None if customer == "null" else customer, email,
            None if amount == "null" else float(amount), status, datetime.date.fromisoformat(day), phone,
        ))
    return rows


ORDERS_SCHEMA = (
    "order_id bigint, customer_id string, email string, amount double, status string,"
    " created_at date, phone string"
)


@pytest.fixture(scope="session")
def orders(spark):
    return spark.createDataFrame(order_rows(), ORDERS_SCHEMA).cache()


@pytest.fixture(scope="session")
def no_orders(orders):
    return orders.where("amount > 1e9")


def contract(*rules: tuple, **overrides) -> dict:
    """An approved contract from ``(rule_id, params)`` or ``(rule_id, params, severity)``."""
    made = {
        "dataset": "orders",
        "approved_at": "2026-06-12T00:00:00Z",
        "rules": [dict(zip(("rule_id", "params", "severity"), rule)) for rule in rules],
    }
    return made | overrides


def run(df, *rules: tuple, **overrides) -> list:
    return tc.run_contract(df, contract(*rules, **overrides)).collect()


def check(df, rule_id: str, **params):
    """The result of a single rule."""
    return run(df, (rule_id, params))[0]
