"""Files by suffix, and the options of database reads."""

import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import tablecheck as tc
from conftest import ROWS
from tablecheck.sources import jdbc

URL = "jdbc:postgresql://db/shop"


def test_csv(spark, tmp_path, orders):
    path = str(tmp_path / "orders.csv")
    orders.coalesce(1).write.csv(path, header=True)
    df = tc.load_table(spark, path)
    types = dict(df.dtypes)
    assert df.count() == ROWS
    assert (types["order_id"], types["amount"], types["created_at"]) == ("int", "double", "date")
    assert df.where("customer_id IS NULL").count() == 2
    assert df.where("amount IS NULL").count() == 1
    assert df.agg({"created_at": "min"}).first()[0] == datetime.date(2020, 1, 15)
    given = tc.load_csv(spark, path, schema=orders.schema)
    assert given.exceptAll(orders).count() == 0
    assert tc.load_csv(spark, path, sampling_ratio=0.9).count() == ROWS


def test_parquet(spark, tmp_path, orders):
    path = str(tmp_path / "orders.parquet")
    orders.write.parquet(path)
    assert tc.load_table(spark, path).exceptAll(orders).count() == 0
    assert tc.load_table(spark, path + "/*.parquet").count() == ROWS
    assert tc.load_table(spark, path, format="parquet").count() == ROWS


def test_csv_and_parquet_give_the_same_profile(spark, tmp_path, orders):
    orders.coalesce(1).write.csv(str(tmp_path / "o.csv"), header=True)
    orders.write.parquet(str(tmp_path / "o.parquet"))
    csv, parquet = (
        tc.profile_columns(tc.load_table(spark, str(tmp_path / name))).drop("dtype")
        for name in ("o.csv", "o.parquet")
    )
    # the deviation depends on the order of the additions, in its last digits
    std = [r.std for r in csv.select("numeric.std").collect()]
    assert std == pytest.approx([r.std for r in parquet.select("numeric.std").collect()])
    same = [
        df.withColumn("numeric", F.col("numeric").dropFields("std")).collect()
        for df in (csv, parquet)
    ]
    assert same[0] == same[1]


def test_quoted_csv_fields(spark, tmp_path):
    import duckdb

    path = tmp_path / "notes.csv"
    path.write_text(
        'id,note,amount\n1,"He said ""hi"", ok",2.5\n2,"two\nlines",3\n3,"a,b",\n4,"",5\n5,plain,6\n6,"back\\slash",7\n'
    )
    want = duckdb.sql(f"SELECT * FROM read_csv('{path}', header = true, quote = '\"', escape = '\"')").fetchall()
    for given in ({}, {"schema": "id int, note string, amount double"}):
        got = [tuple(r) for r in tc.load_table(spark, str(path), **given).orderBy("id").collect()]
        assert [(i, n or None, a) for i, n, a in got] == [(i, n or None, a) for i, n, a in want]
    simple = tmp_path / "simple.csv"
    simple.write_text('id,note\n1,"a ""b"""\n2,c\n')
    assert tc.load_table(spark, str(simple), multi_line=False).orderBy("id").collect()[0]["note"] == 'a "b"'


def test_broken_csv_lines_fail(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tc.load_table(spark, str(path), schema="a int, b int").collect()


def test_unsupported_and_missing(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported file type '.xlsx'"):
        tc.load_table(spark, "orders.xlsx")
    with pytest.raises(ValueError, match="unsupported file type"):
        tc.load_table(spark, "orders")
    with pytest.raises(FileNotFoundError, match="no file at"):
        tc.load_table(spark, str(tmp_path / "missing.csv"))


def test_catalog_tables(spark, orders):
    spark.sql("DROP TABLE IF EXISTS shop_orders")
    orders.write.saveAsTable("shop_orders")
    assert tc.estimate_table_rows(spark, "shop_orders") is None
    unknown = tc.load_table_profiling(spark, table="shop_orders", max_rows=5)
    assert (unknown.sampled, unknown.estimated_rows, unknown.df.count()) == (True, None, 5)
    prefix = tc.load_table_profiling(spark, table="shop_orders", max_rows=5, prefix=True)
    assert (prefix.method, prefix.df.count()) == ("prefix", 5)
    spark.sql("ANALYZE TABLE shop_orders COMPUTE STATISTICS")
    assert tc.estimate_table_rows(spark, "spark_catalog.default.shop_orders") == ROWS
    whole = tc.load_table_profiling(spark, table="shop_orders", max_rows=ROWS)
    assert (whole.sampled, whole.df.count()) == (False, ROWS)
    part = tc.load_table_profiling(spark, table="shop_orders", max_rows=5)
    assert part.sampled and part.df.count() == 5
    for name in ("shop_orders -- no", "a.b.c.d", "a..b"):
        with pytest.raises(ValueError, match="invalid table name"):
            tc.estimate_table_rows(spark, name)
    spark.sql("DROP TABLE shop_orders")


# --- databases: no driver here, so the reads themselves are replaced ---


def test_exactly_one_source():
    for source in ({}, {"table": "items", "query": "SELECT 2"}, {"sample_rows": 3}):
        with pytest.raises(ValueError, match="exactly one"):
            jdbc.jdbc_options(URL, **source)


@pytest.mark.parametrize("name", ["items--", "one.two.three", "9lives", "", "two words", "items\t", "'quoted'"])
def test_table_names(name):
    for read in (jdbc.relation, lambda n: jdbc.relation(n, sample_rows=2), lambda n: tc.estimate_row_count(None, URL, n)):
        with pytest.raises(ValueError, match="invalid table name"):
            read(name)


def test_options():
    assert jdbc.jdbc_options(URL, table="stock.items") == {"url": URL, "dbtable": "stock.items"}
    assert jdbc.jdbc_options(URL, query="SELECT 2", fetchsize=50) == {
        "url": URL, "dbtable": "(SELECT 2) q", "fetchsize": "50",
    }
    drawn = jdbc.jdbc_options(URL, table="items", sample_rows=40)["dbtable"]
    assert drawn == "(SELECT t.* FROM items t ORDER BY random() FETCH FIRST 40 ROWS ONLY) sampled"
    with pytest.raises(ValueError, match="sample_rows"):
        jdbc.jdbc_options(URL, query="SELECT 2", sample_rows=40)


def test_partitioned_reads():
    split = dict(partition_column="nr", lower_bound=1, upper_bound=90, num_partitions=3)
    options = jdbc.jdbc_options(URL, table="items", **split)
    assert (options["dbtable"], options["numPartitions"], options["upperBound"]) == ("items", "3", "90")
    assert jdbc.jdbc_options(URL, query="SELECT 2 AS nr", **split)["dbtable"] == "(SELECT 2 AS nr) q"
    with pytest.raises(ValueError, match="lower_bound"):
        jdbc.jdbc_options(URL, table="items", partition_column="nr")
    with pytest.raises(ValueError, match="sample"):
        jdbc.jdbc_options(URL, table="items", sample_rows=4, **split)


@pytest.fixture
def database(spark, monkeypatch):
    """Answers what is asked of the catalog and of counts and bounds, and other reads with rows."""
    state = SimpleNamespace(reads=[], estimate=None, rows=3, bounds=(1, 9))

    def read(session, options):
        state.reads.append(options)
        asked = options["dbtable"]
        if "pg_class" in asked:
            rows = [] if state.estimate is None else [(float(state.estimate),)]
            return session.createDataFrame(rows, "rows float")
        if "count(*)" in asked:
            return session.createDataFrame([(state.rows,)], "rows long")
        if "min(" in asked:
            return session.createDataFrame([state.bounds], "low long, high long")
        return session.range(state.rows)

    monkeypatch.setattr(jdbc, "_read", read)
    return state


@pytest.mark.parametrize("estimate, known", [(7000, 7000), (-1, None), (0, None), (None, None)])
def test_row_estimate(spark, database, estimate, known):
    database.estimate = estimate
    assert tc.estimate_row_count(spark, URL, "stock.items") == known
    assert "to_regclass('stock.items')" in database.reads[0]["dbtable"]


def test_profiling_load(spark, database):
    database.estimate, database.rows = 80, 80
    load = tc.load_profiling(spark, URL, table="items", max_rows=200)
    assert (load.sampled, load.estimated_rows, load.method) == (False, 80, "whole")
    assert database.reads[-1] == {"url": URL, "dbtable": "items"}

    database.estimate, database.rows = 4_000_000, 900  # rows: what the block sample returns
    load = tc.load_profiling(spark, URL, table="items", max_rows=600, seed=4)
    assert (load.sampled, load.estimated_rows, load.df.count()) == (True, 4_000_000, 600)
    blocks = [r["dbtable"] for r in database.reads if "TABLESAMPLE" in r["dbtable"]]
    assert blocks == ["(SELECT * FROM items TABLESAMPLE SYSTEM (0.022500) REPEATABLE (4)) q"]

    database.estimate, database.rows = None, 900
    load = tc.load_profiling(spark, URL, table="items", max_rows=600)
    assert (load.sampled, load.estimated_rows, load.df.count()) == (True, None, 600)
    load = tc.load_profiling(spark, URL, table="items", max_rows=900)
    assert (load.sampled, load.df.count()) == (False, 900)


def test_load_jdbc(spark, database):
    assert tc.load_jdbc(spark, URL, table="items", user="me").count() == 3
    assert database.reads == [{"url": URL, "dbtable": "items", "user": "me"}]
    tc.load_jdbc(spark, URL, table="items", partition_column="nr", user="me")
    assert "min(nr)" in database.reads[1]["dbtable"] and database.reads[1]["user"] == "me"
    assert (database.reads[2]["lowerBound"], database.reads[2]["upperBound"]) == ("1", "9")
    database.bounds = (None, None)
    tc.load_jdbc(spark, URL, table="items", partition_column="nr")
    assert "partitionColumn" not in database.reads[-1]
