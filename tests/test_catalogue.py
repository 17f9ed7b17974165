"""Every registered query against its SQL on the smallest data."""

import decimal

import duckdb
import pytest

from lodeworks.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    head = [d[0] for d in found.description]
    assert sorted(head) == columns
    at = [head.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from lodeworks.streaming import windows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("ts", events.ts.cast("timestamp"))
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), events.schema), late="0 seconds")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(repr, spark.table("tumbled").select("start", "event_type", "n").collect())) == sorted(map(repr, windows.tumbling(events).select("start", "event_type", "n").collect()))
