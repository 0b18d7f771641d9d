"""Keyed tables, gathered evidence, and keyed state of streams."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from strataframe.operators import keyed
from strataframe.streaming import jobs


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("how", ["replace", "ignore", "merge"])
def test_an_upsert_leaves_other_files_as_they_are(spark, tmp_path, how):
    path = str(tmp_path / "t")
    rows = [(i, f"a{i}", float(i)) for i in range(2000)]
    keyed.create(spark.createDataFrame(rows, "k long, s string, v double"), path, "k", 64)
    before = files(path)
    new = spark.createDataFrame([(7, "old", 1.0, 1), (7, "n7", None, 2), (5000, "n5000", 5.0, 1)], "k long, s string, v double, seq int")
    assert keyed.upsert(path, new, "k", 64, how, order="seq", take=("s",), fill=("v",)) == 2
    after = files(path)
    assert len(after) == 64 and sum(after.get(f) == m for f, m in before.items()) == 62
    got = {r.k: (r.s, r.v) for r in keyed.read(spark, path).collect()}
    want = {k: (s, v) for k, s, v in rows} | {5000: ("n5000", 5.0)}
    want |= {"replace": {7: ("n7", None)}, "ignore": {}, "merge": {7: ("n7", 7.0)}}[how]
    assert got == want
    assert keyed.upsert(path, new, "k", 64, how, order="seq", take=("s",), fill=("v",)) == 2  # put in again: the same table
    assert {r.k: (r.s, r.v) for r in keyed.read(spark, path).collect()} == want
    assert keyed.upsert(path, new.filter("false"), "k", 64, how) == 0


def test_deleted_keys_touch_their_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([(i,) for i in range(20)], "k long"), path, "k", 50)
    before = files(path)
    assert keyed.delete(path, spark.createDataFrame([(3,), (4,), (99,)], "k long"), "k", 50) >= 2
    assert {r.k for r in keyed.read(spark, path).collect()} == set(range(20)) - {3, 4}
    assert len(set(before) & set(files(path))) >= len(before) - 3


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def drained(spark, stream, sink, check):
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_jobs_keep_their_state_over_a_restart_and_time_out(rocks, tmp_path):
    spark, src, sink, check = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "job string, state string, at timestamp"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    saved = spark.createDataFrame([("old", "PROCESSING", at(0))], schema)
    put([("a", "QUEUED", at(1)), ("a", "PROCESSING", at(2)), ("b", "PROCESSING", at(2)), ("b", "QUEUED", at(3)), ("c", "QUEUED", at(3))])
    stream = lambda: jobs.job_stream(spark.readStream.schema(schema).parquet(src), "job", "state", "at", 60, saved=saved)
    drained(spark, stream(), sink, check)
    put([("a", "COMPLETED", at(10)), ("a", "PROCESSING", at(11)), ("old", "COMPLETED", at(12)), ("b", "PROCESSING", at(400))])
    drained(spark, stream(), sink, check)  # a new query from the checkpoint
    put([("z", "QUEUED", at(900))])
    got = drained(spark, stream(), sink, check)
    rows = sorted(((r.job, r.state, r.accepted, (r.reason or "").split(" timed")[0].split(" is no")[0]) for r in got.filter("job <> 'z'").collect()), key=repr)
    assert rows == sorted(
        [
            ("a", "QUEUED", True, ""), ("a", "PROCESSING", True, ""), ("a", "COMPLETED", True, ""), ("a", "PROCESSING", False, "COMPLETED to PROCESSING"),
            ("b", "PROCESSING", False, "None to PROCESSING"), ("b", "QUEUED", True, ""), ("b", "PROCESSING", True, ""), ("b", "FAILED", True, "PROCESSING"),
            ("c", "QUEUED", True, ""), ("c", "FAILED", True, "QUEUED"), ("old", "COMPLETED", True, ""),
        ],
        key=repr,
    )


def test_assessments_go_on_while_the_product_stays(rocks, tmp_path):
    spark, src, sink, check = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "client string, product string, at timestamp"
    saved = spark.createDataFrame([("u", "pump", 4, at(0))], "client string, product string, assessment long, at timestamp")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: jobs.assessment_stream(spark.readStream.schema(schema).parquet(src), "client", "product", "at", 100, saved=saved)
    put([("u", "pump", at(5)), ("u", "pipe", at(6)), ("w", "pump", at(6))])
    drained(spark, stream(), sink, check)
    put([("u", "pipe", at(50)), ("u", "pipe", at(300)), ("w", "pipe", at(7))])
    got = drained(spark, stream(), sink, check)
    assert sorted((r.client, r.assessment, r.fresh, r.product) for r in got.collect()) == [
        ("u", 4, False, "pump"), ("u", 5, False, "pipe"), ("u", 5, True, "pipe"), ("u", 6, True, "pipe"), ("w", 1, True, "pump"), ("w", 2, True, "pipe"),
    ]
