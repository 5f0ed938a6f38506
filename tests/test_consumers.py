"""Consumer groups over a growing log."""

import pytest
from pyspark.sql import functions as F

from aeroband.streaming import consumers


def append(spark, log, *rows):
    df = spark.createDataFrame([(t, k, "v", ts) for t, k, ts in rows], "topic string, key string, value string, ts string")
    consumers.append(df.withColumn("ts", F.to_timestamp("ts")), log)


def keys(df):
    return sorted(r.key for r in df.collect())


@pytest.fixture
def log(tmp_path):
    return f"{tmp_path}/log"


def test_each_message_once(spark, tmp_path, log):
    group = consumers.Group(spark, log, f"{tmp_path}/home", "g")
    append(spark, log, ("a", "1", "2024-01-01 10:00:00"), ("a", "2", "2024-01-02 10:00:00"))
    assert keys(group.deliver("2024-02-01")) == ["1", "2"]
    assert keys(group.deliver("2024-02-02")) == []
    append(spark, log, ("a", "3", "2024-01-01 09:00:00"), ("b", "2", "2024-01-02 10:00:00"))
    again = consumers.Group(spark, log, f"{tmp_path}/home", "g")  # a restart
    assert keys(again.deliver("2024-02-03")) == ["2", "3"]
    assert again.pending().count() == 4 and again.pending().select("entry").distinct().count() == 4


def test_positions_and_patterns(spark, tmp_path, log):
    append(spark, log, *[("site/1" if k % 2 else "site/2", str(k), f"2024-01-0{k} 12:00:00") for k in range(1, 8)])
    early = consumers.Group(spark, log, f"{tmp_path}/home", "early", start="2024-01-03 12:00:00")
    whole = consumers.Group(spark, log, f"{tmp_path}/home", "whole")
    odd = consumers.Group(spark, log, f"{tmp_path}/home", "odd", pattern="site/1")
    assert keys(early.deliver("2024-02-01")) == ["3", "4", "5", "6", "7"]  # at the position, the key decides
    assert keys(whole.deliver("2024-02-01")) == [str(k) for k in range(1, 8)]
    assert keys(odd.deliver("2024-02-01")) == ["1", "3", "5", "7"]


def test_unacknowledged_entries_come_again(spark, tmp_path, log):
    group = consumers.Group(spark, log, f"{tmp_path}/home", "g")
    append(spark, log, *[("a", str(k), "2024-01-01 10:00:00") for k in range(40)])
    got = group.deliver("2024-02-01 00:00:00", members=("x", "y"))
    assert {r.member for r in got.collect()} == {"x", "y"}
    group.acknowledge(got.filter("member = 'x'"))
    left = keys(got.filter("member = 'y'"))
    assert keys(group.pending()) == left
    assert keys(group.claim("x", "2024-02-01 00:00:59")) == []
    assert keys(group.claim("x", "2024-02-01 00:01:00")) == left
    assert {(r.member, r.deliveries) for r in group.pending().collect()} == {("x", 2)}
    assert keys(group.claim("z", "2024-02-01 00:01:30")) == []  # delivered again half a minute ago
    group.acknowledge(group.pending().limit(3))
    assert len(keys(group.claim("z", "2024-02-01 00:05:00"))) == len(left) - 3
    assert {(r.member, r.deliveries) for r in group.pending().collect()} == {("z", 3)}
