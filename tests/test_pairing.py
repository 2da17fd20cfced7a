"""Keyed pairing with timers, parameters with typed defaults, bounded sinks."""

from __future__ import annotations

import datetime as dt

import pytest

from palimpsest.operators import ml, paragraphs
from palimpsest.sources import sinks
from palimpsest.streaming import jobs
from palimpsest.streaming.pairing import keyed_state, pair_or_expire

START = dt.datetime(2024, 1, 1)
SCHEMA = "k long, ts timestamp, side string, value string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streams(spark, folder):
    both = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return [both.filter(f"side = '{s}'").select("k", "ts", "value") for s in ("b", "a")]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_arrivals_pair_wait_or_leave_with_a_reason(spark, tmp_path):
    folder, table, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    write(spark, folder, [
        (1, at(0), "b", "b1"), (1, at(20), "a", "a1"),  # together
        (2, at(5), "b", "b2"),  # its partner comes with the next file
        (3, at(0), "a", "a3"),  # alone
        (4, at(0), "b", "b4"), (4, at(90), "a", "a4"),  # too far apart
        (5, at(1), "b", None), (5, at(2), "a", "a5"),
    ])
    with keyed_state(spark):
        before, after = streams(spark, folder)
        first = jobs.drain(pair_or_expire(before, after, "k", "ts", "value", 60), path=table, offsets=offsets)
        rows = {tuple(r) for r in first.collect()}
        assert {(1, "b1", "a1", "paired"), (5, None, "a5", "paired")} <= rows and len(rows) == 2
        # A restart goes on with the state: 2 is paired, late time lets the others go.
        write(spark, folder, [(2, at(50), "a", "a2"), (9, at(200), "b", "b9"), (8, at(210), "a", "a8")])
        before, after = streams(spark, folder)
        second = jobs.drain(pair_or_expire(before, after, "k", "ts", "value", 60), path=table, offsets=offsets)
        rows = {tuple(r) for r in second.collect()}
    assert rows == {
        (1, "b1", "a1", "paired"), (5, None, "a5", "paired"), (2, "b2", "a2", "paired"),
        (3, None, "a3", "no before"), (4, "b4", None, "no after"),
    }


def test_many_keys_share_a_state_and_a_timer(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(k, at(k % 50), "b", f"b{k}") for k in range(300)]
    rows += [(k, at(k % 50 + 30), "a", f"a{k}") for k in range(0, 300, 3)]
    rows += [(None, at(3), "b", "x"), (None, at(4), "a", "y")]
    late = [(1000, at(500), "b", "l"), (1001, at(500), "a", "m")]
    write(spark, folder, rows)
    write(spark, folder, late)
    with keyed_state(spark):
        found = jobs.drain(pair_or_expire(*streams(spark, folder), "k", "ts", "value", 60, buckets=2)).collect()
    paired = {(k, f"b{k}", f"a{k}", "paired") for k in range(0, 300, 3)} | {(None, "x", "y", "paired")}
    alone = {(k, f"b{k}", None, "no after") for k in range(300) if k % 3}
    assert len(found) == len(paired) + len(alone) and {tuple(r) for r in found} == paired | alone


def test_the_state_store_of_the_session_comes_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), keyed_state(spark):
        assert "RocksDB" in spark.conf.get(key)
        1 / 0
    assert spark.conf.get(key) == before


def test_unknown_parameters_are_errors(spark):
    with pytest.raises(TypeError):
        paragraphs.Settings(vector_sise=3)
    with pytest.raises(TypeError):
        ml.grid_silhouettes(spark.range(1), "id", size=3)
    assert paragraphs.Settings().vector_size == ml.VECTOR_SIZE and paragraphs.Settings().seed == ml.SEED


def test_idioms_beyond_one_row_are_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("palimpsest.session.BROADCAST_ROWS", 2)
    rows = spark.createDataFrame([("int", str(i), i) for i in range(3)], "cls string, value string, count long")
    with pytest.raises(ValueError):
        sinks.write_idioms(rows, str(tmp_path / "idioms"))
