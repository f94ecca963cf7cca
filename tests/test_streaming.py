"""Streams over keyed tables: what a batch reads, and what a crash leaves."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.streaming import jobs, keyed

KEY = StructType().add("key", "string")


def keys(spark, ks):
    return spark.createDataFrame([(f"{hash_(k)}",) for k in ks], KEY)


def hash_(k):
    import hashlib

    return hashlib.sha256(str(k).encode()).hexdigest()


def test_a_batch_opens_the_files_of_its_keys_only(spark):
    t = keyed.Runs(spark, jobs.shared_dir(spark, "runs"), KEY, rows=100, unique=True)
    for b in range(4):
        t.append(keys(spark, range(1000 * b, 1000 * b + 1000)), 1000, "s", b)
    files = sum(r["buckets"] for r in t.state()["runs"])
    assert files == 4 * 16
    one = keys(spark, [2500])
    assert 1 <= len(t.files(one, 1)) <= 3
    assert [r.key for r in t.lookup(one, 1).collect()] == [hash_(2500)]
    assert len(t.files(keys(spark, [10**6]), 1)) <= 2 and t.lookup(keys(spark, [10**6]), 1).count() == 0  # unknown: no file but by chance
    some = keys(spark, [*range(0, 4000, 400), *range(10**6, 10**6 + 10)])
    assert len(t.files(some, 20)) < 20 and len(t.lookup(some, 20).inputFiles()) == len(t.files(some, 20))
    assert t.lookup(some, 20).count() == 10 and t.lookup(some, keyed.FILTERED + 1).count() == 10
    assert len(t.files(some, keyed.FILTERED + 1)) == files


def test_runs_are_merged_in_steps(spark):
    rows = lambda b: spark.createDataFrame([(hash_(k), b) for k in range(b, b + 5)], "key string, n int")
    t = keyed.Runs(spark, jobs.shared_dir(spark, "runs"), rows(0).schema, fan=2)
    for b in range(7):
        t.append(rows(b), 5, "s", b)
        assert {r.key: r.n for r in t.table().collect()} == {hash_(k): min(k, b) for k in range(b + 5)}
    levels = [r["level"] for r in t.state()["runs"]]
    assert sorted(levels) == [0, 1, 2] and t.table().count() == 11
    assert t.done("s", 6) and not t.done("s", 7) and not t.done("other", 0)


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_crash_loses_no_key(spark, monkeypatch, step):
    """The batch fails before the run is published, or in a merge; it is repeated and every key goes on once."""
    out = jobs.shared_dir(spark, "crash")
    monkeypatch.setattr(jobs, "COMPACT", 2)
    write = jobs.dedup_batch(f"{out}/seen", f"{out}/new")
    batch = lambda b: spark.createDataFrame([(hash_(k), str(b), str(k)) for k in range(7 * b, 7 * b + 14)], "key string, scraped_at string, source_id string")
    write(batch(0), 0)
    publish, calls = keyed.Runs.publish, []

    def failing(self, state):
        calls.append(1)
        if len(calls) == step:
            raise OSError("lost")
        return publish(self, state)

    monkeypatch.setattr(keyed.Runs, "publish", failing)
    for b in (1, 2):
        try:
            write(batch(b), b)
        except OSError:
            write(batch(b), b)  # the stream does it again
    monkeypatch.setattr(keyed.Runs, "publish", publish)
    write(batch(3), 3)
    write(batch(3), 3)
    new = spark.read.parquet(f"{out}/new")
    assert sorted(r.key for r in new.collect()) == sorted(hash_(k) for k in range(35))
    t = keyed.Runs(spark, f"{out}/seen", KEY, unique=True)
    assert sorted(r.key for r in t.table().collect()) == sorted(hash_(k) for k in range(35))


def test_upsert_keeps_columns_and_takes_any_key(spark):
    out = jobs.shared_dir(spark, "any")
    rows = spark.createDataFrame([("a", "x", 1), ("ü", "y", 2), ("", "z", 3)], "id string, note string, n int")
    jobs.keyed_table(rows, f"{out}/t", "id")
    up = jobs.upsert_batch(f"{out}/t", rows.schema, "id", preserve=("note",))
    for _ in range(2):
        up(spark.createDataFrame([("ü", "new", 5), ("b", "b", 6)], rows.schema), 0)
    got = {tuple(r) for r in jobs.read_keyed(spark, f"{out}/t", rows.schema, "id").collect()}
    assert got == {("a", "x", 1), ("", "z", 3), ("ü", "y", 5), ("b", "b", 6)}
    up(rows.limit(0), 1)
    assert {tuple(r) for r in jobs.read_keyed(spark, f"{out}/t", rows.schema, "id").collect()} == got


def test_a_stream_starts_where_it_ended(spark, tmp_path):
    """A restarted stream repeats nothing, and another one with batches of the same numbers is not taken for it."""
    out, data = jobs.shared_dir(spark, "restart"), str(tmp_path / "in")
    add = lambda ks: spark.createDataFrame([(hash_(k), "1", str(k)) for k in ks], "key string, scraped_at string, source_id string").coalesce(1).write.mode("append").parquet(data)
    run = lambda name: jobs.start(spark.readStream.schema("key string, scraped_at string, source_id string").parquet(data), jobs.dedup_batch(f"{out}/seen", f"{out}/{name}"), f"{out}/check-{name}").awaitTermination()
    add(range(5))
    run("new")
    add(range(3, 9))
    run("new")
    assert sorted(r.source_id for r in spark.read.parquet(f"{out}/new").collect()) == sorted(map(str, range(9)))
    add([20])
    run("other")
    assert [r.source_id for r in spark.read.parquet(f"{out}/other").collect()] == ["20"]


def test_fetch_health_by_timers(spark, tmp_path):
    """Three failures open, 30 seconds of event time half-open, then a failure opens and a success closes; over restarts."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out, data = jobs.shared_dir(spark, "health"), str(tmp_path / "in")
    schema = "company string, ts timestamp, event_id long, ok boolean"

    def said(*rows):
        df = spark.createDataFrame([(c, second, i, ok) for i, (c, second, ok) in enumerate(rows)], "company string, second long, event_id long, ok boolean")
        df.select("company", F.timestamp_seconds("second").alias("ts"), "event_id", "ok").coalesce(1).write.mode("append").parquet(data)
        got = []
        with jobs.rocksdb(spark):
            jobs.start(jobs.fetch_health(spark.readStream.schema(schema).parquet(data)), lambda df, n: got.extend(tuple(r) for r in df.collect()), f"{out}/checkpoint").awaitTermination()
        return got

    assert sorted(said(("a", 100, False), ("a", 101, False), ("b", 100, True), ("a", 99, True))) == [("a", 2, "closed"), ("b", 0, "closed")]
    got = said(("a", 103, False), ("b", 104, False))
    assert sorted(got) == [("a", 3, "open"), ("b", 1, "closed")]
    got = said(("b", 133, True))  # 30 seconds are not more than 30
    assert got == [("b", 0, "closed")]
    got = said(("b", 134, True))
    assert got == [("b", 0, "closed"), ("a", 3, "half_open")]
    assert said(("a", 140, False)) == [("a", 4, "open")]
    got = said(("b", 200, True))
    assert got[-1] == ("a", 4, "half_open")
    assert said(("a", 201, True), ("a", 202, False)) == [("a", 1, "closed")]
    assert not [r for r in said(("b", 400, True)) if r[0] == "a"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_failures_behind_the_last_success():
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1, 50, 20_000):
        ts, ok = r.integers(0, n, n), r.random(n) < 0.001
        number = r.permutation(n)
        seen = jobs._Behind()
        for k in range(0, n, 777):
            seen.add(ts[k : k + 777], number[k : k + 777], ok[k : k + 777])
        rows = sorted(zip(ts.tolist(), number.tolist(), ok.tolist()))
        last = max((i for i, x in enumerate(rows) if x[2]), default=-1)
        assert sorted(seen.left().tolist()) == [x[0] for x in rows[last + 1 :]]
