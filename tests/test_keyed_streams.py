"""Locks, job states, silent workers and snapshots: streams out of order and restarted against the batch forms."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from aerolith.operators import jobs, scratch
from aerolith.streaming import keyed, progress

START = dt.datetime(2024, 1, 1)
MESSAGE = "key long, id long, ts timestamp, stage string"


def history(n, seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 60, 600, 1800, 3600])
        stage = rng.choice([*progress.STATES[: 1 + i * 12 // n], *progress.STATES[: 1 + i * 12 // n], "BOGUS", "FAILED" if i > n // 2 else "QUEUED"])
        rows.append((rng.choice([1, 1, 1, 2, 3, 4]), i // 2 if i % 9 == 0 else i, START + dt.timedelta(seconds=at), stage))
    return rows


def plain_locks(rows, seconds):
    out, held = set(), {}
    for key, ts, ident in sorted({(k, t, i) for k, i, t, *_ in rows}):
        lock = held.get(key)
        granted = lock is None or ts >= lock[0] + dt.timedelta(seconds=seconds)
        if granted:
            held[key] = lock = (ts, ident)
        out.add((key, ident, ts, granted, lock[1]))
    return out


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = {k: spark.conf.get(k, None) for k in keyed.STORE}
    for k, v in keyed.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(spark, rows, path, name):
    """One file of the stream, after those before it."""
    df = spark.createDataFrame(rows, MESSAGE).coalesce(1)
    df.write.parquet(f"{path}/tmp-{name}")
    os.makedirs(f"{path}/in", exist_ok=True)
    (part,) = [f for f in os.listdir(f"{path}/tmp-{name}") if f.endswith(".parquet")]
    os.rename(f"{path}/tmp-{name}/{part}", f"{path}/in/{name}.parquet")
    time.sleep(0.02)


def source(spark, path):
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def drain(stream, path, **trigger):
    """What there is now; streams by the clock never run out of batches, so that they take once=True."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()


def feed(spark, path, rows, cuts, again):
    """rows out of order by up to a day, in files; again() runs the query after each group of files and is a restart."""
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: r[2] + dt.timedelta(hours=rng.uniform(0, 20)))
    step = -(-len(rows) // cuts)
    for k in range(cuts):
        write(spark, rows[k * step : (k + 1) * step], path, f"{k:03}")
        if k % 2:
            again()
    last = max(r[2] for r in rows)
    for k in range(2):
        write(spark, [(999 + k, 0, last + dt.timedelta(days=9 + k), "QUEUED")], path, f"{cuts + k:03}")
    again()


@pytest.mark.parametrize("seconds", [3600, 90])
def test_locks_in_batch(spark, seconds):
    rows = history(400, 3)
    table = spark.createDataFrame([*rows, *rows[:20], (None, 1, START, "x"), (7, None, START, "x"), (8, 1, None, "x")], MESSAGE)
    got = {(r["key"], r["id"], r["ts"], r["granted"], r["holder"]) for r in jobs.lock_grants(table, seconds).collect()}
    assert got == plain_locks(rows, seconds)
    assert jobs.lock_grants(table.limit(0), seconds).collect() == []


def test_locks_leave_nothing_but_their_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert jobs.lock_grants(spark.createDataFrame(history(100, 5), MESSAGE)).count() > 0
    assert [n.split("-")[0] for n in scratch.children(spark, str(tmp_path))] == ["grants"]


def test_streams_equal_the_batch_over_restarts(spark, tmp_path):
    rows = history(240, 4)
    table = spark.createDataFrame(rows, MESSAGE)
    for name, run, batch in (("locks", keyed.lock_grants, jobs.lock_grants), ("states", keyed.transitions, jobs.transitions)):
        path = str(tmp_path / name)
        feed(spark, path, rows, 4, lambda: drain(run(source(spark, path), late="2 days"), path))  # noqa: B023
        columns = batch(table).columns
        got = sorted(map(str, spark.read.parquet(f"{path}/out").filter("key < 900").select(*columns).collect()))
        assert got == sorted(map(str, batch(table).collect()))


def test_a_live_lock_expires_by_the_clock(spark, tmp_path):
    path = str(tmp_path)
    for k, (rows, pause) in enumerate([([(1, 1, START, ""), (1, 2, START, ""), (2, 3, START, "")], 0), ([(1, 4, START, "")], 6), ([(1, 5, START, "")], 0)]):
        time.sleep(pause)
        write(spark, rows, path, str(k))
        drain(keyed.live_locks(source(spark, path), 4.0), path, once=True)
    got = {(r["id"], r["granted"], r["holder"]) for r in spark.read.parquet(f"{path}/out").collect()}
    assert {(1, True, 1), (2, False, 1), (3, True, 3), (4, True, 4)} <= got and len(got) == 5


def test_silent_workers(spark, tmp_path):
    path = str(tmp_path)
    beat = lambda key, s: (key, 0, START + dt.timedelta(seconds=s), "")
    write(spark, [beat(1, s) for s in (0, 10, 20, 31)] + [beat(2, 5)], path, "0")
    write(spark, [beat(1, 40), beat(2, 100)], path, "1")
    write(spark, [beat(3, 1000)], path, "2")
    write(spark, [beat(4, 2000)], path, "3")
    drain(keyed.silent(source(spark, path)), path)
    got = {(r["key"], (r["ts"] - START).total_seconds()) for r in spark.read.parquet(f"{path}/out").filter("key < 4").collect()}
    assert got == {(1, 40.0), (2, 5.0), (2, 100.0), (3, 1000.0)}


def test_snapshot_then_live_over_a_restart(spark, tmp_path):
    path = str(tmp_path)
    rows = sorted(history(90, 6), key=lambda r: (r[2], r[1]))
    told, later = rows[:40], rows[25:]  # events 25 to 39 are in the snapshot and come again
    latest = spark.createDataFrame([*told, (50, 7, START, "FUSING")], MESSAGE)
    for k in range(3):
        write(spark, later[k * 22 : (k + 1) * 22], path, str(k))
        if k != 1:
            drain(keyed.snapshot_then_live(source(spark, path), latest), path, once=True)
    got = sorted((r["key"], r["source"] == "live", r["ts"], r["id"], r["stage"]) for r in spark.read.parquet(f"{path}/out").collect())
    want = []
    for key in {r[0] for r in rows} | {50}:
        mine = sorted((r[2], r[1], r[3]) for r in [*told, (50, 7, START, "FUSING")] if r[0] == key)
        if mine:
            want.append((key, False, *mine[-1]))
        best = mine[-1][:2] if mine else (dt.datetime(1970, 1, 1), 0)
        want += [(key, True, *r) for r in sorted({(r[2], r[1], r[3]) for r in later if r[0] == key}) if r[:2] > best]
    assert got == sorted(want)


def test_latest_table_writes_only_what_changed(spark, tmp_path):
    path = str(tmp_path)
    upsert = progress.upsert_latest(path, 8)

    def batch(*rows):
        return spark.createDataFrame(rows, "job_id long, stage string, progress double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")

    def latest():
        return {(r["job_id"], r["stage"]) for r in progress.read_latest(spark, path).collect()}

    assert latest() == set()
    upsert(batch(*[(i, "QUEUED", 0.0, 10) for i in range(40)]), 0)
    upsert(batch((1, "FUSING", 50.0, 20), (2, "FAILED", 1.0, 5)), 1)
    want = {(i, "QUEUED") for i in range(40) if i != 1} | {(1, "FUSING")}
    assert latest() == want
    assert len(scratch.children(spark, f"{path}/data/epoch=1")) <= 3  # two buckets and a mark of success
    upsert(batch((1, "FUSING", 50.0, 20), (2, "FAILED", 1.0, 5)), 1)
    assert latest() == want
    for epoch in range(2, 6):
        upsert(batch(*[(i, "COMPLETED", 100.0, 10 + 10 * epoch) for i in range(40)]), epoch)
    upsert(batch(), 6)
    assert latest() == {(i, "COMPLETED") for i in range(40)}
    assert set(scratch.children(spark, f"{path}/data")) == {"epoch=5"} and scratch.children(spark, f"{path}/_log") == ["5", "6"]


def test_a_cluster_must_name_its_folder(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
