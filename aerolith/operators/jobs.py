"""Exclusive locks with a time to live, and the states of jobs, over whole histories of requests and messages.

The counterparts over streams, with the same rows, are in ``aerolith.streaming.keyed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.scratch import Workspace
from aerolith.streaming.progress import STATES, TERMINAL

#: Fixed value: seconds for which a job stays locked.
LOCK_SECONDS = 3600


def _slots(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def _successors(requests: DataFrame, seconds: int) -> DataFrame:
    """key, at, id, next: the first request of the key at or after the end of the lock that a request would get.

    A slot is as long as a lock, so that the end of one that starts in slot s lies in slot s + 1: the search is a sort
    within (key, slot), and slots without a request there take the head of the next slot that has one.
    """
    micros = seconds * 1_000_000
    me = F.struct("at", "id")
    probes = requests.select("key", (F.col("slot") + 1).alias("slot"), (F.col("at") + micros).alias("order"), F.lit(0).alias("kind"), F.lit(None).cast(requests.schema["id"].dataType).alias("tie"), me.alias("node"))
    real = requests.select("key", "slot", F.col("at").alias("order"), F.lit(1).alias("kind"), F.col("id").alias("tie"), me.alias("node"))
    back = Window.partitionBy("key", "slot").orderBy(F.desc("order"), F.desc("kind"), F.desc("tie")).rowsBetween(Window.unboundedPreceding, 0)
    found = probes.unionByName(real).withColumn("within", F.last(F.when(F.col("kind") == 1, F.col("node")), ignorenulls=True).over(back)).filter("kind = 0")
    heads = requests.groupBy("key", "slot").agg(F.min(me).alias("head"))
    by_key = Window.partitionBy("key").orderBy("slot")
    later = heads.select("key", F.col("slot").alias("from"), F.lead(F.struct("slot", "head"), 1).over(by_key).alias("one"), F.lead(F.struct("slot", "head"), 2).over(by_key).alias("two"))
    found = found.withColumn("from", F.col("slot") - 1).join(later, ["key", "from"])
    beyond = F.when(F.col("one.slot") > F.col("slot"), F.col("one.head")).otherwise(F.col("two.head"))
    return found.select("key", F.col("node.at").alias("at"), F.col("node.id").alias("id"), F.coalesce("within", beyond).alias("next")).filter("next is not null")


def lock_grants(requests: DataFrame, seconds: int = LOCK_SECONDS) -> DataFrame:
    """key, id, ts, granted, holder for each request (key, id, ts) of an exclusive lock: ``holder`` is the request that has the lock then.

    A request is granted if the key has no lock, or one given ``seconds`` ago or more; requests are taken in order of (ts, id).
    Each request's successor is searched once; which are granted follows from the first of each key by pointer
    doubling: after k rounds the first 2^k locks of every key are known, whatever their number of requests.
    Requests equal in key, ts and id are one that was delivered again; without key, ts or id there is none.
    """
    rows = requests.select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), _slots(F.col("ts"), seconds).alias("slot"))
    rows = rows.filter("key is not null and id is not null and at is not null").distinct()
    with Workspace(requests.sparkSession) as w:
        rows = w.cut(rows, "requests")
        jump = w.cut(_successors(rows, seconds), "successors")
        held = w.cut(rows.groupBy("key").agg(F.min(F.struct("at", "id")).alias("node")).select("key", "node.at", "node.id"), "locks")
        while True:
            step = held.join(jump, ["key", "at", "id"]).select("key", F.col("next.at").alias("at"), F.col("next.id").alias("id"))
            step = w.cut(step, "step")
            if step.isEmpty():
                break
            held = w.cut(held.unionByName(step), "locks")
            second = jump.select("key", F.col("at").alias("mid_at"), F.col("id").alias("mid_id"), F.col("next").alias("far"))
            jump = jump.select("key", "at", "id", F.col("next.at").alias("mid_at"), F.col("next.id").alias("mid_id")).join(second, ["key", "mid_at", "mid_id"])
            jump = w.cut(jump.select("key", "at", "id", F.col("far").alias("next")), "successors")
        granted = rows.join(held.withColumn("granted", F.lit(True)), ["key", "at", "id"], "left")
        mine = F.when(F.col("granted"), F.struct("at", "id"))
        run = Window.partitionBy("key", "slot").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
        granted = granted.withColumn("here", F.last(mine, ignorenulls=True).over(run))
        before = held.select("key", (_slots(F.timestamp_micros("at"), seconds) + 1).alias("slot"), F.col("id").alias("before"))  # a slot holds one lock at most
        out = granted.join(before, ["key", "slot"], "left")
        out = out.select("key", "id", F.timestamp_micros("at").cast(requests.schema["ts"].dataType).alias("ts"), F.coalesce("granted", F.lit(False)).alias("granted"), F.coalesce("here.id", "before").alias("holder"))
        return w.keep(out, "grants")


def transitions(messages: DataFrame, slot: int = 86_400) -> DataFrame:
    """key, id, ts, stage, before, after, accepted, reason for each message (key, id, ts, stage) to a job.

    Messages are taken in order of (ts, id). A job starts QUEUED, only goes forward, and ends with the first of the last three states; FAILED and CANCELLED come from any state.
    ``reason`` tells why a message was refused: ``duplicate`` (its id was seen before), ``unknown``, ``ended`` or ``backward``. Refusals
    change nothing. The furthest state before a message is a running maximum within slots of time and over slots, so that a busy
    job is sorted in parts.
    """
    names = F.array(*[F.lit(s) for s in STATES])
    place = F.array_position(names, F.col("stage")) - 1
    rows = messages.select("key", "id", "ts", "stage").filter("key is not null and id is not null and ts is not null")
    nth = F.row_number().over(Window.partitionBy("key", "id").orderBy("ts", "stage"))
    rows = rows.withColumn("again", nth > 1).withColumn("place", F.coalesce(place, F.lit(-1))).withColumn("slot", _slots(F.col("ts"), slot))
    counts = ~F.col("again") & (F.col("place") >= 0)
    ends = F.col("stage").isin(*TERMINAL)
    end = rows.filter(counts & ends).groupBy("key").agg(F.min(F.struct("ts", "id", "stage")).alias("end"))
    going = F.when(counts & ~ends, F.col("place"))
    run = Window.partitionBy("key", "slot").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("key", "slot").agg(F.max(going).alias("most")).withColumn("most", F.max("most").over(over))
    rows = rows.withColumn("here", F.max(going).over(run)).join(slots, ["key", "slot"]).join(end, "key", "left")
    rows = rows.withColumn("furthest", F.greatest(F.coalesce("here", F.lit(0)), F.coalesce("most", F.lit(0))))
    ended = F.col("end").isNotNull() & (F.struct("end.ts", "end.id") < F.struct("ts", "id"))
    before = F.when(ended, F.col("end.stage")).otherwise(F.element_at(names, (F.col("furthest") + 1).cast("int")))
    reason = F.when(F.col("again"), "duplicate").when(F.col("place") < 0, "unknown").when(ended, "ended").when(~ends & (F.col("place") < F.col("furthest")), "backward")
    rows = rows.withColumn("before", before).withColumn("reason", reason)
    return rows.select("key", "id", "ts", "stage", "before", F.when(F.col("reason").isNull(), F.col("stage")).otherwise(F.col("before")).alias("after"), F.col("reason").isNull().alias("accepted"), "reason")
