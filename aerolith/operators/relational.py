"""Queries and changes of the control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions import rules


def page(rows: DataFrame, text: str | None, columns: list[str], order: str, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page, newest first, of the rows with the text in one of the columns, whatever its case. The key breaks ties."""
    if text:
        match = F.lit(False)
        for c in columns:
            match = match | F.contains(F.lower(c), F.lit(text.lower()))
        rows = rows.filter(match)
    return rows.orderBy(F.desc(order), key).offset(offset).limit(limit)


def project_detail(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Projects with their number of jobs and failures and the mean confidence (null without jobs)."""
    counts = jobs.groupBy("project_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.avg("confidence").alias("mean_confidence"))
    rows = projects.join(counts, projects["id"] == counts["project_id"], "left").drop("project_id")
    return rows.withColumns({"jobs": F.coalesce("jobs", F.lit(0)), "failed": F.coalesce("failed", F.lit(0))})


def accessible(flights: DataFrame, projects: DataFrame, orgs: DataFrame, role: str) -> DataFrame:
    """Flights of the organisations for which the role of the row suffices."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in rules.ROLE_RANK.items() for x in kv]), F.col("role"))
    return flights.filter(rank >= rules.ROLE_RANK[role]).join(projects, "project_id").join(orgs, "org_id").select("flight_id", "project_id", "org_id")


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key; a partial aggregate, so that a busy key isn't gathered in one task."""
    rest = [c for c in events.columns if c != key and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("__top")
    return events.groupBy(key).agg(top).select(key, *[F.col(f"__top.{c}").alias(c) for c in events.columns if c != key])


def active(beats: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """Keys whose last beat is within ttl of the last beat of all."""
    seen = beats.groupBy(key).agg(F.max(ts).alias("seen"))
    now = seen.agg(F.max("seen").alias("__now"))
    return seen.crossJoin(F.broadcast(now)).filter(F.col("seen") > F.col("__now") - F.expr(f"interval {ttl}")).drop("__now")  # one row


def update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the fields of changes where these aren't null."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    merged = rows.join(new, key, "left")
    return merged.select(*[F.coalesce(f"__{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in rows.columns])


def delete_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """What is left of children when these parents are deleted."""
    return children.join(parents.select(key).distinct(), key, "left_anti")
