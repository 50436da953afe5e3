"""Audit chains, field diffs, artifact history and lineage."""

from __future__ import annotations

import itertools

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions.scalar import flatten_json
from premia.session import BROADCAST_ROWS, cut_lineage

GENESIS = "0" * 64


def core_json(columns: Sequence[str]) -> Column:
    """An event's content as text with its fields in a fixed order."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def event_hash(columns: Sequence[str], previous: str = "prev_hash") -> Column:
    return F.sha2(F.concat(F.col(previous), core_json(columns)), 256)


def verify_chain(
    events: DataFrame, columns: Sequence[str], *, workspace: str = "workspace", first: int = 1, last: int | None = None
) -> DataFrame:
    """Broken events of a hash chain: (workspace, sequence, problem).

    `events` has workspace, sequence, prev_hash, event_hash and the content columns. Each event is
    joined to its predecessor by (workspace, sequence - 1), a unique key, so one long chain spreads
    over all tasks. A span starts at `first`, whose predecessor is still looked up.
    """
    span = events.where(F.col("sequence") >= first)
    if last is not None:
        span = span.where(F.col("sequence") <= last)
    before = events.select(workspace, (F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("__before"))
    joined = span.join(before, [workspace, "sequence"], "left")
    expected = F.when(F.col("sequence") == 1, F.lit(GENESIS)).otherwise(F.col("__before"))
    problem = (
        F.when(expected.isNull(), "sequence gap")
        .when(F.col("prev_hash") != expected, "previous hash does not match")
        .when(F.col("event_hash") != event_hash(columns), "content does not match its hash")
    )
    return joined.select(workspace, "sequence", problem.alias("problem")).where("problem is not null")


def chain_summary(events: DataFrame, broken: DataFrame, workspace: str = "workspace") -> DataFrame:
    """Per workspace: events checked and the first break, if any."""
    counts = events.groupBy(workspace).agg(F.count(F.lit(1)).alias("n_events"))
    first = broken.groupBy(workspace).agg(F.min(F.struct("sequence", "problem")).alias("b"), F.count(F.lit(1)).alias("n_broken"))
    return counts.join(first, workspace, "left").select(
        workspace, "n_events", F.coalesce("n_broken", F.lit(0)).alias("n_broken"), F.col("b.sequence").alias("first_break"), F.col("b.problem").alias("problem")
    )


def field_diff(df: DataFrame, before: str, after: str, *, depth: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """Fields that differ between two JSON texts of a row: (keep, path, before, after).

    A field on one side only reads as null on the other.
    """
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(flatten_json(before, depth), empty), F.coalesce(flatten_json(after, depth), empty)
    rows = df.select(*keep, a.alias("__a"), b.alias("__b"))
    paths = F.explode(F.array_union(F.map_keys("__a"), F.map_keys("__b"))).alias("path")
    long = rows.select(*keep, "__a", "__b", paths).select(
        *keep, "path", F.try_element_at("__a", F.col("path")).alias("before"), F.try_element_at("__b", F.col("path")).alias("after")
    )
    return long.where(~F.col("before").eqNullSafe(F.col("after")))


def history(events: DataFrame, entity: str, *, column: str = "entity_ref", order: str = "sequence") -> DataFrame:
    """The events of one entity in order."""
    return events.where(F.col(column) == entity).orderBy(order)


def _side(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join, broadcast if it has few rows and dealt out by key otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def lineage(edges: DataFrame, start: Sequence, *, up: bool = True, parent: str = "parent", child: str = "child") -> DataFrame:
    """Ancestors (or descendants) of some versions with their distance: (node, distance).

    Breadth first until no new node is found: each round joins the edges with the newest nodes only. Nodes are broadcast
    while they are few; more than that never pass through the driver.
    """
    a, b = (child, parent) if up else (parent, child)
    steps = edges.select(F.col(a).alias("at"), F.col(b).alias("to")).where("to is not null")
    kind = steps.schema["at"].dataType
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in start], f"node {kind.simpleString()}, distance int")
    frontier = seen
    newest = total = len(start)
    for depth in itertools.count(1):
        found = steps.join(_side(frontier, newest), steps["at"] == frontier["node"]).select(F.col("to").alias("node")).distinct()
        fresh = cut_lineage(found.join(_side(seen, total), "node", "left_anti").withColumn("distance", F.lit(depth)))
        newest = fresh.count()
        if not newest:
            break
        total += newest
        seen = seen.unionAll(fresh)
        frontier = fresh
    return seen.where("distance > 0")


def usage_counts(references: DataFrame, artifact: str, user: str) -> DataFrame:
    """How many distinct users reference each artifact."""
    return references.groupBy(artifact).agg(F.count_distinct(user).alias("referenced_by"))
