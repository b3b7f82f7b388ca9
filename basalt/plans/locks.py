"""Conflicts between lock requests that a table holds, as joins. Tables are immutable versions, so the engine itself locks nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The modes that conflict with each.
CONFLICTS = {
    "S": ("X", "IX"),
    "X": ("S", "X", "IS", "IX"),
    "IS": ("X",),
    "IX": ("S", "X"),
}


def conflict_matrix(spark: SparkSession) -> DataFrame:
    """held, asked, conflict: a row for each pair of modes."""
    return spark.createDataFrame([(a, b, b in CONFLICTS[a]) for a in CONFLICTS for b in CONFLICTS], "held string, asked string, conflict boolean")


def waits_for(requests: DataFrame, resource: str, holder: str, mode: str, order: str) -> DataFrame:
    """resource, waiter, blocker, requests: which holders' requests stand behind conflicting earlier ones of others on the same resource.

    A resource's requests are summed up by (holder, mode) first, to their earliest and latest place, so a resource that most requests name is
    at most one row for each of its holders and modes; what a waiter asks after a blocker's earliest conflicting request waits.
    """
    asked = requests.select(F.col(resource).alias("resource"), F.col(holder).alias("who"), F.col(mode).alias("mode"), F.col(order).alias("at")).dropna()
    asked = asked.groupBy("resource", "who", "mode").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    against = F.create_map(*[x for m, others in CONFLICTS.items() for x in (F.lit(m), F.array(*[F.lit(o) for o in others]))])
    earlier = asked.select("resource", F.col("who").alias("blocker"), "first", F.explode(against[F.col("mode")]).alias("mode"))
    earlier = earlier.groupBy("resource", "blocker", "mode").agg(F.min("first").alias("first"))
    later = asked.select("resource", F.col("who").alias("waiter"), "mode", "last")
    met = later.join(earlier, ["resource", "mode"]).where((F.col("waiter") != F.col("blocker")) & (F.col("last") > F.col("first")))
    return met.groupBy("resource", "waiter", "blocker").agg(F.count(F.lit(1)).alias("modes"))
