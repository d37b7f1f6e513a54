"""Costs of probe sets from measured receipts.

Facts are rows (evaluation_id, phase, resource, kind additive|capacity, status
known|unknown|not_applicable, value, unit, group, completed).  An unknown cost is
never zero; a cost that does not apply is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def select_receipts(receipts: DataFrame, phases: Sequence[str]) -> DataFrame:
    """evaluation_id, outcome: ok where every phase has exactly one completed receipt, else missing or ambiguous."""
    done = receipts.where(F.col("completed") & F.col("phase").isin(list(phases))).groupBy("evaluation_id", "phase").count()
    per = done.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("k"), F.max("count").alias("most"))
    everyone = receipts.select("evaluation_id").distinct()
    outcome = F.when(F.coalesce("k", F.lit(0)) < len(phases), "missing").when(F.col("most") > 1, "ambiguous").otherwise("ok")
    return everyone.join(per, "evaluation_id", "left").select("evaluation_id", outcome.alias("outcome"))


def set_costs(sets: DataFrame, facts: DataFrame) -> DataFrame:
    """set_id, resource, cost, unknown: additive resources sum (shared setup groups once), capacities take the largest."""
    joined = sets.join(facts, "evaluation_id")
    shared = F.coalesce(F.col("group"), F.concat(F.col("evaluation_id"), F.lit("/"), F.col("phase")))
    worth = F.when(F.col("status") == "not_applicable", 0.0).when(F.col("status") == "known", F.col("value"))
    once = joined.groupBy("set_id", "resource", "kind", shared.alias("_g")).agg(F.max(worth).alias("v"), F.max((F.col("status") == "unknown").cast("int")).alias("u"), F.countDistinct(worth).alias("d"))
    cost = F.when(F.max("kind") == "capacity", F.max("v")).otherwise(F.sum("v"))
    return once.groupBy("set_id", "resource").agg(cost.alias("cost"), (F.max("u") == 1).alias("unknown"), (F.max("d") > 1).alias("conflict"))


def feasible_sets(costs: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """set_id, pressure, reason (null where feasible): pressure is the sum of cost over limit; over a limit of 0 it is infinite."""
    spark = costs.sparkSession
    table = spark.createDataFrame(list(limits.items()), "resource string, limit double")
    j = costs.join(F.broadcast(table), "resource")  # one row per limited resource
    part = F.when(F.col("limit") > 0, F.col("cost") / F.nullif("limit", F.lit(0.0))).when(F.col("cost") > 0, float("inf")).otherwise(0.0)
    reason = F.when(F.col("unknown"), "unknown").when(F.col("conflict"), "conflict").when(F.col("cost") > F.col("limit"), "over")
    out = j.groupBy("set_id").agg(F.sum(part).alias("pressure"), F.array_sort(F.collect_set(F.concat(reason, F.lit(":"), F.col("resource")))).alias("why"), F.count(F.lit(1)).alias("k"))
    return out.select("set_id", "pressure", F.when(F.col("k") < len(limits), "missing").when(F.size("why") > 0, F.array_join("why", ";")).alias("reason"))
