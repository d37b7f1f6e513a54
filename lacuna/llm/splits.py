"""Problem 4: splits that keep related records together.

Relations are edges between names.  Components come from local union-find
forests that are merged hierarchically: each task folds its edges to a forest,
nodes that got different roots in different tasks become the (far fewer) edges
of the next level, which needs fewer tasks, until one forest is left.  Roots are
the least by a hash that changes with the level, so no order of the names can make
the levels many, and a node's edges to all lesser neighbours meet in one task, so
that few nodes stay roots: chains and sparse random graphs over a hundred tasks
halve with every level (measured in the tests).  Nodes with more edges than a
quarter of a task are spread over several.

Groups are then given to the splits largest first, each to the split furthest
below its target.  Groups of one size are alike, so only the counts of each size
go to the driver (at most the square root of twice the number of records), and
the groups of one size are dealt out by their place in a distributed order.

Defined results: missing names relate nothing; a record without relations is its
own group; an empty table has no groups; repeated rows change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lacuna.operators.ranks import running
from lacuna.session import cut

TASK_EDGES = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one task; the node of least order becomes the root."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    edges = pd.concat(parts, ignore_index=True)
    codes, names = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
    order = np.empty(len(names), dtype=np.int64)
    order[codes] = np.concatenate([edges["ha"].to_numpy(), edges["hb"].to_numpy()])
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(edges)
    for x, y in zip(codes[:half].tolist(), codes[half:].tolist()):
        x, y = root(x), root(y)
        if x != y:
            if (order[x], names[x]) < (order[y], names[y]):
                parent[y] = x
            else:
                parent[x] = y
    roots = np.fromiter((root(x) for x in range(len(names))), dtype=np.int64, count=len(names))
    yield pd.DataFrame({"node": names, "root": names[roots], "root_order": order[roots]})


def _dealt(edges: DataFrame, tasks: int, task_edges: int, level: int) -> DataFrame:
    """Edges (a, b, ha, hb) with the end of greater order first, those of one first end in one task."""
    h = lambda c: F.xxhash64(c, F.lit(level))
    greater = F.struct(h("a"), "a") > F.struct(h("b"), "b")
    ends = edges.select(F.when(greater, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(greater, F.col("b")).otherwise(F.col("a")).alias("b"))
    ends = ends.select("a", "b", h("a").alias("ha"), h("b").alias("hb"))
    if tasks == 1:
        return ends.coalesce(1)
    most = max(1, task_edges // 4)
    hubs = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).alias("_parts"))
    dealt = ends.join(F.broadcast(hubs), "a", "left")  # at most four hubs a task
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("b", F.lit(level), F.lit(1)), F.coalesce("_parts", F.lit(1))))
    return dealt.repartition(tasks, "a", "_part").select("a", "b", "ha", "hb")


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES, sizes: list[int] | None = None) -> DataFrame:
    """node, root for every node of the edges (a, b); equal roots mean one component.  ``sizes`` receives the edges of each level."""
    level, labels = 0, None
    level_edges = cut(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    empty = level_edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        n = level_edges.count()
        if sizes is not None:
            sizes.append(n)
        if n == 0:
            return empty if labels is None else labels
        tasks = math.ceil(n / task_edges)
        forest = cut(_dealt(level_edges, tasks, task_edges, level).mapInPandas(_forest, "node string, root string, root_order long"))
        best = forest.groupBy("node").agg(F.min(F.struct("root_order", "root"))["root"].alias("root"))
        labels = best if labels is None else _follow(labels, best)
        if tasks == 1:
            return cut(labels)
        labels = cut(labels)
        chosen = best.withColumnRenamed("root", "kept")
        level_edges = cut(forest.join(chosen, "node").where(F.col("root") != F.col("kept")).select(F.col("root").alias("a"), F.col("kept").alias("b")).distinct())
        level += 1


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    step = step.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return labels.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def related_groups(members: DataFrame, names: DataFrame) -> DataFrame:
    """member, group_root for ``members(member)``, related through any chain of shared ``names(member, name)``.

    Only one edge per distinct pair of names that meet in a member is built, so
    a name with a third of all members adds few edges.
    """
    pairs = names.where(F.col("member").isNotNull() & F.col("name").isNotNull()).select("member", "name").distinct()
    anchors = pairs.groupBy("member").agg(F.min("name").alias("anchor"))
    edges = pairs.join(anchors, "member").where(F.col("name") != F.col("anchor")).select(F.col("name").alias("a"), F.col("anchor").alias("b"))
    roots = connected_components(edges).select(F.col("node").alias("anchor"), "root")
    placed = anchors.join(roots, "anchor", "left").select("member", F.concat(F.lit("n:"), F.coalesce("root", "anchor")).alias("group_root"))
    return members.join(placed, "member", "left").withColumn("group_root", F.coalesce("group_root", F.concat(F.lit("m:"), F.col("member"))))


def deal_equal_groups(count: int, size: int, deficits: list[float]) -> list[int]:
    """How many of ``count`` groups of one size each split gets when every group goes to the split furthest below its target.

    The choices are the ``count`` largest of the values deficit - j*size over all
    splits and j = 0, 1, ..., ties to the earlier split.
    """
    low, high = min(deficits) - size * (count + 1.0), max(deficits) + 1.0
    taken = lambda level: [min(count, max(0, math.floor((d - level) / size) + 1)) if d >= level else 0 for d in deficits]
    for _ in range(200):
        middle = (low + high) / 2
        if sum(taken(middle)) >= count:
            low = middle
        else:
            high = middle
        if high - low <= size * 1e-9:
            break
    got = taken(high)
    while sum(got) < count:  # ties at the level, and the last few
        k = max(range(len(deficits)), key=lambda i: (deficits[i] - got[i] * size, -i))
        got[k] += 1
    while sum(got) > count:
        k = min((i for i in range(len(deficits)) if got[i]), key=lambda i: (deficits[i] - (got[i] - 1) * size, -i))
        got[k] -= 1
    return got


def assign_splits(groups: DataFrame, shares: Mapping[str, float], seed: int = 0) -> DataFrame:
    """Adds ``split`` to ``groups(group_id, size)``."""
    names = list(shares)
    total_share = sum(shares.values())
    sizes = groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.col("size").desc()).collect()
    total = sum(r["size"] * r["groups"] for r in sizes)
    deficits = [shares[n] / total_share * total for n in names]
    plan = []
    for r in sizes:
        got = deal_equal_groups(r["groups"], r["size"], deficits)
        edge = 0
        for k, g in enumerate(got):
            deficits[k] -= g * r["size"]
            if g:
                plan.append((r["size"], edge, edge + g, names[k]))
                edge += g
    spark = groups.sparkSession
    table = spark.createDataFrame(plan, "size long, first long, stop long, split string")
    # the largest groups first; groups of one size in the order of a hash
    placed = running(groups.withColumn("_h", F.xxhash64("group_id", F.lit(seed))), ["size"], "_h", ["group_id"], out="_place")
    inside = (F.col("_place") > F.col("first")) & (F.col("_place") <= F.col("stop"))
    return placed.join(table, "size").where(inside).select("group_id", "size", "split")
