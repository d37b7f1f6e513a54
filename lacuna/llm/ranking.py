"""Problem 6: one ranking from several scores on unlike scales.

Every column is replaced by its average rank among the proper values (numbers
within the column's bounds), scaled to 0..1 and turned so that more is better.
Rank columns have the same distribution whatever the scale, so no range
dominates.  Their correlation matrix (pairs of present values) is one distributed
aggregate; its first principal component gives the loadings.  The component is
oriented as a whole to the declared directions; a column that runs against its
declared direction even then says nothing reliable, has loading 0 and is named in
the report of loadings.  Items are sorted by the projection.

A missing score counts as the middle rank, so it moves an item neither way; an
item without any score has no projection and the last rank.  Constant columns
have loading 0.  Equal projections share a rank.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lacuna.functions.columns import correlation
from lacuna.operators.ranks import counts_below, value_counts_below
from lacuna.session import cut


def rank_columns(scores: DataFrame, identity: str, columns: Sequence[dict]) -> DataFrame:
    """identity and one column per score in 0..1 (null where missing); ``columns``: name, higher_is_better, lowest, highest."""
    if not columns:
        return scores.select(identity).distinct()
    long = scores.select(
        identity,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c["name"]).alias("col"),
                        F.when(~F.isnan(c["name"]) & F.col(c["name"]).between(c["lowest"], c["highest"]), F.col(c["name"]) + F.lit(0.0)).alias("value"),
                    )
                    for c in columns
                ]
            )
        ).alias("s"),
    ).select(identity, "s.col", "s.value")
    ranks = value_counts_below(long, "col", "value").select("col", "value", ((F.col("below") + F.col("n") / 2.0) / F.col("total")).alias("u"))
    # cut, so that both sides of the join are plain shuffles and a value that many rows share can be split
    placed = long.where(F.col("value").isNotNull()).join(cut(ranks), ["col", "value"])
    turned = [F.max(F.when(F.col("col") == c["name"], F.col("u") if c["higher_is_better"] else 1.0 - F.col("u"))).alias(c["name"]) for c in columns]
    return placed.groupBy(identity).agg(*turned)


def first_component(ranked: DataFrame, names: Sequence[str]) -> dict:
    """Mean, spread and loading of each rank column; one aggregate over all rows, an eigenvector of a small matrix."""
    if not names:
        return {}
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    row = ranked.agg(
        *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)],
        *[correlation(names[i], names[j]).alias(f"r{i}_{j}") for i, j in pairs],
    ).first()
    k = len(names)
    usable = [row[f"s{i}"] is not None and row[f"s{i}"] > 0 for i in range(k)]
    matrix = np.diag([1.0 if u else 0.0 for u in usable])
    for i, j in pairs:
        r = row[f"r{i}_{j}"]
        if usable[i] and usable[j] and r is not None and r == r:
            matrix[i, j] = matrix[j, i] = r
    values, vectors = np.linalg.eigh(matrix)
    raw = vectors[:, -1] * np.array(usable)
    raw = raw if raw.sum() >= 0 else -raw  # columns are turned already: more is better, so most signs must be plus
    return {
        n: {"mean": float(row[f"m{i}"] if usable[i] else 0.0), "spread": float(row[f"s{i}"] if usable[i] else 1.0), "loading": float(max(0.0, raw[i])), "component": float(raw[i]), "share": float(values[-1] / max(1, sum(usable)))}
        for i, n in enumerate(names)
    }


def loadings(scores: DataFrame, identity: str, columns: Sequence[dict]) -> DataFrame:
    """column_name, component (oriented as a whole), loading (0 where it runs against the declared direction), against, share of the variance."""
    model = first_component(cut(rank_columns(scores, identity, columns)), [c["name"] for c in columns])
    rows = [(n, round(m["component"], 9), round(m["loading"], 9), m["component"] < 0, round(m["share"], 9)) for n, m in model.items()]
    return scores.sparkSession.createDataFrame(rows, "column_name string, component double, loading double, against boolean, share double")


def rank_items(items: DataFrame, scores: DataFrame, identity: str, columns: Sequence[dict]) -> DataFrame:
    """identity, n_scores, projection, place (1 is best) of every item."""
    names = [c["name"] for c in columns]
    ranked = cut(rank_columns(scores, identity, columns))  # read by the matrix and by the projection
    model = first_component(ranked, names)
    projection = sum((F.coalesce((F.col(n) - m["mean"]) / m["spread"], F.lit(0.0)) * m["loading"] for n, m in model.items()), F.lit(0.0))
    present = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    scored = ranked.select(identity, F.round(projection, 9).alias("projection"), present.cast("long").alias("n_scores"))
    out = cut(items.join(scored, identity, "left").withColumn("n_scores", F.coalesce("n_scores", F.lit(0))))
    counts = counts_below(out, "projection").withColumn("place", F.col("total") - F.col("below") - F.col("n") + 1)
    last = out.where(F.col("projection").isNotNull()).count() + 1
    placed = out.join(counts.select("projection", "place"), "projection", "left")
    return placed.withColumn("place", F.coalesce("place", F.lit(last).cast("long"))).select(identity, "n_scores", "projection", "place")
