"""Order statistics, errors, baselines, calibration and rankings over long tables.

Medians of others, average ranks and finite-sample quantiles come from counts of
equal values, so no window ever holds one evaluation's rows.

Functions that join such counts back by value (average ranks, leave-one-out
medians, global places) need values that come out equal when computed twice:
stored columns, rounded ones, or a frame that was cut.  Sums of floating-point
numbers in shuffled order are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.functions.columns import correlation
from lacuna.operators.ranks import counts_below, value_counts_below
from lacuna.session import cut

APE_FLOOR, NOISE_FLOOR, MAD_SCALE = 1e-6, 0.5, 1.4826


def error_columns(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """n, mae, medae, medape and the shares within 1, 3, 5 and 10 points."""
    err = F.abs(F.col(predicted) - F.col(actual))
    ape = F.when(F.abs(F.col(actual)) > APE_FLOOR, 100.0 * err / F.abs(F.col(actual)))
    return [
        F.count(err).alias("n"),
        F.round(F.avg(err), 6).alias("mae"),
        F.round(F.median(err), 6).alias("medae"),
        F.round(F.median(ape), 6).alias("medape"),
        *[F.round(F.avg((err <= k).cast("double")), 6).alias(f"within_{k}") for k in (1, 3, 5, 10)],
    ]


def average_ranks(rows: DataFrame, group: str, value: str, out: str = "avg_rank") -> DataFrame:
    """Adds the mean rank of ties within the group."""
    counts = value_counts_below(rows, group, value).select(group, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    return rows.join(counts, [group, value])


def order_statistics(rows: DataFrame, group: str, value: str, places: Column) -> DataFrame:
    """group, total and ``xs``: the values at ``places`` (an array of 1-based places computed from ``total``)."""
    counts = value_counts_below(rows, group, value).withColumn("_place", F.explode(places))
    hit = (F.col("_place") > F.col("below")) & (F.col("_place") <= F.col("below") + F.col("n"))
    picked = counts.where(hit).groupBy(group).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_set(F.struct("_place", value))).alias("xs"))
    return picked


def leave_one_out_median(rows: DataFrame, group: str, value: str, out: str = "loo_median") -> DataFrame:
    """Adds the median of the other rows of the group; null where the row is alone."""
    n = F.col("total")
    half = F.floor((n + 1) / 2).cast("long")
    places = F.array_distinct(F.filter(F.array(half - 1, half, half + 1), lambda p: (p >= 1) & (p <= n)))
    middle = order_statistics(rows, group, value, places).select(F.col(group).alias("_g"), F.col("total").alias("_n"), F.col("xs").alias("_xs"))
    joined = rows.join(middle, F.col(group) == F.col("_g"))
    h = F.floor((F.col("_n") + 1) / 2).cast("long")
    at = lambda p: F.try_element_at("_xs", p)
    even = F.when(F.col(value) <= at(h), at(h + 1)).otherwise(at(h))
    odd = F.when(F.col(value) < at(h), (at(h) + at(h + 1)) / 2.0).when(F.col(value) > at(h), (at(h - 1) + at(h)) / 2.0).otherwise((at(h - 1) + at(h + 1)) / 2.0)
    return joined.withColumn(out, F.when(F.col("_n") < 2, None).when(F.col("_n") % 2 == 0, even).otherwise(odd)).drop("_g", "_n", "_xs")


def linear_quantiles(rows: DataFrame, group: str | None, value: str, levels: Sequence[float], out: str = "qs") -> DataFrame:
    """group, total and ``out``: exact quantiles with linear interpolation; no task holds a group's values.

    ``value`` must come out equal when computed twice, as for all functions here that join counts back.
    """
    n = F.col("total")
    spots = [(n - 1) * F.lit(p) + 1 for p in levels]
    low = [F.floor(x).cast("long") for x in spots]
    places = F.array_distinct(F.concat(F.array(*low), F.array(*[F.least(x + 1, n) for x in low])))
    if group is None:
        counts = counts_below(rows, value).withColumn("_place", F.explode(places))
        hit = (F.col("_place") > F.col("below")) & (F.col("_place") <= F.col("below") + F.col("n"))
        picked = counts.where(hit).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_set(F.struct("_place", value))).alias("xs"))
    else:
        picked = order_statistics(rows, group, value, places)
    at = lambda p: F.try_element_at("xs", p)
    qs = [at(a) + (x - a) * (at(F.least(a + 1, n)) - at(a)) for a, x in zip(low, spots)]
    return picked.select(*([group] if group else []), "total", F.array(*qs).alias(out))


def mad(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, dispersion = 1.4826 x median absolute deviation; null below two rows."""
    centre = linear_quantiles(rows, group, value, [0.5]).select(group, F.col("qs")[0].alias("_m"))
    gaps = cut(rows.join(centre, group).select(group, F.abs(F.col(value) - F.col("_m")).alias("_gap")))
    spread = linear_quantiles(gaps, group, "_gap", [0.5]).select(group, F.col("total").alias("n"), (MAD_SCALE * F.col("qs")[0]).alias("dispersion"))
    return spread.withColumn("dispersion", F.when(F.col("n") >= 2, F.col("dispersion")))


def leave_one_out_mad(rows: DataFrame, group: str, value: str, out: str = "loo_mad") -> DataFrame:
    """Adds 1.4826 x the median absolute deviation of the other rows of the group; null where fewer than two others are.

    The medians of others take at most three values in a group, so every row is measured from three centres at most.
    """
    own = cut(leave_one_out_median(rows, group, value, "_centre").where(F.col("_centre").isNotNull()))
    centres = own.select(F.col(group).alias("_cg"), F.col("_centre").alias("_c")).distinct()
    gaps = own.join(centres, F.col(group) == F.col("_cg")).withColumn("_gap", F.abs(F.col(value) - F.col("_c"))).withColumn("_key", F.concat_ws("\u0001", "_cg", F.col("_c").cast("string")))
    gaps = cut(gaps)
    sizes = rows.groupBy(F.col(group).alias("_s")).agg(F.count(value).alias("_k"))
    found = leave_one_out_median(gaps, "_key", "_gap", "_dd").where(F.col("_c") == F.col("_centre")).join(sizes, F.col(group) == F.col("_s"))
    return found.withColumn(out, F.when(F.col("_k") >= 3, MAD_SCALE * F.col("_dd"))).drop("_centre", "_cg", "_c", "_gap", "_key", "_dd", "_s", "_k")


def error_summary(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``error_columns`` of a whole table, the medians from distributed order statistics."""
    err = F.abs(F.col(predicted) - F.col(actual))
    e = cut(rows.select(err.alias("e"), F.when(F.abs(F.col(actual)) > APE_FLOOR, 100.0 * err / F.abs(F.col(actual))).alias("p")))
    whole = e.agg(F.count("e").alias("n"), F.round(F.avg("e"), 6).alias("mae"), *[F.round(F.avg((F.col("e") <= k).cast("double")), 6).alias(f"within_{k}") for k in (1, 3, 5, 10)])
    medae = linear_quantiles(e, None, "e", [0.5]).select(F.round(F.col("qs")[0], 6).alias("medae"))
    medape = linear_quantiles(e, None, "p", [0.5]).select(F.round(F.col("qs")[0], 6).alias("medape"))
    out = whole.crossJoin(F.broadcast(medae)).crossJoin(F.broadcast(medape))  # one row each
    return out.select("n", "mae", "medae", "medape", *[f"within_{k}" for k in (1, 3, 5, 10)])


def finite_sample_quantile(rows: DataFrame, group: str, value: str, level: float) -> DataFrame:
    """group, q: the value at place min(n, ceil((n + 1) level))."""
    place = F.least(F.col("total"), F.ceil((F.col("total") + 1) * F.lit(level)).cast("long"))
    out = order_statistics(rows, group, value, F.array(place))
    return out.select(group, F.col("total").alias("n"), F.try_element_at(F.map_values("xs"), F.lit(1)).alias("q"))


def column_skill(model_error: Column, baseline: Column) -> tuple[Column, Column]:
    """Skill 1 - error/baseline in -1..1, and the reason of exclusion (first that holds)."""
    reason = F.when(model_error.isNull(), "no_model_error").when(baseline.isNull() | (baseline <= 0), "degenerate_baseline").when(baseline < NOISE_FLOOR, "noise_floor")
    skill = F.when(reason.isNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - model_error / baseline)))
    return skill, reason


def global_place(rows: DataFrame, value: str, ties: Sequence[str], out: str = "place") -> DataFrame:
    """Adds the 1-based place of each row by value, then ties, and ``total``; only equal values share a window."""
    counts = counts_below(rows, value).select(F.col(value).alias("_v"), "below", "total")
    among = Window.partitionBy(value).orderBy(*ties)
    joined = rows.withColumn("_among", F.row_number().over(among)).join(counts, F.col(value) == F.col("_v"))
    return joined.withColumn(out, (F.col("below") + F.col("_among")).cast("long")).drop("_v", "below", "_among")


def group_place(rows: DataFrame, group: str, value: str, ties: Sequence[str], out: str = "place") -> DataFrame:
    """Adds the 1-based place of each row within its group by value, then ties; only equal values of a group share a window."""
    counts = value_counts_below(rows, group, value).select(F.col(group).alias("_g"), F.col(value).alias("_v"), "below")
    among = F.row_number().over(Window.partitionBy(group, value).orderBy(*ties))
    joined = rows.withColumn("_among", among).join(counts, (F.col(group) == F.col("_g")) & (F.col(value) == F.col("_v")))
    return joined.withColumn(out, (F.col("below") + F.col("_among")).cast("long")).drop("_g", "_v", "below", "_among")


def spaced(rows: DataFrame, group: str, value: str, identity: str, gap: float, out: str = "place") -> DataFrame:
    """Adds the value pushed up so that neighbours in the order of values are at least ``gap`` apart.

    A row is pushed by the furthest reaching row before it: the greatest of value - gap x rank so far, plus gap x rank.
    """
    order = Window.partitionBy(group).orderBy(value, identity)  # labels of one picture
    ranked = rows.withColumn("_i", F.row_number().over(order))
    reach = F.max(F.col(value) - gap * F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(out, reach + gap * F.col("_i")).drop("_i")


def equal_count_bin(place: Column, total: Column, bins: int) -> Column:
    """Bin of a place when ``total`` rows are cut into bins of which the first ``total mod bins`` get one more."""
    small = F.floor(total / bins).cast("long")
    extra = total % bins
    edge = extra * (small + 1)
    return F.when(place <= edge, F.floor((place - 1) / (small + 1)) + 1).otherwise(extra + F.floor((place - 1 - edge) / F.greatest(small, F.lit(1))) + 1).cast("long")


def isotonic(points: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Increasing weighted fit of at most a few dozen bins by the max-min formula over prefix sums."""
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumn("_w", F.sum(weight).over(order)).withColumn("_s", F.sum(F.col(weight) * F.col(value)).over(order))
    stretch = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_w").alias("w"), F.col("_s").alias("s"), F.col(weight).alias("w0"), F.col(value).alias("v0"))))
    whole = p.agg(stretch.alias("a"))
    size = F.size("a")

    def mean(j: Column, k: Column) -> Column:
        before_w = F.when(j > 1, F.try_element_at("a", j - 1)["w"]).otherwise(0.0)
        before_s = F.when(j > 1, F.try_element_at("a", j - 1)["s"]).otherwise(0.0)
        end = F.try_element_at("a", k)
        return (end["s"] - before_s) / (end["w"] - before_w)

    def fit(i: Column) -> Column:
        return F.array_max(F.transform(F.sequence(F.lit(1), i), lambda j: F.array_min(F.transform(F.sequence(i, size), lambda k: mean(j, k)))))

    fitted = whole.where(size > 0).select(F.posexplode(F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.try_element_at("a", i)["k"].alias(key), F.try_element_at("a", i)["v0"].alias(value), fit(i).alias("fitted")))))
    return fitted.select("col.*")


def overlap_pairs(cells: DataFrame, by: str, across: str, minimum: int, block: int = 512) -> DataFrame:
    """Pairs (a < b) of ``by`` sharing at least ``minimum`` of ``across``: n, r (Pearson), rmse, and moments for regressions.

    Ids are cut into blocks of about ``block`` by hash and a task takes two blocks: it multiplies their tables, a slice of
    ``across`` at a time, so that a pair's sums come from matrix products.  A cell is copied once for every block, not for
    every other cell of its column; a column with a third of all cells is spread over all pairs of blocks.
    """
    import numpy as np
    import pandas as pd

    ids = cells.select(by).distinct()
    blocks = max(1, -(-ids.count() // block))
    shift = cells.agg(F.avg("score")).first()[0] or 0.0  # so that sums of squares do not cancel
    slim = cells.select(F.col(by).alias("_i"), F.col(across).alias("_k"), (F.col("score") - shift).alias("x"), F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int").alias("_b"))
    mates = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("_b"), o).alias("lo"), F.greatest(F.col("_b"), o).alias("hi")))
    spread = slim.select("_i", "_k", "x", "_b", F.explode(mates).alias("_m")).select("_i", "_k", "x", "_b", "_m.lo", "_m.hi")
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        one, two = (np.sort(frame.loc[frame["_b"] == k, "_i"].unique()) for k in (lo, hi))
        keys, code = np.unique(frame["_k"].to_numpy(dtype=object).astype(str), return_inverse=True)
        sums = np.zeros((6, len(one), len(two)))
        x, own = frame["x"].to_numpy(), frame["_i"].to_numpy(dtype=object)
        at = {k: (ids, frame["_b"].to_numpy() == k) for k, ids in ((lo, one), (hi, two))}
        for start in range(0, len(keys), 4096):
            width = min(4096, len(keys) - start)
            sides = []
            for k in (lo, hi):
                ids, inside = at[k]
                rows = np.flatnonzero(inside & (code >= start) & (code < start + width))
                table, mask = np.zeros((len(ids), width)), np.zeros((len(ids), width))
                r = np.searchsorted(ids, own[rows])
                table[r, code[rows] - start], mask[r, code[rows] - start] = x[rows], 1.0
                sides.append((table, mask))
            (u, m), (v, w) = sides
            for i, (p, q) in enumerate(((m, w), (u, w), (m, v), (u * u, w), (m, v * v), (u, v))):
                sums[i] += p @ q.T
        keep = (sums[0] >= minimum) & (one[:, None] != two[None, :])
        if lo == hi:
            keep &= one[:, None] < two[None, :]
        i, j = np.nonzero(keep)
        swap = one[i] > two[j]
        out = {n: s[i, j] for n, s in zip(names, sums)}
        for p, q in (("sx", "sy"), ("sxx", "syy")):
            out[p], out[q] = np.where(swap, out[q], out[p]), np.where(swap, out[p], out[q])
        return pd.DataFrame({"a": np.where(swap, two[j], one[i]), "b": np.where(swap, one[i], two[j]), **out})

    schema = "a string, b string, " + ", ".join(f"{n} double" for n in names)
    pairs = spread.groupBy("lo", "hi").applyInPandas(multiply, schema)
    n, mx, my = F.col("n"), F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    pairs = pairs.select("a", "b", n, mx.alias("_mx"), my.alias("_my"), (F.col("sxx") / n).alias("_xx"), (F.col("syy") / n).alias("_yy"), (F.col("sxy") / n).alias("_xy"))
    # what is left of equal values by rounding counts as no spread
    spread_of = lambda square, mean: F.when(F.col(square) - F.col(mean) * F.col(mean) > 1e-11 * (1.0 + F.col(square)), F.col(square) - F.col(mean) * F.col(mean)).otherwise(0.0)
    pairs = pairs.withColumn("vx", spread_of("_xx", "_mx")).withColumn("vy", spread_of("_yy", "_my")).withColumn("cxy", F.col("_xy") - F.col("_mx") * F.col("_my"))
    return pairs.select(
        "a", "b", n.cast("long").alias("n"),
        F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("cxy") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("_xx") + F.col("_yy") - 2.0 * F.col("_xy"))).alias("rmse"),
        (F.col("_mx") + shift).alias("mx"), (F.col("_my") + shift).alias("my"), "vx", "vy", "cxy",
    )


def concordance(rows: DataFrame, group: str, margin: float = 0.0, block: int = 4096) -> DataFrame:
    """``concordance_margins`` for one margin of all groups."""
    margins = rows.select(group).distinct().select(group, F.array(F.struct(F.lit("absolute").alias("kind"), F.lit(float(margin)).alias("multiple"), F.lit(float(margin)).alias("margin"))).alias("margins"))
    return concordance_margins(rows, group, margins, block).drop("kind", "multiple")


def concordance_margins(rows: DataFrame, group: str, margins: DataFrame, block: int = 4096) -> DataFrame:
    """Per group and margin: pairs with unlike actual values (by at least the margin) of which one is held out, and how many the prediction orders right or ties.

    Rows: actual, predicted, held; ``margins(group, margins array<struct<kind, multiple, margin>>)``.  A group is cut into
    blocks of about ``block`` rows by hash; pairs of blocks are compared as arrays, so no pair is ever a row and no task holds
    more than two blocks.  The work is still the square of a group's size, over as many tasks as there are pairs of blocks.
    """
    import numpy as np
    import pandas as pd

    sizes = rows.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block))).cast("int").alias("_blocks"))
    placed = rows.select(group, "model_id", "actual", "predicted", "held").join(sizes, group)
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("model_id"), F.col("_blocks")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(F.col("_b"), o).alias("lo"), F.greatest(F.col("_b"), o).alias("hi")))
    spread = placed.select(group, "actual", "predicted", "held", "_b", F.explode(mates).alias("_m")).select(group, "actual", "predicted", "held", "_b", "_m.lo", "_m.hi")

    def beaten(a, p, a2, p2, margin):
        """Ordered pairs (i of the first, j of the second set) with a_i >= a2_j + margin, a_i > a2_j: all, with p_i > p2_j, with p_i = p2_j."""
        if not len(a) or not len(a2):
            return 0, 0, 0
        least = a2[:, None] + margin
        total = right = tied = 0
        for at in range(0, len(a), 512):
            s = slice(at, at + 512)
            ok = (a[s][None, :] >= least) & (a[s][None, :] > a2[:, None])
            total += int(ok.sum())
            right += int((ok & (p[s][None, :] > p2[:, None])).sum())
            tied += int((ok & (p[s][None, :] == p2[:, None])).sum())
        return total, right, tied

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
        a, p, h, b = (frame[c].to_numpy() for c in ("actual", "predicted", "held", "_b"))
        h = h.astype(bool)
        sides = [(b == lo, b == hi), (b == hi, b == lo)] if lo != hi else [(b == lo, b == lo)]
        out = []
        for m in frame["margins"].iloc[0]:
            sums = np.zeros(3, dtype=np.int64)
            for one, two in sides:
                every = np.array(beaten(a[one], p[one], a[two], p[two], m["margin"]))
                open_ = np.array(beaten(a[one & ~h], p[one & ~h], a[two & ~h], p[two & ~h], m["margin"])) if not h.all() else 0
                sums += every - open_  # pairs with at least one held-out side
            out.append((frame[group].iloc[0], m["kind"], m["multiple"], *sums))
        return pd.DataFrame(out, columns=[group, "kind", "multiple", "pairs", "correct", "tied"])

    schema = f"{group} string, kind string, multiple double, pairs long, correct long, tied long"
    parts = spread.join(margins, group).groupBy(group, "lo", "hi").applyInPandas(count, schema)
    return parts.groupBy(group, "kind", "multiple").agg(F.sum("pairs").alias("pairs"), F.sum("correct").alias("correct"), F.sum("tied").alias("tied"))
