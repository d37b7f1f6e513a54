"""Problem 5: one quantity written in several units; every value comes out in one unit per quantity.

Written units are parsed: a unit beside the number comes before the unit field,
and that before a unit in the metric's name.  Where no unit is written, a
mixture on the log scale is fitted per metric: one component per unit of the
quantity, all sharing one mean and spread and shifted by the known conversion
factors.  The unit is the component of largest posterior; values whose posterior
stays below a threshold are flagged.  A metric measures the quantity that most of
its written units belong to.

The fit reads all rows: they are folded to a histogram of log values (bins of
1/64 decade per metric and unit), whose size does not depend on the number of
rows, and each metric's histogram is fitted in a task of its own.  Metrics may be
any number; their models are broadcast only up to a checked count.

Defined results: no number gives no value; zero and non-finite numbers have no
logarithm, so their missing unit stays unknown and flagged; numbers beyond the
range of decimal(38,12) give no value; metrics that are null or blank are one
metric; empty tables give no rows; columns other than those named are carried
unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions.columns import pin
from lacuna.functions.text import is_missing
from lacuna.session import cut

# Spellings of units, without case, blanks and punctuation other
# than the per cent and per mille signs.  Factors lead to the whole output unit:
# millionths of the fraction, milliseconds, bytes.
UNITS = {
    "fraction": {
        "fraction": (1_000_000, ["fraction", "fractions", "01", "proportion", "ratio"]),
        "percent": (10_000, ["percent", "pct", "%", "percentage", "percentagepoints", "percentrelativechange", "percentpoints"]),
        "permille": (1_000, ["permille", "promille", "‰", "perthousand", "permil"]),
        "basis_point": (100, ["basispoint", "basispoints", "bp", "bps"]),
    },
    "time": {
        "second": (1_000, ["second", "seconds", "sec", "secs", "s"]),
        "millisecond": (1, ["millisecond", "milliseconds", "msec", "msecs", "ms"]),
        "minute": (60_000, ["minute", "minutes", "min", "mins"]),
        "hour": (3_600_000, ["hour", "hours", "hr", "hrs", "h"]),
        "day": (86_400_000, ["day", "days", "d"]),
    },
    "memory": {
        "byte": (1, ["byte", "bytes", "b"]),
        "kilobyte": (1_000, ["kilobyte", "kilobytes", "kb"]),
        "kibibyte": (1 << 10, ["kibibyte", "kibibytes", "kib"]),
        "megabyte": (1_000_000, ["megabyte", "megabytes", "mb"]),
        "mebibyte": (1 << 20, ["mebibyte", "mebibytes", "mib"]),
        "gigabyte": (1_000_000_000, ["gigabyte", "gigabytes", "gb"]),
        "gibibyte": (1 << 30, ["gibibyte", "gibibytes", "gib"]),
        "terabyte": (1_000_000_000_000, ["terabyte", "terabytes", "tb"]),
        "tebibyte": (1 << 40, ["tebibyte", "tebibytes", "tib"]),
    },
}
COMMON = {"fraction": "fraction", "time": "second", "memory": "byte"}
# What metrics measure of which no unit is ever written; all others are fractions.
METRIC_QUANTITY = {"wallclock": "time", "peakmemory": "memory"}
#: Models of more metrics than this are joined by a shuffle instead of a broadcast.
BROADCAST_METRICS = 50_000
# Out of the fit: units that no row of the quantity was ever written in get this weight.
_RARE = 1e-6
_BINS_PER_DECADE = 64


def _unit_map() -> Column:
    pairs = []
    for quantity, units in UNITS.items():
        for unit, (_, spellings) in units.items():
            for spelling in spellings:
                pairs += [F.lit(spelling), F.lit(f"{quantity}/{unit}")]
    return F.create_map(*pairs)


def _factor_map() -> Column:
    return F.create_map(*[F.lit(x) for q, units in UNITS.items() for u, (f, _) in units.items() for x in (f"{q}/{u}", int(f))])


def _spelling(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9%‰]", ""))


def unit_of(text: Column) -> Column:
    """``quantity/unit`` of a unit's spelling, null if it is none."""
    return F.when(F.length(text) <= 64, F.try_element_at(_unit_map(), _spelling(text)))


_NUMBER = r"[+-]?(?:[0-9][0-9.,]*|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?"


def clean_number_text(value: Column) -> Column:
    """Plain signs and blanks, and no spread behind the number."""
    plain = F.translate(value, "−‐–   ", "---   ")
    return F.regexp_replace(plain, r"\s*(?:±|\+/-|\+-)\s*[0-9][0-9.,]*(?:[eE][+-]?[0-9]+)?", "")


def metric_base(metric: Column) -> Column:
    """The metric's name without a unit, as a key."""
    name = F.regexp_extract(metric, r"^\s*(.*?)\s*(?:\sin\s|[,(\[]|$)", 1)
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def metric_unit(metric: Column) -> Column:
    """Unit written in a metric: in brackets, after a comma, or after the word in."""
    return F.coalesce(
        unit_of(F.regexp_extract(metric, r"[(\[]([^)\]]*)[)\]]\s*$", 1)),
        unit_of(F.regexp_extract(metric, r",\s*([^,]*)$", 1)),
        unit_of(F.regexp_extract(metric, r"\sin\s+(.*)$", 1)),
    )


def plain_number(number: Column, fraction_like: Column) -> Column:
    """Number text with a point as decimal mark and no thousands marks.

    With both marks the later one is the decimal mark; a repeated mark separates
    thousands; one comma before exactly three digits separates thousands only in
    quantities other than fractions and only if the part before is not 0.
    """
    commas = F.length(number) - F.length(F.regexp_replace(number, ",", ""))
    points = F.length(number) - F.length(F.regexp_replace(number, r"\.", ""))
    no_commas = F.regexp_replace(number, ",", "")
    no_points = F.regexp_replace(number, r"\.", "")
    thousands = number.rlike(r"^[+-]?[1-9][0-9]{0,2},[0-9]{3}(?![0-9])") & ~fraction_like
    return (
        F.when((commas > 0) & (points > 0), F.when(F.instr(F.reverse(number), ",") < F.instr(F.reverse(number), "."), F.regexp_replace(no_points, ",", ".")).otherwise(no_commas))
        .when((commas > 1) | ((commas == 1) & thousands), no_commas)
        .when(commas == 1, F.regexp_replace(number, ",", "."))
        .when(points > 1, no_points)
        .otherwise(number)
    )


def parse_units(rows: DataFrame, value: str = "value", unit: str = "value_unit", metric: str = "metric") -> DataFrame:
    """Adds metric_key, unit_source (value, value_unit, metric; null where no unit is written), ``_unit`` (quantity/unit) and the number in both readings of a lone comma."""
    pattern = rf"({_NUMBER})\s*(.*)$"
    found = pin(rows, _text=clean_number_text(F.col(value)))
    found = pin(found, _n=F.regexp_extract("_text", pattern, 1), _rest=F.regexp_extract("_text", pattern, 2))
    sign_only = F.col(unit).rlike("^[^A-Za-z0-9]*[%‰][^A-Za-z0-9]*$")
    found = pin(
        found,
        _beside=unit_of(F.col("_rest")),
        _field=F.when(sign_only | ~is_missing(unit), unit_of(F.col(unit))),
        _named=metric_unit(F.col(metric)),
        metric_key=F.coalesce(metric_base(F.col(metric)), F.lit("")),
    )
    source = F.when(F.col("_beside").isNotNull(), "value").when(F.col("_field").isNotNull(), "value_unit").when(F.col("_named").isNotNull(), "metric")
    number = lambda fraction_like: F.when(F.col("_n") != "", F.regexp_replace(plain_number(F.col("_n"), F.lit(fraction_like)), r"[.,]+$", "").try_cast("decimal(38,12)"))
    found = pin(found, _unit=F.coalesce("_beside", "_field", "_named"), unit_source=source, _fraction_number=number(True), _other_number=number(False))
    return found.drop("_text", "_n", "_rest", "_beside", "_field", "_named")


def common_whole(number: Column, factor: Column) -> Column:
    """Value in whole output units, rounded half away from zero."""
    return F.round(number.cast("decimal(38,12)") * factor.cast("decimal(20,0)"), 0).try_cast("bigint")


def _fit_metric(bins: pd.DataFrame, rounds: int = 60) -> dict:
    """Quantity, mean and spread of log10 of the common value, and weight of each unit of one metric.

    EM over a histogram; rows with a written unit of the quantity belong to its component, those without share
    themselves out, and those of other quantities take no part.
    """
    written = bins["unit"].str.partition("/")[0].where(bins["unit"].notna())
    votes = bins.groupby(written)["count"].sum().sort_index()
    quantity = str(votes.idxmax()) if len(votes) else METRIC_QUANTITY.get(str(bins["metric_key"].iloc[0]), "fraction")
    units = list(UNITS[quantity])
    shift = np.array([math.log10(UNITS[quantity][u][0]) for u in units])
    own = bins[written.isna() | (written == quantity)]
    place = own["fraction_bin"] if quantity == "fraction" else own["other_bin"]
    own, place = own[place.notna()], place[place.notna()].to_numpy(dtype=float)
    x, n = (place + 0.5) / _BINS_PER_DECADE, own["count"].to_numpy(dtype=float)
    known = np.array([units.index(u.partition("/")[2]) if isinstance(u, str) else -1 for u in own["unit"]], dtype=int)
    if not len(x):
        return {"quantity": quantity, "mean": 0.0, "spread": 1.0, "weight": [1.0 / len(units)] * len(units)}
    y = x[:, None] + shift[None, :]  # log10 in output units under each unit
    seen = np.flatnonzero(known >= 0)
    if len(seen):
        given = y[seen, known[seen]]
        mean = np.average(given, weights=n[seen])
        spread = max(0.05, math.sqrt(np.average((given - mean) ** 2, weights=n[seen])))
        weight = np.bincount(known[seen], weights=n[seen], minlength=len(units)) + _RARE
    else:
        mean, spread, weight = np.average(y[:, 0], weights=n), 1.0, np.ones(len(units))
    weight = weight / weight.sum()
    for _ in range(rounds):
        score = np.log(weight)[None, :] - 0.5 * ((y - mean) / spread) ** 2
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        share[seen] = 0.0
        share[seen, known[seen]] = 1.0
        mass = share * n[:, None]
        new_mean = (mass * y).sum() / mass.sum()
        spread = max(0.05, math.sqrt((mass * (y - new_mean) ** 2).sum() / mass.sum()))
        weight = mass.sum(axis=0) + _RARE
        weight /= weight.sum()
        moved, mean = abs(new_mean - mean), new_mean
        if moved < 1e-9:
            break
    return {"quantity": quantity, "mean": float(mean), "spread": float(spread), "weight": [float(w) for w in weight]}


_MODEL = "metric_key string, model_quantity string, mean double, spread double, units array<struct<unit:string,logw:double,shift:double>>"


def fit_unit_mixtures(parsed: DataFrame) -> DataFrame:
    """One model per metric; ``parsed`` comes from :func:`parse_units`."""
    place = lambda c: F.when(F.col(c) != 0, F.floor(F.log10(F.abs(F.col(c).cast("double"))) * _BINS_PER_DECADE))
    bins = (
        parsed.where(F.col("_fraction_number").isNotNull() | F.col("_other_number").isNotNull() | F.col("_unit").isNotNull())
        .select("metric_key", F.col("_unit").alias("unit"), place("_fraction_number").alias("fraction_bin"), place("_other_number").alias("other_bin"))
        .groupBy("metric_key", "unit", "fraction_bin", "other_bin")
        .count()
    )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        m = _fit_metric(frame)
        units = [{"unit": u, "logw": math.log(w), "shift": math.log10(f)} for (u, (f, _)), w in zip(UNITS[m["quantity"]].items(), m["weight"])]
        return pd.DataFrame([{"metric_key": frame["metric_key"].iloc[0], "model_quantity": m["quantity"], "mean": m["mean"], "spread": m["spread"], "units": units}])

    return bins.groupBy("metric_key").applyInPandas(fit, _MODEL)


def harmonise_units(rows: DataFrame, value: str = "value", unit: str = "value_unit", metric: str = "metric", certain: float = 0.9) -> DataFrame:
    """Adds quantity, number, unit, unit_source, posterior, uncertain, common_value (whole output units) and common_unit."""
    parsed = parse_units(rows, value, unit, metric)
    models = cut(fit_unit_mixtures(parsed))
    few = models.count() <= BROADCAST_METRICS
    parsed = parsed.join(F.broadcast(models) if few else models, "metric_key", "left")
    written = F.col("_unit").isNotNull()
    parsed = pin(parsed, quantity=F.coalesce(F.substring_index("_unit", "/", 1), F.col("model_quantity"), F.lit("fraction")))
    fraction_like = (F.col("quantity") == "fraction") & ~F.coalesce(F.col("_unit").endswith("/basis_point"), F.lit(False))
    parsed = pin(parsed, number=F.when(fraction_like, F.col("_fraction_number")).otherwise(F.col("_other_number")))
    open_ = ~written & F.col("number").isNotNull() & (F.col("number") != 0)
    parsed = pin(parsed, _log=F.when(open_, F.log10(F.abs(F.col("number").cast("double")))))
    scores = F.transform(
        F.when(F.col("_log").isNotNull(), F.col("units")),
        lambda u: F.struct((u["logw"] - 0.5 * F.pow((F.col("_log") + u["shift"] - F.col("mean")) / F.col("spread"), 2)).alias("score"), u["unit"].alias("unit")),
    )
    parsed = pin(parsed, _scores=scores)
    parsed = pin(parsed, _best=F.array_max("_scores"))
    total = F.aggregate("_scores", F.lit(0.0), lambda a, s: a + F.exp(s["score"] - F.col("_best.score")))
    parsed = pin(parsed, _guess=F.col("_best.unit"), posterior=F.when(written, F.lit(1.0)).otherwise(1.0 / total))
    factor = F.try_element_at(_factor_map(), F.coalesce("_unit", F.concat("quantity", F.lit("/"), "_guess")))
    common = F.create_map(*[F.lit(v) for pair in COMMON.items() for v in pair])
    parsed = pin(
        parsed,
        unit_source=F.coalesce("unit_source", F.when(F.col("_guess").isNotNull(), "inferred")),
        unit=F.coalesce(F.substring_index("_unit", "/", -1), F.col("_guess")),
        uncertain=F.col("number").isNotNull() & (F.coalesce("posterior", F.lit(0.0)) < certain),
        common_value=common_whole(F.col("number"), factor),
        common_unit=F.try_element_at(common, F.col("quantity")),
    )
    return parsed.drop("_unit", "_fraction_number", "_other_number", "_log", "_scores", "_best", "_guess", "metric_key", "model_quantity", "mean", "spread", "units")
