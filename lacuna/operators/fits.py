"""Kernel fits as Spark jobs: one grouped task per independent fit.

``jobs`` holds the cells of every fit in long form (job_id, model_id,
evaluation_id, score) plus the cells asked for (score null).  A grouped fit gathers
one job's cells in one task.  ``complete_cells`` and ``complete_grid`` choose by the
measured size of the table: up to ``KERNEL_CELLS`` cells and ``KERNEL_PLACES`` places
the kernel, beyond that ``relational_als``, whose every step is a join and an
aggregate and which gives the same numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lacuna.kernels import als, factor, neighbours, network, refits, transforms
from lacuna.operators import relational_als

KERNEL_CELLS = 5_000_000
KERNEL_PLACES = 20_000_000
_SCHEMA = "job_id string, model_id string, evaluation_id string, predicted double"


def _axes(frame: pd.DataFrame):
    seen = frame[frame["score"].notna()]
    models = np.sort(seen["model_id"].unique())  # code-point order, as the seeds of the factors follow the axes
    evaluations = np.sort(seen["evaluation_id"].unique())
    r = np.searchsorted(models, seen["model_id"].to_numpy(dtype=object))
    c = np.searchsorted(evaluations, seen["evaluation_id"].to_numpy(dtype=object))
    return models, evaluations, r, c, seen["score"].to_numpy(dtype=float)


def _answers(frame: pd.DataFrame, models, evaluations, table: np.ndarray) -> pd.DataFrame:
    asked = frame[frame["score"].isna()]
    m = {k: i for i, k in enumerate(models)}
    e = {k: i for i, k in enumerate(evaluations)}
    r = asked["model_id"].map(m)
    c = asked["evaluation_id"].map(e)
    known = (r.notna() & c.notna()).to_numpy()
    out = np.full(len(asked), np.nan)
    out[known] = table[r[known].astype(int), c[known].astype(int)]
    predicted = pd.Series(out).astype(object).where(~np.isnan(out), None)  # cells of unsupported rows or columns stay null
    return pd.DataFrame({"job_id": asked["job_id"].to_numpy(), "model_id": asked["model_id"].to_numpy(), "evaluation_id": asked["evaluation_id"].to_numpy(), "predicted": predicted.to_numpy()})


def fit_als(jobs: DataFrame, rank: int = 1, ridge: float = als.RIDGE) -> DataFrame:
    """Logit, z-score, bias ALS and back for every job; null for cells without support."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        models, evaluations, r, c, x = _axes(frame)
        if not len(x):
            return _answers(frame, models, evaluations, np.zeros((0, 0)))
        return _answers(frame, models, evaluations, als.complete(r, c, x, len(models), len(evaluations), rank, ridge))

    return jobs.groupBy("job_id").applyInPandas(run, _SCHEMA)


def fits_kernel(cells: DataFrame) -> bool:
    """Whether a table is small enough for one task."""
    n = cells.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model_id").alias("m"), F.countDistinct("evaluation_id").alias("e")).first()
    return n["n"] <= KERNEL_CELLS and n["m"] * n["e"] <= KERNEL_PLACES


def complete_cells(cells: DataFrame, asked: DataFrame, rank: int = 1, ridge: float = als.RIDGE, relational: bool | None = None) -> DataFrame:
    """model_id, evaluation_id, predicted of the cells asked for, by the kernel or, for large tables, by joins and aggregates."""
    cells = cells.select("model_id", "evaluation_id", "score")
    if relational or relational is None and not fits_kernel(cells):
        return relational_als.complete(cells, asked, rank, ridge)
    blank = asked.select("model_id", "evaluation_id", F.lit(None).cast("double").alias("score"))
    return fit_als(cells.unionByName(blank).withColumn("job_id", F.lit("one")), rank, ridge).drop("job_id")


def complete_grid(cells: DataFrame, rank: int, comparison_rank: int, relational: bool | None = None) -> DataFrame:
    """One row per (model, evaluation) of the table with both fits and the counts of its row and column."""
    cells = cells.select("model_id", "evaluation_id", "score")
    if not (relational or relational is None and not fits_kernel(cells)):
        return fit_all_cells(cells, rank, comparison_rank)
    models = cells.groupBy("model_id").agg(F.count(F.lit(1)).alias("model_observations"))
    evaluations = cells.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("evaluation_observations"))
    key = ["model_id", "evaluation_id"]
    grid = models.crossJoin(evaluations)  # the completed table itself
    one = relational_als.complete(cells, grid, rank).withColumnRenamed("predicted", "score")
    two = relational_als.complete(cells, grid, comparison_rank).withColumnRenamed("predicted", "comparison")
    seen = cells.select(*key, F.lit(True).alias("observed"))
    out = grid.join(one, key).join(two, key).join(seen, key, "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    return out.select(*key, "observed", "score", "comparison", "model_observations", "evaluation_observations")


def fit_all_cells(cells: DataFrame, rank: int, comparison_rank: int) -> DataFrame:
    """``complete_grid`` of a table that fits one task; the full grid is emitted by the fit itself."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        models, evaluations, r, c, x = _axes(frame)
        one = als.complete(r, c, x, len(models), len(evaluations), rank)
        two = als.complete(r, c, x, len(models), len(evaluations), comparison_rank)
        seen = np.zeros(one.shape, dtype=bool)
        seen[r, c] = True
        return pd.DataFrame(
            {
                "model_id": np.repeat(models, len(evaluations)),
                "evaluation_id": np.tile(evaluations, len(models)),
                "observed": seen.ravel(),
                "score": one.ravel(),
                "comparison": two.ravel(),
                "model_observations": np.repeat(seen.sum(axis=1), len(evaluations)),
                "evaluation_observations": np.tile(seen.sum(axis=0), len(models)),
            }
        )

    schema = "model_id string, evaluation_id string, observed boolean, score double, comparison double, model_observations long, evaluation_observations long"
    return cells.select("model_id", "evaluation_id", "score").withColumn("_job", F.lit(0)).groupBy("_job").applyInPandas(lambda f: run(f), schema)


# The grid of settings: every method's parameters.
SETTINGS: list[tuple[str, dict]] = [
    ("benchmark_mean", {}),
    ("model_mean", {}),
    *[(m, {"k": k}) for m in ("bench_knn", "model_knn") for k in (3, 5, 7, 10)],
    *[(m, {"top_k": k, "min_r2": r2}) for m in ("bench_regression", "model_regression") for k in (3, 5, 7) for r2 in (0.1, 0.2, 0.3)],
    *[("soft_impute", {"rank": r}) for r in (1, 2)],
    *[("bias_als", {"rank": 1, "ridge": x}) for x in (0.01, 0.1, 1.0)],
    ("bias_als", {"rank": 2, "ridge": 0.1}),
    *[(m, {"rank": r}) for m in ("nmf", "pmf") for r in (1, 2, 3, 5)],
    *[("nuclear_norm", {"weight": w}) for w in (0.1, 0.5, 1.0, 5.0)],
    *[("mlp", {"rate": x}) for x in (1e-4, 1e-3, 1e-2)],
]
COMPLETERS = {**neighbours.COMPLETERS, **factor.COMPLETERS, "mlp": network.mlp}


def setting_label(transform: str, method: str, arguments: dict) -> str:
    """transform/method/ and the head of a hash of the arguments."""
    text = json.dumps(arguments, sort_keys=True, separators=(",", ":"))
    return f"{transform}/{method}/{hashlib.sha1(text.encode()).hexdigest()[:10]}"


def complete_transformed(transform: str, method: str, arguments: dict, r, c, x, n_rows: int, n_cols: int) -> np.ndarray:
    """Columns transformed and z-scored, completed, and turned back; columns of percentages are kept in 0..100."""
    z, columns = np.empty_like(x), [np.flatnonzero(c == j) for j in range(n_cols)]
    for at in columns:
        z[at] = transforms.forward(transform, x[at])
    mean, spread = als.column_moments(c, z, n_cols, 1e-8)
    table = COMPLETERS[method](r, c, (z - mean[c]) / spread[c], n_rows, n_cols, **arguments) * spread + mean
    for j, at in enumerate(columns):
        back = transforms.inverse(transform, table[:, j], x[at])
        table[:, j] = np.clip(back, 0.0, 100.0) if transforms.is_percentage(x[at]) else back
    table[r, c] = x
    return table


def fit_method(jobs: DataFrame) -> DataFrame:
    """Jobs also carry transform, method and arguments (JSON); null predictions where a method reaches no cell."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        models, evaluations, r, c, x = _axes(frame)
        if not len(x):
            return _answers(frame, models, evaluations, np.zeros((0, 0)))
        table = _completer(frame["transform"].iloc[0], frame["method"].iloc[0], json.loads(frame["arguments"].iloc[0]))(r, c, x, len(models), len(evaluations))
        return _answers(frame, models, evaluations, table)

    return jobs.groupBy("job_id").applyInPandas(run, _SCHEMA)


class _Folded:
    """The cells of a table by codes and with their folds, from which the training cells of a fold are cut."""

    def __init__(self, frame: pd.DataFrame):
        self.models, r = np.unique(frame["model_id"].to_numpy(dtype=object), return_inverse=True)
        self.evaluations, c = np.unique(frame["evaluation_id"].to_numpy(dtype=object), return_inverse=True)
        self.r, self.c, self.x, self.fold = r.astype(np.int32), c.astype(np.int32), frame["score"].to_numpy(dtype=float), frame["fold"].to_numpy()

    def fit(self, fold: int, complete) -> tuple[np.ndarray, np.ndarray]:
        """Held cells and their predictions by ``complete(r, c, x, rows, columns)``; not a number where row or column is not in the training cells."""
        held, train = np.flatnonzero(self.fold == fold), np.flatnonzero(self.fold != fold)
        out = np.full(len(held), np.nan)
        if len(train):
            rows, cols = (np.bincount(k[train], minlength=n) > 0 for k, n in ((self.r, len(self.models)), (self.c, len(self.evaluations))))
            i, j = np.cumsum(rows) - 1, np.cumsum(cols) - 1
            table = complete(i[self.r[train]], j[self.c[train]], self.x[train], int(rows.sum()), int(cols.sum()))
            known = rows[self.r[held]] & cols[self.c[held]]
            out[known] = table[i[self.r[held[known]]], j[self.c[held[known]]]]
        return held, out


def _completer(transform: str, method: str, arguments: dict):
    """The completion of a setting; ``als`` and ``svd`` are the pipelines of percent scores, the others those of the grid."""
    if method == "als":
        return lambda r, c, x, n, m: als.complete(r, c, x, n, m, arguments["rank"])
    if method == "svd":
        return lambda r, c, x, n, m: factor.soft_impute(r, c, x, n, m, arguments["rank"], transform)
    return lambda r, c, x, n, m: complete_transformed(transform, method, arguments, r, c, x, n, m)


def fit_grid(folded: DataFrame, settings: DataFrame, folds: int, limit: int = KERNEL_CELLS, named: bool = True) -> DataFrame:
    """Predictions of every fold under every setting: job_id, fold, model_id, evaluation_id (if ``named``), actual, predicted.

    ``folded(model_id, evaluation_id, score, fold)``, ``settings(job_id, transform, method, arguments)``.  Up to ``limit``
    cells the table is broadcast once and each (setting, fold) is a row; larger tables are copied to each fit by a shuffle.
    """
    every = F.explode(F.array(*[F.lit(i).cast("long") for i in range(folds)]))
    if folded.count() > limit:
        jobs = folded.crossJoin(F.broadcast(settings)).withColumn("_fold", every)  # settings are a fixed grid
        jobs = jobs.select(F.concat_ws("\u0001", "job_id", "_fold").alias("job_id"), "transform", "method", "arguments", "model_id", "evaluation_id", F.when(F.col("fold") != F.col("_fold"), F.col("score")).alias("score"))
        out = fit_method(jobs).withColumn("fold", F.substring_index("job_id", "\u0001", -1).cast("long")).withColumn("job_id", F.substring_index("job_id", "\u0001", 1))
        out = out.join(folded.select("model_id", "evaluation_id", "fold", F.col("score").alias("actual")), ["model_id", "evaluation_id", "fold"])
        return out if named else out.drop("model_id", "evaluation_id")
    shared = folded.sparkSession.sparkContext.broadcast(_Folded(folded.select("model_id", "evaluation_id", "score", "fold").toPandas()))  # bounded by the check above

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for batch in batches:
            for job, transform, method, arguments, fold in zip(*(batch[k] for k in ("job_id", "transform", "method", "arguments", "fold"))):
                held, predicted = cells.fit(fold, _completer(transform, method, json.loads(arguments)))
                names = {"model_id": cells.models[cells.r[held]], "evaluation_id": cells.evaluations[cells.c[held]]} if named else {}
                yield pd.DataFrame({"job_id": job, **names, "predicted": predicted, "fold": fold, "actual": cells.x[held]})

    jobs = settings.withColumn("fold", every)
    tasks = max(1, min(2000, jobs.count()))
    schema = _SCHEMA if named else "job_id string, predicted double"
    out = jobs.repartition(tasks, "job_id", "fold").mapInPandas(run, schema + ", fold long, actual double")
    return out.withColumn("predicted", F.when(~F.isnan("predicted"), F.col("predicted")))


def _shuffled_targets(cells: DataFrame, jobs: DataFrame, rank: int, dates: DataFrame | None, own_cells: bool) -> DataFrame:
    """``fit_targets`` without a broadcast: every job's cells and the cells asked of it, in long form."""
    jobs = jobs.select("job_id", "target", F.coalesce("probes", F.array().cast("array<string>")).alias("probes"), "before" if dates is not None else "context")
    kept = cells.select("model_id", "evaluation_id", "score")
    pairs = (kept if dates is None else kept.join(dates.select("model_id", F.col("date").alias("_d")), "model_id", "left")).crossJoin(jobs)  # the refits' own input: the table once a job
    own = F.col("model_id") == F.col("target")
    others = F.coalesce(F.col("_d") < F.col("before"), F.lit(False)) if dates is not None else F.col("context").isNull() | F.array_contains("context", F.col("model_id"))
    seen = pairs.where(F.when(own, F.array_contains("probes", F.col("evaluation_id"))).otherwise(others)).select("job_id", "model_id", "evaluation_id", "score")
    asked = kept.select("model_id", "evaluation_id").join(jobs, F.col("model_id") == F.col("target")).drop("model_id") if own_cells else cells.select("evaluation_id").distinct().crossJoin(jobs)
    asked = asked.where(~F.array_contains("probes", F.col("evaluation_id")))
    asked = asked.select("job_id", F.col("target").alias("model_id"), "evaluation_id", F.lit(None).cast("double").alias("score"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        have, want = frame[frame["score"].notna()], frame[frame["score"].isna()]
        models = np.unique(np.append(have["model_id"].to_numpy(dtype=object).astype(str), want["model_id"].to_numpy(dtype=object).astype(str)))
        evaluations = np.unique(have["evaluation_id"].to_numpy(dtype=object).astype(str))
        if not len(have):
            return _answers(frame, models, evaluations, np.full((len(models), 0), np.nan))
        r, c = np.searchsorted(models, have["model_id"].to_numpy(dtype=object).astype(str)), np.searchsorted(evaluations, have["evaluation_id"].to_numpy(dtype=object).astype(str))
        return _answers(frame, models, evaluations, als.complete(r, c, have["score"].to_numpy(dtype=float), len(models), len(evaluations), rank, allow_empty_rows=True))

    return seen.unionByName(asked).groupBy("job_id").applyInPandas(run, _SCHEMA)


class _Targets:
    """The cells of a table in the order of their models, from which the refits of single targets are cut."""

    def __init__(self, frame: pd.DataFrame, dates: pd.DataFrame | None):
        self.models, r = np.unique(frame["model_id"].to_numpy(dtype=object).astype(str), return_inverse=True)
        self.evaluations, c = np.unique(frame["evaluation_id"].to_numpy(dtype=object).astype(str), return_inverse=True)
        order = np.argsort(r, kind="stable")
        self.r, self.c, self.x = r[order], c[order], frame["score"].to_numpy(dtype=float)[order]
        self.starts = np.searchsorted(self.r, np.arange(len(self.models) + 1))
        self.codes = {e: i for i, e in enumerate(self.evaluations)}
        self.dates = None
        if dates is not None:  # a model without a date is no context
            of = dict(zip(dates["model_id"], dates["date"]))
            self.dates = np.array([of.get(m, np.inf) for m in self.models], dtype=float)
        self.whole = None

    def differs_little(self) -> bool:
        """Whether the table is one of whose fit the refits of single rows are small differences."""
        n, m = len(self.models), len(self.evaluations)
        dense = n * m <= als.DENSE_PLACES or n * m <= min(refits.STATE_PLACES, als.DENSE_SHARE * len(self.x))
        return self.dates is None and dense and n >= refits.LEAST_ROWS and n * als.ENSEMBLES * als.ROUNDS <= refits.STATE_PLACES

    def _whole(self, jobs: int, rank: int) -> refits.RowRefits | None:
        """The fit of the whole table, made once a worker, if it holds enough models for refits to differ little and enough of them are asked."""
        if rank != 1 or jobs < refits.BATCH or not self.differs_little():
            return None
        if self.whole is None:
            self.whole = refits.RowRefits(self.r, self.c, self.x, self.starts, len(self.evaluations))
        return self.whole

    def near_fits(self, jobs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """``refits.RowRefits.near_fits`` of jobs (row, columns of it that are seen, as flags)."""
        return self._whole(refits.BATCH, 1).near_fits(jobs)

    def fit_all(self, jobs: list[tuple], rank: int, own_cells: bool) -> Iterator:
        """What ``fit`` gives for each (target, probes, context, before); refits that see all other models are made together where they can be."""
        near, lines = {}, []
        if (whole := self._whole(len(jobs), rank)) is not None:
            for k, (target, probes, context, _) in enumerate(jobs):
                at = int(np.searchsorted(self.models, target))
                if context is None and at < len(self.models) and self.models[at] == target:
                    near[k] = (at, self._known(probes))
            lines = whole.fit(list(near.values()))
        lines = dict(zip(near, lines))
        for k, job in enumerate(jobs):
            if lines.get(k) is None:
                yield self.fit(*job, rank, own_cells)
                continue
            at, known = near[k]
            asked = self._asked(known, self.starts[at], self.starts[at + 1], own_cells)
            yield np.flatnonzero(asked), lines[k][asked]

    def _known(self, probes) -> np.ndarray:
        known = np.zeros(len(self.evaluations), dtype=bool)
        known[[self.codes[e] for e in (probes if probes is not None else ()) if e in self.codes]] = True
        return known

    def _asked(self, known: np.ndarray, low: int, high: int, own_cells: bool) -> np.ndarray:
        return ~known & (np.bincount(self.c[low:high], minlength=len(known)) > 0) if own_cells else ~known

    def fit(self, target: str, probes, context, before, rank: int, own_cells: bool):
        """Evaluations asked and their predictions; None if the job sees no cell."""
        at = int(np.searchsorted(self.models, target))
        found = at < len(self.models) and self.models[at] == target
        low, high = (self.starts[at], self.starts[at + 1]) if found else (self.starts[at],) * 2  # a new model stands where its name would
        known = self._known(probes)
        use = np.ones(len(self.models), dtype=bool)
        if self.dates is not None:
            use = self.dates < before
        elif context is not None:
            use = np.isin(self.models, np.asarray(list(context), dtype=str))
        keep = use[self.r]
        keep[low:high] = known[self.c[low:high]]
        if not keep.any():
            return None
        if found:
            use[at] = True
        row = int(use[:at].sum())
        place = np.cumsum(use) - 1
        if not found:
            place[at:] += 1
        r, c = place[self.r[keep]], self.c[keep]
        has = np.bincount(c, minlength=len(self.evaluations)) > 0
        line = np.full(len(self.evaluations), np.nan)
        line[has] = als.complete(r, (np.cumsum(has) - 1)[c], self.x[keep], int(use.sum()) + (not found), int(has.sum()), rank, allow_empty_rows=True, row=row)[0]
        asked = self._asked(known, low, high, own_cells)
        return np.flatnonzero(asked), line[asked]


def fit_targets(cells: DataFrame, jobs: DataFrame, rank: int = 1, limit: int = KERNEL_CELLS, dates: DataFrame | None = None, own_cells: bool = False) -> DataFrame:
    """Refits for single target models: ``jobs(job_id, target, probes array, context array or null)``.

    A job sees the context models' cells (all other models if null) and of the target only the probes, and predicts every
    other evaluation of the target, or of those only what the target has a cell of (``own_cells``).  With
    ``dates(model_id, date double)`` jobs have a date ``before`` instead of a context, and see the models of earlier dates.  Up
    to ``limit`` cells the table is broadcast once; beyond that each job's cells are copied to it by a shuffle.
    """
    if cells.count() > limit:
        return _shuffled_targets(cells, jobs, rank, dates, own_cells)
    frame = cells.select("model_id", "evaluation_id", "score").toPandas()  # bounded by the check above
    dated = None if dates is None else dates.join(cells.select("model_id").distinct(), "model_id", "left_semi").select("model_id", "date").toPandas()
    shared = cells.sparkSession.sparkContext.broadcast(_Targets(frame, dated))
    last = "context" if dates is None else "before"

    def run(batches):
        table = shared.value
        for frame in batches:
            found = [[], [], [], []]
            asked = [(target, probes, *((seen, None) if table.dates is None else (None, seen))) for target, probes, seen in zip(frame["target"], frame["probes"], frame[last])]
            for job, target, fitted in zip(frame["job_id"], frame["target"], table.fit_all(asked, rank, own_cells)):
                if fitted is None:
                    continue
                for part, more in zip(found, ([job] * len(fitted[0]), [target] * len(fitted[0]), table.evaluations[fitted[0]], fitted[1])):
                    part.extend(more)
            if found[0]:
                yield pd.DataFrame(dict(zip(("job_id", "model_id", "evaluation_id", "predicted"), found)))

    tasks = max(1, min(200, jobs.count()))
    out = jobs.select("job_id", "target", "probes", last).repartition(tasks, "job_id").mapInPandas(run, _SCHEMA)
    return out.withColumn("predicted", F.when(~F.isnan("predicted"), F.col("predicted")))
