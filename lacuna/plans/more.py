"""Further inventory queries: lookups, unions, sweeps, screenings and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lacuna.functions.columns import count_all
from lacuna.functions.text import same_key
from lacuna.operators import fits, holdouts, search
from lacuna.operators import stats as S
from lacuna.plans.base import SQL_CELLS, SQL_FOLD, SQL_PRED, SQL_REPEATS, cells, predictions, repeated_errors, with_fold
from lacuna.plans.measures import _SQL_FOLDS, _fold_errors, _trust_rows
from lacuna.plans.quality import sql_key
from lacuna.plans.relations import HIBOU, PHIKON, _probes
from lacuna.product import ScoreTable
from lacuna.session import cut
from lacuna.sources.files import markdown_tables
from lacuna.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("c2_cell_lookup", f"WITH {SQL_CELLS} SELECT c.model_id, c.evaluation_id, round(score, 6) AS score, round(value, 6) AS value FROM c JOIN tasks t USING (evaluation_id) WHERE t.task_type = 'classification'")
def c2(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "tasks").where("task_type = 'classification'").select("evaluation_id")
    return cells(s, d).join(t, "evaluation_id").select("model_id", "evaluation_id", F.round("score", 6).alias("score"), F.round("value", 6).alias("value"))


@query("c9_score_union", f"SELECT suite_id, source, count(*) AS n FROM (SELECT suite_id, 'hibou' AS source FROM {HIBOU} UNION ALL SELECT suite_id, 'phikon' FROM {PHIKON} UNION ALL SELECT suite_id, 'registry' FROM scores) GROUP BY 1, 2")
def c9(s, d):
    part = lambda name, tag: table(s, d, name).select("suite_id", F.lit(tag).alias("source"))
    return part(HIBOU, "hibou").unionByName(part(PHIKON, "phikon")).unionByName(part("scores", "registry")).groupBy("suite_id", "source").agg(count_all().alias("n"))


_PB = "pb AS (SELECT evaluation_id FROM c GROUP BY 1 ORDER BY count(*) DESC, evaluation_id LIMIT 5)"


@query("c14_context_isolation", f"WITH {SQL_CELLS}, {_PB}, t AS (SELECT max(model_id) AS target FROM c), cx AS (SELECT DISTINCT model_id FROM c, t WHERE model_id < target AND model_id IN (SELECT model_id FROM c GROUP BY 1 HAVING count(*) >= 20)) SELECT model_id, count(*) AS n FROM (SELECT c.model_id, c.evaluation_id FROM c JOIN cx USING (model_id) UNION ALL SELECT c.model_id, c.evaluation_id FROM c, t WHERE model_id = target AND evaluation_id IN (SELECT evaluation_id FROM pb)) GROUP BY 1")
def c14(s, d):
    c = cells(s, d)
    target = c.agg(F.max("model_id").alias("target"))
    sized = c.groupBy("model_id").agg(count_all().alias("k")).crossJoin(F.broadcast(target))  # one row: an ungrouped aggregate
    context = sized.where((F.col("k") >= 20) & (F.col("model_id") < F.col("target"))).select("model_id")
    own = c.join(target, c["model_id"] == target["target"]).join(_probes(c), "evaluation_id", "left_semi").select("model_id", "evaluation_id")
    return c.join(context, "model_id", "left_semi").select("model_id", "evaluation_id").unionByName(own).groupBy("model_id").agg(count_all().alias("n"))


@query("c26_candidate_steps", f"WITH {SQL_CELLS}, {_PB}, o AS (SELECT evaluation_id, row_number() OVER (ORDER BY n DESC, evaluation_id) - 1 AS i FROM (SELECT evaluation_id, count(*) AS n FROM c GROUP BY 1)), s AS (SELECT k AS step, coalesce((SELECT string_agg(evaluation_id, '+' ORDER BY i) FROM o WHERE i < k), '') AS prefix FROM range(5) t(k)) SELECT CAST(step AS INTEGER) AS step, prefix, evaluation_id AS candidate FROM s, o WHERE NOT (i < step)")
def c26(s, d):
    """Every remaining candidate of each step of a growing prefix (the five most observed evaluations)."""
    n = cells(s, d).groupBy("evaluation_id").agg(count_all().alias("n"))
    first = n.orderBy(F.desc("n"), "evaluation_id").limit(5).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "evaluation_id"))), lambda x: x["evaluation_id"]).alias("order"))
    steps = first.select("order", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step")).select("step", F.when(F.col("step") > 0, F.slice("order", 1, F.greatest(F.lit(1), F.col("step")))).otherwise(F.array().cast("array<string>")).alias("taken"))
    every = n.select(F.col("evaluation_id").alias("candidate")).crossJoin(F.broadcast(steps))  # five steps
    return every.where(~F.array_contains("taken", F.col("candidate"))).select("step", F.array_join("taken", "+").alias("prefix"), "candidate")


@query("c27_combinations", f"WITH {SQL_CELLS}, e AS (SELECT DISTINCT evaluation_id FROM c) SELECT row_number() OVER (ORDER BY a.evaluation_id, b.evaluation_id) - 1 AS place, a.evaluation_id AS first, b.evaluation_id AS second FROM e a JOIN e b ON a.evaluation_id < b.evaluation_id")
def c27(s, d):
    """All pairs of evaluations by their place in the lexicographic order, unranked in the tasks."""
    names = sorted(r["evaluation_id"] for r in cells(s, d).select("evaluation_id").distinct().collect())  # a row per evaluation
    return search.combinations(s, names, 2).select("place", F.col("members")[0].alias("first"), F.col("members")[1].alias("second"))


@query("d13_leave_target_out_dispersion", f"WITH {SQL_CELLS}, o AS (SELECT a.model_id, a.evaluation_id, b.score AS x FROM c a JOIN c b ON a.evaluation_id = b.evaluation_id AND a.model_id <> b.model_id), m AS (SELECT model_id, evaluation_id, median(x) AS m FROM o GROUP BY 1, 2) SELECT o.evaluation_id, round(avg(dd), 5) AS mean_dispersion FROM (SELECT o.model_id, o.evaluation_id, 1.4826 * median(abs(x - m)) AS dd FROM o JOIN m USING (model_id, evaluation_id) GROUP BY 1, 2 HAVING count(*) >= 2) o GROUP BY 1")
def d13(s, d):
    """Median absolute deviation of the other models' scores, per cell, from order statistics."""
    c = cells(s, d).select("model_id", "evaluation_id", "score")
    return S.leave_one_out_mad(c, "evaluation_id", "score", "dd").where(F.col("dd").isNotNull()).groupBy("evaluation_id").agg(F.round(F.avg("dd"), 5).alias("mean_dispersion"))


@query("d14_context_dispersion", f"WITH {SQL_CELLS}, x AS (SELECT * FROM c WHERE model_id IN (SELECT model_id FROM c GROUP BY 1 HAVING count(*) >= 20)), m AS (SELECT evaluation_id, median(score) AS m FROM x GROUP BY 1) SELECT evaluation_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(1.4826 * median(abs(score - m)), 6) END AS dispersion FROM x JOIN m USING (evaluation_id) GROUP BY 1")
def d14(s, d):
    c = cells(s, d)
    context = c.groupBy("model_id").count().where("count >= 20").select("model_id")
    return S.mad(c.join(context, "model_id", "left_semi"), "evaluation_id", "score").select("evaluation_id", "n", F.round("dispersion", 6).alias("dispersion"))


@query("d21_linear_quantiles", f"WITH {SQL_CELLS} SELECT evaluation_id, round(quantile_cont(score, 0.1), 6) AS q10, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.9), 6) AS q90 FROM c GROUP BY 1")
def d21(s, d):
    q = S.linear_quantiles(cells(s, d).select("evaluation_id", "score"), "evaluation_id", "score", [0.1, 0.5, 0.9])
    return q.select("evaluation_id", *[F.round(F.col("qs")[i], 6).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@query("d38_rank_aggregate", f"WITH {_SQL_FOLDS}, x AS (SELECT 'mean' AS method, suite_id, abs(predicted - actual) AS e FROM p UNION ALL SELECT 'fifty', suite_id, abs(50 - actual) FROM p) SELECT method, suite_id, count(*) AS n, round(avg(e), 6) AS mae FROM x GROUP BY GROUPING SETS ((method), (method, suite_id))")
def d38(s, d):
    p = _fold_errors(s, d)
    pair = F.array(F.struct(F.lit("mean").alias("method"), F.abs(F.col("predicted") - F.col("actual")).alias("e")), F.struct(F.lit("fifty").alias("method"), F.abs(50.0 - F.col("actual")).alias("e")))
    x = p.select("suite_id", F.explode(pair).alias("x")).select("suite_id", "x.method", "x.e")
    return x.groupingSets([["method"], ["method", "suite_id"]], "method", "suite_id").agg(count_all().alias("n"), F.round(F.avg("e"), 6).alias("mae"))


@query("d40_repeat_summary", f"WITH {SQL_REPEATS}, m AS (SELECT suite_id, r, median(e) AS x FROM p GROUP BY 1, 2) SELECT suite_id, count(*) AS repeats, round(median(x), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3 FROM m GROUP BY 1 HAVING count(*) = 10")
def d40(s, d):
    """Median and quartiles of a suite's error over ten repeats; suites without all ten are left out."""
    m = repeated_errors(s, d).groupBy("suite_id", "r").agg(F.median("e").alias("x"))
    q = m.groupBy("suite_id").agg(count_all().alias("repeats"), F.round(F.median("x"), 6).alias("median"), F.round(F.percentile("x", 0.25), 6).alias("q1"), F.round(F.percentile("x", 0.75), 6).alias("q3"))
    return q.where("repeats = 10")


@query("e10_nearest_models", f"WITH {SQL_CELLS}, d AS (SELECT a.model_id, b.model_id AS near, round(sqrt(avg((a.score - b.score) ** 2)), 9) AS d FROM c a JOIN c b ON a.evaluation_id = b.evaluation_id AND a.model_id <> b.model_id GROUP BY 1, 2 HAVING count(*) >= 3) SELECT model_id, near, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY d, near) AS k FROM d) WHERE k <= 3")
def e10(s, d):
    p = S.overlap_pairs(cells(s, d), "model_id", "evaluation_id", 3).select("a", "b", F.round("rmse", 9).alias("d"))
    both = p.select(F.col("a").alias("model_id"), F.col("b").alias("near"), "d").unionByName(p.select(F.col("b").alias("model_id"), F.col("a").alias("near"), "d"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("model_id").orderBy("d", "near"))).where("place <= 3").select("model_id", "near", "place")


@query("e11_best_regressors", f"WITH {SQL_CELLS}, f AS (SELECT a.evaluation_id, b.evaluation_id AS other, round(regr_r2(a.score, b.score), 9) AS r2 FROM c a JOIN c b ON a.model_id = b.model_id AND a.evaluation_id <> b.evaluation_id GROUP BY 1, 2 HAVING count(*) >= 5 AND var_pop(a.score) * count(*) >= 1e-10 AND var_pop(b.score) * count(*) >= 1e-10) SELECT evaluation_id, other, round(r2, 6) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY r2 DESC, other) AS k FROM f) WHERE k <= 5 AND r2 >= 0.2")
def e11(s, d):
    p = S.overlap_pairs(cells(s, d), "evaluation_id", "model_id", 5).where((F.col("vx") * F.col("n") >= 1e-10) & (F.col("vy") * F.col("n") >= 1e-10))
    p = p.select("a", "b", F.round(F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy")), 9).alias("r2"))
    both = p.select(F.col("a").alias("evaluation_id"), F.col("b").alias("other"), "r2").unionByName(p.select(F.col("b").alias("evaluation_id"), F.col("a").alias("other"), "r2"))
    k = F.row_number().over(Window.partitionBy("evaluation_id").orderBy(F.desc("r2"), "other"))
    return both.withColumn("k", k).where((F.col("k") <= 5) & (F.col("r2") >= 0.2)).select("evaluation_id", "other", F.round("r2", 6).alias("r2"))


@query("e15_utility", f"WITH {SQL_PRED}, u AS (SELECT evaluation_id, round(median(abs(middle - actual)) - median(abs(predicted - actual)), 6) AS improvement FROM p GROUP BY 1) SELECT * FROM u WHERE improvement > 0 ORDER BY improvement DESC, evaluation_id LIMIT 8")
def e15(s, d):
    """The eight evaluations that gain most over the column median."""
    error = lambda c: F.median(F.abs(F.col(c) - F.col("actual")))
    u = predictions(s, d, middle=True).groupBy("evaluation_id").agg(F.round(error("middle") - error("predicted"), 6).alias("improvement"))
    return u.where("improvement > 0").orderBy(F.desc("improvement"), "evaluation_id").limit(8)


@query("e17_choice_key", f"WITH {SQL_PRED}, m AS (SELECT p.suite_id, evaluation_id, round(median(abs(predicted - actual)), 6) AS loss FROM p GROUP BY 1, 2), k AS (SELECT m.*, coalesce(try_cast(num_samples AS DOUBLE), 1e18) AS cost FROM m LEFT JOIN tasks USING (evaluation_id)) SELECT suite_id, evaluation_id FROM (SELECT *, row_number() OVER (PARTITION BY suite_id ORDER BY loss, cost, evaluation_id) AS n FROM k) WHERE n = 1")
def e17(s, d):
    m = predictions(s, d).groupBy("suite_id", "evaluation_id").agg(F.round(F.median(F.abs(F.col("predicted") - F.col("actual"))), 6).alias("loss"))
    cost = table(s, d, "tasks").select("evaluation_id", F.col("num_samples").try_cast("double").alias("c"))
    k = m.join(cost, "evaluation_id", "left").withColumn("cost", F.coalesce("c", F.lit(1e18)))
    return k.groupBy("suite_id").agg(F.min(F.struct("loss", "cost", "evaluation_id"))["evaluation_id"].alias("evaluation_id"))


@query("f5_probe_seeds", f"WITH {SQL_CELLS}, t AS (SELECT model_id, row_number() OVER (ORDER BY model_id) - 1 AS i FROM (SELECT DISTINCT model_id FROM c)) SELECT model_id, k, 42 + 1009 * seed + 97 * i + 13 * k AS draw_seed FROM t, (VALUES (1), (3), (5), (10)) a(k), (VALUES (0), (1)) b(seed)")
def f5(s, d):
    x = holdouts.probe_jobs(cells(s, d), (1, 3, 5, 10), (0, 1))
    return x.select("model_id", "k", "draw_seed")


@query("f5_probe_draws")
def f5_draws(s, d):
    """The probes of every model, number and seed, drawn by the parity generator among the model's own cells."""
    c = cells(s, d)
    return holdouts.probe_draws(c, holdouts.probe_jobs(c, (1, 3, 5, 10), (0, 1)))


@query("f8_random_split", f"WITH {SQL_CELLS}, m AS (SELECT DISTINCT model_id FROM c), o AS (SELECT model_id, row_number() OVER (ORDER BY md5('42|' || model_id)) AS k, count(*) OVER () AS n FROM m) SELECT model_id, CASE WHEN k <= round(0.7 * n) THEN 'train' ELSE 'validation' END AS role FROM o")
def f8(s, d):
    """Exactly 70 % of the models, in the order of a seeded hash."""
    m = cells(s, d).select("model_id").distinct().withColumn("h", F.md5(F.concat(F.lit("42|"), "model_id")))
    placed = S.global_place(m, "h", ["model_id"])
    return placed.select("model_id", F.when(F.col("place") <= F.round(0.7 * F.col("total")), "train").otherwise("validation").alias("role"))


@query("f16_screening", f"WITH {SQL_CELLS}, e AS (SELECT evaluation_id, count(*) AS n FROM c GROUP BY 1) SELECT evaluation_id, CASE WHEN t.evaluation_id IS NULL THEN 'no_task' WHEN try_cast(num_samples AS BIGINT) IS NULL THEN 'cost_unknown' WHEN n < 5 THEN 'too_few_scores' END AS reason FROM e LEFT JOIN tasks t USING (evaluation_id)")
def f16(s, d):
    e = cells(s, d).groupBy("evaluation_id").agg(count_all().alias("n"))
    t = table(s, d, "tasks").select("evaluation_id", F.lit(True).alias("known"), F.col("num_samples").try_cast("long").alias("cost"))
    reason = F.when(F.col("known").isNull(), "no_task").when(F.col("cost").isNull(), "cost_unknown").when(F.col("n") < 5, "too_few_scores")
    return e.join(t, "evaluation_id", "left").select("evaluation_id", reason.alias("reason"))


@query("f18_rank_sweep")
def f18(s, d):
    """Ranks 0 to 10 of the completion, and 1 to 10 of the iterated SVD on plain and logit scores, over three folds, each fit its own task."""
    kinds = [("als", "logit", r) for r in range(11)] + [("svd", t, r) for t in ("identity", "logit") for r in range(1, 11)]
    grid = s.createDataFrame([(f"{m}/{t}/{r}", m, t, r) for m, t, r in kinds], "setting string, method string, transform string, rank int")
    settings = grid.select(F.col("setting").alias("job_id"), "transform", "method", F.to_json(F.struct("rank")).alias("arguments"))
    p = fits.fit_grid(with_fold(cells(s, d), 3).select("model_id", "evaluation_id", "score", "fold"), settings, 3, named=False)
    e = p.groupBy(F.col("job_id").alias("setting")).agg(*S.error_columns())
    return grid.join(F.broadcast(e), "setting").drop("setting")  # a row per setting


_MARGINS = f"""{SQL_CELLS}, m AS (SELECT model_id, round(avg(score), 6) AS predicted FROM c GROUP BY 1), x AS (SELECT c.evaluation_id, c.model_id, score AS actual, predicted FROM c JOIN m USING (model_id))"""


_ABSOLUTE, _RELATIVE = (0.0, 0.5, 1.0, 2.0, 5.0, 10.0), (0.25, 0.5, 1.0)


@query("f19_margin_sweep", f"""WITH {_MARGINS}, st AS (SELECT evaluation_id, stddev_pop(score) AS sd, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM c GROUP BY 1),
mg AS (SELECT DISTINCT x.evaluation_id, 'absolute' AS kind, v AS multiple, v AS margin FROM x, (VALUES {', '.join(f'({v}::DOUBLE)' for v in _ABSOLUTE)}) t(v)
  UNION ALL SELECT evaluation_id, kind, v, round(v * CASE kind WHEN 'sd' THEN sd ELSE iqr END, 9) FROM st, (VALUES ('sd'), ('iqr')) k(kind), (VALUES {', '.join(f'({v}::DOUBLE)' for v in _RELATIVE)}) t(v)),
q AS (SELECT a.evaluation_id, a.actual AS ya, b.actual AS yb, (a.predicted > b.predicted)::INT AS ok FROM x a JOIN x b ON a.evaluation_id = b.evaluation_id AND a.actual > b.actual),
r AS (SELECT kind, multiple, mg.evaluation_id, count(q.ya) AS pairs, CAST(coalesce(sum(ok), 0) AS BIGINT) AS correct FROM mg LEFT JOIN q ON q.evaluation_id = mg.evaluation_id AND q.ya >= q.yb + margin GROUP BY 1, 2, 3)
SELECT kind, multiple, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(correct) AS BIGINT) AS correct, round(median(correct / pairs) FILTER (WHERE pairs > 0), 6) AS median_accuracy FROM r GROUP BY 1, 2""")
def f19(s, d):
    """Pairwise accuracy under six absolute margins and three multiples of each column's spread and interquartile range."""
    c = cells(s, d)
    x = c.join(c.groupBy("model_id").agg(F.round(F.avg("score"), 6).alias("predicted")), "model_id").select("evaluation_id", "model_id", F.col("score").alias("actual"), "predicted", F.lit(True).alias("held"))
    stats = c.groupBy("evaluation_id").agg(F.stddev_pop("score").alias("sd"), F.percentile("score", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    sd, iqr = F.col("sd"), F.col("q")[1] - F.col("q")[0]
    each = [F.struct(F.lit("absolute").alias("kind"), F.lit(v).alias("multiple"), F.lit(v).alias("margin")) for v in _ABSOLUTE]
    each += [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("multiple"), F.round(v * w, 9).alias("margin")) for k, w in (("sd", sd), ("iqr", iqr)) for v in _RELATIVE]
    margins = stats.select("evaluation_id", F.array(*each).alias("margins"))
    counted = S.concordance_margins(x, "evaluation_id", margins)
    share = F.when(F.col("pairs") > 0, F.col("correct") / F.col("pairs"))
    return counted.groupBy("kind", "multiple").agg(F.sum("pairs").alias("pairs"), F.sum("correct").alias("correct"), F.round(F.median(share), 6).alias("median_accuracy"))


@query("g17_supported_axes", f"WITH {SQL_CELLS}, f AS (SELECT *, {SQL_FOLD} AS fold FROM c), x AS (SELECT * FROM f WHERE fold > 1), h AS (SELECT * FROM f WHERE fold <= 1) SELECT (SELECT count(DISTINCT model_id) FROM x) AS models, (SELECT count(DISTINCT evaluation_id) FROM x) AS evaluations, count(*) AS held, count(*) FILTER (WHERE model_id NOT IN (SELECT model_id FROM x) OR evaluation_id NOT IN (SELECT evaluation_id FROM x)) AS unsupported FROM h")
def g17(s, d):
    f = with_fold(cells(s, d))
    train, held = f.where("fold > 1"), f.where("fold <= 1")
    ok = held.join(train.select("model_id").distinct(), "model_id", "left_semi").join(train.select("evaluation_id").distinct(), "evaluation_id", "left_semi")
    axes = train.agg(F.countDistinct("model_id").alias("models"), F.countDistinct("evaluation_id").alias("evaluations"))
    both = axes.crossJoin(F.broadcast(held.agg(count_all().alias("held")))).crossJoin(F.broadcast(ok.agg(count_all().alias("k"))))  # one row each
    return both.select("models", "evaluations", "held", (F.col("held") - F.col("k")).alias("unsupported"))


@query("g23_crossfit_trust", f"""WITH {_SQL_FOLDS}, sd AS (SELECT evaluation_id, round(stddev_pop(score), 9) AS risk FROM c GROUP BY 1), k AS (SELECT p.*, risk, (abs(predicted - actual) <= 10)::INT AS ok FROM p JOIN sd USING (evaluation_id)),
tr AS (SELECT t.fold AS target, k.risk, k.ok, k.model_id, k.evaluation_id FROM k JOIN (SELECT DISTINCT fold FROM k) t ON t.fold <> k.fold), b AS (SELECT target, bin, avg(ok) AS event, median(risk) AS middle FROM (SELECT *, ntile(20) OVER (PARTITION BY target ORDER BY risk, model_id, evaluation_id) AS bin FROM tr) GROUP BY 1, 2)
SELECT target AS fold, CAST(bin AS BIGINT) AS bin, round(event, 6) AS event, round(middle, 6) AS risk FROM b""")
def g23(s, d):
    p = _fold_errors(s, d)
    sd = cells(s, d).groupBy("evaluation_id").agg(F.round(F.stddev_pop("score"), 9).alias("risk"))
    k = p.join(sd, "evaluation_id").withColumn("ok", (F.abs(F.col("predicted") - F.col("actual")) <= 10).cast("double"))
    folds = F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)])).alias("target")
    train = k.select("fold", "risk", "ok", "model_id", "evaluation_id", folds).where("fold <> target")
    # ties are broken by id inside equal risks; counts below come from value counts per target
    counts = S.value_counts_below(train, "target", "risk").select(F.col("target").alias("_t"), F.col("risk").alias("_r"), "below", "total")
    among = F.row_number().over(Window.partitionBy("target", "risk").orderBy("model_id", "evaluation_id"))
    placed = train.withColumn("_a", among).join(counts, (F.col("target") == F.col("_t")) & (F.col("risk") == F.col("_r")))
    binned = placed.withColumn("bin", S.equal_count_bin(F.col("below") + F.col("_a"), F.col("total"), 20))
    return binned.groupBy(F.col("target").alias("fold"), "bin").agg(F.round(F.avg("ok"), 6).alias("event"), F.round(F.median("risk"), 6).alias("risk"))


@query("g25_score_bundle", f"""WITH {SQL_PRED}, sd AS (SELECT evaluation_id, stddev_samp(score) AS sd FROM c GROUP BY 1), o AS (SELECT a.model_id, a.evaluation_id, b.score AS x FROM c a JOIN c b ON a.evaluation_id = b.evaluation_id AND a.model_id <> b.model_id), om AS (SELECT model_id, evaluation_id, median(x) AS m FROM o GROUP BY 1, 2),
dd AS (SELECT model_id, evaluation_id, 1.4826 * median(abs(x - m)) AS dd FROM o JOIN om USING (model_id, evaluation_id) GROUP BY 1, 2 HAVING count(*) >= 2), e AS (SELECT p.*, abs(predicted - actual) AS e, sd, dd FROM p LEFT JOIN sd USING (evaluation_id) LEFT JOIN dd USING (model_id, evaluation_id))
SELECT suite_id, count(*) AS n, round(avg(e), 6) AS mae, round(median(e), 6) AS medae, round(median(100 * e / abs(actual)) FILTER (WHERE abs(actual) > 1e-6), 6) AS medape, round(median(e / sd) FILTER (WHERE sd > 0), 6) AS medae_by_column, round(median(e / dd) FILTER (WHERE dd > 1e-9), 5) AS medae_by_others, count(DISTINCT model_id) AS models FROM e GROUP BY 1""")
def g25(s, d):
    """Errors of a suite, also over the column's spread and over the deviation of the other models' scores."""
    c = cells(s, d).select("model_id", "evaluation_id", "score")
    sd = c.groupBy("evaluation_id").agg(F.stddev_samp("score").alias("sd"))
    others = S.leave_one_out_mad(c, "evaluation_id", "score", "dd").select("model_id", "evaluation_id", "dd")
    p = predictions(s, d).join(sd, "evaluation_id", "left").join(others, ["model_id", "evaluation_id"], "left").withColumn("e", F.abs(F.col("predicted") - F.col("actual")))
    over = lambda c, least: F.median(F.when(F.col(c) > least, F.col("e") / F.col(c)))
    return p.groupBy("suite_id").agg(
        count_all().alias("n"), F.round(F.avg("e"), 6).alias("mae"), F.round(F.median("e"), 6).alias("medae"), F.round(F.median(F.when(F.abs("actual") > S.APE_FLOOR, 100 * F.col("e") / F.abs("actual"))), 6).alias("medape"),
        F.round(over("sd", 0), 6).alias("medae_by_column"), F.round(over("dd", 1e-9), 5).alias("medae_by_others"), F.countDistinct("model_id").alias("models"),
    )


@query("g29_matched_replay")
def g29(s, d):
    """Five probe arms (none, most observed, random, greedy, greedy among cheap tasks), refitted for the same targets and scored on the cells no arm reveals, pooled and as the median over folds of models.

    The greedy arms take their probes by regression on the probes' mean z-score, as a search that refits would fit every arm anew.
    """
    c = cells(s, d)
    ranked = c.groupBy("evaluation_id").agg(count_all().alias("n"))
    names = lambda frame: frame.agg(F.array_sort(F.collect_list("evaluation_id")).alias("probes"))
    cheap = table(s, d, "tasks").where(F.col("num_samples").try_cast("double") <= 5_000).select("evaluation_id")
    arms = names(ranked.orderBy(F.desc("n"), "evaluation_id").limit(4)).withColumn("arm", F.lit("supported"))
    arms = arms.unionByName(names(ranked.orderBy(F.md5("evaluation_id")).limit(4)).withColumn("arm", F.lit("random")))
    arms = arms.unionByName(names(search.greedy_probes(c, 4)).withColumn("arm", F.lit("greedy"))).unionByName(names(search.greedy_probes(c, 4, cheap)).withColumn("arm", F.lit("allowlist")))
    arms = cut(arms.unionByName(arms.limit(1).select(F.array().cast("array<string>").alias("probes"), F.lit("none").alias("arm"))))
    targets = c.select("model_id").distinct()
    jobs = targets.crossJoin(F.broadcast(arms)).select(F.concat("arm", F.lit("/"), "model_id").alias("job_id"), F.col("model_id").alias("target"), "probes", F.lit(None).cast("array<string>").alias("context"))  # five arms
    p = cut(fits.fit_targets(c, jobs, own_cells=True).withColumn("arm", F.substring_index("job_id", "/", 1)))
    matched = p.groupBy("model_id", "evaluation_id").agg(F.countDistinct("arm").alias("k")).where("k = 5").select("model_id", "evaluation_id")
    truth = c.select("model_id", "evaluation_id", F.col("score").alias("actual"))
    rows = p.join(matched, ["model_id", "evaluation_id"], "left_semi").join(truth, ["model_id", "evaluation_id"])
    rows = rows.withColumn("fold", F.conv(F.substring(F.md5("model_id"), 1, 6), 16, 10).cast("long") % 5)
    folds = rows.groupBy("arm", "fold").agg(F.median(F.abs(F.col("predicted") - F.col("actual"))).alias("m")).groupBy("arm").agg(F.round(F.median("m"), 6).alias("median_of_folds"))
    return rows.groupBy("arm").agg(*S.error_columns()).join(folds, "arm")


@query("e20_label_spacing", f"WITH {SQL_CELLS}, m AS (SELECT suite_id, evaluation_id, round(avg(score), 6) AS x FROM c GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY suite_id ORDER BY x, evaluation_id) AS i FROM m) SELECT suite_id, evaluation_id, round(max(x - 2.5 * i) OVER (PARTITION BY suite_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 2.5 * i, 6) AS place FROM o")
def e20(s, d):
    """Labels of a suite's evaluations at their means, pushed up so that neighbours are at least 2.5 apart."""
    m = cells(s, d).groupBy("suite_id", "evaluation_id").agg(F.round(F.avg("score"), 6).alias("x"))
    return S.spaced(m, "suite_id", "x", "evaluation_id", 2.5).select("suite_id", "evaluation_id", F.round("place", 6).alias("place"))


@query("trust_by_suite", f"WITH {SQL_PRED}, t AS (SELECT *, (abs(predicted - actual) <= 10)::INT AS ok, round(dispersion, 9) AS risk FROM p), o AS (SELECT *, ntile(20) OVER (ORDER BY risk, model_id, evaluation_id) AS bin FROM t) SELECT suite_id, round(avg(bin), 6) AS mean_bin, round(avg(ok), 6) AS event FROM o GROUP BY 1")
def trust_by_suite(s, d):
    return _trust_rows(s, d).groupBy("suite_id").agg(F.round(F.avg("bin"), 6).alias("mean_bin"), F.round(F.avg("ok"), 6).alias("event"))


@query("b11_clip", f"WITH {SQL_CELLS} SELECT suite_id, round(avg(greatest(0, least(100, score * 1.5 - 20))), 6) AS clipped FROM c GROUP BY 1")
def b11(s, d):
    x = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") * 1.5 - 20))
    return cells(s, d).groupBy("suite_id").agg(F.round(F.avg(x), 6).alias("clipped"))


@query("b14_strict_aliases", f"WITH a AS (SELECT DISTINCT {sql_key('model_id')} AS k FROM model_metadata), x AS (SELECT {sql_key('model_alias')} AS k, suite_id FROM {HIBOU} WHERE model_alias IS NOT NULL) SELECT suite_id, k IN (SELECT k FROM a) AS known, count(*) AS n FROM x GROUP BY 1, 2")
def b14(s, d):
    """Aliases that resolve to a registered model, and those a strict reader would refuse, by suite."""
    known = table(s, d, "model_metadata").select(same_key("model_id").alias("k")).distinct().withColumn("known", F.lit(True))
    x = table(s, d, HIBOU).where(F.col("model_alias").isNotNull()).select("suite_id", same_key("model_alias").alias("k"))
    return x.join(known, "k", "left").groupBy("suite_id", F.coalesce("known", F.lit(False)).alias("known")).agg(count_all().alias("n"))


@query("b16_text_search", "SELECT model_id, family, provider FROM model_metadata WHERE contains(lower(model_id), 'slide') OR contains(lower(coalesce(provider, '')), 'health')")
def b16(s, d):
    hit = F.contains(F.lower("model_id"), F.lit("slide")) | F.contains(F.lower(F.coalesce("provider", F.lit(""))), F.lit("health"))
    return table(s, d, "model_metadata").where(hit).select("model_id", "family", "provider")


@query("e12_greedy_argmin", f"WITH {_SQL_FOLDS}, m AS (SELECT fold, evaluation_id, round(median(abs(predicted - actual)), 6) AS loss FROM p GROUP BY 1, 2) SELECT fold, evaluation_id, loss FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY loss, evaluation_id) AS n FROM m) WHERE n = 1")
def e12(s, d):
    m = _fold_errors(s, d).groupBy("fold", "evaluation_id").agg(F.round(F.median(F.abs(F.col("predicted") - F.col("actual"))), 6).alias("loss"))
    best = m.groupBy("fold").agg(F.min(F.struct("loss", "evaluation_id")).alias("b"))
    return best.select("fold", "b.evaluation_id", "b.loss")


@query("h6_predict")
def h6(s, d):
    """All cells of one model: the observed score if there is one, else the completion with its interval and trust."""
    opened = ScoreTable.open(table(s, d, "scores"))
    target = opened.models().orderBy(F.desc("observed"), "model_id").first()["model_id"]
    return opened.predict(target, confidence=True)


@query("h11_export_scores", f"WITH {SQL_CELLS} SELECT c.model_id, c.evaluation_id, c.suite_id, t.task_family, round(score, 6) AS score FROM c LEFT JOIN tasks t USING (evaluation_id)")
def h11(s, d):
    t = table(s, d, "tasks").select("evaluation_id", "task_family")
    return cells(s, d).join(t, "evaluation_id", "left").select("model_id", "evaluation_id", "suite_id", "task_family", F.round("score", 6).alias("score"))


@query("a1_score_scan", "SELECT model_id, evaluation_id, value, normalized_score, suite_id, metric, reference_url, audit_status FROM scores WHERE audit_status IN ('verified', 'parsed_primary_source')")
def a1(s, d):
    """The eight columns of the score scan; filter and columns reach the Parquet reader."""
    keep = F.col("audit_status").isin("verified", "parsed_primary_source")
    return table(s, d, "scores").where(keep).select("model_id", "evaluation_id", "value", "normalized_score", "suite_id", "metric", "reference_url", "audit_status")


@query("a17_text_tables")
def a17(s, d):
    """Rows of Markdown tables inside the documents."""
    return markdown_tables(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")
