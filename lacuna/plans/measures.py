"""Filters, aggregates, windows and rankings over the score table (inventory groups B, D, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lacuna.functions.columns import correlation, count_all
from lacuna.operators import cells as C
from lacuna.operators import stats as S
from lacuna.plans.base import SQL_CELLS, SQL_FOLD, SQL_PRED, SQL_REPEATS, cells, predictions, repeated_errors, with_fold
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




@query("b1_status_filter", "SELECT audit_status, count(*) AS n FROM scores WHERE audit_status IN ('verified', 'parsed_primary_source') GROUP BY 1")
def b1(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scores").where(F.col("audit_status").isin(C.ACCEPTED)).groupBy("audit_status").agg(count_all().alias("n"))


_ROUND = "r{0}r AS (SELECT model_id FROM r{1} GROUP BY 1 HAVING count(*) >= 20), r{0}c AS (SELECT evaluation_id FROM r{1} GROUP BY 1 HAVING count(*) >= 15), r{0} AS (SELECT r{1}.* FROM r{1} SEMI JOIN r{0}r USING (model_id) SEMI JOIN r{0}c USING (evaluation_id))"


@query("b2_support_core", f"WITH {SQL_CELLS}, r0 AS (SELECT * FROM c), {', '.join(_ROUND.format(i, i - 1) for i in range(1, 13))} SELECT model_id, evaluation_id, round(score, 6) AS score FROM r12")
def b2(s, d):
    return C.support_core(cells(s, d), 20, 15).select("model_id", "evaluation_id", F.round("score", 6).alias("score"))


@query("b3_finite", "SELECT count(*) FILTER (WHERE isfinite(c1)) AS finite_c1, count(*) FILTER (WHERE c1 IS NOT NULL AND NOT isfinite(c1)) AS strange_c1, count(*) AS n FROM score_matrix_wide")
def b3(s, d):
    strange = F.col("c1").isNotNull() & ~C.finite("c1")
    return table(s, d, "score_matrix_wide").agg(F.sum(C.finite("c1").cast("long")).alias("finite_c1"), F.sum(strange.cast("long")).alias("strange_c1"), count_all().alias("n"))


@query("b4_logit", f"WITH {SQL_CELLS}, x AS (SELECT evaluation_id, ln(q / (1 - q)) AS z FROM (SELECT *, greatest(0.5, least(99.5, score)) / 100 AS q FROM c)) SELECT evaluation_id, round(avg(z), 6) AS mean_logit, round(avg(100 / (1 + exp(-z))), 6) AS mean_back FROM x GROUP BY 1")
def b4(s, d):
    x = cells(s, d).withColumn("z", C.logit_percent(F.col("score")))
    return x.groupBy("evaluation_id").agg(F.round(F.avg("z"), 6).alias("mean_logit"), F.round(F.avg(C.percent_of_logit(F.col("z"))), 6).alias("mean_back"))


@query("b5_transforms", f"WITH {SQL_CELLS} SELECT suite_id, round(avg(ln(1 + greatest(score, 0))), 6) AS log1p, round(avg(asinh(score / 50)), 6) AS asinh, round(avg(sqrt(greatest(score, 0))), 6) AS sqrt FROM c GROUP BY 1")
def b5(s, d):
    x = F.col("score")
    zero = F.greatest(x, F.lit(0.0))
    return cells(s, d).groupBy("suite_id").agg(F.round(F.avg(F.log1p(zero)), 6).alias("log1p"), F.round(F.avg(F.asinh(x / 50)), 6).alias("asinh"), F.round(F.avg(F.sqrt(zero)), 6).alias("sqrt"))


@query("b5_quantile_transform", f"WITH {SQL_CELLS}, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY evaluation_id, score) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY evaluation_id) AS n FROM c WINDOW w AS (PARTITION BY evaluation_id ORDER BY score)) SELECT model_id, evaluation_id, round(k / (n + 1), 6) AS q FROM r")
def b5q(s, d):
    c = cells(s, d).select("model_id", "evaluation_id", "score")
    sizes = c.groupBy("evaluation_id").agg(count_all().alias("n"))
    return S.average_ranks(c, "evaluation_id", "score").join(sizes, "evaluation_id").select("model_id", "evaluation_id", F.round(F.col("avg_rank") / (F.col("n") + 1), 6).alias("q"))


@query("b6_percentage_columns", f"WITH {SQL_CELLS} SELECT evaluation_id, min(score) >= -1 AND max(score) <= 101 AS is_percentage FROM c GROUP BY 1")
def b6(s, d):
    return C.percentage_columns(cells(s, d))


_NATIVE = "CASE WHEN metric IN ('mean_pearson_r', 'pearson_r', 'weighted_kappa', 'clustering_score') THEN score / 50 - 1 WHEN metric IN ('auroc', 'balanced_accuracy', 'dice', 'f1_score', 'macro_ovr_auc', 'top1_accuracy') THEN score / 100 ELSE score END"


@query("b7_native_scores", f"WITH {SQL_CELLS} SELECT metric, count(*) AS n, round(avg({_NATIVE}), 6) AS mean_native, round(min({_NATIVE}), 6) AS least_native FROM c GROUP BY 1")
def b7(s, d):
    x = C.native_score(F.col("score"), F.col("metric"))
    return cells(s, d).groupBy("metric").agg(count_all().alias("n"), F.round(F.avg(x), 6).alias("mean_native"), F.round(F.min(x), 6).alias("least_native"))


@query("b8_normalised_scores", "SELECT metric, round(avg(CASE WHEN metric = 'mean_pearson_r' THEN (value + 1) * 50 ELSE value * 100 END), 6) AS mean_normalised, count(*) AS n FROM scores GROUP BY 1")
def b8(s, d):
    return table(s, d, "scores").groupBy("metric").agg(F.round(F.avg(C.normalised_score(F.col("value"), F.col("metric"))), 6).alias("mean_normalised"), count_all().alias("n"))


@query("b9_medape", f"WITH {SQL_PRED} SELECT suite_id, count(*) AS n, round(median(100 * abs(predicted - actual) / abs(actual)), 6) AS medape FROM p WHERE abs(actual) > 1e-6 GROUP BY 1")
def b9(s, d):
    p = predictions(s, d).where(F.abs("actual") > S.APE_FLOOR)
    return p.groupBy("suite_id").agg(count_all().alias("n"), F.round(F.median(100 * F.abs(F.col("predicted") - F.col("actual")) / F.abs("actual")), 6).alias("medape"))


@query("b10_relative_width", f"WITH {SQL_PRED} SELECT suite_id, round(median(2 * dispersion / abs(actual)), 6) AS median_relative_width FROM p WHERE abs(actual) > 1e-8 GROUP BY 1")
def b10(s, d):
    p = predictions(s, d).where(F.abs("actual") > 1e-8)
    return p.groupBy("suite_id").agg(F.round(F.median(2 * F.col("dispersion") / F.abs("actual")), 6).alias("median_relative_width"))


@query("b12_formats", f"WITH {SQL_CELLS} SELECT model_id, evaluation_id, printf('%.6f', score) AS six FROM c")
def b12(s, d):
    return cells(s, d).select("model_id", "evaluation_id", F.format_string("%.6f", F.col("score")).alias("six"))


@query("b13_slugs", "SELECT DISTINCT provider, trim(regexp_replace(lower(provider), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM model_metadata WHERE provider IS NOT NULL")
def b13(s, d):
    slug = F.btrim(F.regexp_replace(F.lower("provider"), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(s, d, "model_metadata").where(F.col("provider").isNotNull()).select("provider", slug.alias("slug")).distinct()


_TASK_N = "try_cast(num_samples AS BIGINT)"
_FEASIBLE = f"CASE WHEN sample_unit NOT IN ('image', 'patch', 'tile') THEN 'unit' WHEN task_type <> 'classification' THEN 'type' WHEN {_TASK_N} IS NULL THEN 'count_unknown' WHEN {_TASK_N} > 10000 THEN 'too_many' ELSE 'feasible' END"


@query("b17_feasibility", f"SELECT {_FEASIBLE} AS reason, count(*) AS n FROM tasks GROUP BY 1")
def b17(s, d):
    n = F.col("num_samples").try_cast("long")
    reason = F.when(~F.col("sample_unit").isin("image", "patch", "tile") , "unit").when(F.col("task_type") != "classification", "type").when(n.isNull(), "count_unknown").when(n > 10000, "too_many").otherwise("feasible")
    return table(s, d, "tasks").groupBy(reason.alias("reason")).agg(count_all().alias("n"))


@query("b18_feasibility_tiers", f"SELECT evaluation_id, CASE WHEN {_TASK_N} IS NULL THEN 4 WHEN sample_unit = 'tile' AND {_TASK_N} <= 10000 THEN 1 WHEN sample_unit = 'tile' THEN 2 WHEN {_TASK_N} <= 1000 THEN 2 ELSE 3 END AS tier FROM tasks")
def b18(s, d):
    n, tile = F.col("num_samples").try_cast("long"), F.col("sample_unit") == "tile"
    tier = F.when(n.isNull(), 4).when(tile & (n <= 10000), 1).when(tile, 2).when(n <= 1000, 2).otherwise(3)
    return table(s, d, "tasks").select("evaluation_id", tier.alias("tier"))


@query("b19_blank_checks", "SELECT audit_status, count(*) FILTER (WHERE normalized_score IS NULL) AS blank_scores, count(*) FILTER (WHERE coalesce(trim(review_status), '') = '') AS blank_reviews FROM scores GROUP BY 1")
def b19(s, d):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return table(s, d, "scores").groupBy("audit_status").agg(F.sum(F.col("normalized_score").isNull().cast("long")).alias("blank_scores"), F.sum(blank("review_status").cast("long")).alias("blank_reviews"))


@query("b21_review_ids", "SELECT model_id, evaluation_id, 'review.' || substr(sha256(model_id || chr(31) || evaluation_id), 1, 20) AS review_id FROM scores")
def b21(s, d):
    return table(s, d, "scores").select("model_id", "evaluation_id", F.concat(F.lit("review."), F.substring(F.sha2(F.concat("model_id", F.lit("\x1f"), "evaluation_id"), 256), 1, 20)).alias("review_id"))


# ---- D: aggregates ----


@query("d1_density", f"WITH {SQL_CELLS} SELECT count(*) AS observed, count(DISTINCT model_id) AS models, count(DISTINCT evaluation_id) AS evaluations, round(count(*) / (count(DISTINCT model_id) * count(DISTINCT evaluation_id)), 6) AS density FROM c")
def d1(s, d):
    return C.density(cells(s, d))


@query("d2_column_moments", f"WITH {SQL_CELLS} SELECT evaluation_id, count(*) AS n, round(avg(score), 6) AS mean, round(CASE WHEN stddev_pop(score) < 1e-12 THEN 1 ELSE stddev_pop(score) END, 6) AS sd FROM c GROUP BY 1")
def d2(s, d):
    return C.column_moments(cells(s, d)).select("evaluation_id", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_ERR = """count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae, round(median(abs(predicted - actual)), 6) AS medae,
 round(median(100 * abs(predicted - actual) / abs(actual)) FILTER (WHERE abs(actual) > 1e-6), 6) AS medape,
 round(avg((abs(predicted - actual) <= 1)::INT), 6) AS within_1, round(avg((abs(predicted - actual) <= 3)::INT), 6) AS within_3,
 round(avg((abs(predicted - actual) <= 5)::INT), 6) AS within_5, round(avg((abs(predicted - actual) <= 10)::INT), 6) AS within_10"""


@query("d3_d4_errors", f"WITH {SQL_PRED} SELECT {_ERR} FROM p")
def d3(s, d):
    return S.error_summary(predictions(s, d))


@query("d5_spread_summary", f"WITH {SQL_REPEATS}, m AS (SELECT suite_id, r, median(e) AS x FROM p GROUP BY 1, 2) SELECT suite_id, count(*) AS repeats, round(median(x), 6) AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM m GROUP BY 1")
def d5(s, d):
    """Median errors of suites over ten repeats: their median, spread, mean and deviation."""
    m = repeated_errors(s, d).groupBy("suite_id", "r").agg(F.median("e").alias("x"))
    return m.groupBy("suite_id").agg(count_all().alias("repeats"), F.round(F.median("x"), 6).alias("median"), F.round(F.percentile("x", 0.75) - F.percentile("x", 0.25), 6).alias("iqr"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))


def _fold_errors(s, d):
    """Every fold predicted by the column means of the other folds: totals minus the fold's own sums."""
    folded = with_fold(cells(s, d))
    by_fold = folded.groupBy("evaluation_id", "fold").agg(F.sum("score").alias("fs"), count_all().alias("fn"))
    whole = by_fold.groupBy("evaluation_id").agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    rest = by_fold.join(whole, "evaluation_id").where(F.col("tn") > F.col("fn")).select("evaluation_id", "fold", ((F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn"))).alias("predicted"))
    return folded.join(rest, ["evaluation_id", "fold"]).select("model_id", "evaluation_id", "suite_id", "fold", F.col("score").alias("actual"), "predicted")


_SQL_FOLDS = f"""{SQL_CELLS}, f AS (SELECT *, {SQL_FOLD} AS fold FROM c),
p AS (SELECT a.model_id, a.evaluation_id, a.suite_id, a.fold, any_value(a.score) AS actual, avg(b.score) AS predicted FROM f a JOIN f b ON a.evaluation_id = b.evaluation_id AND a.fold <> b.fold GROUP BY ALL)"""


@query("d6_fold_medians", f"WITH {_SQL_FOLDS}, m AS (SELECT fold, median(abs(predicted - actual)) AS e FROM p GROUP BY 1) SELECT round(median(e), 6) AS median_of_folds, (SELECT round(median(abs(predicted - actual)), 6) FROM p) AS pooled FROM m")
def d6(s, d):
    e = _fold_errors(s, d).withColumn("e", F.abs(F.col("predicted") - F.col("actual")))
    per = e.groupBy("fold").agg(F.median("e").alias("m")).agg(F.round(F.median("m"), 6).alias("median_of_folds"))
    return per.crossJoin(F.broadcast(e.agg(F.round(F.median("e"), 6).alias("pooled"))))  # two rows in all


@query("d7_model_average_error", f"WITH {SQL_PRED}, m AS (SELECT model_id, abs(avg(predicted) - avg(actual)) AS e FROM p GROUP BY 1) SELECT count(*) AS models, round(median(e), 6) AS median_error, round(avg(e), 6) AS mean_error FROM m")
def d7(s, d):
    m = predictions(s, d).groupBy("model_id").agg(F.abs(F.avg("predicted") - F.avg("actual")).alias("e"))
    return m.agg(count_all().alias("models"), F.round(F.median("e"), 6).alias("median_error"), F.round(F.avg("e"), 6).alias("mean_error"))


_PARITY = f"""{_SQL_FOLDS}, q AS (SELECT *, fold = 1 AS revealed, CASE WHEN fold = 1 THEN 0 ELSE abs(predicted - actual) END AS e FROM p)"""


@query("d8_denominators", f"WITH {_PARITY} SELECT suite_id, count(*) AS parity_n, round(median(e), 6) AS parity_medae, count(*) FILTER (WHERE NOT revealed) AS hidden_n, round(median(e) FILTER (WHERE NOT revealed), 6) AS hidden_medae, count(DISTINCT model_id) AS average_n FROM q GROUP BY 1")
def d8(s, d):
    p = _fold_errors(s, d)
    hidden = F.col("fold") != 1
    e = F.when(hidden, F.abs(F.col("predicted") - F.col("actual"))).otherwise(0.0)
    return p.groupBy("suite_id").agg(count_all().alias("parity_n"), F.round(F.median(e), 6).alias("parity_medae"), F.sum(hidden.cast("long")).alias("hidden_n"), F.round(F.median(F.when(hidden, e)), 6).alias("hidden_medae"), F.countDistinct("model_id").alias("average_n"))


@query("d9_column_hidden_error", f"WITH {SQL_PRED}, h AS (SELECT evaluation_id, median(abs(predicted - actual)) AS e FROM p GROUP BY 1) SELECT a.evaluation_id, round(h.e, 6) AS hidden_medae FROM (SELECT DISTINCT evaluation_id FROM c) a LEFT JOIN h USING (evaluation_id)")
def d9(s, d):
    h = predictions(s, d).groupBy("evaluation_id").agg(F.round(F.median(F.abs(F.col("predicted") - F.col("actual"))), 6).alias("hidden_medae"))
    return cells(s, d).select("evaluation_id").distinct().join(h, "evaluation_id", "left")


@query("d10_in_sample_baseline", f"WITH {SQL_CELLS}, m AS (SELECT evaluation_id, median(score) AS m FROM c GROUP BY 1) SELECT evaluation_id, round(median(abs(score - m)), 6) AS baseline FROM c JOIN m USING (evaluation_id) GROUP BY 1")
def d10(s, d):
    c = cells(s, d)
    m = c.groupBy("evaluation_id").agg(F.median("score").alias("m"))
    return c.join(m, "evaluation_id").groupBy("evaluation_id").agg(F.round(F.median(F.abs(F.col("score") - F.col("m"))), 6).alias("baseline"))


_LOO = f"""{SQL_CELLS}, l AS (SELECT a.model_id, a.evaluation_id, any_value(a.score) AS score, median(b.score) AS m FROM c a LEFT JOIN c b ON a.evaluation_id = b.evaluation_id AND a.model_id <> b.model_id GROUP BY 1, 2)"""


@query("d11_leave_one_out_median", f"WITH {_LOO} SELECT model_id, evaluation_id, round(m, 6) AS loo_median FROM l")
def d11(s, d):
    return S.leave_one_out_median(cells(s, d), "evaluation_id", "score").select("model_id", "evaluation_id", F.round("loo_median", 6).alias("loo_median"))


@query("d11_loo_baseline", f"WITH {_LOO} SELECT evaluation_id, round(median(abs(score - m)), 6) AS baseline FROM l GROUP BY 1")
def d11b(s, d):
    l = S.leave_one_out_median(cells(s, d), "evaluation_id", "score")
    return l.groupBy("evaluation_id").agg(F.round(F.median(F.abs(F.col("score") - F.col("loo_median"))), 6).alias("baseline"))


@query("d12_mad", f"WITH {SQL_CELLS}, m AS (SELECT evaluation_id, median(score) AS m FROM c GROUP BY 1) SELECT evaluation_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(1.4826 * median(abs(score - m)), 6) END AS dispersion FROM c JOIN m USING (evaluation_id) GROUP BY 1")
def d12(s, d):
    return S.mad(cells(s, d), "evaluation_id", "score").select("evaluation_id", "n", F.round("dispersion", 6).alias("dispersion"))


@query("d15_column_sd", f"WITH {SQL_CELLS} SELECT evaluation_id, round(stddev_pop(score), 6) AS sd FROM c GROUP BY 1")
def d15(s, d):
    return cells(s, d).groupBy("evaluation_id").agg(F.round(F.stddev_pop("score"), 6).alias("sd"))


_SKILL = f"""{_LOO}, base AS (SELECT evaluation_id, median(abs(score - m)) AS b FROM l GROUP BY 1), pr AS (WITH {SQL_PRED} SELECT evaluation_id, median(abs(predicted - actual)) AS e FROM p GROUP BY 1),
k AS (SELECT base.evaluation_id, e, b, CASE WHEN e IS NULL THEN 'no_model_error' WHEN b IS NULL OR b <= 0 THEN 'degenerate_baseline' WHEN b < 0.5 THEN 'noise_floor' END AS reason FROM base LEFT JOIN pr USING (evaluation_id))"""


def _skills(s, d):
    base = S.leave_one_out_median(cells(s, d), "evaluation_id", "score").groupBy("evaluation_id").agg(F.median(F.abs(F.col("score") - F.col("loo_median"))).alias("b"))
    err = predictions(s, d).groupBy("evaluation_id").agg(F.median(F.abs(F.col("predicted") - F.col("actual"))).alias("e"))
    skill, reason = S.column_skill(F.col("e"), F.col("b"))
    return base.join(err, "evaluation_id", "left").withColumn("skill", skill).withColumn("reason", reason)


@query("d16_column_skill", f"WITH {_SKILL} SELECT evaluation_id, CASE WHEN reason IS NULL THEN round(greatest(-1, least(1, 1 - e / b)), 6) END AS skill, reason FROM k")
def d16(s, d):
    return _skills(s, d).select("evaluation_id", F.round("skill", 6).alias("skill"), "reason")


@query("d17_positive_fraction", f"WITH {_SKILL} SELECT count(*) AS columns, count(*) FILTER (WHERE reason IS NULL) AS scored, count(*) FILTER (WHERE reason IS NULL AND e < b) AS positive, round(count(*) FILTER (WHERE reason IS NULL AND e < b) / count(*) FILTER (WHERE reason IS NULL), 6) AS fraction FROM k")
def d17(s, d):
    k = _skills(s, d)
    scored, better = F.col("reason").isNull(), F.col("reason").isNull() & (F.col("e") < F.col("b"))
    out = k.agg(count_all().alias("columns"), F.sum(scored.cast("long")).alias("scored"), F.sum(better.cast("long")).alias("positive"))
    return out.withColumn("fraction", F.round(F.col("positive") / F.nullif("scored", F.lit(0)), 6))


@query("d20_finite_sample_quantile", f"WITH {SQL_PRED}, e AS (SELECT suite_id, abs(predicted - actual) AS e, row_number() OVER (PARTITION BY suite_id ORDER BY abs(predicted - actual)) AS k, count(*) OVER (PARTITION BY suite_id) AS n FROM p) SELECT suite_id, n, round(e, 6) AS q FROM e WHERE k = least(n, ceil((n + 1) * 0.9))")
def d20(s, d):
    e = predictions(s, d).withColumn("e", F.abs(F.col("predicted") - F.col("actual")))
    return S.finite_sample_quantile(e, "suite_id", "e", 0.9).select("suite_id", "n", F.round("q", 6).alias("q"))


@query("d22_group_balanced_median", f"WITH {SQL_PRED}, m AS (SELECT model_id, median(abs(predicted - actual)) AS e FROM p GROUP BY 1) SELECT round(median(e), 6) AS balanced, count(*) AS models FROM m")
def d22(s, d):
    m = predictions(s, d).groupBy("model_id").agg(F.median(F.abs(F.col("predicted") - F.col("actual"))).alias("e"))
    return m.agg(F.round(F.median("e"), 6).alias("balanced"), count_all().alias("models"))


@query("d23_group_balanced_quantile", f"""WITH {SQL_PRED}, e AS (SELECT suite_id, model_id, abs(predicted - actual) AS e FROM p), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY suite_id, model_id) AS w FROM e),
t AS (SELECT suite_id, count(DISTINCT model_id) AS g FROM e GROUP BY 1), v AS (SELECT suite_id, e, sum(w) AS w FROM w GROUP BY 1, 2),
a AS (SELECT v.*, g, sum(w) OVER (PARTITION BY suite_id ORDER BY e) / g AS cum FROM v JOIN t USING (suite_id)) SELECT suite_id, any_value(g) AS groups, round(min(e) FILTER (WHERE cum >= least(1, ceil((g + 1) * 0.9) / g) - 1e-9), 6) AS q FROM a GROUP BY 1""")
def d23(s, d):
    e = predictions(s, d).select("suite_id", "model_id", F.abs(F.col("predicted") - F.col("actual")).alias("e"))
    own = e.groupBy("suite_id", "model_id").agg((F.lit(1.0) / count_all()).alias("w"))
    groups = own.groupBy("suite_id").agg(count_all().alias("groups"))
    mass = e.join(own, ["suite_id", "model_id"]).groupBy("suite_id", "e").agg(F.sum("w").alias("w")).join(groups, "suite_id")
    cum = F.sum("w").over(Window.partitionBy("suite_id").orderBy("e")) / F.col("groups")
    level = F.least(F.lit(1.0), F.ceil((F.col("groups") + 1) * 0.9) / F.col("groups"))
    return mass.withColumn("hit", cum >= level - 1e-9).groupBy("suite_id").agg(F.max("groups").alias("groups"), F.round(F.min(F.when(F.col("hit"), F.col("e"))), 6).alias("q"))


@query("d24_collapsed_repeats", f"WITH {SQL_REPEATS}, k AS (SELECT model_id, evaluation_id, suite_id, median(e) AS x FROM p GROUP BY 1, 2, 3) SELECT suite_id, count(*) AS n, round(median(x), 6) AS e FROM k GROUP BY GROUPING SETS ((suite_id), ())")
def d24(s, d):
    """One median error a cell over the repeats, then by suite and over all."""
    k = repeated_errors(s, d).groupBy("model_id", "evaluation_id", "suite_id").agg(F.median("e").alias("x"))
    return k.groupingSets([["suite_id"], []], "suite_id").agg(count_all().alias("n"), F.round(F.median("x"), 6).alias("e"))


@query("d25_risk_medians", f"WITH {SQL_PRED} SELECT model_id, evaluation_id, grouping(model_id, evaluation_id) AS level, round(median(dispersion), 6) AS risk, count(*) AS n FROM p GROUP BY GROUPING SETS ((model_id), (evaluation_id), ())")
def d25(s, d):
    p = predictions(s, d)
    return p.groupingSets([["model_id"], ["evaluation_id"], []], "model_id", "evaluation_id").agg(F.grouping_id().alias("level"), F.round(F.median("dispersion"), 6).alias("risk"), count_all().alias("n"))


@query("d26_coverage_width", f"WITH {SQL_PRED} SELECT suite_id, round(avg((abs(predicted - actual) <= 1.645 * dispersion)::INT), 6) AS coverage, round(median(3.29 * dispersion), 6) AS width, round(median(3.29 * dispersion / abs(actual)) FILTER (WHERE abs(actual) > 1e-8), 6) AS relative_width FROM p GROUP BY 1")
def d26(s, d):
    p, w = predictions(s, d), F.col("dispersion")
    inside = (F.abs(F.col("predicted") - F.col("actual")) <= 1.645 * w).cast("double")
    return p.groupBy("suite_id").agg(F.round(F.avg(inside), 6).alias("coverage"), F.round(F.median(3.29 * w), 6).alias("width"), F.round(F.median(F.when(F.abs("actual") > 1e-8, 3.29 * w / F.abs("actual"))), 6).alias("relative_width"))


_AVG_RANK = "rank() OVER (PARTITION BY suite_id ORDER BY {0}) + (count(*) OVER (PARTITION BY suite_id, {0}) - 1) / 2.0"


@query("d27_spearman", f"WITH {SQL_PRED}, e AS (SELECT suite_id, round(dispersion, 9) AS u, round(abs(predicted - actual), 9) AS e FROM p), r AS (SELECT suite_id, {_AVG_RANK.format('u')} AS ru, {_AVG_RANK.format('e')} AS re FROM e) SELECT suite_id, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ru) > 0 AND stddev_pop(re) > 0 THEN round(corr(ru, re), 6) END AS rho FROM r GROUP BY 1")
def d27(s, d):
    e = predictions(s, d).select("model_id", "evaluation_id", "suite_id", F.round("dispersion", 9).alias("u"), F.round(F.abs(F.col("predicted") - F.col("actual")), 9).alias("e"))
    r = S.average_ranks(S.average_ranks(e, "suite_id", "u", "ru"), "suite_id", "e", "re")
    fit = (count_all() >= 3) & (F.stddev_pop("ru") > 0) & (F.stddev_pop("re") > 0)
    return r.groupBy("suite_id").agg(count_all().alias("n"), F.round(F.when(fit, correlation("ru", "re")), 6).alias("rho"))


_PAIRS = f"""{SQL_CELLS}, pr AS (SELECT a.evaluation_id AS a, b.evaluation_id AS b, count(*) AS n, corr(a.score, b.score) AS r FROM c a JOIN c b ON a.model_id = b.model_id AND a.evaluation_id <> b.evaluation_id GROUP BY 1, 2)"""


@query("d28_best_peer", f"WITH {_PAIRS} SELECT a AS evaluation_id, round(max(abs(r)), 6) AS best FROM pr WHERE n >= 3 AND isfinite(r) GROUP BY 1")
def d28(s, d):
    pairs = S.overlap_pairs(cells(s, d), "evaluation_id", "model_id", 3).where(C.finite("r"))
    both = pairs.select(F.col("a").alias("evaluation_id"), "r").unionByName(pairs.select(F.col("b").alias("evaluation_id"), "r"))
    return both.groupBy("evaluation_id").agg(F.round(F.max(F.abs("r")), 6).alias("best"))


@query("d29_structure", f"""WITH {SQL_CELLS}, r AS (SELECT model_id, count(*) AS rn, median(score) AS rm, stddev_pop(score) AS rs FROM c GROUP BY 1), k AS (SELECT evaluation_id, count(*) AS cn, median(score) AS cm, stddev_pop(score) AS cs FROM c GROUP BY 1),
pr AS (SELECT a.evaluation_id, corr(a.score, b.score) AS r FROM c a JOIN c b ON a.model_id = b.model_id AND a.evaluation_id <> b.evaluation_id GROUP BY a.evaluation_id, b.evaluation_id HAVING count(*) >= 5 AND stddev_pop(a.score) > 1e-9 AND stddev_pop(b.score) > 1e-9), bp AS (SELECT evaluation_id, max(abs(r)) AS best FROM pr GROUP BY 1)
SELECT model_id, evaluation_id, rn AS row_n, cn AS col_n, round(rm, 6) AS row_median, round(cm, 6) AS col_median, round(rs, 6) AS row_sd, round(cs, 6) AS col_sd, round(coalesce(best, 0), 5) AS best_peer, best IS NULL AS no_peer, rn = 1 AS row_alone, cn = 1 AS col_alone FROM c JOIN r USING (model_id) JOIN k USING (evaluation_id) LEFT JOIN bp USING (evaluation_id)""")
def d29(s, d):
    """Counts, medians and spreads of a cell's row and column, the column's best peer correlation, and flags where these are missing."""
    c = cells(s, d)

    def axis(key, tag):
        return c.groupBy(key).agg(count_all().alias(f"{tag}_n"), F.round(F.median("score"), 6).alias(f"{tag}_median"), F.round(F.stddev_pop("score"), 6).alias(f"{tag}_sd"))

    pairs = S.overlap_pairs(c, "evaluation_id", "model_id", 5).where(F.col("r").isNotNull())
    peers = pairs.select(F.col("a").alias("evaluation_id"), "r").unionByName(pairs.select(F.col("b").alias("evaluation_id"), "r")).groupBy("evaluation_id").agg(F.max(F.abs("r")).alias("best"))
    j = c.select("model_id", "evaluation_id").join(axis("model_id", "row"), "model_id").join(axis("evaluation_id", "col"), "evaluation_id").join(peers, "evaluation_id", "left")
    return j.select(
        "model_id", "evaluation_id", "row_n", "col_n", "row_median", "col_median", "row_sd", "col_sd", F.round(F.coalesce("best", F.lit(0.0)), 5).alias("best_peer"), F.col("best").isNull().alias("no_peer"),
        (F.col("row_n") == 1).alias("row_alone"), (F.col("col_n") == 1).alias("col_alone"),
    )


_STACK = f"""{SQL_CELLS}, rm AS (SELECT model_id, avg(score) AS v FROM c GROUP BY 1), cm AS (SELECT evaluation_id, avg(score) AS v FROM c GROUP BY 1), sm AS (SELECT suite_id, avg(score) AS v FROM c GROUP BY 1),
st AS (SELECT model_id, evaluation_id, score, unnest([rm.v, cm.v, sm.v]) AS v FROM c JOIN rm USING (model_id) JOIN cm USING (evaluation_id) JOIN sm USING (suite_id))"""


@query("d30_disagreement", f"WITH {_STACK}, k AS (SELECT model_id, evaluation_id, stddev_pop(v) AS sd, median(v) AS m, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS spread, any_value(score) AS score FROM st GROUP BY 1, 2) SELECT model_id, evaluation_id, round(sd, 6) AS sd, round(abs(score - m), 6) AS to_median, round(spread, 6) AS spread FROM k")
def d30(s, d):
    c = cells(s, d)
    means = [c.groupBy(k).agg(F.avg("score").alias(f"m_{k}")) for k in ("model_id", "evaluation_id", "suite_id")]
    x = c
    for m in means:
        x = x.join(m, m.columns[0])
    stack = x.select("model_id", "evaluation_id", "score", F.explode(F.array("m_model_id", "m_evaluation_id", "m_suite_id")).alias("v"))
    k = stack.groupBy("model_id", "evaluation_id").agg(F.stddev_pop("v").alias("sd"), F.median("v").alias("m"), (F.percentile("v", 0.9) - F.percentile("v", 0.1)).alias("spread"), F.max("score").alias("score"))
    return k.select("model_id", "evaluation_id", F.round("sd", 6).alias("sd"), F.round(F.abs(F.col("score") - F.col("m")), 6).alias("to_median"), F.round("spread", 6).alias("spread"))


_TRUST = f"""{SQL_PRED}, t AS (SELECT *, (abs(predicted - actual) <= 10)::INT AS ok, round(dispersion, 9) AS risk FROM p), o AS (SELECT *, ntile(20) OVER (ORDER BY risk, model_id, evaluation_id) AS bin FROM t),
b AS (SELECT bin, count(*) AS n, median(risk) AS risk, avg(ok) AS event FROM o GROUP BY 1)"""


def _trust_rows(s, d):
    p = predictions(s, d).withColumn("ok", (F.abs(F.col("predicted") - F.col("actual")) <= 10).cast("double")).withColumn("risk", F.round("dispersion", 9))
    placed = S.global_place(p, "risk", ["model_id", "evaluation_id"])
    return placed.withColumn("bin", S.equal_count_bin(F.col("place"), F.col("total"), 20))


@query("e2_equal_count_bins", f"WITH {_TRUST} SELECT CAST(bin AS BIGINT) AS bin, n, round(risk, 6) AS risk, round(event, 6) AS event FROM b")
def e2(s, d):
    return _trust_rows(s, d).groupBy("bin").agg(count_all().alias("n"), F.round(F.median("risk"), 6).alias("risk"), F.round(F.avg("ok"), 6).alias("event"))


@query("d31_probability_scores", f"WITH {_TRUST}, x AS (SELECT o.*, b.event FROM o JOIN b USING (bin)), g AS (SELECT greatest(1e-12, least(1 - 1e-12, event)) AS q, * FROM x), z AS (SELECT bin, count(*) AS n, avg(q) AS q, avg(ok) AS f FROM g GROUP BY 1) SELECT (SELECT round(avg((q - ok) ** 2), 6) FROM g) AS brier, (SELECT round(-avg(ok * ln(q) + (1 - ok) * ln(1 - q)), 6) FROM g) AS log_loss, round(sum(n * abs(q - f)) / sum(n), 6) AS ece FROM z")
def d31(s, d):
    rows = _trust_rows(s, d)
    bins = rows.groupBy("bin").agg(F.avg("ok").alias("event"))
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("event")))
    g = rows.join(bins, "bin").withColumn("q", q)
    loss = g.agg(F.round(F.avg(F.pow(F.col("q") - F.col("ok"), 2)), 6).alias("brier"), F.round(-F.avg(F.col("ok") * F.ln("q") + (1 - F.col("ok")) * F.ln(1 - F.col("q"))), 6).alias("log_loss"))
    ece = g.groupBy("bin").agg(count_all().alias("n"), F.avg("q").alias("q"), F.avg("ok").alias("f")).agg(F.round(F.sum(F.col("n") * F.abs(F.col("q") - F.col("f"))) / F.sum("n"), 6).alias("ece"))
    return loss.crossJoin(F.broadcast(ece))  # two rows in all


_ISOTONIC = f"""{_TRUST}, s AS (SELECT *, sum(n) OVER w AS cw, sum(n * event) OVER w AS cs FROM b WINDOW w AS (ORDER BY bin)),
seg AS (SELECT j.bin AS jb, k.bin AS kb, (k.cs - j.cs + j.n * j.event) / (k.cw - j.cw + j.n) AS v FROM s j JOIN s k ON k.bin >= j.bin),
mx AS (SELECT i.bin, g.jb, max(g.v) AS m FROM s i JOIN seg g ON g.jb <= i.bin AND g.kb >= i.bin GROUP BY 1, 2)"""


@query("e18_isotonic_trust", f"WITH {_ISOTONIC} SELECT CAST(bin AS BIGINT) AS bin, round(min(m), 6) AS trust FROM mx GROUP BY 1")
def e18(s, d):
    bins = _trust_rows(s, d).groupBy("bin").agg(F.avg("ok").alias("event"), count_all().cast("double").alias("n")).withColumn("event", -F.col("event"))
    return S.isotonic(bins, "bin", "event", "n").select("bin", F.round(-F.col("fitted"), 6).alias("trust"))


@query("d35_coverage_rollup", "SELECT suite_id, task_family, count(*) AS n, count(*) FILTER (WHERE try_cast(num_samples AS BIGINT) IS NOT NULL) AS counted FROM tasks GROUP BY ROLLUP (suite_id, task_family)")
def d35(s, d):
    return table(s, d, "tasks").rollup("suite_id", "task_family").agg(count_all().alias("n"), F.sum(F.col("num_samples").try_cast("long").isNotNull().cast("long")).alias("counted"))


@query("d36_suite_breakdown", f"WITH {_SKILL} SELECT t.suite_id, count(*) AS columns, count(*) FILTER (WHERE reason IS NULL) AS scored, count(*) FILTER (WHERE reason IS NULL AND e < b) AS positive, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded FROM k JOIN tasks t USING (evaluation_id) GROUP BY 1")
def d36(s, d):
    k = _skills(s, d).join(table(s, d, "tasks").select("evaluation_id", "suite_id"), "evaluation_id")
    n = lambda c: F.sum(c.cast("long"))
    ok = F.col("reason").isNull()
    return k.groupBy("suite_id").agg(count_all().alias("columns"), n(ok).alias("scored"), n(ok & F.coalesce(F.col("e") < F.col("b"), F.lit(False))).alias("positive"), n(~ok).alias("excluded"))


@query("d37_all_suites", f"WITH {SQL_CELLS}, q AS (SELECT suite_id FROM c GROUP BY 1 ORDER BY count(*) DESC, suite_id LIMIT 3) SELECT DISTINCT m.model_id FROM c m WHERE NOT EXISTS (SELECT 1 FROM q WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.model_id = m.model_id AND x.suite_id = q.suite_id))")
def d37(s, d):
    c = cells(s, d)
    wanted = c.groupBy("suite_id").agg(count_all().alias("n")).orderBy(F.desc("n"), "suite_id").limit(3)
    have = c.join(wanted.select("suite_id"), "suite_id", "left_semi").groupBy("model_id").agg(F.countDistinct("suite_id").alias("k"))
    return have.crossJoin(F.broadcast(wanted.agg(count_all().alias("w")))).where("k = w").select("model_id")  # one row: an ungrouped aggregate


@query("d39_three_groupings", f"WITH {_SQL_FOLDS} SELECT fold, suite_id, count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae, round(median(abs(predicted - actual)), 6) AS medae FROM p GROUP BY GROUPING SETS ((fold), (suite_id), ())")
def d39(s, d):
    e = F.abs(F.col("predicted") - F.col("actual"))
    return _fold_errors(s, d).groupingSets([["fold"], ["suite_id"], []], "fold", "suite_id").agg(count_all().alias("n"), F.round(F.avg(e), 6).alias("mae"), F.round(F.median(e), 6).alias("medae"))


@query("d41_outcomes", "SELECT audit_status, review_status, count(*) AS n FROM scores GROUP BY 1, 2")
def d41(s, d):
    return table(s, d, "scores").groupBy("audit_status", "review_status").agg(count_all().alias("n"))


# Fixed value: 97.5 % quantile of Student's t with 59 degrees of freedom, for columns reported as 60 repeats.
_T_59 = 2.00099537704821


@query("d42_mean_and_half_width", f"WITH {SQL_CELLS} SELECT evaluation_id, round(avg(score), 6) AS mean, round({_T_59} * stddev_samp(score) / sqrt(count(*)), 6) AS half_width FROM c GROUP BY 1")
def d42(s, d):
    return cells(s, d).groupBy("evaluation_id").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(_T_59 * F.stddev_samp("score") / F.sqrt(count_all()), 6).alias("half_width"))


# ---- E: windows, sorts, top-k ----


@query("e1_average_rank", f"WITH {SQL_CELLS} SELECT model_id, evaluation_id, rank() OVER (PARTITION BY evaluation_id ORDER BY score) + (count(*) OVER (PARTITION BY evaluation_id, score) - 1) / 2.0::DOUBLE AS avg_rank FROM c")
def e1(s, d):
    return S.average_ranks(cells(s, d), "evaluation_id", "score").select("model_id", "evaluation_id", "avg_rank")


@query("e3_risk_coverage", f"WITH {SQL_PRED}, o AS (SELECT abs(predicted - actual) AS e, row_number() OVER (ORDER BY round(dispersion, 9), model_id, evaluation_id) AS k, count(*) OVER () AS n FROM p) SELECT f AS fraction, count(*) AS kept, round(median(e), 6) AS medae FROM o, (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) AS t(f) WHERE k <= ceil(f * n) GROUP BY 1")
def e3(s, d):
    p = predictions(s, d).withColumn("risk", F.round("dispersion", 9)).withColumn("e", F.abs(F.col("predicted") - F.col("actual")))
    placed = S.global_place(p, "risk", ["model_id", "evaluation_id"])
    cut = F.explode(F.array(*[F.lit(x) for x in (0.2, 0.5, 0.8, 1.0)])).alias("fraction")
    kept = placed.select("e", "place", "total", cut).where(F.col("place") <= F.ceil(F.col("fraction") * F.col("total")))
    return kept.groupBy("fraction").agg(count_all().alias("kept"), F.round(F.median("e"), 6).alias("medae"))


@query("e4_terciles", f"WITH {SQL_PRED}, o AS (SELECT abs(predicted - actual) AS e, ntile(3) OVER (ORDER BY round(dispersion, 9), model_id, evaluation_id) AS tercile FROM p) SELECT CAST(tercile AS BIGINT) AS tercile, count(*) AS n, round(avg(e), 6) AS mae, round(median(e), 6) AS medae FROM o GROUP BY 1")
def e4(s, d):
    p = predictions(s, d).withColumn("risk", F.round("dispersion", 9)).withColumn("e", F.abs(F.col("predicted") - F.col("actual")))
    placed = S.global_place(p, "risk", ["model_id", "evaluation_id"])
    return placed.groupBy(S.equal_count_bin(F.col("place"), F.col("total"), 3).alias("tercile")).agg(count_all().alias("n"), F.round(F.avg("e"), 6).alias("mae"), F.round(F.median("e"), 6).alias("medae"))


_TOPK = f"""{SQL_CELLS}, m AS (SELECT model_id, avg(score) AS mm FROM c GROUP BY 1), x AS (SELECT evaluation_id, model_id, score, round(mm, 9) AS pred FROM c JOIN m USING (model_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY score DESC, model_id) AS a, row_number() OVER (PARTITION BY evaluation_id ORDER BY pred DESC, model_id) AS b, count(*) OVER (PARTITION BY evaluation_id) AS n FROM x)"""


@query("e5_top_fraction", f"WITH {_TOPK} SELECT evaluation_id, CAST(greatest(1, least(n, ceil(0.25 * n))) AS BIGINT) AS k, count(*) FILTER (WHERE a <= greatest(1, ceil(0.25 * n)) AND b <= greatest(1, ceil(0.25 * n))) AS overlap FROM o GROUP BY evaluation_id, n")
def e5(s, d):
    c = cells(s, d)
    x = c.join(c.groupBy("model_id").agg(F.round(F.avg("score"), 9).alias("pred")), "model_id").select("evaluation_id", "model_id", "score", "pred")
    sizes = x.groupBy("evaluation_id").agg(F.greatest(F.lit(1), F.ceil(0.25 * count_all())).cast("long").alias("k"))
    by = lambda c: F.row_number().over(Window.partitionBy("evaluation_id").orderBy(F.desc(c), "model_id"))
    placed = x.withColumn("a", by("score")).withColumn("b", by("pred")).join(sizes, "evaluation_id")
    return placed.groupBy("evaluation_id", "k").agg(F.sum(((F.col("a") <= F.col("k")) & (F.col("b") <= F.col("k"))).cast("long")).alias("overlap"))


@query("e7_top_columns", f"WITH {SQL_PRED}, m AS (SELECT evaluation_id, median(abs(predicted - actual)) AS e FROM p GROUP BY 1) SELECT evaluation_id, round(e, 6) AS medae FROM m ORDER BY round(e, 9), evaluation_id LIMIT 15")
def e7(s, d):
    m = predictions(s, d).groupBy("evaluation_id").agg(F.median(F.abs(F.col("predicted") - F.col("actual"))).alias("e"))
    return m.orderBy(F.round("e", 9), "evaluation_id").limit(15).select("evaluation_id", F.round("e", 6).alias("medae"))


@query("e8_best_per_group", f"WITH {SQL_PRED}, m AS (SELECT suite_id, evaluation_id, round(median(abs(predicted - actual)), 9) AS e FROM p GROUP BY 1, 2) SELECT suite_id, arg_min(evaluation_id, struct_pack(e := e, i := evaluation_id)) AS evaluation_id, round(min(e), 6) AS medae FROM m GROUP BY 1")
def e8(s, d):
    m = predictions(s, d).groupBy("suite_id", "evaluation_id").agg(F.round(F.median(F.abs(F.col("predicted") - F.col("actual"))), 9).alias("e"))
    return m.groupBy("suite_id").agg(F.min_by("evaluation_id", F.struct("e", "evaluation_id")).alias("evaluation_id"), F.round(F.min("e"), 6).alias("medae"))


@query("e9_strong_roster", f"""WITH {SQL_PRED}, n AS (SELECT evaluation_id, count(*) AS n FROM f GROUP BY 1), m AS (SELECT evaluation_id, count(*) AS k, round(median(100 * abs(predicted - actual) / abs(actual)) FILTER (WHERE abs(actual) > 1e-6), 9) AS e FROM p GROUP BY 1),
t AS (SELECT evaluation_id, k / n AS coverage, e FROM m JOIN n USING (evaluation_id)) SELECT evaluation_id, round(coverage, 6) AS coverage, round(e, 6) AS medape FROM t WHERE coverage >= (SELECT max(coverage) FROM t) - 1e-12 AND e IS NOT NULL ORDER BY e, evaluation_id LIMIT 12""")
def e9(s, d):
    """Of the evaluations of greatest coverage the twelve of least median percent error; it is an error if there are fewer."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    m = predictions(s, d).groupBy("evaluation_id").agg(count_all().alias("k"), F.round(F.median(F.when(F.abs("actual") > S.APE_FLOOR, 100 * e / F.abs("actual"))), 9).alias("e"))
    t = m.join(cells(s, d).groupBy("evaluation_id").agg(count_all().alias("n")), "evaluation_id").withColumn("coverage", F.col("k") / F.col("n"))
    most = t.agg(F.max("coverage").alias("most"))
    out = t.crossJoin(F.broadcast(most)).where((F.col("coverage") >= F.col("most") - 1e-12) & F.col("e").isNotNull())  # one row: an ungrouped aggregate
    out = out.orderBy("e", "evaluation_id").limit(12).select("evaluation_id", F.round("coverage", 6).alias("coverage"), F.round("e", 6).alias("medape"))
    short = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) < 12  # twelve rows at most
    return out.withColumn("coverage", F.when(short & F.raise_error(F.lit("fewer than twelve evaluations of greatest coverage")).isNotNull(), None).otherwise(F.col("coverage")))


@query("e13_cheapest_per_identity", f"SELECT task_identity_id, evaluation_id FROM (SELECT *, row_number() OVER (PARTITION BY task_identity_id ORDER BY {_TASK_N} IS NULL, {_TASK_N}, sample_unit, evaluation_id) AS k FROM tasks) WHERE k = 1")
def e13(s, d):
    n = F.col("num_samples").try_cast("long")
    order = Window.partitionBy("task_identity_id").orderBy(n.isNull(), n, "sample_unit", "evaluation_id")
    return table(s, d, "tasks").withColumn("k", F.row_number().over(order)).where("k = 1").select("task_identity_id", "evaluation_id")


@query("e14_rank_pruning", f"WITH {_SQL_FOLDS}, sc AS (SELECT fold AS step, evaluation_id AS id, round(median(abs(predicted - actual)), 9) AS score FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score, id) AS k, count(*) OVER (PARTITION BY step) AS n FROM sc) SELECT id AS evaluation_id, count(*) AS steps, round(avg((k - 1.0) / greatest(1, n - 1)), 6) AS mean_percentile, round(avg(k), 6) AS mean_rank FROM r GROUP BY 1")
def e14(s, d):
    sc = _fold_errors(s, d).groupBy(F.col("fold").alias("step"), F.col("evaluation_id").alias("id")).agg(F.round(F.median(F.abs(F.col("predicted") - F.col("actual"))), 9).alias("score"))
    r = sc.withColumn("k", F.row_number().over(Window.partitionBy("step").orderBy("score", "id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("step")))
    pct = (F.col("k") - 1.0) / F.greatest(F.lit(1), F.col("n") - 1)
    return r.groupBy(F.col("id").alias("evaluation_id")).agg(count_all().alias("steps"), F.round(F.avg(pct), 6).alias("mean_percentile"), F.round(F.avg("k"), 6).alias("mean_rank"))


@query("e19_interpolated_trust", f"WITH {_TRUST}, n AS (SELECT *, lead(risk) OVER (ORDER BY bin) AS r2, lead(event) OVER (ORDER BY bin) AS e2 FROM b), q AS (SELECT evaluation_id, avg(risk) AS x FROM t GROUP BY 1), e AS (SELECT min(risk) AS lo, max(risk) AS hi, arg_min(event, bin) AS elo, arg_max(event, bin) AS ehi FROM b) SELECT q.evaluation_id, round(CASE WHEN x <= lo THEN elo WHEN x >= hi THEN ehi ELSE (SELECT max(event + (e2 - event) * (x - risk) / (r2 - risk)) FROM n WHERE risk <= x AND x < r2) END, 5) AS trust FROM q, e")
def e19(s, d):
    rows = _trust_rows(s, d)
    bins = rows.groupBy("bin").agg(F.median("risk").alias("risk"), F.avg("ok").alias("event"))
    knots = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "risk", "event"))).alias("k"))  # 20 bins
    asked = rows.groupBy("evaluation_id").agg(F.avg("risk").alias("x")).crossJoin(F.broadcast(knots))
    first, last = F.col("k")[0], F.element_at("k", -1)
    before = F.element_at(F.filter("k", lambda b: b["risk"] <= F.col("x")), -1)
    after = F.try_element_at(F.filter("k", lambda b: b["risk"] > F.col("x")), F.lit(1))
    line = before["event"] + (after["event"] - before["event"]) * (F.col("x") - before["risk"]) / (after["risk"] - before["risk"])
    trust = F.when(F.col("x") <= first["risk"], first["event"]).when(F.col("x") >= last["risk"], last["event"]).otherwise(line)
    return asked.select("evaluation_id", F.round(trust, 5).alias("trust"))
