"""Queries of deployment: refits for targets, temporal holdouts, intervals, resampling, burdens (inventory D17-D19, D32-D34, F2-F12, G18-G29, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lacuna.functions.columns import count_all
from lacuna.operators import cells as C
from lacuna.operators import confidence, fits, holdouts, resample, search
from lacuna.operators import stats as S
from lacuna.plans.base import SQL_CELLS, SQL_PRED, cells, predictions, with_fold
from lacuna.plans.measures import _fold_errors, _skills
from lacuna.plans.relations import _MODELS, _models, _probes
from lacuna.product import ScoreTable
from lacuna.session import cut
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


@query("d17_bootstrap_fraction")
def d17(s: SparkSession, d: str) -> DataFrame:
    """Share of columns with positive skill and its bootstrap interval (a flag per column reaches the driver)."""
    flags = [bool(r["better"]) for r in _skills(s, d).where("reason IS NULL").select("evaluation_id", (F.col("e") < F.col("b")).alias("better")).orderBy("evaluation_id").collect()]
    r = resample.fraction_interval(flags)
    return s.createDataFrame([(r["n"], r["fraction"], r["low"], r["high"])], "n long, fraction double, low double, high double")


def _arm_medians(s, d):
    """Per fold: median error of column means and of column medians of the other folds."""
    f = with_fold(cells(s, d))
    folds = F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)])).alias("held")
    med = f.select("evaluation_id", "score", "fold", folds).where("fold <> held").groupBy("evaluation_id", "held").agg(F.median("score").alias("med"))
    arm = f.join(med, (f["evaluation_id"] == med["evaluation_id"]) & (f["fold"] == med["held"])).groupBy("fold").agg(F.median(F.abs(F.col("score") - F.col("med"))).alias("arm"))
    base = _fold_errors(s, d).groupBy("fold").agg(F.median(F.abs(F.col("predicted") - F.col("actual"))).alias("base"))
    return base.join(arm, "fold").orderBy("fold")


@query("d18_d19_paired_arms")
def d18(s, d):
    """Reduction of the median error with its fold bootstrap, and the signed-rank test (a row per fold reaches the driver)."""
    rows = _arm_medians(s, d).collect()
    base, arm = [r["base"] for r in rows], [r["arm"] for r in rows]
    a, b = resample.reduction_interval(base, arm), resample.signed_rank(arm, base)
    return s.createDataFrame([(a["n"], a["reduction"], a["low"], a["high"], b["statistic"], b["p"])], "n long, reduction double, low double, high double, statistic double, p double")


@query("d32_suite_burden", "SELECT suite_id, CAST(sum(try_cast(num_samples AS BIGINT)) AS BIGINT) AS known_samples, max(try_cast(num_samples AS BIGINT)) AS largest, count(*) FILTER (WHERE try_cast(num_samples AS BIGINT) IS NULL) AS unknown FROM tasks GROUP BY 1")
def d32(s, d):
    n = F.col("num_samples").try_cast("long")
    return table(s, d, "tasks").groupBy("suite_id").agg(F.sum(n).alias("known_samples"), F.max(n).alias("largest"), F.sum(n.isNull().cast("long")).alias("unknown"))


@query("d34_budget_pressure", "SELECT suite_id, round(sum(try_cast(num_samples AS DOUBLE)) / 200000, 6) AS pressure, CASE WHEN count(*) FILTER (WHERE try_cast(num_samples AS DOUBLE) IS NULL) > 0 THEN 'unknown' WHEN sum(try_cast(num_samples AS DOUBLE)) > 200000 THEN 'over' END AS reason FROM tasks GROUP BY 1")
def d34(s, d):
    n = F.col("num_samples").try_cast("double")
    reason = F.when(F.sum(n.isNull().cast("int")) > 0, "unknown").when(F.sum(n) > 200000, "over")
    return table(s, d, "tasks").groupBy("suite_id").agg(F.round(F.sum(n) / 200000, 6).alias("pressure"), reason.alias("reason"))


@query("d43_method_completeness", f"WITH {SQL_PRED}, a AS (SELECT suite_id, count(*) AS n FROM f GROUP BY 1), b AS (SELECT suite_id, count(*) AS k FROM p GROUP BY 1) SELECT suite_id, n AS expected, coalesce(k, 0) AS predicted, round(coalesce(k, 0) / n, 6) AS share FROM a LEFT JOIN b USING (suite_id)")
def d43(s, d):
    a = cells(s, d).groupBy("suite_id").agg(count_all().alias("expected"))
    b = predictions(s, d).groupBy("suite_id").agg(count_all().alias("predicted"))
    j = a.join(b, "suite_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    return j.select("suite_id", "expected", "predicted", F.round(F.col("predicted") / F.col("expected"), 6).alias("share"))


@query("f1_seeded_folds")
def f1(s, d):
    """Within-model folds of the parity generator."""
    return holdouts.within_model_folds(cells(s, d), [42, 43])


@query("f2_random_cells")
def f2(s, d):
    return holdouts.random_cells(cells(s, d), repeats=3)


@query("f7_group_split", f"WITH {_MODELS}, m AS (SELECT model_id, coalesce(family, model_id) AS grp FROM mm), o AS (SELECT grp, row_number() OVER (ORDER BY md5('42|' || grp)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM m)) SELECT model_id, grp, CASE WHEN k <= round(0.7 * n) THEN 'train' ELSE 'validation' END AS role FROM m JOIN o USING (grp)")
def f7(s, d):
    """Exactly 70 % of the families to train, as wholes, in the order of a seeded hash."""
    m = _models(s, d).select("model_id", F.coalesce("family", "model_id").alias("grp"))
    g = m.select("grp").distinct().withColumn("h", F.md5(F.concat(F.lit("42|"), "grp")))
    placed = S.global_place(g, "h", ["grp"]).select("grp", F.when(F.col("place") <= F.round(0.7 * F.col("total")), "train").otherwise("validation").alias("role"))
    return m.join(placed, "grp").select("model_id", "grp", "role")


@query("f11_random_prefixes")
def f11(s, d):
    """Nested random probe sets."""
    names = [r["evaluation_id"] for r in cells(s, d).select("evaluation_id").distinct().orderBy("evaluation_id").collect()]  # a row per evaluation
    rows = holdouts.nested_prefixes(names, [1, 3, 5])
    return s.createDataFrame(rows, "repeat int, k int, probes array<string>")


def _targets(c):
    return c.select("model_id").distinct()


@query("g19_all_known_probes")
def g19(s, d):
    """Every model refitted with only the five probes of it revealed."""
    c = cells(s, d)
    probes = _probes(c).agg(F.array_sort(F.collect_list("evaluation_id")).alias("probes"))
    jobs = _targets(c).crossJoin(F.broadcast(probes)).select(F.col("model_id").alias("job_id"), F.col("model_id").alias("target"), "probes", F.lit(None).cast("array<string>").alias("context"))
    p = fits.fit_targets(c, jobs, own_cells=True)
    return p.join(c.select("model_id", "evaluation_id", F.col("score").alias("actual")), ["model_id", "evaluation_id"]).groupBy("model_id").agg(*S.error_columns())


@query("g28_temporal_units")
def g28(s, d):
    """Verified targets refitted on strictly earlier models and k revealed cells, ten seeded draws each; revealed cells count as error 0."""
    c = cells(s, d)
    m = _models(s, d).where((F.col("verification_status") == "verified") & F.col("release_date").isNotNull()).select("model_id", "release_date")
    dated = c.join(m, "model_id")
    targets = dated.groupBy("model_id", "release_date").agg(count_all().alias("n")).where("n > 20")
    dates = cut(dated.select("model_id", F.unix_date(F.col("release_date").cast("date")).cast("double").alias("date")).distinct())
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dates.groupBy("date").agg(count_all().alias("_n")).select("date", F.sum("_n").over(w).alias("earlier_models")).where("earlier_models > 0")  # a row per day
    context = targets.select("model_id").join(dates, "model_id").join(earlier, "date")
    draws = holdouts.text_draws(dated.join(context.select("model_id"), "model_id", "left_semi"), (1, 5, 10), range(10))
    jobs = cut(draws.join(context, "model_id").select(F.concat_ws("/", "model_id", "k", "seed").alias("job_id"), F.col("model_id").alias("target"), "probes", F.col("date").alias("before"), "k", "seed", "earlier_models"))
    p = fits.fit_targets(c, jobs, dates=dates, own_cells=True).join(c.select("model_id", "evaluation_id", F.col("score").alias("actual")), ["model_id", "evaluation_id"])
    error = F.abs(F.col("predicted") - F.col("actual"))
    e = p.groupBy("job_id", "model_id").agg(F.count("predicted").alias("hidden"), F.sum(error).alias("total"), F.median(error).alias("hidden_medae"), (count_all() - F.count("predicted")).alias("not_predictable"))
    j = e.join(jobs.select("job_id", "k", "seed", "earlier_models"), "job_id")
    return j.groupBy("model_id", "k").agg(
        count_all().alias("draws"), F.max("earlier_models").cast("int").alias("earlier_models"), F.sum("hidden").alias("hidden"), F.sum("not_predictable").alias("not_predictable"),
        F.round(F.median("hidden_medae"), 6).alias("hidden_medae"), F.round(F.median(F.col("total") / (F.col("hidden") + F.col("k"))), 6).alias("parity_mae"),
    )


@query("g21_error_risk")
def g21(s, d):
    """Cross-fitted ridge risk of every fold, its penalty chosen inside the training folds, from supports, spreads, the column's deviation and its best peer."""
    p = _fold_errors(s, d).withColumn("error", F.abs(F.col("predicted") - F.col("actual")))
    c = cells(s, d)
    pairs = S.overlap_pairs(c, "evaluation_id", "model_id", 5).where(F.col("r").isNotNull())
    peers = pairs.select(F.col("a").alias("evaluation_id"), "r").unionByName(pairs.select(F.col("b").alias("evaluation_id"), "r")).groupBy("evaluation_id").agg(F.max(F.abs("r")).alias("peer"))
    side = lambda key, tag: c.groupBy(key).agg(count_all().alias(f"{tag}_n"), F.stddev_pop("score").alias(f"{tag}_sd"))
    rows = p.join(side("model_id", "row"), "model_id").join(side("evaluation_id", "col"), "evaluation_id").join(peers, "evaluation_id", "left").join(S.mad(c, "evaluation_id", "score").drop("n"), "evaluation_id", "left")
    rows = cut(rows.fillna(0.0, ["peer", "dispersion"]))
    r = confidence.ridge_error_risk(rows, ["row_n", "col_n", "row_sd", "col_sd", "peer", "dispersion"])
    return r.groupBy("fold").agg(count_all().alias("n"), F.round(F.avg("risk"), 6).alias("mean_risk"), F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.avg(F.abs(F.col("risk") - F.col("error"))), 6).alias("risk_mae"))


def _errors(s, d):
    p = _fold_errors(s, d)
    sd = cells(s, d).groupBy("evaluation_id").agg(F.stddev_pop("score").alias("risk"))
    return p.withColumn("error", F.abs(F.col("predicted") - F.col("actual"))).join(sd, "evaluation_id")


_DEPLOY = """WITH {c}, f AS (SELECT *, {fold} AS fold FROM c), p AS (SELECT a.model_id, a.evaluation_id, a.suite_id, a.fold, any_value(a.score) AS actual, avg(b.score) AS predicted FROM f a JOIN f b ON a.evaluation_id = b.evaluation_id AND a.fold <> b.fold GROUP BY ALL),
sd AS (SELECT evaluation_id, stddev_pop(score) AS risk FROM c GROUP BY 1), k AS (SELECT p.*, abs(predicted - actual) AS error, risk FROM p JOIN sd USING (evaluation_id)),
mr AS (SELECT model_id, median(risk) AS mr FROM k GROUP BY 1), er AS (SELECT evaluation_id, median(risk) AS er FROM k GROUP BY 1), sc AS (SELECT quantile_cont(error / risk, 0.9) AS scale FROM k WHERE risk > 1e-8)
SELECT suite_id, count(*) AS n, round(avg((actual BETWEEN greatest(0, predicted - r) AND least(100, predicted + r))::INT), 6) AS coverage, round(median(least(100, predicted + r) - greatest(0, predicted - r)), 5) AS width
FROM (SELECT k.*, scale * 0.5 * (mr + er) AS r FROM k JOIN mr USING (model_id) JOIN er USING (evaluation_id), sc) GROUP BY 1"""


@query("c24_deployed_intervals", _DEPLOY.format(c=SQL_CELLS, fold="CAST('0x' || substr(md5(model_id || '|' || evaluation_id), 1, 6) AS BIGINT) % 5"))
def c24(s, d):
    e = _errors(s, d)
    out = confidence.deployed_intervals(e.select("model_id", "evaluation_id", "suite_id", "predicted", "actual"), confidence.deployment_lookup(e))
    return out.groupBy("suite_id").agg(count_all().alias("n"), F.round(F.avg(F.col("actual").between(F.col("low"), F.col("high")).cast("double")), 6).alias("coverage"), F.round(F.median(F.col("high") - F.col("low")), 5).alias("width"))


@query("g24_new_entity_intervals")
def g24(s, d):
    """New models with k revealed cells: leave-one-model-out risks and group-balanced scales; coverage, width and abstentions by k and scope."""
    r = cut(confidence.new_entity_risk(cut(confidence.new_entity_errors(cells(s, d)))))  # both are read several times
    j = r.join(F.broadcast(confidence.balanced_scale(r).drop("models")), "k", "left")  # a row per k
    radius = F.col("scale") * F.col("risk")
    low, high = F.greatest(F.lit(0.0), F.col("predicted") - radius), F.least(F.lit(100.0), F.col("predicted") + radius)
    inside = F.when(radius.isNotNull(), F.col("actual").between(low, high).cast("double"))
    return j.groupBy("k", "scope").agg(count_all().alias("n"), F.round(F.avg(inside), 6).alias("coverage"), F.round(F.median(F.when(radius.isNotNull(), high - low)), 6).alias("width"))


@query("h1_audit", f"WITH {SQL_CELLS} SELECT count(*) AS observed, count(DISTINCT model_id) AS models, count(DISTINCT evaluation_id) AS evaluations, round(count(*) / (count(DISTINCT model_id) * count(DISTINCT evaluation_id)), 6) AS density FROM c")
def h1(s, d):
    return C.density(cells(s, d))


@query("h2_validate")
def h2(s, d):
    """Random-cell holdout of the rank-1 completion, ten repeats."""
    return ScoreTable(cells(s, d)).validate(10)


@query("h8_add_model")
def h8(s, d):
    """The most observed model taken out and added again from three of its scores: predictions, intervals or why there is none, and what was observed."""
    c = cells(s, d)
    target = c.groupBy("model_id").agg(count_all().alias("n")).orderBy(F.desc("n"), "model_id").first()["model_id"]
    own = c.where(F.col("model_id") == target)
    known = {r["evaluation_id"]: r["score"] for r in own.orderBy("evaluation_id").limit(3).collect()}
    out = ScoreTable(c.where(F.col("model_id") != target)).add_model(known, "new-entity", confidence=True)
    return out.join(own.select("evaluation_id", F.round("score", 6).alias("actual")), "evaluation_id", "left")


@query("h10_starter_sets")
def h10(s, d):
    """The first greedy probes of all evaluations, and of those that are cheap by their known sample count."""
    c = cells(s, d)
    cheap = table(s, d, "tasks").where(F.col("num_samples").try_cast("double") <= 5_000).select("evaluation_id")
    modes, made = [("unrestricted", None), ("feasible", cheap)], search.Refits()
    found = [search.refit_greedy(c, rounds=2, allowed=allowed, made=made).select(F.lit(name).alias("mode"), "step", "evaluation_id", "loss") for name, allowed in modes]
    return found[0].unionByName(found[1])




@query("h11_export_manifest", f"WITH {SQL_CELLS} SELECT 'scores' AS name, (SELECT count(*) FROM c) AS n, (SELECT count(DISTINCT model_id) FROM c) AS models, (SELECT count(DISTINCT evaluation_id) FROM c) AS evaluations UNION ALL SELECT 'observations', (SELECT count(*) FROM scores), (SELECT count(DISTINCT model_id) FROM scores), (SELECT count(DISTINCT evaluation_id) FROM scores) UNION ALL SELECT 'wide', (SELECT count(DISTINCT model_id) FROM c), (SELECT count(DISTINCT model_id) FROM c), (SELECT count(DISTINCT evaluation_id) FROM c)")
def h11_manifest(s, d):
    """What an export would hold: rows, models and evaluations of all observations, of the accepted cells, and of the wide table."""
    facts = [count_all().alias("n"), F.countDistinct("model_id").alias("models"), F.countDistinct("evaluation_id").alias("evaluations")]
    of = lambda name, frame: frame.agg(*facts).select(F.lit(name).alias("name"), "n", "models", "evaluations")
    accepted = of("scores", cells(s, d))
    return accepted.unionByName(of("observations", table(s, d, "scores"))).unionByName(accepted.select(F.lit("wide").alias("name"), F.col("models").alias("n"), "models", "evaluations"))


@query("h12_site_cells")
def h12_cells(s, d):
    """Per model its whole row: observed or predicted score, interval and trust of every evaluation."""
    core = C.support_core(cells(s, d), 3, 5)
    errors = confidence.held_out_errors(core)
    lookup = confidence.deployment_lookup(errors)
    grid = fits.complete_grid(core, 1, 2).join(core.groupBy("evaluation_id").agg(F.min("suite_id").alias("suite_id")), "evaluation_id").withColumnRenamed("score", "predicted")
    out = confidence.deployed_intervals(grid, lookup).join(lookup["model"], "model_id", "left").join(lookup["evaluation"], "evaluation_id", "left")
    out = out.crossJoin(F.broadcast(confidence.trust_curve(errors)))  # one row of knots
    hidden = ~F.col("observed")
    trust = confidence.interpolated(F.col("knots"), 0.5 * (F.col("model_risk") + F.col("evaluation_risk")))
    cell = F.struct("evaluation_id", "observed", F.round("predicted", 2).alias("score"), F.when(hidden, F.round("low", 2)).alias("low"), F.when(hidden, F.round("high", 2)).alias("high"), F.when(hidden, F.round(trust, 3)).alias("trust"))
    return out.groupBy("model_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


@query("d38_rank_protocols")
def d38_ranks(s, d):
    """Errors and unsupported cells of ranks 0, 1 and 2 under two protocols (three folds; every model as a new one with five cells), by suite and in all."""
    c = cells(s, d)
    f = with_fold(c, 3)
    jobs = cut(f.select("model_id", "evaluation_id", "score", "fold", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("job")))
    jobs = jobs.select(F.col("job").cast("string").alias("job_id"), "model_id", "evaluation_id", F.when(F.col("fold") != F.col("job"), F.col("score")).alias("score"))
    w = Window.partitionBy("model_id")
    shown = c.select("model_id", "evaluation_id", F.row_number().over(w.orderBy(F.md5(F.concat("model_id", F.lit("|"), "evaluation_id")))).alias("p"), count_all().over(w).alias("n")).where("n > 5 AND p <= 5")
    sparse = shown.groupBy("model_id").agg(F.array_sort(F.collect_list("evaluation_id")).alias("probes"))
    sparse = cut(sparse.select(F.col("model_id").alias("job_id"), F.col("model_id").alias("target"), "probes", F.lit(None).cast("array<string>").alias("context")))
    truth = c.select("model_id", "evaluation_id", "suite_id", F.col("score").alias("actual"))
    parts = None
    for rank in (0, 1, 2):
        for protocol, p in (("folds", fits.fit_als(jobs, rank)), ("sparse", fits.fit_targets(c, sparse, rank, own_cells=True))):
            rows = p.join(truth, ["model_id", "evaluation_id"]).select(F.lit(rank).alias("rank"), F.lit(protocol).alias("protocol"), "suite_id", "actual", "predicted")
            parts = rows if parts is None else parts.unionByName(rows)
    sets = [["rank", "protocol"], ["rank", "protocol", "suite_id"]]
    return cut(parts).groupingSets(sets, "rank", "protocol", "suite_id").agg(*S.error_columns(), (count_all() - F.count("predicted")).alias("unsupported"))
