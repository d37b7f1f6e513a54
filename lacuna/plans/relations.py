"""Joins, set operations, estimators, splits, searches and product queries (inventory groups C, F, G, H)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lacuna.functions.text import same_key
from lacuna.functions.columns import count_all
from lacuna.kernels import transforms
from lacuna.operators import cells as C
from lacuna.operators import estimators as E
from lacuna.operators import fits, search
from lacuna.operators import stats as S
from lacuna.operators.orphans import find_orphans
from lacuna.plans.base import SQL_CELLS, SQL_FOLD, SQL_PRED, cells, predictions, with_fold
from lacuna.plans.quality import MIDNIGHT, sql_key, sql_missing
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


# ---- C: joins ----


@query("c1_retained_axes", f"WITH {SQL_CELLS}, m AS (SELECT model_id FROM c GROUP BY 1 HAVING count(*) >= 20), e AS (SELECT evaluation_id FROM c GROUP BY 1 HAVING count(*) >= 15) SELECT count(*) AS n FROM c SEMI JOIN m USING (model_id) SEMI JOIN e USING (evaluation_id)")
def c1(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    m = c.groupBy("model_id").count().where("count >= 20").select("model_id")
    e = c.groupBy("evaluation_id").count().where("count >= 15").select("evaluation_id")
    return c.join(m, "model_id", "left_semi").join(e, "evaluation_id", "left_semi").agg(count_all().alias("n"))


_MODELS = f"""mm AS (SELECT {sql_key('model_id')} AS k, min(model_id) AS model_id, min(CASE WHEN {sql_missing('family')} THEN NULL ELSE family END) AS family, min(provider) AS provider, min(release_date) AS release_date, min(verification_status) AS verification_status FROM model_metadata GROUP BY 1)"""


def _models(s, d):
    from lacuna.functions.text import given

    t = table(s, d, "model_metadata").select(same_key("model_id").alias("k"), "model_id", given("family").alias("family"), "provider", "release_date", "verification_status")
    return t.groupBy("k").agg(*[F.min(c).alias(c) for c in ("model_id", "family", "provider", "release_date", "verification_status")])


@query("c3_metadata_coalesce", f"WITH {_MODELS}, so AS (SELECT {sql_key('model_id')} AS k, min(CASE WHEN {sql_missing('canonical_family')} THEN NULL ELSE canonical_family END) AS cf, min(primary_paper_url) AS pu FROM model_sources WHERE NOT {sql_missing('model_id')} GROUP BY 1) SELECT mm.model_id, coalesce(cf, family) AS family, pu AS paper_url FROM mm LEFT JOIN so USING (k)")
def c3(s, d):
    from lacuna.functions.text import given, given_key

    so = table(s, d, "model_sources").select(given_key("model_id").alias("k"), given("canonical_family").alias("cf"), "primary_paper_url").where(F.col("k").isNotNull())
    so = so.groupBy("k").agg(F.min("cf").alias("cf"), F.min("primary_paper_url").alias("paper_url"))
    return _models(s, d).join(so, "k", "left").select("model_id", F.coalesce("cf", "family").alias("family"), "paper_url")


@query("c4_model_suites", f"WITH {SQL_CELLS}, {_MODELS}, k AS (SELECT model_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT suite_id)), ';') AS suites FROM c GROUP BY 1) SELECT mm.model_id, coalesce(n, 0) AS n, suites FROM mm LEFT JOIN k USING (model_id)")
def c4(s, d):
    k = cells(s, d).groupBy("model_id").agg(count_all().alias("n"), F.array_join(F.array_sort(F.collect_set("suite_id")), ";").alias("suites"))
    return _models(s, d).select("model_id").join(k, "model_id", "left").select("model_id", F.coalesce("n", F.lit(0)).alias("n"), "suites")


@query("c5_evaluation_rows", f"WITH {SQL_CELLS}, k AS (SELECT evaluation_id, count(*) AS n, min(suite_id) AS s, min(metric) AS m FROM c GROUP BY 1) SELECT evaluation_id, coalesce(t.suite_id, s) AS suite_id, coalesce(t.metric, m) AS metric, coalesce(n, 0) AS n FROM tasks t FULL JOIN k USING (evaluation_id)")
def c5(s, d):
    k = cells(s, d).groupBy("evaluation_id").agg(count_all().alias("n"), F.min("suite_id").alias("s"), F.min("metric").alias("m"))
    t = table(s, d, "tasks").select("evaluation_id", "suite_id", "metric")
    return t.join(k, "evaluation_id", "full").select("evaluation_id", F.coalesce("suite_id", "s").alias("suite_id"), F.coalesce("metric", "m").alias("metric"), F.coalesce("n", F.lit(0)).alias("n"))


_KEYED = lambda t: f"(SELECT {sql_key('model_id')} AS k, {sql_key('dedup_key')} AS c, min(try_cast(value AS DOUBLE)) AS v FROM {t} WHERE NOT {sql_missing('model_id')} AND NOT {sql_missing('dedup_key')} GROUP BY 1, 2)"
HIBOU, PHIKON = "hibou_official_scores_2024", "phikon_family_official_scores_2023_2024"


def _keyed(s, d, name):
    from lacuna.functions.text import given_key

    t = table(s, d, name).select(given_key("model_id").alias("k"), given_key("dedup_key").alias("c"), F.col("value").try_cast("double").alias("v"))
    return t.where(F.col("k").isNotNull() & F.col("c").isNotNull()).groupBy("k", "c").agg(F.min("v").alias("v"))


@query("c7_source_merge", f"WITH a AS {_KEYED(HIBOU)}, b AS {_KEYED(PHIKON)} SELECT k AS model_key, c AS cell_key, round(coalesce(a.v, b.v), 6) AS value, a.k IS NOT NULL AND b.k IS NOT NULL AS conflict, round(abs(a.v - b.v), 6) AS difference FROM a FULL JOIN b USING (k, c)")
def c7(s, d):
    a, b = _keyed(s, d, HIBOU).withColumn("ia", F.lit(True)), _keyed(s, d, PHIKON).withColumnRenamed("v", "w").withColumn("ib", F.lit(True))
    j = a.join(b, ["k", "c"], "full")
    both = F.coalesce(F.col("ia") & F.col("ib"), F.lit(False))
    return j.select(F.col("k").alias("model_key"), F.col("c").alias("cell_key"), F.round(F.coalesce("v", "w"), 6).alias("value"), both.alias("conflict"), F.round(F.abs(F.col("v") - F.col("w")), 6).alias("difference"))


@query("c8_alias_union", f"SELECT suite_id, model_alias, arg_max(model_id, struct_pack(t := reported_at, r := record_id)) AS model_id FROM (SELECT suite_id, model_alias, model_id, reported_at, record_id FROM {HIBOU} UNION ALL SELECT suite_id, model_alias, model_id, reported_at, record_id FROM {PHIKON}) WHERE model_alias IS NOT NULL AND model_id IS NOT NULL GROUP BY 1, 2")
def c8(s, d):
    cols = ["suite_id", "model_alias", "model_id", "reported_at", "record_id"]
    u = table(s, d, HIBOU).select(*cols).unionByName(table(s, d, PHIKON).select(*cols)).where(F.col("model_alias").isNotNull() & F.col("model_id").isNotNull())
    return u.groupBy("suite_id", "model_alias").agg(F.max_by("model_id", F.struct("reported_at", "record_id")).alias("model_id"))


@query("c10_ledger_coverage", "SELECT CASE WHEN s.evaluation_id IS NULL THEN 'task_without_scores' WHEN t.evaluation_id IS NULL THEN 'scores_without_task' WHEN s.suite_id <> t.suite_id THEN 'suite_differs' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT evaluation_id, min(suite_id) AS suite_id FROM scores GROUP BY 1) s FULL JOIN tasks t USING (evaluation_id) GROUP BY 1")
def c10(s, d):
    k = table(s, d, "scores").groupBy("evaluation_id").agg(F.min("suite_id").alias("s"), F.lit(True).alias("has_s"))
    t = table(s, d, "tasks").select("evaluation_id", "suite_id", F.lit(True).alias("has_t"))
    outcome = F.when(F.col("has_s").isNull(), "task_without_scores").when(F.col("has_t").isNull(), "scores_without_task").when(F.col("s") != F.col("suite_id"), "suite_differs").otherwise("ok")
    return k.join(t, "evaluation_id", "full").groupBy(outcome.alias("outcome")).agg(count_all().alias("n"))


@query("c11_coverage_difference", f"SELECT 'without_metadata' AS side, model_id FROM (SELECT model_id FROM score_matrix_wide EXCEPT SELECT model_id FROM model_metadata) UNION ALL SELECT 'without_scores', model_id FROM (SELECT model_id FROM model_metadata EXCEPT SELECT model_id FROM score_matrix_wide)")
def c11(s, d):
    a, b = table(s, d, "score_matrix_wide").select("model_id"), table(s, d, "model_metadata").select("model_id")
    return a.subtract(b).select(F.lit("without_metadata").alias("side"), "model_id").unionByName(b.subtract(a).select(F.lit("without_scores").alias("side"), "model_id"))


@query("c12_holdout_removal", f"WITH {SQL_CELLS}, h AS (SELECT model_id, evaluation_id FROM c WHERE {SQL_FOLD} = 0) SELECT count(*) AS n, round(avg(score), 6) AS mean FROM c ANTI JOIN h USING (model_id, evaluation_id)")
def c12(s, d):
    c = cells(s, d)
    held = with_fold(c).where("fold = 0").select("model_id", "evaluation_id")
    return c.join(held, ["model_id", "evaluation_id"], "left_anti").agg(count_all().alias("n"), F.round(F.avg("score"), 6).alias("mean"))


_PROBES = "pb AS (SELECT evaluation_id FROM c GROUP BY 1 ORDER BY count(*) DESC, evaluation_id LIMIT 5)"


def _probes(c, k=5):
    return c.groupBy("evaluation_id").agg(count_all().alias("n")).orderBy(F.desc("n"), "evaluation_id").limit(k).select("evaluation_id")


@query("c13_probe_reveal", f"WITH {SQL_CELLS}, {_PROBES}, t AS (SELECT min(model_id) AS target FROM c) SELECT c.model_id = t.target AS is_target, count(*) AS n FROM c, t WHERE c.model_id <> t.target OR c.evaluation_id IN (SELECT evaluation_id FROM pb) GROUP BY 1")
def c13(s, d):
    c = cells(s, d)
    p = _probes(c).withColumn("probe", F.lit(True))
    target = c.agg(F.min("model_id").alias("target"))
    j = c.join(F.broadcast(p), "evaluation_id", "left").crossJoin(F.broadcast(target))  # five probes, one target
    return j.where((F.col("model_id") != F.col("target")) | F.col("probe")).groupBy((F.col("model_id") == F.col("target")).alias("is_target")).agg(count_all().alias("n"))


@query("c15_strictly_earlier", f"WITH {_MODELS}, v AS (SELECT * FROM mm WHERE verification_status = 'verified' AND release_date IS NOT NULL) SELECT a.model_id, count(b.model_id) AS earlier FROM v a LEFT JOIN v b ON b.release_date < a.release_date GROUP BY 1")
def c15(s, d):
    v = _models(s, d).where((F.col("verification_status") == "verified") & F.col("release_date").isNotNull())
    days = v.groupBy("release_date").agg(count_all().alias("n"))  # one row per day: the running sum is over days, not models
    before = F.coalesce(F.sum("n").over(Window.orderBy("release_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return v.join(days.withColumn("earlier", before).drop("n"), "release_date").select("model_id", "earlier")


_CONC = f"""{SQL_CELLS}, m AS (SELECT model_id, round(avg(score), 6) AS predicted FROM c GROUP BY 1), x AS (SELECT c.evaluation_id, c.model_id, score AS actual, predicted, {SQL_FOLD.replace('model_id', 'c.model_id').replace('evaluation_id', 'c.evaluation_id')} = 0 AS held FROM c JOIN m USING (model_id))"""


@query("c16_pairwise_ranking", f"WITH {_CONC} SELECT a.evaluation_id, count(*) AS pairs, count(*) FILTER (WHERE a.predicted > b.predicted) AS correct, count(*) FILTER (WHERE a.predicted = b.predicted) AS tied FROM x a JOIN x b ON a.evaluation_id = b.evaluation_id AND a.actual >= b.actual + 5.0 AND (a.held OR b.held) GROUP BY 1")
def c16(s, d):
    c = cells(s, d)
    x = with_fold(c.join(c.groupBy("model_id").agg(F.round(F.avg("score"), 6).alias("predicted")), "model_id"))
    x = x.select("evaluation_id", "model_id", F.col("score").alias("actual"), "predicted", (F.col("fold") == 0).alias("held"))
    return S.concordance(x, "evaluation_id", 5.0).where("pairs > 0")


@query("c17_overlap_pairs", f"WITH {SQL_CELLS} SELECT a.evaluation_id AS a, b.evaluation_id AS b, count(*) AS n, round(corr(a.score, b.score), 6) AS r, round(sqrt(avg((a.score - b.score) ** 2)), 6) AS rmse FROM c a JOIN c b ON a.model_id = b.model_id AND a.evaluation_id < b.evaluation_id GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_pop(a.score) > 1e-9 AND stddev_pop(b.score) > 1e-9")
def c17(s, d):
    p = S.overlap_pairs(cells(s, d), "evaluation_id", "model_id", 5).where((F.sqrt("vx") > 1e-9) & (F.sqrt("vy") > 1e-9))
    return p.select("a", "b", "n", F.round("r", 6).alias("r"), F.round("rmse", 6).alias("rmse"))


@query("c18_matched_cells", f"WITH {SQL_CELLS}, {_PROBES}, o AS (SELECT evaluation_id FROM c GROUP BY 1 ORDER BY count(*), evaluation_id LIMIT 5), r AS (SELECT model_id, evaluation_id FROM c WHERE evaluation_id IN (SELECT evaluation_id FROM pb) UNION SELECT model_id, evaluation_id FROM c WHERE evaluation_id IN (SELECT evaluation_id FROM o)) SELECT count(*) AS matched, (SELECT count(*) FROM r) AS revealed FROM c ANTI JOIN r USING (model_id, evaluation_id)")
def c18(s, d):
    c = cells(s, d)
    rare = c.groupBy("evaluation_id").agg(count_all().alias("n")).orderBy("n", "evaluation_id").limit(5).select("evaluation_id")
    key = ["model_id", "evaluation_id"]
    arms = [c.join(p, "evaluation_id", "left_semi").select(*key) for p in (_probes(c), rare)]
    revealed = arms[0].union(arms[1]).distinct()
    return c.join(revealed, key, "left_anti").agg(count_all().alias("matched")).crossJoin(F.broadcast(revealed.agg(count_all().alias("revealed"))))  # one row each


@query("c19_dedup_groups", f"SELECT {sql_key('dedup_key')} AS identity, count(*) AS n, arg_min(record_id, struct_pack(v := inclusion_status <> 'accepted', i := record_id)) AS canonical FROM {PHIKON} WHERE NOT {sql_missing('dedup_key')} AND inclusion_status IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def c19(s, d):
    from lacuna.functions.text import given_key

    t = table(s, d, PHIKON).where(F.col("inclusion_status").isNotNull()).select(given_key("dedup_key").alias("identity"), "record_id", (F.col("inclusion_status") != "accepted").alias("variant"))
    g = t.where(F.col("identity").isNotNull()).groupBy("identity").agg(count_all().alias("n"), F.min_by("record_id", F.struct("variant", "record_id")).alias("canonical"))
    return g.where("n > 1")


@query("c20_task_contracts", "SELECT evaluation_id, suite_id || '/' || task_identity_id AS contract_id, coalesce(nullif(trim(dataset_artifact_id), ''), 'not_reported') AS artifact FROM tasks")
def c20(s, d):
    t = table(s, d, "tasks")
    return t.select("evaluation_id", F.concat("suite_id", F.lit("/"), "task_identity_id").alias("contract_id"), F.coalesce(F.nullif(F.trim("dataset_artifact_id"), F.lit("")), F.lit("not_reported")).alias("artifact"))


@query("c21_memberships", "SELECT task_identity_id, count(*) AS n, array_to_string(list_sort(list(evaluation_id)), ';') AS members FROM tasks GROUP BY 1")
def c21(s, d):
    return table(s, d, "tasks").groupBy("task_identity_id").agg(count_all().alias("n"), F.array_join(F.array_sort(F.collect_list("evaluation_id")), ";").alias("members"))


@query("c22_same_suite_probes", f"WITH {SQL_PRED}, {_PROBES}, ps AS (SELECT suite_id, count(DISTINCT evaluation_id) AS k FROM c WHERE evaluation_id IN (SELECT evaluation_id FROM pb) GROUP BY 1) SELECT p.suite_id, coalesce(k, 0) AS same_suite_probes, count(*) AS n FROM p LEFT JOIN ps USING (suite_id) GROUP BY 1, 2")
def c22(s, d):
    c = cells(s, d)
    per_suite = c.join(_probes(c), "evaluation_id", "left_semi").groupBy("suite_id").agg(F.countDistinct("evaluation_id").alias("k"))
    return predictions(s, d).join(per_suite, "suite_id", "left").groupBy("suite_id", F.coalesce("k", F.lit(0)).alias("same_suite_probes")).agg(count_all().alias("n"))


@query("c23_hierarchical_fallback", f"WITH {SQL_PRED}, e AS (SELECT *, abs(predicted - actual) AS e FROM p), l1 AS (SELECT evaluation_id, median(e) AS q FROM e GROUP BY 1 HAVING count(*) >= 5), l2 AS (SELECT suite_id, median(e) AS q FROM e GROUP BY 1 HAVING count(*) >= 20), l3 AS (SELECT median(e) AS q FROM e), t AS (SELECT DISTINCT evaluation_id, suite_id FROM c) SELECT t.evaluation_id, CASE WHEN l1.q IS NOT NULL THEN 'evaluation' WHEN l2.q IS NOT NULL THEN 'suite' ELSE 'global' END AS level, round(coalesce(l1.q, l2.q, l3.q), 6) AS q FROM t LEFT JOIN l1 USING (evaluation_id) LEFT JOIN l2 USING (suite_id), l3")
def c23(s, d):
    e = predictions(s, d).withColumn("e", F.abs(F.col("predicted") - F.col("actual")))
    level = lambda k, least, out: e.groupBy(k).agg(F.median("e").alias(out), count_all().alias("n")).where(F.col("n") >= least).drop("n")
    t = cells(s, d).select("evaluation_id", "suite_id").distinct()
    j = t.join(level("evaluation_id", 5, "q1"), "evaluation_id", "left").join(level("suite_id", 20, "q2"), "suite_id", "left").crossJoin(F.broadcast(e.agg(F.median("e").alias("q3"))))  # one row: an ungrouped aggregate
    name = F.when(F.col("q1").isNotNull(), "evaluation").when(F.col("q2").isNotNull(), "suite").otherwise("global")
    return j.select("evaluation_id", name.alias("level"), F.round(F.coalesce("q1", "q2", "q3"), 6).alias("q"))


@query("c25_group_purge", f"WITH {SQL_CELLS}, f AS (SELECT *, {SQL_FOLD} AS fold FROM c) SELECT a.fold, count(*) AS kept FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.fold = 0 AND b.model_id = a.model_id AND b.suite_id = a.suite_id) AND a.fold <> 0 GROUP BY 1")
def c25(s, d):
    f = with_fold(cells(s, d))
    test = f.where("fold = 0").select("model_id", "suite_id").distinct()
    return f.where("fold <> 0").join(test, ["model_id", "suite_id"], "left_anti").groupBy("fold").agg(count_all().alias("kept"))


@query("c28_rule_checks", f"""WITH g AS (SELECT {sql_key('dedup_key')} AS identity, count(DISTINCT metric) AS metrics, count(DISTINCT suite_id) AS suites, count(*) FILTER (WHERE inclusion_status = 'accepted') AS accepted FROM {HIBOU} WHERE NOT {sql_missing('dedup_key')} GROUP BY 1)
SELECT *, CASE WHEN metrics > 1 OR suites > 1 THEN 'identities_differ' WHEN accepted = 0 THEN 'no_canonical' WHEN accepted > 1 THEN 'several_canonical' ELSE 'ok' END AS verdict FROM g""")
def c28(s, d):
    """One canonical record a group, of one metric and suite: counts and the first rule that is broken."""
    from lacuna.functions.text import given_key

    t = table(s, d, HIBOU).select(given_key("dedup_key").alias("identity"), "metric", "suite_id", "inclusion_status").where(F.col("identity").isNotNull())
    ok = F.sum((F.coalesce(F.col("inclusion_status"), F.lit("")) == "accepted").cast("long"))
    g = t.groupBy("identity").agg(F.countDistinct("metric").alias("metrics"), F.countDistinct("suite_id").alias("suites"), ok.alias("accepted"))
    verdict = F.when((F.col("metrics") > 1) | (F.col("suites") > 1), "identities_differ").when(F.col("accepted") == 0, "no_canonical").when(F.col("accepted") > 1, "several_canonical").otherwise("ok")
    return g.withColumn("verdict", verdict)


# ---- G: estimators ----

_EST = f"""{SQL_CELLS}, f AS (SELECT *, {SQL_FOLD} AS fold FROM c), x AS (SELECT model_id, evaluation_id, score FROM f WHERE fold <> 0), q AS (SELECT model_id, evaluation_id, score AS actual FROM f WHERE fold = 0)"""


def _train_ask(s, d):
    f = with_fold(cells(s, d))
    return f.where("fold <> 0").select("model_id", "evaluation_id", "score"), f.where("fold = 0").select("model_id", "evaluation_id")


def _out(frame):
    """Rounded a little off the middle, as means of a few two-digit scores are often exact ties."""
    return frame.select("model_id", "evaluation_id", F.round(F.col("predicted"), 9).alias("predicted"))


@query("g11_benchmark_mean", f"WITH {_EST} SELECT model_id, evaluation_id, round((SELECT avg(score) FROM x WHERE x.evaluation_id = q.evaluation_id), 9) AS predicted FROM q")
def g11(s, d):
    return _out(E.benchmark_mean(*_train_ask(s, d)))


@query("g12_model_mean", f"WITH {_EST}, r AS (SELECT model_id, avg(score) AS v FROM x GROUP BY 1), k AS (SELECT evaluation_id, avg(score) AS v FROM x GROUP BY 1) SELECT q.model_id, q.evaluation_id, round(coalesce(r.v, k.v), 9) AS predicted FROM q LEFT JOIN r USING (model_id) LEFT JOIN k USING (evaluation_id)")
def g12(s, d):
    return _out(E.model_mean(*_train_ask(s, d)))


@query("g13_model_knn", f"""WITH {_EST}, dist AS (SELECT a.model_id AS t, b.model_id AS o, round(sqrt(avg((a.score - b.score) ** 2)), 9) AS d FROM x a JOIN x b ON a.evaluation_id = b.evaluation_id AND a.model_id <> b.model_id GROUP BY 1, 2 HAVING count(*) >= 3),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, o) AS k FROM dist) WHERE k <= 5), v AS (SELECT q.model_id, q.evaluation_id, avg(x.score) AS v FROM q JOIN nn ON nn.t = q.model_id JOIN x ON x.model_id = nn.o AND x.evaluation_id = q.evaluation_id GROUP BY 1, 2),
k AS (SELECT evaluation_id, avg(score) AS v FROM x GROUP BY 1) SELECT q.model_id, q.evaluation_id, round(coalesce(v.v, k.v), 9) AS predicted FROM q LEFT JOIN v USING (model_id, evaluation_id) LEFT JOIN k USING (evaluation_id)""")
def g13(s, d):
    return _out(E.model_knn(*_train_ask(s, d)))


@query("g14_bench_knn", f"""WITH {_EST}, mo AS (SELECT evaluation_id, avg(score) AS m, CASE WHEN stddev_pop(score) < 1e-8 THEN 1 ELSE stddev_pop(score) END AS sd FROM x GROUP BY 1),
co AS (SELECT a.evaluation_id AS t, b.evaluation_id AS o, round(corr(a.score, b.score), 9) AS r FROM x a JOIN x b ON a.model_id = b.model_id AND a.evaluation_id <> b.evaluation_id GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_pop(a.score) > 1e-9 AND stddev_pop(b.score) > 1e-9),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r DESC, o) AS k FROM co) WHERE k <= 5),
v AS (SELECT q.model_id, q.evaluation_id, sum(greatest(r, 0.01) * (x.score - mo.m) / mo.sd) / sum(greatest(r, 0.01)) AS z FROM q JOIN nn ON nn.t = q.evaluation_id JOIN x ON x.model_id = q.model_id AND x.evaluation_id = nn.o JOIN mo ON mo.evaluation_id = nn.o GROUP BY 1, 2)
SELECT q.model_id, q.evaluation_id, round(mo.m + mo.sd * coalesce(v.z, 0), 9) AS predicted FROM q LEFT JOIN v USING (model_id, evaluation_id) LEFT JOIN mo USING (evaluation_id)""")
def g14(s, d):
    return _out(E.bench_knn(*_train_ask(s, d)))


def _sql_regression(by: str, across: str) -> str:
    return f"""WITH {_EST}, fit AS (SELECT a.{by} AS t, b.{by} AS o, regr_slope(a.score, b.score) AS sl, regr_intercept(a.score, b.score) AS ic, round(regr_r2(a.score, b.score), 9) AS r2 FROM x a JOIN x b ON a.{across} = b.{across} AND a.{by} <> b.{by} GROUP BY 1, 2 HAVING count(*) >= 5 AND var_pop(a.score) * count(*) >= 1e-10 AND var_pop(b.score) * count(*) >= 1e-10),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r2 DESC, o) AS k FROM fit) WHERE k <= 5 AND r2 >= 0.2 AND t IN (SELECT {by} FROM x GROUP BY 1 HAVING count(*) >= 5)),
v AS (SELECT q.model_id, q.evaluation_id, sum(r2 * (sl * x.score + ic)) / sum(r2) AS v FROM q JOIN best ON best.t = q.{by} JOIN x ON x.{by} = best.o AND x.{across} = q.{across} GROUP BY 1, 2)
SELECT q.model_id, q.evaluation_id, round(v.v, 9) AS predicted FROM q LEFT JOIN v USING (model_id, evaluation_id)"""


@query("g15_benchmark_regression", _sql_regression("evaluation_id", "model_id"))
def g15(s, d):
    return _out(E.regression(*_train_ask(s, d), by="evaluation_id"))


@query("g15_model_regression", _sql_regression("model_id", "evaluation_id"))
def g15m(s, d):
    return _out(E.regression(*_train_ask(s, d), by="model_id"))


def _fit_jobs(s, d, folds=3):
    """Every fold as one job: the other folds' cells, and the fold's cells asked for."""
    f = with_fold(cells(s, d), folds)
    jobs = f.select("model_id", "evaluation_id", "score", "fold", F.explode(F.array(*[F.lit(i) for i in range(folds)])).alias("job"))
    return jobs.select(F.col("job").cast("string").alias("job_id"), "model_id", "evaluation_id", F.when(F.col("fold") != F.col("job"), F.col("score")).alias("score")), f.select("model_id", "evaluation_id", "score", F.col("fold").cast("string").alias("job_id"))


@query("g2_cross_validated_als")
def g2(s, d):
    """Errors of the rank-1 completion over three hash folds."""
    jobs, truth = _fit_jobs(s, d)
    p = fits.fit_als(jobs, 1).join(truth, ["job_id", "model_id", "evaluation_id"])
    return p.select("job_id", F.col("score").alias("actual"), "predicted").groupBy("job_id").agg(*S.error_columns(), (count_all() - F.count("predicted")).alias("unsupported"))


def _settings(s):
    """The grid of 7 transforms x 49 settings."""
    rows = [(fits.setting_label(t, m, a), t, m, json.dumps(a, sort_keys=True)) for t in transforms.TRANSFORMS for m, a in fits.SETTINGS]
    return s.createDataFrame(rows, "job_id string, transform string, method string, arguments string")


@query("f17_method_grid")
def f17(s, d):
    """All 343 settings (7 transforms x 49) on all of three folds, one task a fit, with errors and coverage."""
    grid = _settings(s)
    f = with_fold(cells(s, d), 3)
    p = fits.fit_grid(f.select("model_id", "evaluation_id", "score", "fold"), grid, 3, named=False)
    e = p.groupBy("job_id").agg(*S.error_columns(), F.round(F.count("predicted") / count_all(), 6).alias("coverage"))
    return grid.join(F.broadcast(e), "job_id", "left")  # a row per setting


@query("b22_setting_labels", "SELECT arguments, substr(sha1(arguments), 1, 10) AS label FROM (VALUES " + ", ".join(f"('{t}')" for t in sorted({json.dumps(a, sort_keys=True, separators=(',', ':')) for _, a in fits.SETTINGS})) + ") t(arguments)")
def b22(s, d):
    """Short labels of the settings by the head of a hash."""
    rows = [(t,) for t in sorted({json.dumps(a, sort_keys=True, separators=(",", ":")) for _, a in fits.SETTINGS})]
    return s.createDataFrame(rows, "arguments string").select("arguments", F.substring(F.sha1("arguments"), 1, 10).alias("label"))


@query("g22_conformal_intervals", f"""WITH {SQL_CELLS}, f AS (SELECT *, {SQL_FOLD} AS fold FROM c), p AS (SELECT a.model_id, a.evaluation_id, a.fold, any_value(a.score) AS actual, avg(b.score) AS predicted, stddev_pop(b.score) AS risk FROM f a JOIN f b ON a.evaluation_id = b.evaluation_id AND a.fold <> b.fold GROUP BY ALL),
r AS (SELECT *, abs(predicted - actual) / risk AS ratio FROM p WHERE risk > 1e-8), sc AS (SELECT k.fold, quantile_cont(r.ratio, 0.9) AS scale FROM (SELECT DISTINCT fold FROM p) k JOIN r ON r.fold <> k.fold GROUP BY 1 HAVING count(*) >= 5)
SELECT p.fold, count(*) AS n, round(avg((abs(predicted - actual) <= scale * risk)::INT), 6) AS coverage, round(median(2 * scale * risk), 5) AS width FROM p JOIN sc USING (fold) GROUP BY 1""")
def g22(s, d):
    f = with_fold(cells(s, d))
    part = f.groupBy("evaluation_id", "fold").agg(count_all().alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"))
    whole = part.groupBy("evaluation_id").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    n, m = F.col("tn") - F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    rest = part.join(whole, "evaluation_id").where(n > 0).select("evaluation_id", "fold", m.alias("predicted"), F.sqrt(F.greatest(F.lit(0.0), (F.col("tss") - F.col("ss")) / n - m * m)).alias("risk"))
    p = f.join(rest, ["evaluation_id", "fold"]).withColumn("e", F.abs(F.col("predicted") - F.col("score")))
    ratios = p.where(F.col("risk") > 1e-5).select("fold", (F.col("e") / F.col("risk")).alias("ratio"))
    folds = F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)])).alias("target")
    scale = ratios.select("fold", "ratio", folds).where(F.col("fold") != F.col("target")).groupBy("target").agg(F.percentile("ratio", 0.9).alias("scale"), count_all().alias("k")).where("k >= 5")
    j = p.join(F.broadcast(scale.select(F.col("target").alias("fold"), "scale")), "fold")  # a row per fold
    return j.groupBy("fold").agg(count_all().alias("n"), F.round(F.avg((F.col("e") <= F.col("scale") * F.col("risk")).cast("double")), 6).alias("coverage"), F.round(F.median(2 * F.col("scale") * F.col("risk")), 5).alias("width"))


@query("g27_relative_margins", f"WITH {SQL_CELLS} SELECT evaluation_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE 0.5 * stddev_pop(score) END, 6) AS sd_margin, round(CASE WHEN count(*) < 2 THEN 0 ELSE 0.5 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) END, 6) AS iqr_margin FROM c GROUP BY 1")
def g27(s, d):
    few = count_all() < 2
    return cells(s, d).groupBy("evaluation_id").agg(F.round(F.when(few, 0.0).otherwise(0.5 * F.stddev_pop("score")), 6).alias("sd_margin"), F.round(F.when(few, 0.0).otherwise(0.5 * (F.percentile("score", 0.75) - F.percentile("score", 0.25))), 6).alias("iqr_margin"))


# ---- F: splits and search ----


@query("f1_hash_folds", f"WITH {SQL_CELLS} SELECT model_id, evaluation_id, {SQL_FOLD} AS fold FROM c")
def f1(s, d):
    return with_fold(cells(s, d)).select("model_id", "evaluation_id", "fold")


@query("f3_suite_blocks", f"WITH {SQL_CELLS}, t AS (SELECT *, count(*) OVER (PARTITION BY model_id) AS n, count(*) OVER (PARTITION BY model_id, suite_id) AS inside FROM c) SELECT suite_id, model_id, evaluation_id FROM t WHERE n > inside")
def f3(s, d):
    """The split itself: for each suite the held cells, those of models observed in it and elsewhere."""
    c = cells(s, d)
    k = c.groupBy("model_id", "suite_id").agg(count_all().alias("inside"))
    bridge = k.join(k.groupBy("model_id").agg(F.sum("inside").alias("n")), "model_id").where(F.col("n") > F.col("inside")).select("model_id", "suite_id")
    return c.join(bridge, ["model_id", "suite_id"], "left_semi").select("suite_id", "model_id", "evaluation_id")


@query("f4_sparse_new_models", f"WITH {SQL_CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY md5(model_id || '|' || evaluation_id)) AS p, count(*) OVER (PARTITION BY model_id) AS n FROM c) SELECT k, model_id, evaluation_id, p <= k AS revealed FROM o, (VALUES (3), (5), (10)) AS t(k) WHERE n > k")
def f4(s, d):
    """The split itself: for each k and model of more than k cells, which are revealed and which hidden."""
    w = Window.partitionBy("model_id")
    o = cells(s, d).select("model_id", "evaluation_id", F.row_number().over(w.orderBy(F.md5(F.concat("model_id", F.lit("|"), "evaluation_id")))).alias("p"), count_all().over(w).alias("n"))
    x = o.select("model_id", "evaluation_id", "p", "n", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("k")).where("n > k")
    return x.select("k", "model_id", "evaluation_id", (F.col("p") <= F.col("k")).alias("revealed"))


@query("f6_family_folds", f"WITH {_MODELS}, g AS (SELECT model_id, coalesce({sql_key('family')}, 'model:' || model_id) AS grp FROM mm) SELECT model_id, dense_rank() OVER (ORDER BY grp) - 1 AS fold FROM g")
def f6(s, d):
    g = _models(s, d).select("model_id", F.coalesce(same_key("family"), F.concat(F.lit("model:"), "model_id")).alias("grp"))
    folds = g.select("grp").distinct().withColumn("fold", F.row_number().over(Window.orderBy("grp")) - 1)  # one row per family
    return g.join(folds.select("grp", "fold"), "grp").select("model_id", F.col("fold").cast("long").alias("fold"))


@query("f9_temporal_targets", f"WITH {SQL_CELLS}, {_MODELS}, n AS (SELECT model_id, count(*) AS n FROM c GROUP BY 1) SELECT model_id, n FROM mm JOIN n USING (model_id) WHERE verification_status = 'verified' AND release_date BETWEEN DATE '2022-01-01' AND DATE '2024-12-31' AND n > 20")
def f9(s, d):
    n = cells(s, d).groupBy("model_id").agg(count_all().alias("n")).where("n > 20")
    m = _models(s, d).where((F.col("verification_status") == "verified") & F.col("release_date").between("2022-01-01", "2024-12-31"))
    return m.join(n, "model_id").select("model_id", "n")


@query("f10_text_seeds", f"WITH {_MODELS} SELECT model_id, CAST('0x' || substr(sha256('42:model_' || model_id || ':0'), 1, 8) AS BIGINT) AS seed FROM mm")
def f10(s, d):
    return _models(s, d).select("model_id", F.conv(F.substring(F.sha2(F.concat(F.lit("42:model_"), "model_id", F.lit(":0")), 256), 1, 8), 16, 10).cast("long").alias("seed"))


@query("f13_greedy_probes")
def f13(s, d):
    """Three greedy probes: each round refits every model as a target for every remaining candidate; least median error over all cells."""
    return search.refit_greedy(cells(s, d), rounds=3).drop("spent")


@query("f15_exhaustive_pairs")
def f15(s, d):
    """The best of all two-probe sets, ranked by hidden error."""
    return search.exhaustive_probes(cells(s, d), candidates=None, size=2)


def _probe_costs(s, d):
    t = table(s, d, "tasks")
    return t.select("evaluation_id", F.col("num_samples").try_cast("double").alias("cost")), t.select("evaluation_id", F.col("task_identity_id").alias("identity"))


@query("f14_budgeted_probes")
def f14(s, d):
    """Greedy probes under a total sample budget, one per task identity, judged by refits; unknown counts are screened out."""
    costs, identities = _probe_costs(s, d)
    return search.refit_greedy(cells(s, d), rounds=3, costs=costs, budget=60_000.0, identities=identities)


@query("f14_exact_probes")
def f14_exact(s, d):
    """The best of all sets of up to two probes within a total sample budget, one per task identity, every set refitted."""
    costs, identities = _probe_costs(s, d)
    return search.refit_exact(cells(s, d), 2, objective="hidden_medae", costs=costs, budget=2_000.0, identities=identities)


@query("d44_informativeness")
def d44(s, d):
    """Every evaluation as the only probe, all models refitted: parity error, gain over the column median, coverage, and places by both."""
    c = cells(s, d)
    sets = c.select("evaluation_id").distinct().select(F.col("evaluation_id").alias("set_id"), F.array("evaluation_id").alias("members"))
    one = search.refit_sets(c, sets).select(F.col("set_id").alias("evaluation_id"), "hidden", F.round("parity_medae", 6).alias("parity_medae"))
    middle = c.groupBy("evaluation_id").agg(F.median("score").alias("_m"), count_all().alias("models"))
    base = c.join(middle, "evaluation_id").agg(F.median(F.abs(F.col("score") - F.col("_m"))).alias("_base"), F.countDistinct("model_id").alias("_all"))
    j = one.join(middle.drop("_m"), "evaluation_id").crossJoin(F.broadcast(base))  # one row: an ungrouped aggregate
    j = j.select("evaluation_id", "hidden", "parity_medae", F.round(F.col("_base") - F.col("parity_medae"), 6).alias("improvement"), F.round(F.col("models") / F.col("_all"), 6).alias("coverage"))
    j = S.global_place(cut(j), "parity_medae", ["evaluation_id"], "place").drop("total")
    return S.global_place(j.withColumn("_c", -F.col("coverage")), "_c", ["evaluation_id"], "coverage_place").drop("total", "_c")


# ---- H: product ----


@query("h4_list_models", f"WITH {SQL_CELLS} SELECT model_id, count(*) AS observed, (SELECT count(DISTINCT evaluation_id) FROM c) AS evaluations FROM c GROUP BY 1")
def h4(s, d):
    c = cells(s, d)
    return c.groupBy("model_id").agg(count_all().alias("observed")).crossJoin(F.broadcast(c.agg(F.countDistinct("evaluation_id").alias("evaluations"))))  # one row: an ungrouped aggregate


@query("h5_list_evaluations", f"WITH {SQL_CELLS} SELECT evaluation_id, min(suite_id) AS suite_id, min(metric) AS metric, count(*) AS observed FROM c GROUP BY 1")
def h5(s, d):
    return cells(s, d).groupBy("evaluation_id").agg(F.min("suite_id").alias("suite_id"), F.min("metric").alias("metric"), count_all().alias("observed"))


@query("h3_impute")
def h3(s, d):
    """One row per cell of the supported table: observed or imputed, native estimate, supports, second-rank sensitivity."""
    core = C.support_core(cells(s, d), 3, 5)
    labels = core.groupBy("evaluation_id").agg(F.min("suite_id").alias("suite_id"), F.min("metric").alias("metric"))
    g = fits.complete_grid(core, rank=1, comparison_rank=2).join(labels, "evaluation_id")
    hidden = ~F.col("observed")
    return g.select(
        "model_id", "evaluation_id", "suite_id", "metric", F.when(F.col("observed"), "observed").otherwise("imputed").alias("status"),
        F.round("score", 6).alias("normalized_score"), F.round(C.native_score(F.col("score"), F.col("metric")), 6).alias("native_score_estimate"),
        "model_observations", "evaluation_observations",
        F.lit("logit_zscore_bias_als").alias("method"), F.lit(1).alias("rank"), F.lit(2).alias("comparison_rank"),
        F.when(hidden, F.round("comparison", 6)).alias("comparison_normalized_score"),
        F.when(hidden, F.round(F.abs(F.col("score") - F.col("comparison")), 6)).alias("rank_sensitivity_absolute_difference"),
    )


@query("h7_complete_model")
def h7(s, d):
    """Missing cells of the most observed model."""
    core = C.support_core(cells(s, d), 3, 5)
    target = core.groupBy("model_id").agg(count_all().alias("n")).orderBy(F.desc("n"), "model_id").limit(1).select("model_id")
    asked = core.select("evaluation_id").distinct().crossJoin(F.broadcast(target)).join(core.select("model_id", "evaluation_id"), ["model_id", "evaluation_id"], "left_anti")  # one model
    return fits.complete_cells(core, asked, 1).select("model_id", "evaluation_id", F.round("predicted", 6).alias("predicted"))


@query("e6_leaderboard", f"""WITH {SQL_CELLS}, m AS (SELECT model_id, round(avg(score), 6) AS mean FROM c GROUP BY 1), g AS (SELECT m.model_id, e.evaluation_id, c.score IS NOT NULL AS observed, coalesce(c.score, m.mean) AS x FROM m CROSS JOIN (SELECT DISTINCT evaluation_id FROM c) e LEFT JOIN c ON c.model_id = m.model_id AND c.evaluation_id = e.evaluation_id)
SELECT model_id, evaluation_id, observed, round(x, 6) AS score, row_number() OVER (PARTITION BY evaluation_id ORDER BY x DESC, model_id) AS place FROM g""")
def e6(s, d):
    """All models of each evaluation, by the observed score or else the model's mean."""
    c = cells(s, d).select("model_id", "evaluation_id", "score")
    grid = c.groupBy("model_id").agg(F.round(F.avg("score"), 6).alias("mean")).crossJoin(c.select("evaluation_id").distinct())  # the completed table itself
    g = grid.join(c, ["model_id", "evaluation_id"], "left").withColumn("observed", F.col("score").isNotNull()).withColumn("x", -F.coalesce("score", "mean"))
    placed = S.group_place(g, "evaluation_id", "x", ["model_id"])
    return placed.select("model_id", "evaluation_id", "observed", F.round(-F.col("x"), 6).alias("score"), "place")


@query("h12_site_rows", f"WITH {SQL_CELLS} SELECT model_id, count(*) AS n, array_to_string([x.e || '=' || x.s for x in list_sort(list(struct_pack(e := evaluation_id, s := printf('%.2f', score))))], ',') AS cells FROM c GROUP BY 1")
def h12(s, d):
    pair = F.struct(F.col("evaluation_id").alias("e"), F.format_string("%.2f", F.col("score")).alias("s"))
    return cells(s, d).groupBy("model_id").agg(count_all().alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: F.concat(x["e"], F.lit("="), x["s"])), ",").alias("cells"))


@query("a11_wide_matrix", f"WITH {SQL_CELLS}, r AS (SELECT model_id, evaluation_id, round(score, 6) AS score FROM c) SELECT * FROM (PIVOT r ON evaluation_id USING first(score) GROUP BY model_id)")
def a11(s, d):
    """One row a model, one column an evaluation, in the order of their names; missing cells are null."""
    c = cells(s, d)
    names = sorted(r["evaluation_id"] for r in c.select("evaluation_id").distinct().collect())  # a column per evaluation
    return c.groupBy("model_id").pivot("evaluation_id", names).agg(F.round(F.first("score"), 6))


@query("c6_cell_semi_filter", f"WITH {SQL_CELLS} SELECT c.model_id, c.evaluation_id FROM c WHERE EXISTS (SELECT 1 FROM {MIDNIGHT} x WHERE {sql_key('x.model_id')} = {sql_key('c.model_id')} AND {sql_key('x.evaluation_id')} = {sql_key('c.evaluation_id')})")
def c6(s, d):
    c = cells(s, d).select("model_id", "evaluation_id", same_key("model_id").alias("m"), same_key("evaluation_id").alias("e"))
    lost = find_orphans(c, ["m", "e"], table(s, d, MIDNIGHT).select(same_key("model_id").alias("m"), same_key("evaluation_id").alias("e")), ["m", "e"], keep=["model_id", "evaluation_id"])
    return c.select("model_id", "evaluation_id").join(lost.select("model_id", "evaluation_id"), ["model_id", "evaluation_id"], "left_anti")
