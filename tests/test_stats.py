"""Cells, order statistics, errors, rankings and kernels on hand-built values and against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.kernels import als, factor, transforms
from lacuna.operators import cells as C
from lacuna.operators import estimators as E
from lacuna.operators import fits, relational_als, search
from lacuna.operators import stats as S
from lacuna.operators.ranks import running, value_counts_below


def _cells(spark, rows):
    return spark.createDataFrame(rows, "model_id string, evaluation_id string, score double")


def _random_cells(spark, n=14, m=9, seed=0, share=0.7):
    rng = np.random.default_rng(seed)
    rows = [(f"m{i:02d}", f"e{j:02d}", float(np.round(50 + 2 * i - j + rng.normal(0, 4), 2))) for i in range(n) for j in range(m) if rng.random() < share]
    return _cells(spark, rows), rows


def test_support_core_fixpoint(spark):
    rows = [("a", "x", 80.0), ("a", "y", 81.0), ("b", "x", 70.0), ("b", "y", 71.0), ("c", "x", 60.0), ("c", "z", 62.0)]
    assert sorted((r.model_id, r.evaluation_id) for r in C.support_core(_cells(spark, rows), 2, 2).collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert C.support_core(_cells(spark, []), 2, 2).count() == 0


def test_unique_cells(spark):
    with pytest.raises(C.DuplicateCellError):
        C.require_unique(_cells(spark, [("a", "x", 1.0), ("a", "x", 2.0)]), ["model_id", "evaluation_id"])


def test_medape_guard(spark):
    rows = list(zip([0.0, 1e-6, -1e-6, 10.0, -20.0], [100.0, 100.0, 100.0, 11.0, -24.0]))
    r = spark.createDataFrame(rows, "actual double, predicted double").agg(*S.error_columns()).first()
    assert r.medape == 15.0 and r.n == 5


def test_native_scores(spark):
    rows = [(80.0, "pearson_r", 0.6), (82.2, "dice", 0.822), (65.6, "other", 65.6)]
    got = spark.createDataFrame(rows, "s double, m string, w double").select(C.native_score(F.col("s"), F.col("m")).alias("g"), "w").collect()
    assert all(abs(r.g - r.w) < 1e-12 for r in got)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_loo_median_ranks_and_quantile(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"g{k}", i, float(rng.integers(0, 6 + 4 * k))) for k in range(4) for i in range(1 + 3 * k)]
    frame = spark.createDataFrame(rows, "g string, i int, x double")
    by = {}
    for g, i, x in rows:
        by.setdefault(g, []).append((i, x))
    for r in S.leave_one_out_median(frame, "g", "x").collect():
        rest = [x for i, x in by[r.g] if i != r.i]
        assert (r.loo_median is None and not rest) or r.loo_median == np.median(rest)
    for r in S.average_ranks(frame, "g", "x").collect():
        xs = np.array([x for _, x in by[r.g]])
        assert r.avg_rank == (xs < r.x).sum() + ((xs == r.x).sum() + 1) / 2
    for r in S.finite_sample_quantile(frame, "g", "x", 0.9).collect():
        xs = sorted(x for _, x in by[r.g])
        assert r.q == xs[min(len(xs), int(np.ceil((len(xs) + 1) * 0.9))) - 1]


def test_mad(spark):
    got = {r.g: r.dispersion for r in S.mad(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0)], "g string, x double"), "g", "x").collect()}
    assert got["b"] is None and abs(got["a"] - 1.4826) < 1e-12


def test_equal_count_bins(spark):
    rows = [(i, 7) for i in range(1, 8)]
    got = [r.b for r in spark.createDataFrame(rows, "p int, n int").select("p", S.equal_count_bin(F.col("p"), F.col("n"), 3).alias("b")).orderBy("p").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3]


def test_isotonic_against_pooling(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        y, w = rng.normal(size=9), rng.integers(1, 5, size=9).astype(float)
        blocks = []
        for v, k in zip(y, w):
            blocks.append([v, k, 1])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                b = blocks.pop()
                a = blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
        want = [v for v, _, n in blocks for _ in range(n)]
        frame = spark.createDataFrame([(i, float(v), float(k)) for i, (v, k) in enumerate(zip(y, w))], "bin int, v double, w double")
        got = [r.fitted for r in S.isotonic(frame, "bin", "v", "w").orderBy("bin").collect()]
        assert np.allclose(got, want)


def test_pairwise_ranking(spark):
    rows = [("e", m, a, p, h) for m, a, p, h in zip("abcd", [90.0, 80.0, 70.0, 60.0], [90.0, 75.0, 75.0, 60.0], [False, True, True, False])]
    frame = spark.createDataFrame(rows, "g string, model_id string, actual double, predicted double, held boolean")
    for block in (4096, 2, 1):
        r = S.concordance(frame, "g", 0.0, block).first()
        assert (r.pairs, r.correct, r.tied) == (5, 4, 1)


def test_running_sum_and_value_counts(spark):
    frame = spark.range(1000).select("id", F.xxhash64("id").alias("h"), (F.col("id") % 3 * 0).alias("g"), (F.col("id") % 7).alias("v"))
    got = [r.place for r in running(frame, ["g"], "h", ["id"]).orderBy("h", "id").collect()]
    assert got == list(range(1, 1001))
    counts = {r.v: (r.n, r.below) for r in value_counts_below(frame, "g", "v").collect()}
    below = 0
    for v in range(7):
        n = len([i for i in range(1000) if i % 7 == v])
        assert counts[v] == (n, below)
        below += n


# ---- kernels ----


def test_completion_keeps_observed_cells():
    rng = np.random.default_rng(0)
    table = np.clip(60 + rng.normal(0, 10, (6, 5)), 1, 99)
    hole = np.zeros((6, 5), dtype=bool)
    hole[[0, 1, 2, 3, 4], [0, 1, 2, 3, 4]] = True
    r, c = np.nonzero(~hole)
    for rank in (0, 1, 2):
        out = als.complete(r, c, table[r, c], 6, 5, rank)
        assert np.array_equal(out[r, c], table[r, c]) and np.isfinite(out).all() and out.min() >= 0 and out.max() <= 100


def test_completion_checks():
    with pytest.raises(ValueError):
        als.complete([0], [0], [50.0], 1, 2, 1)
    with pytest.raises(ValueError):
        als.complete([0], [0], [50.0], 2, 1, 1)
    with pytest.raises(ValueError):
        als.bias_als([0], [0], [1.0], 1, 1, 1, ridge=0.0)
    assert np.isfinite(als.complete([1, 1, 2, 2], [0, 1, 0, 1], [60.0, 70.0, 80.0, 90.0], 3, 2, 0, allow_empty_rows=True)).all()


def test_other_kernels_keep_observed_cells():
    rng = np.random.default_rng(1)
    r, c = np.nonzero(rng.random((12, 8)) < 0.7)
    x = rng.normal(0, 1, len(r))
    for name, f in factor.COMPLETERS.items():
        out = f(r, c, x, 12, 8) if name == "nuclear_norm" else f(r, c, x, 12, 8, rank=2)
        assert np.allclose(out[r, c], x) and np.isfinite(out).all(), name
    assert np.isfinite(factor.soft_impute(r, c, 50 + 5 * x, 12, 8, rank=1)).all()


def test_transforms_round_trip():
    x = np.array([1.0, 20.0, 20.0, 55.5, 98.0])
    for name in ("identity", "log1p", "logit", "asinh", "sqrt", "probit", "quantile"):
        assert np.allclose(transforms.inverse(name, transforms.forward(name, x), x), x, atol=1e-6), name
    assert np.array_equal(transforms.forward("logit", np.array([500.0])), [500.0])


def test_grouped_fit_equals_kernel_and_leaves_unsupported_null(spark):
    cells, rows = _random_cells(spark)
    asked = _cells(spark, [("m00", "e00", None), ("m13", "e08", None), ("new", "e00", None), ("m00", "none", None)])
    held = {("m00", "e00"), ("m13", "e08")}
    jobs = cells.join(asked.select("model_id", "evaluation_id"), ["model_id", "evaluation_id"], "left_anti").unionByName(asked).withColumn("job_id", F.lit("j"))
    got = {(r.model_id, r.evaluation_id): r.predicted for r in fits.fit_als(jobs, 1).collect()}
    kept = [x for x in rows if x[:2] not in held]
    ms, es = sorted({x[0] for x in kept}), sorted({x[1] for x in kept})
    want = als.complete([ms.index(x[0]) for x in kept], [es.index(x[1]) for x in kept], [x[2] for x in kept], len(ms), len(es), 1)
    assert abs(got["m00", "e00"] - want[0, 0]) < 1e-9 and got["new", "e00"] is None and got["m00", "none"] is None


def test_hidden_values_do_not_leak(spark):
    cells, rows = _random_cells(spark)
    a = E.bench_knn(cells.where("evaluation_id <> 'e00' or model_id <> 'm01'"), _cells(spark, [("m01", "e00", None)]).select("model_id", "evaluation_id")).first().predicted
    changed = cells.withColumn("score", F.when((F.col("model_id") == "m01") & (F.col("evaluation_id") == "e00"), 1.0).otherwise(F.col("score")))
    b = E.bench_knn(changed.where("evaluation_id <> 'e00' or model_id <> 'm01'"), _cells(spark, [("m01", "e00", None)]).select("model_id", "evaluation_id")).first().predicted
    assert a == b


@pytest.mark.parametrize("rank", [0, 1, 2])
def test_relational_completion_equals_the_kernel(spark, rank):
    """The same starts, so the same numbers after any number of rounds."""
    rng = np.random.default_rng(rank)
    rows = [(f"m{i:02d}", f"e{j:02d}", float(np.clip(60 + 20 * rng.normal(), 1, 99))) for i in range(14) for j in range(9) if rng.random() < 0.7]
    cells = spark.createDataFrame(rows, "model_id string, evaluation_id string, score double")
    models, evaluations = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    r, c = np.array([models.index(x[0]) for x in rows]), np.array([evaluations.index(x[1]) for x in rows])
    x = als.logit_percent(np.array([x[2] for x in rows]))
    mean, spread = als.column_moments(c, x, len(evaluations), 1e-12)
    want = als.bias_als(r, c, (x - mean[c]) / spread[c], len(models), len(evaluations), rank, rounds=3)
    z = spark.createDataFrame([(a[0], a[1], float(v)) for a, v in zip(rows, (x - mean[c]) / spread[c])], "model_id string, evaluation_id string, z double")
    left, right, means = relational_als.relational_bias_als(z, rank, rounds=3)
    grid = cells.select("model_id").distinct().crossJoin(cells.select("evaluation_id").distinct())
    got = {(y.model_id, y.evaluation_id): y.z for y in relational_als.predict(grid, left, right, means, rank).collect()}
    assert len(got) == len(models) * len(evaluations)
    assert max(abs(got[m, e] - want[i, j]) for i, m in enumerate(models) for j, e in enumerate(evaluations)) < 1e-9


def test_completion_is_routed_by_size_with_equal_results(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"m{i}", f"e{j}", float(np.clip(60 + 15 * rng.normal(), 1, 99))) for i in range(8) for j in range(6) if (i + j) % 4]
    cells = spark.createDataFrame(rows, "model_id string, evaluation_id string, score double")
    monkeypatch.setattr(als, "ROUNDS", 4)
    monkeypatch.setattr(relational_als.complete, "__defaults__", (1, als.RIDGE, 4))
    monkeypatch.setattr(als.bias_als, "__defaults__", (als.RIDGE, 4, *als.bias_als.__defaults__[2:]))
    small = {(x.model_id, x.evaluation_id): x for x in fits.complete_grid(cells, 1, 0, relational=True).collect()}
    task = als.complete(np.array([int(x[0][1:]) for x in rows]), np.array([int(x[1][1:]) for x in rows]), np.array([x[2] for x in rows]), 8, 6, 1)
    assert len(small) == 48 and sum(x.observed for x in small.values()) == len(rows)
    assert max(abs(x.score - task[int(m[1:]), int(e[1:])]) for (m, e), x in small.items()) < 1e-9
    assert fits.fits_kernel(cells)
    monkeypatch.setattr(fits, "KERNEL_CELLS", 10)
    assert not fits.fits_kernel(cells)



def test_unranking_is_lexicographic():
    from itertools import combinations

    assert [search.unrank(i, 6, 3) for i in range(20)] == [list(c) for c in combinations(range(6), 3)]


def test_greedy_probes(spark):
    cells, _ = _random_cells(spark, 20, 6, share=1.0)
    got = search.greedy_probes(cells, 2).collect()
    assert [r.step for r in got] == [1, 2] and got[0].evaluation_id != got[1].evaluation_id
    best = search.single_probe_errors(cells).orderBy(F.round("mae", 9), "evaluation_id").first()
    assert got[0].evaluation_id == best.evaluation_id


def test_refit_search_hides_the_target(spark):
    cells, rows = _random_cells(spark, 8, 5, share=0.8)
    names = sorted({x[1] for x in rows})
    got = {r.set_id: r for r in search.refit_sets(cells, spark.createDataFrame([(e, [e]) for e in names], "set_id string, members array<string>")).collect()}
    models = sorted({x[0] for x in rows})
    for probe in names:
        errors = []
        for target in models:
            seen = [x for x in rows if x[0] != target or x[1] == probe]
            es = sorted({x[1] for x in seen})
            table = als.complete([models.index(x[0]) for x in seen], [es.index(x[1]) for x in seen], [x[2] for x in seen], len(models), len(es), 1, allow_empty_rows=True)
            errors += [0.0 if x[1] == probe else abs(table[models.index(target), es.index(x[1])] - x[2]) for x in rows if x[0] == target and (x[1] == probe or x[1] in es)]
        assert abs(got[probe].parity_medae - np.median(errors)) < 1e-9
    first = search.refit_greedy(cells, 1).first()
    assert first.evaluation_id == min(names, key=lambda e: (round(got[e].parity_medae, 9), e))
    costs = spark.createDataFrame([(names[0], 5.0), (names[1], 9.0), (names[2], None)], "evaluation_id string, cost double")
    assert [r.evaluation_id for r in search.refit_greedy(cells, 3, costs=costs, budget=6.0).collect()] == [names[0]]


def test_exhaustive_search_scores_every_pair(spark):
    from itertools import combinations

    cells, rows = _random_cells(spark, 20, 14, share=0.9)
    names = sorted({x[1] for x in rows})
    got = search.exhaustive_probes(cells, None, 2, top=1000, batch=40).collect()
    assert sorted(r.set_id for r in got) == sorted("+".join(c) for c in combinations(names, 2))
    assert [r.mae for r in got] == sorted(r.mae for r in got)
    assert search.exhaustive_probes(cells.where("false"), None, 2).count() == 0


def test_new_entity_errors_come_from_refits_with_revealed_cells(spark):
    from lacuna.operators.confidence import new_entity_errors as _new_entity_errors

    cells, rows = _random_cells(spark, 8, 6, share=1.0)
    c = cells.withColumn("suite_id", F.when(F.col("evaluation_id") < "e03", "a").otherwise("b"))
    got = _new_entity_errors(c, (1, 3), (42,)).collect()
    assert {r.k for r in got} == {1, 3} and len(got) == 8 * (5 + 3)
    ms, es = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    for target, k in (("m01", 1), ("m02", 3)):
        mine = [r for r in got if (r.model_id, r.k) == (target, k)]
        probes = set(es) - {r.evaluation_id for r in mine}
        seen = [x for x in rows if x[0] != target or x[1] in probes]
        table = als.complete([ms.index(x[0]) for x in seen], [es.index(x[1]) for x in seen], [x[2] for x in seen], len(ms), len(es), 1)
        suites = {"a" if e < "e03" else "b" for e in probes}
        for r in mine:
            assert abs(r.predicted - table[ms.index(target), es.index(r.evaluation_id)]) < 1e-9 and r.same_suite == (r.suite_id in suites)


def test_exact_search_beats_greedy_and_keeps_the_rules(spark):
    cells, _ = _random_cells(spark, 12, 5, share=0.9)
    names = sorted(r.evaluation_id for r in cells.select("evaluation_id").distinct().collect())
    exact = search.refit_exact(cells, 2, objective="hidden_medae").first()
    greedy = search.refit_greedy(cells, 2, objective="hidden_medae").collect()
    assert exact.evaluated == 15 and exact.loss <= min(r.loss for r in greedy) + 1e-9
    one = spark.createDataFrame([(n, "same" if i < 4 else "other") for i, n in enumerate(names)], "evaluation_id string, identity string")
    costs = spark.createDataFrame([(n, float(i + 1)) for i, n in enumerate(names)], "evaluation_id string, cost double")
    kept = search.refit_exact(cells, 2, costs=costs, budget=6.0, identities=one).first()
    assert kept.cost <= 6.0 and kept.evaluated == 5 + 1  # the singles, and the one pair of unlike identity within the budget
    assert len({r.evaluation_id for r in search.refit_greedy(cells, 3, identities=one).collect()}) == 2
    with pytest.raises(search.SearchSpaceTooLarge):
        search.refit_exact(cells, 3, limit=10)


def test_ranking_objectives_against_brute_force(spark):
    cells, rows = _random_cells(spark, 10, 4, share=1.0)
    sets = spark.createDataFrame([("s", ["e00"])], "set_id string, members array<string>")
    got = search.refit_sets(cells, sets, ranked=True).first()
    jobs = cells.select("model_id").distinct().select(F.col("model_id").alias("job_id"), F.col("model_id").alias("target"), F.array(F.lit("e00")).alias("probes"), F.lit(None).cast("array<string>").alias("context"))
    fit = {(r.model_id, r.evaluation_id): r.predicted for r in fits.fit_targets(cells, jobs).collect()}
    actual = {x[:2]: x[2] for x in rows}
    accuracy, found = [], []
    for e in ("e00", "e01", "e02", "e03"):
        column = {m: (a, a if e == "e00" else fit[m, e]) for (m, k), a in actual.items() if k == e}
        pairs = [(x, y) for x in column.values() for y in column.values() if x[0] >= y[0] + search.PAIR_MARGIN and e != "e00"]
        if pairs:
            accuracy.append(sum(x[1] > y[1] for x, y in pairs) / len(pairs))
        top = lambda i: set(sorted(column, key=lambda m: (-round(column[m][i], 9), m))[:2])  # noqa: B023, E731
        found.append(len(top(0) & top(1)) / 2)
    assert abs(got.pairwise_margin_error - (1 - np.median(accuracy))) < 1e-9 and abs(got.top_fraction_error - (1 - np.median(found))) < 1e-9


def test_shards_cover_every_place_once(spark):
    names = list("abcdef")
    parts = [search.combinations(spark, names, 3, 4, k) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).withColumn("loss", F.when(F.col("place") != 3, -F.col("place")))
    assert [r.place for r in search.merged_top(whole, "loss", 3, 20).collect()] == [19, 18, 17]
    assert search.combinations(spark, names, 3, 4, 1, done=parts[1].limit(2)).count() == 3  # what is left of a shard
    with pytest.raises(ValueError):
        search.merged_top(whole.where("place <> 5"), "loss", 3, 20)


@pytest.mark.parametrize("block", [512, 3])
def test_overlap_pairs_in_blocks_against_numpy(spark, block):
    cells, rows = _random_cells(spark, 11, 7, share=0.7)
    score = {x[:2]: x[2] for x in rows}
    got = {(p.a, p.b): p for p in S.overlap_pairs(cells, "model_id", "evaluation_id", 3, block).collect()}
    models = sorted({m for m, _ in score})
    want = 0
    for i, a in enumerate(models):
        for b in models[i + 1 :]:
            shared = sorted(e for m, e in score if m == a and (b, e) in score)
            if len(shared) < 3:
                assert (a, b) not in got
                continue
            want += 1
            x, y, p = np.array([score[a, e] for e in shared]), np.array([score[b, e] for e in shared]), got[a, b]
            assert p.n == len(shared) and abs(p.rmse - np.sqrt(np.mean((x - y) ** 2))) < 1e-9 and abs(p.mx - x.mean()) < 1e-9 and abs(p.vy - y.var()) < 1e-8 and abs(p.cxy - np.cov(x, y, bias=True)[0, 1]) < 1e-8
            assert abs(p.r - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert len(got) == want


def test_quantiles_and_deviations_of_others_against_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{i % 4}", i, float(rng.integers(0, 9))) for i in range(60)] + [("one", 100, 5.0), ("two", 101, 1.0), ("two", 102, 4.0)]
    frame = spark.createDataFrame(rows, "g string, i int, v double")
    by = {}
    for g, i, v in rows:
        by.setdefault(g, []).append((i, v))
    for r in S.linear_quantiles(frame, "g", "v", [0.1, 0.5, 0.9]).collect():
        assert np.allclose(r.qs, np.quantile([v for _, v in by[r.g]], [0.1, 0.5, 0.9]))
    assert np.allclose(S.linear_quantiles(frame, None, "v", [0.25]).first().qs, np.quantile([x[2] for x in rows], [0.25]))
    got = {r.i: r.loo_mad for r in S.leave_one_out_mad(frame, "g", "v").collect()}
    for g, own in by.items():
        for i, _ in own:
            rest = np.array([v for j, v in own if j != i])
            if len(rest) >= 2:
                assert abs(got[i] - S.MAD_SCALE * np.median(np.abs(rest - np.median(rest)))) < 1e-9
            else:
                assert got.get(i) is None
    mads = {r.g: r.dispersion for r in S.mad(frame, "g", "v").collect()}
    assert mads["one"] is None and abs(mads["two"] - S.MAD_SCALE * 1.5) < 1e-9


def test_shared_table_scores_sets_as_joins_do(spark):
    cells, rows = _random_cells(spark, 25, 8, share=0.6)
    z = search._z(cells)
    sets = spark.createDataFrame([(f"{a}+{b}", e) for a in range(8) for b in range(a + 1, 8) for e in (f"e{a:02d}", f"e{b:02d}")], "set_id string, evaluation_id string")
    slow = {r.set_id: (r.cells, r.mae) for r in search.score_sets(z, sets).collect()}
    quick = {r.set_id: (r.cells, r.mae) for r in search.score_sets(z, sets, shared=search.shared_scorer(z)).collect()}
    assert quick.keys() == slow.keys() and all(quick[k][0] == slow[k][0] and abs(quick[k][1] - slow[k][1]) < 1e-9 for k in slow)
    few = spark.createDataFrame([("x", "e00")], "set_id string, evaluation_id string")
    assert search.score_sets(z, few, minimum=1000, shared=search.shared_scorer(z)).count() == 0


def test_blocks_of_rows_give_the_normal_equations(monkeypatch):
    """Also of tables beyond ``DENSE_PLACES``, for empty rows and columns, and of one row alone."""
    rng = np.random.default_rng(3)
    r, c = np.nonzero(rng.random((300, 20)) < 0.4)
    kept = (r != 7) & (c != 4)
    r, c = r[kept], c[kept]
    x = rng.normal(size=len(r)) + 0.01 * r
    for rank in (0, 1, 2, 4):
        slow = als.bias_als(r, c, x, 300, 20, rank, rounds=6, dense_places=0)
        monkeypatch.setattr(als, "BLOCK_SUMS", 1)  # blocks of 64 rows
        monkeypatch.setattr(als, "_solve_side", None)  # the way by lists of cells is not taken
        quick = als.bias_als(r, c, x, 300, 20, rank, rounds=6, dense_places=1)
        assert np.abs(quick - slow).max() < 1e-9
        assert np.abs(als.bias_als(r, c, x, 300, 20, rank, rounds=6, row=11) - quick[11:12]).max() < 1e-12
        monkeypatch.undo()


def test_low_rank_steps_equal_the_singular_value_decomposition():
    rng = np.random.default_rng(5)
    for shape in ((40, 9), (9, 40)):
        table = rng.normal(size=shape)
        u, s, vt = np.linalg.svd(table, full_matrices=False)
        assert np.abs(factor._reweighted(table, lambda s: (np.arange(len(s)) < 3) * 1.0) - (u[:, :3] * s[:3]) @ vt[:3]).max() < 1e-10


def test_grid_fits_do_not_copy_the_table(spark):
    """The rank sweep's settings beside the kernels on hand-cut folds, without a shuffle of cells."""
    cells, rows = _random_cells(spark, 12, 7, share=0.8)
    folded = cells.withColumn("fold", F.pmod(F.xxhash64("model_id", "evaluation_id"), F.lit(2)))
    settings = spark.createDataFrame([("a", "logit", "als", '{"rank":2}'), ("s", "identity", "svd", '{"rank":1}')], "job_id string, transform string, method string, arguments string")
    out = fits.fit_grid(folded, settings, 2, named=False)
    assert "model_id" not in out.columns
    got = sorted((r.job_id, r.fold, r.actual, r.predicted) for r in out.collect())
    long = fits.fit_grid(folded, settings, 2, limit=1, named=False)
    want = sorted((r.job_id, r.fold, r.actual, r.predicted) for r in long.collect())
    assert len(got) == 2 * len(rows) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_targets_see_models_of_earlier_dates(spark):
    cells, rows = _random_cells(spark, 8, 5, share=0.9)
    models = sorted({x[0] for x in rows})
    dates = spark.createDataFrame([(m, float(i // 2)) for i, m in enumerate(models[:-1])], "model_id string, date double")  # the last has none
    probes = [x[1] for x in rows if x[0] == models[5]][:2]
    job = [("j", models[5], probes)]
    want = fits.fit_targets(cells, spark.createDataFrame([(*job[0], models[:4])], "job_id string, target string, probes array<string>, context array<string>"))
    want = {r.evaluation_id: r.predicted for r in want.collect()}
    own = {x[1] for x in rows if x[0] == models[5]} - set(probes)
    for limit in (fits.KERNEL_CELLS, 1):
        got = fits.fit_targets(cells, spark.createDataFrame([(*job[0], 2.0)], "job_id string, target string, probes array<string>, before double"), limit=limit, dates=dates, own_cells=True)
        got = {r.evaluation_id: r.predicted for r in got.collect()}
        assert set(got) == own and all(abs(got[e] - want[e]) < 1e-9 for e in own)


def test_a_refit_is_made_once_for_all_rounds_and_searches(spark, monkeypatch):
    cells, rows = _random_cells(spark, 8, 5, share=0.7)
    asked, fit = [], fits.fit_targets
    monkeypatch.setattr(fits, "fit_targets", lambda c, jobs, *a, **k: (asked.extend(r.job_id for r in jobs.collect()), fit(c, jobs, *a, **k))[1])
    made = search.Refits()
    first = search.refit_greedy(cells, 2, made=made).collect()
    n = len(asked)
    assert search.refit_greedy(cells, 2, made=made).collect() == first
    assert len(asked) == len(set(asked)) == n
    asked.clear()
    exact = search.refit_exact(cells, 2, batch=4)
    assert len(asked) == len(set(asked)) and exact.first() == search.refit_exact(cells, 2, batch=100).first()


def test_refits_beside_the_whole_table_are_those_made_alone(monkeypatch):
    from lacuna.kernels import refits

    rng = np.random.default_rng(5)
    n, m = 1_200, 9
    table = 50 + 12 * rng.normal(size=(n, 1)) + 6 * rng.normal(size=(n, 1)) * rng.normal(size=m) + 4 * rng.normal(size=(n, m))
    seen = rng.random((n, m)) < 0.7
    seen[:, 0] = True
    seen[:, 8] = False
    seen[3, 8] = True  # a column of one model
    rows = [(f"m{i:04d}", f"e{j}", float(np.clip(table[i, j], 1, 99))) for i, j in zip(*np.nonzero(seen))]
    cells = pd.DataFrame([*rows, ("m0004", "e0", 33.0)], columns=["model_id", "evaluation_id", "score"])  # and a cell written twice
    own = cells.groupby("model_id")["evaluation_id"].agg(lambda x: sorted(set(x)))
    jobs = [(t, own[t][:k], None, None) for t in own.index[:12] for k in (0, 1, 2)]
    jobs += [("m0007", list(own["m0007"]), None, None), ("m0007", ["e8", "none"], None, None), ("new", ["e1"], None, None), ("m0009", ["e0"], list(own.index[:200]), None)]
    want = [fits._Targets(cells, None).fit(*j, 1, True) for j in jobs]
    alone, complete = [], als.complete
    monkeypatch.setattr(als, "complete", lambda *a, **k: (alone.append(1), complete(*a, **k))[1])
    got = list(fits._Targets(cells, None).fit_all(jobs, 1, True))
    assert len(alone) <= len(jobs) // 3
    for a, b in zip(got, want, strict=True):
        assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1], rtol=0, atol=1e-6, equal_nan=True)
    alone.clear()
    monkeypatch.setattr(refits, "MOST", 0.0)  # what differs too much is fitted alone
    again = list(fits._Targets(cells, None).fit_all(jobs, 1, True))
    assert len(alone) >= len(jobs) - 1 and all(np.array_equal(a[1], b[1], equal_nan=True) for a, b in zip(again[:-4], want[:-4]))


def test_greedy_search_settles_by_full_refits_what_first_order_leaves_open(spark, monkeypatch):
    from lacuna.operators import contenders

    rng = np.random.default_rng(7)
    n, m = 1_000, 6
    table = 50 + 12 * rng.normal(size=(n, 1)) + 6 * rng.normal(size=(n, 1)) * rng.normal(size=m) + 4 * rng.normal(size=(n, m))
    seen = rng.random((n, m)) < 0.6
    seen[:, 0] = True
    seen[:, 5] = False
    seen[3, 5] = True  # a column of one model
    cells = spark.createDataFrame([(f"m{i:04d}", f"e{j}", float(np.clip(table[i, j], 1, 99))) for i, j in zip(*np.nonzero(seen))], "model_id string, evaluation_id string, score double")
    costs = spark.createDataFrame([("e0", 9.0), ("e1", 3.0), ("e2", 3.0), ("e3", 2.0), ("e5", 1.0)], "evaluation_id string, cost double")
    kinds = spark.createDataFrame([("e1", "x"), ("e2", "x")], "evaluation_id string, identity string")
    asked, made, init = [], [], contenders.Contenders.__init__
    monkeypatch.setattr(contenders.Contenders, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    full = search.refit_sets
    monkeypatch.setattr(search, "refit_sets", lambda *a, **k: (asked.append(1), full(*a, **k))[1])
    got = search.refit_greedy(cells, 2, "parity_medae", costs, 8.0, identities=kinds).collect()
    assert not asked and made[-1].near and 0 < len(made[-1].full) < n  # of about 3,600
    monkeypatch.setattr(contenders, "table_of", lambda c: None)
    want = search.refit_greedy(cells, 2, "parity_medae", costs, 8.0, identities=kinds).collect()
    assert len(got) == 2 and [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and asked
    assert [r["loss"] for r in got] == pytest.approx([r["loss"] for r in want], abs=2e-6)


def test_medians_are_between_their_bounds():
    from lacuna.operators import contenders

    rng, table = np.random.default_rng(3), type("T", (), {"c": np.arange(40) % 5})()
    for parity in (True, False):
        for lost in (0, 3, 40):
            error, bound = rng.random(40), rng.random(40) * 0.1
            error[:lost] = np.nan
            true = np.where(table.c == 2, 0.0, error + bound * rng.uniform(-1, 1, 40))
            low, high, n, below, hidden, missing, at, _, _ = contenders._bounded(table, error, bound, [2], parity)
            kept, at = true[~np.isnan(true) & (parity | (table.c != 2))], np.frombuffer(at, dtype=int)
            assert (n, hidden, missing) == (len(kept), 32, np.isnan(true).sum())
            if not n:
                assert low is None and not len(at)
                continue
            some = np.sort(true[at])
            assert low <= np.median(kept) <= high and np.median(kept) == (some[(n - 1) // 2 - below] + some[n // 2 - below]) / 2


def test_new_model_fits_only_the_number_it_uses(spark, monkeypatch):
    from lacuna.operators import confidence

    cells, _ = _random_cells(spark, 8, 6, share=1.0)
    cells, asked, all_errors = cells.withColumn("suite_id", F.lit("s")), [], confidence.new_entity_errors
    monkeypatch.setattr(confidence, "new_entity_errors", lambda c, counts=confidence.COUNTS, *a: (asked.append(counts), all_errors(c, counts, *a))[1])
    assert {r.k for r in confidence.errors_for(cells, 4).select("k").distinct().collect()} == {3} and asked == [(3,)]
    asked.clear()
    assert {r.k for r in confidence.errors_for(cells, 20).select("k").distinct().collect()} == {5} and asked == [(10,), (5,)]
