"""Files, streams, product commands, resampling, burdens and confidence."""

import gzip
import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import cli, product
from lacuna.operators import burden, confidence, fits, holdouts, resample
from lacuna.operators.cells import DuplicateCellError
from lacuna.sources import files
from lacuna.streaming import scores as streaming

HEADER = "model_id,evaluation_id,value,normalized_score,suite_id,metric,reference_url,audit_status\n"


def _grid(n=8, m=6, hole=True):
    return [(f"m{i}", f"e{j}", 20.0 + 8 * i + 3 * j) for i in range(n) for j in range(m) if not hole or (i + j) % 7]


@pytest.fixture(scope="module")
def score_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("scores") / "scores.csv"
    lines = [f"{m},{e},{s / 100},{s},suite{int(e[1]) % 2},dice,u,{'verified' if e != 'e5' else 'pending'}\n" for m, e, s in _grid()]
    path.write_text(HEADER + "".join(lines))
    return str(path)


def test_csv_sources(spark, score_csv, tmp_path):
    assert files.read_scores(spark, score_csv).where("audit_status <> 'verified'").count() == 0
    assert files.read_scores(spark, score_csv, None).count() == len(_grid())
    packed = tmp_path / "s.csv.gz"
    packed.write_bytes(gzip.compress(open(score_csv, "rb").read()))
    assert files.read_scores(spark, str(packed), None).count() == len(_grid())
    bad = tmp_path / "bad.csv"
    bad.write_text(HEADER + "a,b,x,1,s,m,u,verified\n")
    with pytest.raises(Exception):
        files.read_scores(spark, str(bad)).collect()
    files.write_csv(files.read_scores(spark, score_csv), str(tmp_path / "out"), ["model_id", "value"], gzip=True)
    assert list((tmp_path / "out").glob("*.csv.gz"))


def test_release_dates(spark, tmp_path):
    head = "model_id,release_date,verification_status,date_basis,is_proxy,primary_source_url,source_title,audit_notes\n"
    (tmp_path / "r.csv").write_text(head + " a ,2024-01-02,verified,x,TRUE,u,t,n\nb, ,pending,x,no,u,t,n\n")
    rows = {r.model_id: (str(r.release_date), r.is_proxy) for r in files.read_release_dates(spark, str(tmp_path / "r.csv")).collect()}
    assert rows == {"a": ("2024-01-02", True), "b": ("None", False)}
    (tmp_path / "d.csv").write_text(head + "a,,v,x,no,u,t,n\na,,v,x,no,u,t,n\n")
    with pytest.raises(DuplicateCellError):
        files.read_release_dates(spark, str(tmp_path / "d.csv"))


def test_parquet_json_and_manifests(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    out = str(tmp_path / "p")
    files.write_parquet(frame, out, ["s", "n"])
    assert files.verify_rows(spark, {out: 2}) == {out: 2} and spark.read.parquet(out).columns == ["s", "n"]
    with pytest.raises(ValueError):
        files.verify_rows(spark, {out: 3})
    files.write_json({"b": 1, "a": [1.5]}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text().startswith('{\n  "a"')
    with pytest.raises(ValueError):
        files.write_json({"a": math.nan}, str(tmp_path / "y.json"))
    assert files.without_local_paths({"local_path": 1, "a": [{"in_paths": 2, "k": 3}]}) == {"a": [{"k": 3}]}
    folder = tmp_path / "m"
    folder.mkdir()
    for n in ("same", "changed", "extra"):
        (folder / n).write_text(n)
    declared = [("same", files.digest(str(folder / "same"))), ("changed", "0"), ("gone", "0")]
    got = {r.name: r.outcome for r in files.check_manifest(spark, str(folder), spark.createDataFrame(declared, "name string, sha256 string")).collect()}
    assert got == {"same": "ok", "changed": "stale", "extra": "undeclared", "gone": "missing"}


def test_folds_are_checked(spark, tmp_path):
    cells = spark.createDataFrame(_grid(), "model_id string, evaluation_id string, score double")
    folds = holdouts.within_model_folds(cells, [1, 2])
    assert folds.groupBy("seed").count().where(f"count <> {len(_grid())}").count() == 0
    files.save_folds(folds, str(tmp_path / "f"))
    assert files.load_folds(spark, str(tmp_path / "f"), cells).count() == 2 * len(_grid())
    with pytest.raises(ValueError):
        files.load_folds(spark, str(tmp_path / "f"), cells.where("model_id <> 'm1'"))
    values = spark.createDataFrame([(0, 1.0)], "fold int, v double")
    assert files.repeat_invariants(values, spark.createDataFrame([(5.0,)], "v double"), spark.createDataFrame([(0,), (1,)], "fold int")).count() == 3


def test_text_tables(spark):
    rows = [(1, "x\n| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 |  |\nend"), (2, None), (3, "")]
    got = [(r.id, r.cells) for r in files.markdown_tables(spark.createDataFrame(rows, "id int, t string"), "id", "t").orderBy("line").collect()]
    assert got == [(1, ["1", "2"]), (1, ["3", ""])]
    page = "<table><tr><th>n</th><td>0.5 &plusmn; <b>1</b></td></tr><TR><td>a&amp;b</td></TR></table>"
    got = [r.cells for r in files.html_tables(spark.createDataFrame([(1, page)], "id int, t string"), "id", "t").orderBy("row").collect()]
    assert got == [["n", "0.5 ± 1"], ["a&b"]]
    text = "train:\n  - a\n  - b\ntest:\n- c\n"
    got = {(r.key, r.item) for r in files.simple_yaml(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()}
    assert got == {("train", "a"), ("train", "b"), ("test", "c")}


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>sc</t></r><r><t>ore</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="AA2"><v>1.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(buffer.getvalue())
    rows = files.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()
    assert rows[0].cells == ["name", None, "score"] and len(rows[1].cells) == 27 and rows[1].cells[26] == "1.5"


def test_receipts(spark, tmp_path):
    for i, n in enumerate(("a", "b")):
        (tmp_path / f"{i}.json").write_text(json.dumps({"measurement_id": n, "v": 1}))
    assert files.read_receipts(spark, str(tmp_path), "measurement_id string, v int").count() == 2
    (tmp_path / "2.json").write_text(json.dumps({"measurement_id": "a", "v": 1}))
    with pytest.raises(DuplicateCellError):
        files.read_receipts(spark, str(tmp_path), "measurement_id string, v int")


def test_known_scores():
    assert files.parse_known_scores("a=1, b=99.5") == {"a": 1.0, "b": 99.5}
    for bad in ("a", "a=1,a=2", "a=x", "a=101", "=3"):
        with pytest.raises(ValueError):
            files.parse_known_scores(bad)


def test_stream_drops_repeats(spark, tmp_path):
    import datetime as dt

    schema = "model_id string, evaluation_id string, metric string, reported_at timestamp"
    day = lambda d: dt.datetime(2024, 1, d)
    for k, rows in enumerate(([("a", "x", "m", day(1)), ("a", "x", "m", day(2))], [("a", "x", "m", day(3)), ("b", "x", "m", day(3))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = streaming.read_score_stream(spark, str(tmp_path / "in" / "*"), schema, 1)
    streaming.run_to_table(streaming.deduplicated(stream), "firsts", str(tmp_path / "c1"))
    assert {r.model_id for r in spark.table("firsts").collect()} == {"a", "b"} and spark.table("firsts").count() == 2
    streaming.run_to_table(streaming.windowed_support(streaming.read_score_stream(spark, str(tmp_path / "in" / "*"), schema)), "support", str(tmp_path / "c2"), "complete")
    assert sum(r.n for r in spark.table("support").collect()) == 4


def test_product_commands(spark, score_csv, capsys, tmp_path):
    table = product.open_path(spark, score_csv)
    assert table.audit().first().evaluations == 5
    whole = table.predict("m3").collect()
    assert len(whole) == 5 and {r.status for r in whole} == {"observed", "predicted"} and all(0 <= r.score <= 100 for r in whole)
    seen = [r.evaluation_id for r in whole if r.status == "observed"]
    assert [r.status for r in table.predict("m3", seen[:1]).collect()] == ["observed"]
    with pytest.raises(product.UnknownName):
        table.predict("nobody")
    assert table.add_model("e0=50, e1=55").count() == 3
    assert table.impute().count() == 8 * 5
    assert table.validate(2).first().n > 0
    assert cli.run(["list-models", "--scores", score_csv], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 8
    assert cli.run(["predict", "--scores", score_csv], spark) == 2
    assert cli.run(["audit", "--scores", score_csv, "--output", str(tmp_path / "a")], spark) == 0


def test_holdout_counts(spark):
    cells = spark.createDataFrame(_grid(6, 5, hole=False), "model_id string, evaluation_id string, score double")
    held = holdouts.random_cells(cells, repeats=3)
    assert held.count() == 18
    assert holdouts.text_seed(42, "uni", 0) == int(__import__("hashlib").sha256(b"42:model_uni:0").hexdigest()[:8], 16)
    sets = holdouts.nested_prefixes(["a", "b", "c", "d"], [1, 3], repeats=2)
    assert sets[1][2][:1] == sets[0][2] and len(sets) == 4
    import random

    assert holdouts.feasible_prefix({"a": 1.0, "b": 5.0, "c": 1.0}, {"a": "i", "c": "i"}, 2.0, 3, random.Random(0)) in (["a"], ["c"])


def test_resampling():
    r = resample.signed_rank([1.0, 2.0, 3.0, 4.0, 5.0], [0.5, 1.0, 1.5, 2.0, 2.5])
    assert r["statistic"] == 0.0 and abs(r["p"] - 0.0625) < 1e-12
    assert resample.signed_rank([1.0, 2.0], [1.0, 2.0])["p"] is None
    tied = resample.signed_rank([1.0, 1.0, 0.0, 3.0], [0.0, 0.0, 1.0, 0.0])
    assert 0 < tied["p"] <= 1
    f = resample.fraction_interval([True, False, True, True])
    assert f["fraction"] == 0.75 and f["low"] <= 0.75 <= f["high"] and resample.fraction_interval([])["fraction"] is None
    assert abs(resample.reduction_interval([2.0, 2.0], [1.0, 1.0])["reduction"] - 0.5) < 1e-12


def test_burdens(spark):
    facts = [("a", "setup", "gpu", "additive", "known", 2.0, "h", "g", True), ("b", "setup", "gpu", "additive", "known", 2.0, "h", "g", True), ("a", "run", "gpu", "additive", "known", 1.0, "h", None, True), ("b", "run", "gpu", "additive", "not_applicable", None, "h", None, True), ("a", "run", "ram", "capacity", "known", 8.0, "gb", None, True), ("b", "run", "ram", "capacity", "known", 16.0, "gb", None, True), ("c", "run", "gpu", "additive", "unknown", None, "h", None, True)]
    f = spark.createDataFrame(facts, "evaluation_id string, phase string, resource string, kind string, status string, value double, unit string, group string, completed boolean")
    sets = spark.createDataFrame([("ab", "a"), ("ab", "b"), ("c", "c")], "set_id string, evaluation_id string")
    costs = burden.set_costs(sets, f)
    got = {(r.set_id, r.resource): (r.cost, r.unknown) for r in costs.collect()}
    assert got == {("ab", "gpu"): (3.0, False), ("ab", "ram"): (16.0, False), ("c", "gpu"): (None, True)}
    why = {r.set_id: r.reason for r in burden.feasible_sets(costs, {"gpu": 3.0, "ram": 10.0}).collect()}
    assert why["ab"] == "over:ram" and why["c"] == "missing"
    assert {r.evaluation_id: r.outcome for r in burden.select_receipts(f, ["run", "setup"]).collect()} == {"a": "ambiguous", "b": "ambiguous", "c": "missing"}
    assert {r.outcome for r in burden.select_receipts(f, ["setup"]).where("evaluation_id <> 'c'").collect()} == {"ok"}


def test_new_entity_risk_leaves_the_target_out(spark):
    rng = np.random.default_rng(0)
    rows = [(f"m{i}", f"e{j}", "s", 3, True, float(rng.random() * 5)) for i in range(8) for j in range(4)]
    schema = "model_id string, evaluation_id string, suite_id string, k int, same_suite boolean, error double"
    a = {(r.model_id, r.evaluation_id): (r.risk, r.scope) for r in confidence.new_entity_risk(spark.createDataFrame(rows, schema)).collect()}
    changed = [(m, e, s, k, q, 100.0 if m == "m0" else x) for m, e, s, k, q, x in rows]
    b = {(r.model_id, r.evaluation_id): r.risk for r in confidence.new_entity_risk(spark.createDataFrame(changed, schema)).collect()}
    assert all(abs(a["m0", f"e{j}"][0] - b["m0", f"e{j}"]) < 1e-12 for j in range(4))
    others = [np.median([x for m, e, _, _, _, x in rows if m == f"m{i}"]) for i in range(1, 8)]
    own = np.median([x for m, e, _, _, _, x in rows if m != "m0" and e == "e0"])
    assert abs(a["m0", "e0"][0] - 0.5 * (own + np.median(others))) < 1e-12 and a["m0", "e0"][1] == "suite_same_probe"
    few = confidence.new_entity_risk(spark.createDataFrame(rows[:12], schema)).first()
    assert few.risk is None and few.scope == "unsupported_evaluation"


def test_ridge_risk_is_cross_fitted(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 3, float(x), float(np.expm1(0.5 * np.log1p(x) + 0.1))) for i, x in enumerate(rng.random(300) * 50)]
    out = confidence.ridge_error_risk(spark.createDataFrame(rows, "fold int, x double, error double"), ["x"], penalty=1e-6).collect()
    assert max(abs(r.risk - r.error) for r in out) < 1e-3


def test_the_penalty_is_chosen_inside_the_training_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 4, float(a), float(b), float(np.expm1(abs(0.4 * np.log1p(a) + rng.normal(0, 0.3))))) for i, (a, b) in enumerate(rng.random((200, 2)) * 20)]
    frame = spark.createDataFrame(rows, "fold int, a double, b double, error double")
    got = {(r.fold, r.a): r.risk for r in confidence.ridge_error_risk(frame, ["a", "b"]).collect()}
    x, y, fold = np.log1p(np.array([r[1:3] for r in rows])), np.log1p([r[3] for r in rows]), np.array([r[0] for r in rows])

    def fit(keep, penalty):
        mean, sd = x[keep].mean(axis=0), x[keep].std(axis=0)
        z = (x[keep] - mean) / sd
        beta = np.linalg.solve(z.T @ z + penalty * np.eye(2), z.T @ (y[keep] - y[keep].mean())) / sd
        return lambda at: y[keep].mean() + (x[at] - mean) @ beta

    for f in range(4):
        losses = [(sum(((fit((fold != f) & (fold != g), c)(fold == g) - y[fold == g]) ** 2).sum() for g in range(4) if g != f), c) for c in confidence.PENALTIES]
        want = np.maximum(0.0, np.expm1(fit(fold != f, min(losses)[1])(fold == f)))
        assert np.allclose([got[f, r[1]] for r in rows if r[0] == f], want)


def test_target_refits_hide_what_is_not_revealed(spark):
    cells = spark.createDataFrame(_grid(8, 6, hole=False), "model_id string, evaluation_id string, score double")
    jobs = spark.createDataFrame([("j", "m3", ["e0", "e2"], None), ("k", "m3", ["e0"], ["m1", "m2", "m4"])], "job_id string, target string, probes array<string>, context array<string>")
    a = {(r.job_id, r.evaluation_id): r.predicted for r in fits.fit_targets(cells, jobs).collect()}
    hidden = cells.withColumn("score", F.when((F.col("model_id") == "m3") & ~F.col("evaluation_id").isin("e0", "e2"), 1.0).otherwise(F.col("score")))
    b = {(r.job_id, r.evaluation_id): r.predicted for r in fits.fit_targets(hidden, jobs).collect()}
    assert set(a) == {("j", e) for e in ("e1", "e3", "e4", "e5")} | {("k", f"e{i}") for i in range(1, 6)}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    shuffled = {(r.job_id, r.evaluation_id): r.predicted for r in fits.fit_targets(cells, jobs, limit=10).collect()}
    assert set(shuffled) == set(a) and all(abs(shuffled[k] - a[k]) < 1e-9 for k in a)


def test_predictions_have_intervals_and_trust(spark):
    rng = np.random.default_rng(2)
    skill, hard = rng.normal(0, 8, 16), rng.normal(0, 6, 8)
    rows = [(f"m{i:02d}", f"e{j}", f"s{j % 2}", "auroc", "verified", float(np.clip(70 + skill[i] + hard[j] + rng.normal(0, 2), 1, 99))) for i in range(16) for j in range(8) if (3 * i + j) % 5]
    scores = spark.createDataFrame(rows, "model_id string, evaluation_id string, suite_id string, metric string, audit_status string, normalized_score double").withColumn("value", F.col("normalized_score"))
    table = product.ScoreTable.open(scores)
    out = table.predict("m03", confidence=True).collect()
    made = [r for r in out if r.status == "predicted"]
    assert len(out) == 8 and made and all(r.low <= r.score <= r.high and 0 <= r.trust <= 1 and r.source == "model+evaluation" for r in made)
    assert all(r.low is None and r.trust is None for r in out if r.status == "observed")
    added = table.add_model({"e0": 80.0, "e1": 75.0}, "new", confidence=True).collect()
    assert len(added) == 6 and all(r.low <= r.score <= r.high for r in added if r.scope != "unsupported_evaluation") and any(r.scope == "suite_same_probe" for r in added)
    few = product.ScoreTable(table.cells.where("model_id < 'm04'")).add_model({"e0": 80.0}, "new", confidence=True).collect()
    assert few and all(r.scope == "unsupported_evaluation" and r.low is None and r.score is not None for r in few)
    with pytest.raises(product.UnknownName):
        table.add_model({"e0": 80.0}, "m03")


def test_shards_appear_whole_and_are_checked(spark, tmp_path):
    frame = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "model_id string, score double")
    for name, rank in (("a", 1), ("b", 2)):
        files.write_shard(frame, str(tmp_path), name, {"rank": rank})
    files.write_shard(frame.limit(1), str(tmp_path), "b", {"rank": 2})  # a shard written again replaces the old one
    out = files.read_shards(spark, str(tmp_path), {"a": {"rank": 1}, "b": {"rank": 2}})
    assert sorted((r.shard, r.model_id) for r in out.collect()) == [("a", "m"), ("a", "n"), ("b", "m")]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    for wrong in ({"c": {}}, {"a": {"rank": 7}}):
        with pytest.raises(ValueError):
            files.read_shards(spark, str(tmp_path), wrong)


def test_export_and_metadata(spark, tmp_path):
    scores = spark.createDataFrame([("m", "e", "s", "auroc", 0.9, 90.0, "verified"), ("m", "f", "s", "auroc", 0.8, 80.0, "verified"), ("n", "e", "s", "auroc", 0.7, 70.0, "rejected")], "model_id string, evaluation_id string, suite_id string, metric string, value double, normalized_score double, audit_status string")
    meta = spark.createDataFrame([("m", "x"), ("n", "y")], "model_id string, family string")
    assert files.export_tables(scores, meta, str(tmp_path / "out")) == {"all": 3, "cells": 2, "wide": 1, "models": 2}
    assert spark.read.parquet(str(tmp_path / "out" / "wide")).first().asDict() == {"model_id": "m", "e": 90.0, "f": 80.0}
    assert json.loads(spark.read.text(str(tmp_path / "out" / "manifest")).first()[0])["rows"]["cells"] == 2
    (tmp_path / "meta.csv").write_text("model_id,family\n m ,x\nm,y\n")
    with pytest.raises(DuplicateCellError):
        files.read_metadata(spark, str(tmp_path / "meta.csv"), "model_id string, family string").count()


def test_latex_tables(spark):
    text = "\\begin{tabular}{l|c{2cm}r} % head\n\\toprule Model & \\textbf{AUROC} & n \\\\ \\midrule\nA\\_1 & $0.9$ & 5\\% \\\\[2pt]\n\\multicolumn{2}{c}{\\emph{B}} & 7 \\\\ \\hline\n\\end{tabular} text \\begin{tabular}{c}x\\end{tabular}"
    got = [(r.table, r.cells) for r in files.latex_tables(spark.createDataFrame([(1, text), (2, None), (3, "none")], "i int, t string"), "i", "t").orderBy("table", "row").collect()]
    assert got == [(0, ["Model", "AUROC", "n"]), (0, ["A_1", "0.9", "5%"]), (0, ["B", "7"]), (1, ["x"])]


def test_the_autoencoder_learns_and_keeps_observed_cells():
    from lacuna.kernels import network

    rng = np.random.default_rng(0)
    full = rng.normal(size=(30, 1)) @ rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(30, 8))
    r, c = np.nonzero(rng.random((30, 8)) < 0.8)
    out = network.mlp(r, c, full[r, c], 30, 8, rate=1e-2)
    hidden = np.ones((30, 8), dtype=bool)
    hidden[r, c] = False
    assert np.allclose(out[r, c], full[r, c]) and np.abs(out - full)[hidden].mean() < 0.8 * np.abs(full)[hidden].mean()
    assert np.array_equal(out, network.mlp(r, c, full[r, c], 30, 8, rate=1e-2))
