"""Orphans, drift, units and hot deck on small hand-made tables and against brute force."""

import datetime as dt
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lacuna.functions.text import is_missing, same_key
from lacuna.operators import drift, hotdeck, orphans, quantities

T = lambda day: dt.datetime(2024, 1, day)


def test_missing_words_and_keys(spark):
    rows = [("N/A",), (" ",), (None,), ("—",), ("Not reported",), ("x",), ("“A-b”",), ("模型",)]
    got = spark.createDataFrame(rows, "v string").select(is_missing("v").alias("m"), same_key("v").alias("k")).collect()
    assert [r.m for r in got] == [True, True, True, True, True, False, False, False]
    assert [r.k for r in got][-2:] == ["ab", ""]


def _orphans(spark, refs, targets):
    r = spark.createDataFrame(refs, "id long, k string, t timestamp")
    g = spark.createDataFrame(targets, "k string, a timestamp, z timestamp")
    out = orphans.find_orphans(r, ["k"], g, ["k"], ref_time="t", valid_from="a", valid_to="z", keep=["id"])
    return {(x.id, x.kind) for x in out.collect()}


def test_orphans_by_time(spark):
    targets = [("a", T(5), T(10)), ("a", T(12), None), ("b", T(3), T(4)), ("b", T(3), T(6)), ("a", T(5), T(10))]
    refs = [(1, "a", T(4)), (2, "a", T(5)), (3, "a", T(10)), (4, "a", T(20)), (5, "b", T(5)), (6, "b", T(6)), (7, "c", T(5)), (8, None, T(5)), (9, "a", None), (10, "c", None)]
    assert _orphans(spark, refs, targets) == {(1, "late"), (3, "deleted"), (6, "deleted"), (7, "missing"), (10, "missing")}


def test_orphans_empty_tables(spark):
    assert _orphans(spark, [], [("a", T(1), None)]) == set()
    assert _orphans(spark, [(1, "a", T(1))], []) == {(1, "missing")}


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_orphans_composite_masks_against_brute_force(spark, match):
    rng = random.Random(3)
    pick = lambda: rng.choice(["x", "y", "z", None])
    refs = [(i, pick(), pick(), pick()) for i in range(80)]
    targets = [(pick(), pick(), pick()) for _ in range(6)]
    out = orphans.find_orphans(
        spark.createDataFrame(refs, "id long, a string, b string, c string"), ["a", "b", "c"], spark.createDataFrame(targets, "a string, b string, c string"), ["a", "b", "c"], match=match, keep=["id"]
    )
    got = {r.id: r.kind for r in out.collect()}
    want = {}
    for i, *key in refs:
        nulls = sum(k is None for k in key)
        hit = any(all(k is None or k == t for k, t in zip(key, row)) for row in targets)
        if match == "simple" and nulls == 0 and not hit or match == "partial" and nulls < 3 and not hit or match == "full" and nulls == 0 and not hit:
            want[i] = "missing"
        if match == "full" and 0 < nulls < 3:
            want[i] = "partial"
    assert got == want


def test_component_orphans_by_mask_and_time_against_brute_force(spark):
    rng = random.Random(8)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 60))
    refs = [(i, rng.choice("aaabcd") if rng.random() > 0.2 else None, rng.choice("xxyz") if rng.random() > 0.2 else None, day() if rng.random() > 0.1 else None) for i in range(400)]

    def targets(names):
        rows = []
        for n in names:
            for _ in range(12):
                start = day()
                rows.append((n, start if rng.random() > 0.1 else None, None if rng.random() < 0.05 else start + dt.timedelta(hours=rng.randrange(-5, 90))))
        return rows

    left, right = targets("abc"), targets("xy")
    frame = lambda rows: spark.createDataFrame(rows, "k string, a timestamp, z timestamp")
    parts = [orphans.Component("L", "l", frame(left), "k", "a", "z"), orphans.Component("R", "r", frame(right), "k", "a", "z")]
    out = orphans.find_component_orphans(spark.createDataFrame(refs, "id long, l string, r string, t timestamp"), parts, "t", ["id"]).collect()
    want = set()
    for i, l, r, t in refs:
        for name, k, rows in (("L", l, left), ("R", r, right)):
            own = [x for x in rows if x[0] == k]
            if k is None or own and t is None:
                continue
            starts = [a for _, a, _ in own if a is not None]
            if not own:
                want.add((i, name, "missing"))
            elif not any(a is not None and a <= t and (z is None or z > t) for _, a, z in own):
                want.add((i, name, "late" if not starts or t < min(starts) else "deleted"))
    assert {(x.id, x.ref_field, x.kind) for x in out} == want and len(out) == len(want)
    assert {x.id: x.null_mask for x in out} == {i: (l is None) + 2 * (r is None) for i, l, r, _ in refs if i in {w[0] for w in want}}


def test_orphan_report_counts(spark):
    rows = spark.createDataFrame([("m", 0, T(1), "late"), ("m", 0, T(20), "late"), ("m", 1, dt.datetime(2024, 2, 1), "late")], "ref_field string, null_mask int, at timestamp, kind string")
    got = {(r.period, r.orphans) for r in orphans.orphan_report(rows, "ref_field", "at").collect()}
    assert got == {("2024-01-01", 2), ("2024-02-01", 1)}


def _lines(spark, files):
    rows, n = [], 0
    for day, (name, objects) in enumerate(files, 1):
        for k, o in enumerate(objects):
            n += 1
            rows.append((n, "src", "f", name, T(day), k, o if isinstance(o, str) else json.dumps(o), "extra"))
    return spark.createDataFrame(rows, "line_id long, source_table string, feed string, file_name string, delivered_at timestamp, line_no int, payload string, file_note string")


def _changes(spark, files):
    return {(r.file_name, r.change_kind, r.old_field, r.new_field) for r in drift.schema_changes(_lines(spark, files)).collect()}


def test_drift_kinds(spark):
    files = [
        ("1", [{"source_row": "a", "m": "x", "v": 1.0, "gone": 1, "o": {"a": 1, "b": 2}}, {"source_row": "b", "m": None, "v": 2}]),
        ("2", [{"source_row": "a", "mm": "x", "v": "1.0", "q": {"b": 2, "a": 1}}, {"source_row": "b", "v": "2", "new": True}, {"source_row": "c", "mm": "zzz"}, {"source_row": "a", "mm": "x", "v": "1.0", "q": {"b": 2, "a": 1}}]),
        ("3", [{"source_row": "a", "mm": None, "v": None, "new": True}, "not json", "[1]"]),
        ("4", [{"source_row": "a", "mm": ["x"], "v": 1, "new": True}]),
    ]
    assert _changes(spark, files) == {
        ("2", "renamed", "m", "mm"), ("2", "renamed", "o", "q"), ("2", "retyped", "v", "v"), ("2", "removed", "gone", ""), ("2", "added", "", "new"),
        ("3", "removed", "q", ""), ("4", "retyped", "mm", "mm"), ("4", "retyped", "v", "v"),
    }


def test_drift_all_null_is_no_rename_and_empty_table(spark):
    files = [("1", [{"source_row": "a", "x": None}]), ("2", [{"source_row": "a", "y": None}])]
    assert _changes(spark, files) == {("2", "removed", "x", ""), ("2", "added", "", "y")}
    assert _changes(spark, []) == set()


def test_consistent_cells_follow_renames(spark):
    files = [("1", [{"source_row": "a", "m": "x"}]), ("2", [{"source_row": "a", "mm": "x"}]), ("3", [{"source_row": "a", "mmm": "x", "k": 5}])]
    got = {(r.file_name, r.field, r.value) for r in drift.consistent_cells(_lines(spark, files)).collect() if r.field != "source_row"}
    assert got == {("1", "m", "x"), ("2", "m", "x"), ("3", "m", "x"), ("3", "k", "5")}


def test_one_consistent_table_per_source(spark):
    files = [
        ("1", [{"source_row": "a", "m": "x", "v": 1.5, "o": {"k": 1}, "line_id": 7}, {"source_row": "b", "m": None, "v": 2}]),
        ("2", [{"source_row": "a", "mm": "x", "v": "2.5", "flag": True, "o": [1]}, {"source_row": "c", "it's": 3, "a'b\"c": "q"}, "not json"]),
        ("3", [{"source_row": "a", "m": 9, "V": None}]),
    ]
    lines = _lines(spark, files)
    out = drift.consistent_table(lines, "src")
    types = dict(out.dtypes)
    assert (types["V"], types["v_field"], types["flag"], types["o"], types["it's"], types["line_id_field"]) == ("string", "string", "boolean", "string", "double", "double")
    got = {r.line_id: r.asDict() for r in out.collect()}
    assert len(got) == 6 and got[1]["m"] == "x" and got[1]["v_field"] == "1.5" and got[1]["o"] == '{"k":1}' and got[1]["line_id_field"] == 7.0
    assert got[3]["m"] == "x" and got[3]["v_field"] == "2.5" and got[3]["flag"] is True and got[3]["o"] == "[1]" and got[4]["it's"] == 3.0 and got[4]["a'b\"c"] == "q"
    assert got[2]["m"] is None and got[5]["source_row"] is None
    assert drift.consistent_table(lines, "none").count() == 0 and drift.consistent_table(lines.where("false"), "src").count() == 0


CASES = [
    ("78.63", "pct", "auroc", 786300), ("0,5 fraction", "percent", "auroc", 500000), ("12±1.2 %", None, "dice", 120000), ("−3.5 +/- 0.1", "percent", "relative_drop", -35000),
    ("7,863 bp", None, "auroc", 786300), ("1,234,567", "KiB", "peak_memory", 1234567 * 1024), ("6,169.491", "s", "wall_clock", 6169491), ("1.5 GB", "MiB", "peak_memory", 1500000000),
    ("2", "not_reported", "wall_clock in hours", 7200000), ("9.5e-01", "", "auroc [ratio]", 950000), ("822,9 per mille", None, "dice", 822900), (".5", "‰", "dice", 500),
]


def test_quantities(spark):
    rows = [(i, v, u, m) for i, (v, u, m, _) in enumerate(CASES)] + [(99, "n/a", "pct", "auroc"), (98, None, None, None), (97, "", "s", "x")]
    got = {r.id: r.common_value for r in quantities.harmonise_units(spark.createDataFrame(rows, "id int, value string, value_unit string, metric string")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]
    assert got[99] is None and got[98] is None and got[97] is None


def test_missing_units_are_inferred(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x = min(0.99, max(0.3, rng.gauss(0.75, 0.08)))
        unit, text = rng.choice([("fraction", x), ("percent", x * 100), ("bp", x * 10000)])
        rows.append((i, f"{text:.4f}", unit if i % 4 else None, "auroc", unit, int(round(x * 1e6))))
    frame = spark.createDataFrame(rows, "id int, value string, value_unit string, metric string, true_unit string, true_value long")
    out = quantities.harmonise_units(frame).where("value_unit is null").collect()
    right = [abs(r.common_value - r.true_value) < 200 for r in out]
    assert sum(right) / len(right) > 0.98 and all(r.unit_source == "inferred" for r in out)


def test_a_metric_measures_what_most_of_its_units_do(spark):
    rows = [(i, f"{3 + i % 5}.5", "GB", "footprint") for i in range(30)] + [(90, "4100", None, "footprint"), (91, "4,5", None, "auroc"), (92, "0", None, "footprint"), (93, "5", None, None)]
    got = {r.id: r for r in quantities.harmonise_units(spark.createDataFrame(rows, "id int, value string, value_unit string, metric string")).collect()}
    assert got[90].quantity == "memory" and got[90].common_unit == "byte" and got[90].unit_source == "inferred"
    assert got[91].quantity == "fraction" and got[92].unit is None and got[92].uncertain and got[93].quantity == "fraction"


def test_hidden_units_are_found_again(spark):
    """Accuracy on the test tables: units that are written are hidden and must be inferred; wrong ones must mostly be flagged."""
    source = "/root/testdata/sf0.01/midnight_miccai2025_official_scores.parquet"
    if not pathlib.Path(source).exists():
        pytest.skip("no test tables")
    truth = quantities.harmonise_units(spark.read.parquet(source).select("record_id", "value", "value_unit", "metric"))
    truth = truth.where("unit_source = 'value_unit'").select("record_id", F.col("common_value").alias("truth"), F.col("unit").alias("written"))
    hide = F.col("record_id") % 4 == 0
    rows = spark.read.parquet(source).select("record_id", "value", F.when(~hide, F.col("value_unit")).alias("value_unit"), "metric")
    out = quantities.harmonise_units(rows).where("unit_source = 'inferred'").join(truth, "record_id").collect()
    sure = [r for r in out if not r.uncertain]
    right = lambda rs: sum(r.unit == r.written for r in rs) / len(rs)
    print("hidden", len(out), "right", right(out), "certain", len(sure), "right", right(sure))
    assert len(out) > 300 and right(sure) > 0.97 and right(out) > 0.9


def test_units_empty_table(spark):
    assert quantities.harmonise_units(spark.createDataFrame([], "id int, value string, value_unit string, metric string")).count() == 0


def test_hot_deck_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"m{i:03d}", rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randrange(50))]) if i % 9 else None, rng.choice([None, i * 1.0])) for i in range(150)]
    frame = spark.createDataFrame(rows, "id string, g string, day double, v double")
    out = {r.id: r for r in hotdeck.hot_deck(frame, "g", "day", "id", "v").collect()}
    assert len(out) == len(rows)
    inf = float("-inf")
    for i, g, day, v in rows:
        donors = [(inf if d2 is None else d2, j, w) for j, g2, d2, w in rows if g2 == g and g is not None and w is not None and j != i]
        assert out[i].was_filled == (v is None and bool(donors))
        if out[i].was_filled:
            gap = min(abs(d2 - (inf if day is None else day)) if day is not None and d2 > inf else (0 if day is None and d2 == inf else float("inf")) for d2, _, _ in donors)
            assert out[i].distance == gap or out[i].distance is None or gap == float("inf")
        else:
            assert out[i].v_filled == v


def test_hot_deck_empty(spark):
    frame = spark.createDataFrame([], "id string, g string, day double, v double")
    assert hotdeck.hot_deck(frame, "g", "day", "id", "v").count() == 0
