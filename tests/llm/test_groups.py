"""Survivors, splits, rankings and mixtures against brute force and on edge cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import mixing, ranking, splits, survivors

DATES = [
    ("v8 of 2025-10-12", dt.date(2025, 10, 12)), ("card commit 000004; modified 2024-01-22T09:30:00Z", dt.date(2024, 1, 22)), ("x (2023.12.09)", dt.date(2023, 12, 9)), ("x | 2024/01/27", dt.date(2024, 1, 27)),
    ("report TR-2023-004, posted 20250619", dt.date(2025, 6, 19)), ("asset 5 (4 Jan 2024)", dt.date(2024, 1, 4)), ("file 5 (January 21, 2024)", dt.date(2024, 1, 21)), ("of 20 November 2023", dt.date(2023, 11, 20)),
    ("report TR-2023-007", None), ("card commit 000003", None), ("2024-02-31", None), (None, None), ("", None),
]


def test_written_dates(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    got = [r.d for r in rows.select("i", survivors.written_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [d for _, d in DATES]


def _records(n, seed):
    rng = random.Random(seed)
    return [
        (i, rng.choice("aaaabcdefg"), rng.choice([1, 2, 3, None]), rng.choice([dt.date(2024, 1, 1), dt.date(2024, 5, 1), None]), rng.choice(["x", None, "n/a"]), rng.choice(["y", ""]), rng.choice([None, "z"]))
        for i in range(1, n + 1)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_survivors_against_brute_force(spark, seed):
    rows = _records(120, seed)
    fields = ["f1", "f2", "f3"]
    frame = spark.createDataFrame(rows + rows[:0], "id long, g string, trust int, day date, f1 string, f2 string, f3 string")
    got = {(r.group_id, r.field_name): r.record for r in survivors.choose_fields(frame, ["g"], "id", "trust", "day", fields).collect()}
    given = lambda v: v not in (None, "", "n/a")
    groups, want = {}, {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    key = lambda r: (r[2] or 99, -(r[3].toordinal() if r[3] else 0), -sum(map(given, r[4:])), r[0])
    for rs in groups.values():
        if len(rs) > 1:
            for k, f in enumerate(fields):
                giving = sorted((r for r in rs if given(r[4 + k])), key=key)
                if giving:
                    want[min(r[0] for r in rs), f] = giving[0][0]
    assert got == want
    whole = survivors.build_survivors(frame, ["g"], "id", "trust", "day", fields).collect()
    assert len(whole) == sum(len(rs) > 1 for rs in groups.values())
    for r in whole:
        assert r.f2_from == want.get((r.group_id, "f2")) and (r.f2_layer is None or r.f2_layer >= 1)
    assert survivors.choose_fields(frame.where("id < 0"), ["g"], "id", "trust", "day", fields).count() == 0


def test_layers_fill_and_the_policy_checks_them(spark):
    day = lambda m: dt.date(2024, m, 1)
    rows = [
        (1, "g", 1, day(5), None, "a", None), (2, "g", 1, day(1), "b", None, None), (3, "g", 2, day(6), "c", None, None), (4, "g", 3, day(2), None, None, "d"),
        (5, "h", 2, day(3), None, "x", None), (6, "h", 1, day(4), None, None, "y"), (7, "h", 3, day(1), "z", "z", "z"),
    ]
    frame = spark.createDataFrame(rows, "id long, g string, trust int, day date, f1 string, f2 string, f3 string")
    got = {(r.group_id, r.field_name): r for r in survivors.choose_fields(frame, ["g"], "id", "trust", "day", ["f1", "f2", "f3"]).collect()}
    f1 = got[1, "f1"]
    assert (f1.record, f1.layer, f1.layer_record, f1.base_record) == (2, 2, 3, 1)  # the layers alone take the less trusted record of the skyline
    f3 = got[1, "f3"]
    assert (f3.record, f3.layer_record) == (4, 4) and f3.layer > 1  # a gap of the skyline filled from a later layer
    assert got[5, "f2"].record == 5 and got[5, "f2"].layer == 2 and got[5, "f2"].layer_record == 7  # the complete record is undominated
    whole = {r.group_id: r for r in survivors.build_survivors(frame, ["g"], "id", "trust", "day", ["f1", "f2", "f3"]).collect()}
    assert (whole[1].f1, whole[1].f1_from, whole[1].f1_by_layers, whole[1].f3_from) == ("b", 2, 3, 4)


def _components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    out = {}
    for x in parent:
        out.setdefault(root(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("task_edges", [1_000_000, 20, 7])
def test_components_over_levels(spark, task_edges):
    rng = random.Random(2)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"s{rng.randrange(60)}", f"s{rng.randrange(60)}") for _ in range(45)] + [("h", f"h{i}") for i in range(20)]
    labels = splits.connected_components(spark.createDataFrame(edges, "a string, b string"), task_edges).collect()
    got = {}
    for r in labels:
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == {c for c in _components([e for e in edges if e[0] != e[1]]) if len(c) > 1}


@pytest.mark.parametrize("shape", ["chain", "random", "hub"])
def test_every_level_shrinks(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(f"n{i}", f"n{i + 1}") for i in range(2000)],
        "random": [(f"n{rng.randrange(2000)}", f"n{rng.randrange(2000)}") for _ in range(2000)],
        "hub": [("h", f"n{i}") for i in range(2000)],
    }[shape]
    sizes: list[int] = []
    labels = splits.connected_components(spark.createDataFrame(edges, "a string, b string"), 20, sizes).collect()  # a hundred tasks
    got = {}
    for r in labels:
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == {c for c in _components([e for e in edges if e[0] != e[1]]) if len(c) > 1}
    assert len(sizes) <= 9 and all(b <= 0.7 * a for a, b in zip(sizes, sizes[1:])), sizes


def test_related_groups_and_edge_cases(spark):
    members = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "member string")
    names = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", None), ("d", "q"), ("d", "q")], "member string, name string")
    got = {}
    for r in splits.related_groups(members, names).collect():
        got.setdefault(r.group_root, set()).add(r.member)
    assert {frozenset(v) for v in got.values()} == {frozenset("abc"), frozenset("d"), frozenset("e")}
    assert splits.related_groups(members.where("false"), names.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_equal_groups_are_dealt_as_greedy_would(seed):
    rng = random.Random(seed)
    count, size, deficits = rng.randrange(1, 60), rng.randrange(1, 9), [rng.uniform(-20, 200) for _ in range(3)]
    left, want = list(deficits), [0, 0, 0]
    for _ in range(count):
        k = max(range(3), key=lambda i: (left[i], -i))
        left[k] -= size
        want[k] += 1
    assert splits.deal_equal_groups(count, size, deficits) == want


def test_splits_reach_their_shares_and_keep_groups(spark):
    rng = random.Random(0)
    rows = [(f"g{i}", rng.choice([1, 1, 1, 2, 3, 9, 40])) for i in range(400)]
    groups = spark.createDataFrame(rows, "group_id string, size long")
    out = splits.assign_splits(groups, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert sorted(r.group_id for r in out) == sorted(g for g, _ in rows)
    total = sum(s for _, s in rows)
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r.size for r in out if r.split == name) / total - share) < 0.01


def test_ranking_is_not_governed_by_range_and_follows_directions(spark):
    rng = np.random.default_rng(0)
    skill = rng.normal(size=300)
    rows = [(f"m{i:03d}", float(1e6 * np.exp(skill[i]) + 1), float(-skill[i] + rng.normal(0, 0.3)), float(rng.choice([np.nan, np.inf, -999.0])) if i % 5 == 0 else float(skill[i] + rng.normal(0, 0.3)), 7.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "id string, a double, b double, c double, k double")
    columns = [{"name": n, "higher_is_better": n != "b", "lowest": -100.0, "highest": 1e12} for n in "abck"]
    items = spark.createDataFrame([(r[0],) for r in rows] + [("none",)], "id string")
    out = {r.id: r for r in ranking.rank_items(items, frame, "id", columns).collect()}
    place = np.array([out[r[0]].place for r in rows])
    assert np.corrcoef(place, -skill.argsort().argsort())[0, 1] > 0.95
    assert out["none"].projection is None and out["none"].place == 301 and out["none"].n_scores == 0
    scaled = frame.withColumn("a", F.col("a") / 1e6)
    again = {r.id: r.place for r in ranking.rank_items(items, scaled, "id", columns).collect()}
    assert again == {k: v.place for k, v in out.items()}


def test_a_column_against_its_direction_has_no_weight(spark):
    rng = np.random.default_rng(3)
    skill = rng.normal(size=200)
    rows = [(f"m{i}", float(skill[i] + rng.normal(0, 0.2)), float(skill[i] + rng.normal(0, 0.2)), float(skill[i] + rng.normal(0, 0.2)), float(-skill[i])) for i in range(200)]
    columns = [{"name": n, "higher_is_better": True, "lowest": -100.0, "highest": 100.0} for n in "abcd"]
    got = {r.column_name: r for r in ranking.loadings(spark.createDataFrame(rows, "id string, a double, b double, c double, d double"), "id", columns).collect()}
    assert got["d"].against and got["d"].loading == 0 and got["d"].component < 0 and all(got[n].loading > 0.3 for n in "abc")


def test_ranking_of_empty_scores(spark):
    columns = [{"name": "a", "higher_is_better": True, "lowest": 0.0, "highest": 1.0}, {"name": "b", "higher_is_better": True, "lowest": 0.0, "highest": 1.0}]
    items = spark.createDataFrame([("x",)], "id string")
    out = ranking.rank_items(items, spark.createDataFrame([], "id string, a double, b double"), "id", columns).collect()
    assert [(r.id, r.place, r.projection) for r in out] == [("x", 1, None)]


def test_blocks_split_exactly():
    blocks = {"a": 101, "b": 7, "c": 0, "d": 64}
    quotas = mixing.split_blocks(blocks, shards=8, seed=3)
    assert {s: sum(q) for s, q in quotas.items()} == blocks
    loads = [sum(q[k] for q in quotas.values()) for k in range(8)]
    assert max(loads) - min(loads) <= 1
    assert mixing.split_blocks({}, 4) == {}


def test_draws_beyond_the_range_of_the_generator_are_exact():
    rng = np.random.default_rng(1)
    counts = np.array([6 * 10**9, 3 * 10**9, 10**9, 5, 0], dtype=np.int64)
    left = 4 * 10**9
    draws = np.array([mixing.draw_blocks(rng, counts, left) for _ in range(600)])
    assert (draws.sum(axis=1) == left).all() and (draws <= counts).all() and (draws >= 0).all()
    total = int(counts.sum())
    for i in range(3):
        p = counts[i] / total
        spread = np.sqrt(left * p * (1 - p) * (total - left) / (total - 1))
        assert abs(draws[:, i].mean() - left * p) < 5 * spread / np.sqrt(600)
        assert 0.85 < draws[:, i].std() / spread < 1.15  # a mean with a random remainder would have a spread of about one
    blocks = {"a": 7 * 10**9, "b": 3 * 10**9 + 1}
    quotas = mixing.split_blocks(blocks, shards=8, seed=3)
    assert {s: sum(q) for s, q in quotas.items()} == blocks


def test_the_large_draw_agrees_with_the_generator(monkeypatch):
    """Both ways give one distribution where both can be used."""
    rng = np.random.default_rng(2)
    good, bad, sample = 400, 900, 350

    def large(g, b, s):
        low, high = max(0, s - b), min(g, s)
        weights = np.array([math.exp(math.lgamma(g + 1) - math.lgamma(k + 1) - math.lgamma(g - k + 1) + math.lgamma(b + 1) - math.lgamma(s - k + 1) - math.lgamma(b - s + k + 1) - math.lgamma(g + b + 1) + math.lgamma(s + 1) + math.lgamma(g + b - s + 1)) for k in range(low, high + 1)])
        return low, weights

    low, weights = large(good, bad, sample)
    monkeypatch.setattr(mixing, "GENERATOR_RANGE", 0)
    draws = np.array([mixing.hypergeometric(rng, good, bad, sample) for _ in range(20_000)]) - low
    seen = np.bincount(draws, minlength=len(weights)) / 20_000
    assert np.abs(np.cumsum(seen) - np.cumsum(weights)).max() < 0.015


def test_a_larger_total_gives_capped_sources_all_they_have():
    plan = mixing.plan_shares({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, total=2000)
    assert plan["a"]["wanted"] == 1000 and plan["b"] == {"wanted": 20, "full": 2, "rest": 0}
    assert mixing.plan_shares({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)})["a"]["wanted"] == 20


def test_mixture_reaches_shares_within_caps(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaaaab"), rng.randrange(0, 50)) for i in range(1500)] + [(9000, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    supply = {}
    for _, s, t in rows:
        supply[s] = supply.get(s, 0) + t
    targets = {"a": (0.5, 2), "b": (0.4, 3), "none": (0.1, 3)}
    plan = mixing.plan_shares({k: v for k, v in supply.items() if k}, targets)
    out = mixing.draw_mixture(frame, plan, shards=4, block_rows=8).collect()
    drawn, copies = {}, {}
    for r in out:
        drawn[r.source] = drawn.get(r.source, 0) + r.tokens
        copies[r.doc_id, r.copy_no] = copies.get((r.doc_id, r.copy_no), 0) + 1
    assert set(copies.values()) == {1} and max(r.copy_no for r in out if r.source == "b") <= 3 and all(r.copy_no <= 2 for r in out if r.source == "a")
    assert abs(drawn["a"] / sum(drawn.values()) - 0.5 / 0.9) < 0.01
    assert {r.shard for r in out} == {0, 1, 2, 3} and 9000 not in {r.doc_id for r in out}
    assert mixing.plan_shares({}, targets) == {}
