"""Training, scoring, contributions and drift."""

import math
import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift, explain, flagging, metrics, model
from riskloom.schemas import MODEL_FEATURES


def features(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randrange(0, 50)) for _ in MODEL_FEATURES]
        x[3] = None if rng.random() < 0.1 else x[3]
        label = int(x[1] > 30 and x[9] > 10 or (x[3] or 0) > 45)
        rows.append((i, i, label, *x))
    schema = "transactionid long, transactiondt long, isfraud int, " + ", ".join(
        f"{c} double" for c in MODEL_FEATURES
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def data(spark):
    return features(spark).persist()


@pytest.fixture(scope="module")
def fitted(spark, data):
    return model.train_model(data, trees=5, depth=3)


def test_unlabelled_rows_teach_nothing(spark, data):
    more = data.unionByName(data.withColumn("isfraud", F.lit(None).cast("int")))
    a = model.train_model(data, trees=2, depth=2).featureImportances
    b = model.train_model(more, trees=2, depth=2).featureImportances
    assert np.allclose(a.toArray(), b.toArray())


def test_scores_rank_well(spark, data, fitted):
    scored = model.score(data, fitted)
    assert scored.count() == data.count()
    assert metrics.roc_auc(scored).first()[0] > 0.9


def test_contributions_sum_to_the_score(spark, data, fitted):
    scored = model.score(data, fitted).select("transactionid", "score")
    rows = explain.tree_contributions(data, fitted).join(scored, "transactionid").collect()
    assert len(rows) == 600
    for r in rows:
        total = r.base + sum(r[f"c_{c}"] for c in MODEL_FEATURES)
        assert total == pytest.approx(math.log(r.score / (1 - r.score)), abs=1e-9)


def expected_value(tree, x, known):
    """Mean output of a tree when only ``known`` features of x are given."""

    def walk(node):
        if node["left"] < 0:
            return node["value"]
        left, right = tree[node["left"]], tree[node["right"]]
        if node["feature"] in known:
            return walk(left if x[node["feature"]] <= node["threshold"] else right)
        return (walk(left) * left["cover"] + walk(right) * right["cover"]) / node["cover"]

    return walk(tree[0])


def test_contributions_are_shapley_values(spark, data, fitted):
    """Against the definition: the mean gain over all feature subsets."""
    nodes = explain.tree_nodes(fitted, spark)
    trees = {}
    for node in nodes:
        trees.setdefault(node["tree"], {})[node["id"]] = node
    used = sorted({n["feature"] for n in nodes if n["left"] >= 0})
    m = len(used)
    got = explain.tree_contributions(data.filter("transactionid < 3"), fitted).collect()
    for r in got:
        x = [model.MISSING if r[c] is None else r[c] for c in MODEL_FEATURES]
        for f in used:
            others = [o for o in used if o != f]
            phi = 0.0
            for size in range(m):
                w = factorial(size) * factorial(m - size - 1) / factorial(m)
                for s in combinations(others, size):
                    for t in trees.values():
                        gain = expected_value(t, x, {*s, f}) - expected_value(t, x, set(s))
                        phi += w * 2.0 * t[0]["weight"] * gain
            assert r[f"c_{MODEL_FEATURES[f]}"] == pytest.approx(phi, abs=1e-9)


def grown_tree(rng, number, depth, features=6):
    """A tree of its own; features come back on a path, and some leaves are shallow."""
    nodes, todo, last = [], [(0, 0, 1e6)], 0
    while todo:
        at, level, cover = todo.pop()
        node = {"tree": number, "weight": 0.1, "id": at, "value": rng.gauss(0, 1), "cover": cover, "left": -1, "right": -1}
        if level < depth and rng.random() > 0.1:
            share = rng.uniform(0.1, 0.9)
            node |= {"left": last + 1, "right": last + 2, "feature": rng.randrange(features), "threshold": float(rng.randrange(9))}
            todo += [(last + 1, level + 1, cover * share), (last + 2, level + 1, cover * (1 - share))]
            last += 2
        nodes.append(node)
    return nodes


@pytest.mark.parametrize("depth, most_bytes", [(0, 10**8), (1, 10**8), (5, 10**8), (5, 20_000), (9, 10**8)])
def test_looked_up_contributions_are_the_computed_ones(monkeypatch, depth, most_bytes):
    """Also of leaves with too many decisions for a table, of models with too many leaves, and of values at the thresholds."""
    monkeypatch.setattr(explain, "MOST_BYTES", most_bytes)
    rng = random.Random(depth)
    nodes = [n for t in range(12) for n in grown_tree(rng, t, depth)]
    x = np.array([[rng.choice([model.MISSING, rng.uniform(0, 9), rng.randrange(9)]) for _ in range(6)] for _ in range(400)])
    base, groups = explain.leaf_groups(nodes)
    same_base, tables = explain.contribution_tables(nodes)
    assert same_base == base
    assert np.allclose(tables.values(x), explain.shapley_values(x, groups), rtol=0, atol=1e-12)
    assert tables.values(x[:0]).shape == (0, 6)


def test_a_row_costs_look_ups_only():
    """Of a model as it is trained, nothing is computed row by row."""
    rng = random.Random(7)
    tables = explain.contribution_tables([n for t in range(50) for n in grown_tree(rng, t, 5)])[1]
    assert not tables.rest and sum(table.nbytes for _, _, table in tables.parts) < explain.MOST_BYTES / 10


def test_reasons_and_response(spark, data, fitted):
    scored = model.score(data, fitted)
    contributions = explain.tree_contributions(scored, fitted, keep=("score",))
    long = explain.reasons(contributions)
    assert long.count() == 600 * 13
    top = long.filter("transactionid = 5").orderBy("rank").collect()
    sizes = [abs(r.contribution) for r in top]
    assert sizes == sorted(sizes, reverse=True) and top[0].strongest == sizes[0]
    shown = explain.reasons_display(long).filter("rank = 1")
    assert shown.filter("relative_share <> 1.0 AND contribution <> 0").count() == 0
    response = flagging.score_response(explain.ranked(contributions, ("score",))).first()
    assert len(response.reasons) == 13 and response.threshold_used == 0.07


def test_reasons_need_no_shuffle(spark, data):
    weights = {c: 1.0 for c in MODEL_FEATURES}
    long = explain.reasons(explain.linear_contributions(data, weights, weights), 5)
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()


def test_training_run(spark, data, tmp_path):
    fitted, row = model.training_run(data, trees=3, save_to=str(tmp_path / "model"))
    got = row.first()
    assert (got.trees, got.train_rows, got.test_rows) == (3, 480, 120)
    assert 0.5 < got.roc_auc <= 1.0 and 0.01 <= got.best_threshold <= 0.99
    assert type(fitted).load(str(tmp_path / "model")).numFeatures == 13


# --- drift -------------------------------------------------------------------


def sides(spark, reference, current, columns=("a",)):
    rows = [("reference", *r) for r in reference] + [("current", *r) for r in current]
    return spark.createDataFrame(rows, "side string, " + ", ".join(f"{c} double" for c in columns))


def test_statistic_is_the_largest_gap(spark):
    rng = random.Random(2)
    a = [float(rng.randrange(30)) for _ in range(200)]
    b = [float(rng.randrange(8, 38)) for _ in range(90)]
    report = drift.drift_report(sides(spark, [(v,) for v in a], [(v,) for v in b]), ["a"])
    gap = max(
        abs(sum(x <= v for x in a) / 200 - sum(x <= v for x in b) / 90) for v in set(a + b)
    )
    row = report.first()
    assert row.ks_statistic == round(gap, 4) and row.drift_detected


def test_same_distribution_is_stable(spark):
    rows = [(float(i % 20),) for i in range(400)]
    row = drift.drift_report(sides(spark, rows, rows), ["a"]).first()
    assert (row.ks_statistic, row.p_value, row.drift_detected) == (0.0, 1.0, False)


def test_small_sides_are_skipped(spark):
    full = [(float(i), None if i > 8 else 1.0) for i in range(20)]
    report = drift.drift_report(sides(spark, full, full, ("a", "b")), ["a", "b"])
    assert [r.feature for r in report.collect()] == ["a"]
    none = drift.any_drift(report.filter("false")).first()
    assert (none.any_drift, none.n_drifted) == (False, 0)
