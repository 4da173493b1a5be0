"""Boosted trees from counts of binned rows, against MLlib's own."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from riskloom.operators import boosting, explain, model
from riskloom.schemas import MODEL_FEATURES


def table(spark, n, seed, parts=4):
    """Unlike values, few values, one value, unknown ones, zeros."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = [draw.choice([draw.uniform(-5, 5), 0.0]) if c % 3 else float(draw.randrange(2 + c)) for c in range(len(MODEL_FEATURES))]
        x[4], x[7] = 1.0, None if draw.random() < 0.2 else x[7]
        rows.append((i, int(x[1] + x[2] + draw.gauss(0, 4) > 1), *x))
    schema = "transactionid long, isfraud int, " + ", ".join(f"{c} double" for c in MODEL_FEATURES)
    return spark.createDataFrame(rows, schema).repartition(parts).persist()


def mllib(rows, trees, depth):
    known = model.assemble(rows).select("inputs", F.col("isfraud").cast("double").alias("label"))
    return GBTClassifier(
        featuresCol="inputs", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.1, minInstancesPerNode=20, checkpointInterval=10,
        seed=42,
    ).fit(known)


def nodes(spark, fitted):
    return sorted(explain.tree_nodes(fitted, spark), key=lambda n: (n["tree"], n["id"]))


@pytest.mark.parametrize("trees, depth", [(2, 0), (1, 1), (12, 4)])
def test_the_trees_are_those_of_mllib(spark, monkeypatch, trees, depth):
    """Also from several chunks, and with scores written in between."""
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 500)
    rows = table(spark, 3000, trees)
    expected, got = mllib(rows, trees, depth), model.train_model(rows, trees=trees, depth=depth)
    exact = ("tree", "id", "weight", "cover", "left", "right", "feature", "threshold")
    a, b = nodes(spark, expected), nodes(spark, got)
    assert [[n[k] for k in exact] for n in a] == [[n[k] for k in exact] for n in b]
    assert np.allclose([n["value"] for n in a], [n["value"] for n in b], rtol=0, atol=1e-12)
    assert np.allclose(expected.featureImportances.toArray(), got.featureImportances.toArray(), rtol=0, atol=1e-12)
    one, other = (model.score(rows, m).orderBy("transactionid").select("score").toPandas() for m in (expected, got))
    assert np.allclose(one, other, rtol=0, atol=1e-12)
    given = [{p.name: m.getOrDefault(p) for p in m.params if m.isSet(p)} for m in (expected, got)]
    assert given[0] == given[1]


def test_a_pass_takes_as_many_tasks_as_its_rows_need(spark):
    """And not as many as the table has files or partitions."""
    rows, tasks = table(spark, 600, 5, parts=64), []
    rows.count()
    tracker = spark.sparkContext.statusTracker()
    for trees in (2, 6):
        spark.sparkContext.setJobGroup(f"trees-{trees}", "")
        model.train_model(rows, trees=trees, depth=3)
        stages = {s for j in tracker.getJobIdsForGroup(f"trees-{trees}") for s in tracker.getJobInfo(j).stageIds}
        tasks.append(sum(found.numTasks for found in map(tracker.getStageInfo, stages) if found))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks[1] - tasks[0] < 4 * 64  # not one per partition and tree; storing and loading the model takes some


def test_pairs_of_inputs_count_as_each_of_them(monkeypatch):
    """An odd number of inputs, rows in leaves, the first tree and a later one."""
    draw = np.random.default_rng(3)
    splits = [4, 1, 6]
    bins = np.stack([draw.integers(0, n + 1, 300).astype(np.uint8) for n in splits])
    signs, tree = draw.choice(np.array([-1, 1], np.int8), 300), boosting.Tree(splits={1: (0, 2, 1.0), 3: (2, 3, 1.0)})
    for scores in (None, draw.normal(size=300)):
        found = []
        for enough in (1, 1000):
            monkeypatch.setattr(boosting, "PAIRED_ROWS", enough)
            found.append(boosting.counted([(bins, signs, scores)] * 2, tree, [6, 7], splits))
        assert found[0].shape == (2, 3, 7, 3) and np.allclose(*found, rtol=0, atol=1e-9)
        inside = (bins[0] > 2) & (bins[2] > 3) & (bins[1] == 1)
        assert found[0][1, 1, 1, 0] == 2 * inside.sum()


def test_of_siblings_in_a_large_table_the_smaller_is_counted(spark, monkeypatch):
    """And the trees are still MLlib's."""
    rows, passes, counting = table(spark, 3000, 8), [], boosting._pass

    def noted(chunks, tree, nodes, splits):
        passes.append((tree, nodes))
        return counting(chunks, tree, nodes, splits)

    monkeypatch.setattr(boosting, "PAIRED_ROWS", 1000)
    monkeypatch.setattr(boosting, "_pass", noted)
    a, b = nodes(spark, mllib(rows, 6, 4)), nodes(spark, model.train_model(rows, trees=6, depth=4))
    exact = ("tree", "id", "weight", "cover", "left", "right", "feature", "threshold")
    assert [[n[k] for k in exact] for n in a] == [[n[k] for k in exact] for n in b]
    assert np.allclose([n["value"] for n in a], [n["value"] for n in b], rtol=0, atol=1e-11)
    for tree, some in passes:
        assert not any(n ^ 1 in some for n in some)
        assert sum(tree.stats[n][0] for n in some if n > 1) <= 3000 / 2 or some == [1]


def test_groups_of_inputs():
    """Every input in one group, of no more cells than allowed but for one input alone."""
    for splits in ([31] * 7 + [23, 6, 4, 1, 0], [3000, 31, 31, 2], [0]):
        groups = boosting.input_groups(splits)
        assert sorted(sum(groups, [])) == list(range(len(splits)))
        assert all(len(g) == 1 or np.prod([splits[i] + 1 for i in g]) <= boosting.GROUP_CELLS for g in groups)
    assert len(boosting.input_groups([31] * 7 + [23, 6, 4, 1, 0])) < 6


def test_candidates():
    assert boosting.split_points(np.array([3.0, 1.0, 1.0]), 5).tolist() == [2.0]
    assert boosting.split_points(np.ones(4), 5).tolist() == []
    assert boosting.split_points(np.arange(8.0), 3).tolist() == [1.5, 3.5, 5.5]
    assert boosting.split_points(np.array([0.0] * 50 + [*range(1, 51)]), 3).tolist() == [0.5, 1.5, 25.5]


def test_other_labels_and_no_rows_are_errors(spark):
    rows = table(spark, 30, 1)
    for bad in (rows.withColumn("isfraud", F.lit(2)), rows.limit(0)):
        with pytest.raises(ValueError, match="labelled"):
            model.train_model(bad, trees=1)
