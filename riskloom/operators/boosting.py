"""Boosted trees grown from counts of binned rows.

The trees are those of MLlib's ``GBTClassifier`` with the same parameters: the same candidates for a split (all rows up to
10,000, beyond that a sample of as many, by which only the candidates are found), variance as impurity, log loss, the same
rules for leaves and ties; sums are added in another order, so values agree up to rounding. What differs is what a pass
costs. Of two siblings only the smaller is counted in a large table. Every input of a row becomes one byte, the number of its bin, once. A pass counts a chunk of rows at a time, in
as many tasks as there are cores, whatever the number of files, and gives out number, sum and sum of squares per node, input and
bin, whose size depends on the tree and not on the rows. A level of a tree is one pass, and the scores of a finished tree are added in the
first pass of the next.

The finished trees are written in the form in which Spark stores such a model, and loaded as one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import delete, materialise, temporary, workspace

#: Rows by which the candidates for splits are found.
CANDIDATE_ROWS = 10_000
#: Rows that are counted at once.
CHUNK_ROWS = 60_000
#: From so many rows on a chunk is counted by the bins of several inputs at once, and of two siblings only the smaller, which takes a third
#: of the time. Of fewer rows the cells would be too many; and their sums are added in the order of MLlib's, so that ties are broken alike.
PAIRED_ROWS = 20_000
#: Cells of the inputs that are counted at once, but for one input alone.
GROUP_CELLS = 1024
#: Partial sums that may be added up in one place.
MOST_PARTS = 64
#: An impurity below is none.
EPSILON = float(np.finfo(float).eps)

#: Bins (inputs, rows), labels as -1 and 1, and scores so far (None before the first tree).
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray | None]

_NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of k are 2k (values up to the bin) and 2k + 1."""

    stats: dict[int, np.ndarray] = field(default_factory=dict)
    impurity: dict[int, float] = field(default_factory=dict)
    #: Input, last bin of the left side, and gain of the nodes that are split.
    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)

    def value(self, node: int) -> float:
        return float(self.stats[node][1] / self.stats[node][0])

    def values(self) -> np.ndarray:
        out = np.zeros(max(self.stats) + 1)
        for node in self.stats:
            out[node] = self.value(node)
        return out


def fit(estimator: GBTClassifier, rows: DataFrame) -> GBTClassificationModel:
    """The model that ``estimator`` describes, of rows with its columns of inputs (a vector) and labels (0 or 1)."""
    spark = rows.sparkSession
    rows = rows.select(vector_to_array(estimator.getFeaturesCol()).alias("inputs"), F.col(estimator.getLabelCol()).alias("label"))
    total, known = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label").isin(0.0, 1.0))).first()
    if known < total or not total:
        raise ValueError(f"training needs rows, all labelled 0 or 1: {known} of {total} are")
    with temporary(spark):
        thresholds = candidates(rows, total, estimator)
        chunks = binned(rows, total, thresholds)
        trees = boost(chunks, [len(t) for t in thresholds], estimator)
        return _loaded(spark, estimator, trees, thresholds)


# --- bins --------------------------------------------------------------------------


def candidates(rows: DataFrame, total: int, estimator: GBTClassifier) -> list[np.ndarray]:
    """Per input the values that may split it, rising."""
    bins = estimator.getMaxBins()
    enough = max(bins**2, CANDIDATE_ROWS)
    found = rows if total <= enough else rows.sample(enough / total, estimator.getSeed())
    values = np.array([r.inputs for r in found.select("inputs").collect()])
    return [split_points(column, min(bins, total) - 1) for column in values.T]


def split_points(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds that cut the values into parts of about the same number of rows."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) <= most:
        return between
    stride = target = len(values) / (most + 1)
    before, found = np.cumsum(counts).tolist(), []
    for i in range(len(between)):
        if abs(before[i] - target) < abs(before[i + 1] - target):
            found.append(between[i])
            target += stride
    return np.array(found)


def binned(rows: DataFrame, total: int, thresholds: list[np.ndarray]) -> RDD:
    """The rows as chunks of about CHUNK_ROWS, dealt out evenly to as many partitions as there are cores, fewer for few rows."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        values = np.concatenate([b.column("inputs").flatten().to_numpy(zero_copy_only=False) for b in held])
        columns = values.reshape(-1, len(thresholds)).T
        bins = np.stack([np.searchsorted(t, x).astype(np.uint8 if len(t) < 256 else np.int32) for t, x in zip(thresholds, columns)])
        signs = np.concatenate([b.column("label").to_numpy(zero_copy_only=False) for b in held]) * 2 - 1
        return pa.RecordBatch.from_pydict({"kind": [bins.dtype.str], "bins": [bins.tobytes()], "signs": [signs.astype(np.int8).tobytes()]})

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                yield chunk(held)
                held = []
        if held:
            yield chunk(held)

    def opened(row) -> Chunk:
        signs = np.frombuffer(row.signs, np.int8)
        return np.frombuffer(row.bins, row.kind).reshape(-1, len(signs)), signs, None

    packed = materialise(rows.mapInArrow(chunks, "kind string, bins binary, signs binary"), "binned")
    parts = min(-(-total // CHUNK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return packed.repartition(parts).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)


# --- passes ------------------------------------------------------------------------


def places(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The number of the node each row has come to."""
    at = np.ones(bins.shape[1], np.min_scalar_type(2 * max(tree.splits, default=1) + 1))
    for node in sorted(tree.splits):  # parents come first
        of, last, _ = tree.splits[node]
        right = bins[of] > last
        at += (at == node) * (right + at.dtype.type(node))
    return at


def left_to_learn(signs: np.ndarray, scores: np.ndarray | None) -> np.ndarray:
    """The labels at first, then the negative gradient of the log loss."""
    if scores is None:
        return signs.astype(float)
    with np.errstate(over="ignore"):
        return 4.0 * signs / (1.0 + np.exp(2.0 * signs * scores))


def advanced(chunk: Chunk, tree: Tree, weight: float) -> Chunk:
    """The chunk with a finished tree's scores added."""
    bins, signs, scores = chunk
    more = weight * tree.values()[places(bins, tree)]
    return bins, signs, more if scores is None else scores + more


def input_groups(splits: list[int]) -> list[list[int]]:
    """The inputs in groups whose bins have GROUP_CELLS combinations or fewer; those with most bins first."""
    groups: list[tuple[list[int], int]] = []
    for of in sorted(range(len(splits)), key=lambda i: -splits[i]):
        width = splits[of] + 1
        at = next((i for i, (_, cells) in enumerate(groups) if cells * width <= GROUP_CELLS), None)
        if at is None:
            groups.append(([of], width))
        else:
            groups[at] = [*groups[at][0], of], groups[at][1] * width
    return [some for some, _ in groups]


def counted(chunks: Iterable[Chunk], tree: Tree, nodes: list[int], splits: list[int]) -> np.ndarray:
    """Number, sum and sum of squares of what is left to learn, by node, input and bin: (nodes, inputs, bins, 3)."""
    width = max(splits) + 1
    groups = input_groups(splits)
    shapes = [[splits[of] + 1 for of in some] for some in groups]
    sizes = [int(np.prod(shape)) for shape in shapes]
    both = [np.zeros((3, len(nodes) * size)) for size in sizes]
    each = np.zeros((len(splits), 3, (len(nodes) + 1) * width))  # one node more for other rows
    slot = np.full(2 * max(nodes) + 2, len(nodes), np.intp)
    slot[nodes] = np.arange(len(nodes))
    for bins, signs, scores in chunks:
        at = slot[places(bins, tree)]
        if len(signs) >= PAIRED_ROWS and len(bins) > 1:
            here = np.flatnonzero(at < len(nodes))
            if len(here) < len(at):
                bins, signs, at = bins.take(here, axis=1), signs[here], at[here]
                scores = None if scores is None else scores[here]
            left = left_to_learn(signs, scores)
            weights = None, left, left * left
            for some, shape, size, totals in zip(groups, shapes, sizes, both):
                code = bins[some[0]].astype(np.min_scalar_type(size))
                for of, more in zip(some[1:], shape[1:]):
                    code *= code.dtype.type(more)
                    code += bins[of].astype(code.dtype)
                cells = at * size
                cells += code
                _count(totals, cells, weights)
            continue
        left = left_to_learn(signs, scores)
        weights = None, left, left * left
        for of in range(len(bins)):
            _count(each[of], at * width + bins[of], weights)
    each = each.reshape(len(splits), 3, len(nodes) + 1, width)[:, :, :-1].transpose(2, 0, 3, 1).copy()
    for some, shape, totals in zip(groups, shapes, both):
        totals = totals.reshape(3, len(nodes), *shape)
        for i, of in enumerate(some):
            rest = tuple(2 + k for k in range(len(some)) if k != i)
            each[:, of, : shape[i]] += totals.sum(axis=rest).transpose(1, 2, 0)
    return each


def _count(totals: np.ndarray, cells: np.ndarray, weights: tuple) -> None:
    for total, weight in zip(totals, weights):
        total += np.bincount(cells, weight, total.size)


def _impurity(stats: np.ndarray) -> np.ndarray:
    n, total, squares = np.moveaxis(stats, -1, 0)
    n = np.maximum(n, 1.0)  # of no rows the sums are 0
    return (squares - total * total / n) / n


# --- trees -------------------------------------------------------------------------


def boost(chunks: RDD, splits: list[int], estimator: GBTClassifier) -> list[Tree]:
    """All trees, one after the other; ``splits``: how many candidates each input has."""
    spark, trees, kept = SparkSession.active(), [], []
    for number in range(estimator.getMaxIter()):
        tree = Tree()
        nodes, known = [1], {}
        for level in range(max(estimator.getMaxDepth(), 1)):
            stats = _stats(chunks, tree, nodes, splits, known)
            known = dict(zip(nodes, stats))
            if level == 0:
                kept.append(chunks)
                for old in kept[:-1]:  # the pass has made the new ones
                    old.unpersist()
                if chunks.getCheckpointFile():
                    for old in kept[:-1]:
                        if old.getCheckpointFile():
                            delete(spark, old.getCheckpointFile())
                    kept = kept[-1:]
            nodes = _split(tree, nodes, stats, splits, level, estimator)
            if not nodes:
                break
        trees.append(tree)
        weight = estimator.getStepSize() if number else 1.0
        chunks = chunks.map(lambda chunk, tree=tree, weight=weight: advanced(chunk, tree, weight)).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % estimator.getCheckpointInterval() == 0:
            chunks.checkpoint()
    for old in kept:
        old.unpersist()
        if old.getCheckpointFile():
            delete(spark, old.getCheckpointFile())
    return trees


def _stats(chunks: RDD, tree: Tree, nodes: list[int], splits: list[int], known: dict[int, np.ndarray]) -> np.ndarray:
    """What a pass counts for the nodes; of two siblings in a large table the larger is their parent's, which is ``known``, less the smaller."""
    larger = set()
    if tree.stats and tree.stats[1][0] >= PAIRED_ROWS:
        larger = {max(n, n ^ 1, key=lambda k: (tree.stats[k][0], k)) for n in nodes if n ^ 1 in nodes}
    to_count = [n for n in nodes if n not in larger]
    found = dict(zip(to_count, _pass(chunks, tree, to_count, splits)))
    for node in larger:
        rest = known[node // 2] - found[node ^ 1]
        rest[rest[..., 0] == 0] = 0  # no rows: nothing is left of rounding either, so that equal splits stay equal
        found[node] = rest
    return np.stack([found[n] for n in nodes])


def _pass(chunks: RDD, tree: Tree, nodes: list[int], splits: list[int]) -> np.ndarray:
    parts = chunks.mapPartitions(lambda some: [counted(some, tree, nodes, splits)])
    return parts.treeReduce(np.add, 1 if parts.getNumPartitions() <= MOST_PARTS else 2)


def _split(tree: Tree, nodes: list[int], stats: np.ndarray, splits: list[int], level: int, estimator: GBTClassifier) -> list[int]:
    """Split the nodes where it gains most, and return those of their children that may be split further."""
    left = stats.cumsum(axis=2)
    whole = left[:, :, -1:]
    if level == 0:
        tree.stats[1] = whole[0, 0, 0]
        tree.impurity[1] = float(_impurity(whole[0, 0, 0]))
    left, right = left[:, :, :-1], whole - left[:, :, :-1]
    rows_left, rows_right, rows = left[..., 0], right[..., 0], whole[..., 0]
    now = np.array([tree.impurity[n] for n in nodes])[:, None, None]
    gains = now - rows_left / rows * _impurity(left) - rows_right / rows * _impurity(right)
    allowed = np.arange(left.shape[2]) < np.array(splits)[:, None]
    allowed = allowed & (np.minimum(rows_left, rows_right) >= estimator.getMinInstancesPerNode()) & (gains >= estimator.getMinInfoGain())
    gains = np.where(allowed, gains, -np.inf).reshape(len(nodes), -1)
    more = []
    for i, node in enumerate(nodes):
        if not gains.shape[1] or level >= estimator.getMaxDepth():
            continue
        best = int(gains[i].argmax())  # the first of equals
        if not gains[i, best] > 0:
            continue
        of, last = divmod(best, left.shape[2])
        tree.splits[node] = of, last, float(gains[i, best])
        for child, side in ((2 * node, left), (2 * node + 1, right)):
            tree.stats[child] = side[i, of, last]
            tree.impurity[child] = float(_impurity(side[i, of, last]))
            if level + 1 < estimator.getMaxDepth() and abs(tree.impurity[child]) >= EPSILON:
                more.append(child)
    return more


# --- the model -----------------------------------------------------------------------


def _stored(tree: Tree, thresholds: list[np.ndarray]) -> list[tuple]:
    """The nodes in the order and form in which Spark stores them; leaves of one parent that say the same are one."""

    def below(node: int) -> bool:
        """Whether the node stays split."""
        if node not in tree.splits:
            return False
        left, right = 2 * node, 2 * node + 1
        split = [below(left), below(right)]
        if any(split) or tree.value(left) != tree.value(right):
            return True
        del tree.splits[node]
        return False

    def store(node: int) -> int:
        at = len(out)
        stats = tree.stats[node]
        begin = (at, tree.value(node), tree.impurity[node], stats.tolist(), int(stats[0]))
        out.append(())
        if node in tree.splits:
            of, last, gain = tree.splits[node]
            left, right = store(2 * node), store(2 * node + 1)
            out[at] = (*begin, gain, left, right, (of, [float(thresholds[of][last])], -1))
        else:
            out[at] = (*begin, -1.0, -1, -1, (-1, [], -1))
        return at

    out: list[tuple] = []
    below(1)
    store(1)
    return out


def _loaded(spark: SparkSession, estimator: GBTClassifier, trees: list[Tree], thresholds: list[np.ndarray]) -> GBTClassificationModel:
    path = workspace(spark, "trained")
    given = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.isSet(p)}
    usual = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.hasDefault(p) and not estimator.isSet(p)}

    def about(kind: str, uid: str, without: tuple[str, ...] = (), **more) -> str:
        params = [{k: v for k, v in some.items() if k not in without} for some in (given, usual)]
        named = {"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
        return json.dumps(named | {"paramMap": params[0], "defaultParamMap": params[1]} | more)

    whole = about("classification.GBTClassificationModel", estimator.uid, numFeatures=len(thresholds), numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    boosting = (
        "featureSubsetStrategy", "lossType", "maxIter", "probabilityCol", "rawPredictionCol", "stepSize", "subsamplingRate",
        "thresholds", "validationIndicatorCol", "validationTol",
    )
    one = [about("regression.DecisionTreeRegressionModel", f"{estimator.uid}_{i}", boosting) for i in range(len(trees))]
    weights = [estimator.getStepSize() if i else 1.0 for i in range(len(trees))]
    spark.createDataFrame([*zip(range(len(trees)), one, weights)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    nodes = [(i, node) for i, tree in enumerate(trees) for node in _stored(tree, thresholds)]
    spark.createDataFrame(nodes, _NODES).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
