"""Document quality from a linear-chain conditional random field over lines.

Every line gets the features of its characters and words, and those of the lines before
and after. The field labels lines good or bad; forward-backward marginals, weighted by
length, add up to the document's quality, which a two-parameter logistic calibrates. Lines carry
no labels of their own, so training gives each the label of its document.

The field is fitted on at most TRAIN_DOCUMENTS labelled documents, those with the
least hashed ids; features are computed by Spark, the fit of some fifty weights is
done on the driver. Scoring reads every whole text.

A null or empty text is one empty line. Repeated rows are scored alike; repeated labels
of a document count as their least; null labels and ids are not learned from. Without any labelled
document every score is 0.5. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_hash_mod, map_rows

TRAIN_DOCUMENTS = 6000
HELD_OUT_OF, HELD_OUT = 4, 2
GOOD = 0.7
ROUNDS, RATE, DECAY = 300, 0.05, 1e-3
#: Characters analysed at once.
SLICE = 1 << 21
#: Character classes: line feed and space, then the groups below, other letters, rest.
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"-()", "!", "|", "#*$%&<>@^~=_+/\\{}[]")
SPACE, LOWER, UPPER, OTHER_LOWER, OTHER_UPPER, REST = 0, 1, 2, 8, 9, 10
N_CLASSES = 11
N_FEATURES = N_CLASSES + 5


def _class_table() -> np.ndarray:
    table = np.full(0x10000, REST, np.uint8)
    for code in range(0x80, 0x10000):
        char = chr(code)
        if char.isalpha():
            table[code] = OTHER_UPPER if char.isupper() else OTHER_LOWER
        elif char.isspace():
            table[code] = SPACE
    table[[32, *range(9, 14)]] = SPACE
    for number, group in enumerate(GROUPS, 1):
        table[[ord(c) for c in group]] = number
    return table


_TABLE = _class_table()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, N_FEATURES), lengths of lines, lines per text."""
    features, lengths, counts = [], [], []
    at = 0
    while at < len(texts):
        part, chars = [], 0
        while at < len(texts) and (not part or chars < SLICE):
            part.append(texts[at] or "")
            chars += len(part[-1])
            at += 1
        lines = [t.split("\n") for t in part]
        counts += map(len, lines)
        flat = [line for each in lines for line in each]
        codes = np.frombuffer("\n".join([*flat, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = _TABLE[np.minimum(codes, 0xFFFF)]
        size = np.array([len(line) for line in flat], np.int64)
        starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        of_class = np.stack([np.add.reduceat(classes == k, starts, dtype=np.int64) for k in range(N_CLASSES)], axis=1)
        of_class[:, SPACE] -= 1  # the line feed
        words = [line.split() for line in flat]
        n_words = np.array([len(w) for w in words])
        distinct = np.array([len(set(w)) for w in words])
        n = np.maximum(size, 1)
        ends = np.array([line.rstrip()[-1:] in (".", "?", "!", ":", '"') for line in flat])
        rest = [np.log1p(n_words), distinct / np.maximum(n_words, 1), size / np.maximum(n_words, 1) / 10.0, ends, n_words == 0]
        features.append(np.column_stack([of_class / n[:, None], *rest]))
        lengths.append(size)
    if not counts:
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(features), np.concatenate(lengths), np.array(counts, np.int64)


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the lines before and after, first, last, and one."""
    starts = np.cumsum(counts) - counts
    first, last = np.zeros(len(features), bool), np.zeros(len(features), bool)
    first[starts], last[starts + counts - 1] = True, True
    before = np.where(first[:, None], 0.0, np.roll(features, 1, axis=0))
    after = np.where(last[:, None], 0.0, np.roll(features, -1, axis=0))
    return np.column_stack([features, before, after, first, last, np.ones(len(features))])


def padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences one below the other, as rows; and which places hold values."""
    held = np.arange(counts.max()) < counts[:, None]
    out = np.zeros(held.shape)
    out[held] = values
    return out, held


def forward_backward(unary: np.ndarray, held: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 (n, t), and of label pairs summed over places (2, 2).

    unary: score of label 1 over label 0; moves: scores of label pairs.
    """
    n, steps = unary.shape
    score = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha = np.empty((n, steps, 2))
    beta = np.zeros((n, steps, 2))
    alpha[:, 0] = score[:, 0]
    for t in range(1, steps):
        go = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + score[:, t]
        alpha[:, t] = np.where(held[:, t, None], go, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        after = score[:, t + 1] + beta[:, t + 1]
        go = np.logaddexp(after[:, :1] + moves[:, 0], after[:, 1:] + moves[:, 1])
        beta[:, t] = np.where(held[:, t + 1, None], go, 0.0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    ones = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total[:, None], 0.0))
    pairs = np.zeros((2, 2))
    if steps > 1:
        both = held[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                x = alpha[:, :-1, i] + moves[i, j] + score[:, 1:, j] + beta[:, 1:, j] - total[:, None]
                pairs[i, j] = np.exp(np.minimum(x[both], 0.0)).sum()
    return ones, pairs


def length_groups(counts: np.ndarray) -> list[np.ndarray]:
    """Texts of like length together, so that padding at most doubles the work."""
    size = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    return [np.flatnonzero(size == s) for s in np.unique(size)]


def _lines_of(texts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    return np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in texts])


def marginal_means(model: dict, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, for each text."""
    if not len(counts):
        return np.zeros(0)
    wide = with_neighbours((features - model["mean"]) / model["scale"], counts)
    unary = wide @ model["weights"]
    out = np.empty(len(counts))
    for texts in length_groups(counts):
        rows = _lines_of(texts, counts)
        u, held = padded(unary[rows], counts[texts])
        w, _ = padded(np.maximum(lengths[rows], 1), counts[texts])
        ones, _ = forward_backward(u, held, model["moves"])
        out[texts] = (ones * w * held).sum(axis=1) / w.sum(axis=1)
    return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict | None:
    """Weights, moves and calibration by gradient ascent (Adam) on the regularised likelihood."""
    if not len(counts):
        return None
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    wide = with_neighbours((features - mean) / scale, counts)
    groups = [(t, _lines_of(t, counts)) for t in length_groups(counts)]
    stay = np.array([((counts - 1) * (labels == v)).sum() for v in (0, 1)], float)
    truth = np.repeat(labels, counts)
    theta = np.zeros(wide.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        unary = wide @ weights
        miss, expected = np.empty(len(wide)), np.zeros((2, 2))
        for texts, rows in groups:
            u, held = padded(unary[rows], counts[texts])
            ones, pairs = forward_backward(u, held, moves)
            miss[rows] = truth[rows] - ones[held]
            expected += pairs
        gradient = np.concatenate([wide.T @ miss, (np.diag(stay) - expected).ravel()]) / len(wide) - DECAY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "weights": theta[:-4], "moves": theta[-4:].reshape(2, 2)}
    x = np.column_stack([logit(marginal_means(model, features, lengths, counts)), np.ones(len(counts))])
    line = np.array([1.0, 0.0])
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ line))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        line += np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * (line - [1.0, 0.0]))
    return model | {"line": line}


def scores(model: dict | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    means = marginal_means(model, *line_features(texts))
    return 1 / (1 + np.exp(-(logit(means) * model["line"][0] + model["line"][1])))


def held_out(doc_id: Column) -> Column:
    return doc_hash_mod(doc_id, HELD_OUT_OF) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> dict | None:
    """Fitted on at most `most` documents; the labels given are all that may be learned from."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "_labelled")
    docs = docs.select("doc_id", "text")
    chosen = docs.join(F.broadcast(sample), docs["doc_id"] == sample["_labelled"]).select("doc_id", "text", "_label")

    def make():
        def work(batch: dict[str, list]) -> dict[str, list]:
            features, lengths, counts = line_features(batch["text"])
            cut = np.cumsum(counts)[:-1] if len(counts) else []
            return {
                "doc_id": batch["doc_id"],
                "label": batch["_label"],
                "features": [x.ravel().tolist() for x in np.split(features, cut)] if len(counts) else [],
                "lengths": [x.tolist() for x in np.split(lengths, cut)] if len(counts) else [],
            }

        return work

    found = map_rows(chosen, make, "doc_id long, label int, features array<float>, lengths array<long>").toPandas()
    if not len(found):
        return None
    found = found.sort_values("doc_id", kind="stable")
    lengths = [np.asarray(x) for x in found["lengths"]]
    features = np.concatenate([np.asarray(x, float) for x in found["features"]]).reshape(-1, N_FEATURES)
    counts = np.array([len(x) for x in lengths])
    return fit(features, np.concatenate(lengths), counts, found["label"].to_numpy(float))


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score of every row, from its text only."""

    def make():
        return lambda batch: {"doc_id": batch["doc_id"], "score": scores(model, batch["text"]).tolist()}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double")


def judge_documents(docs: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; held-out labels are not learned from."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    found = score_documents(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted")
    )
