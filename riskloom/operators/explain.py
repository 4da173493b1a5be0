"""Why a transaction got its score: contribution of each feature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.model import MISSING
from riskloom.schemas import MODEL_FEATURES
from riskloom.session import workspace

# Words shown for each feature.
DISPLAY_NAMES = {
    "transactionamt": "Transaction Amount",
    "has_identity": "Identity Verification on File",
    "uid_avg_amt_before_this": "Typical Spend for This Customer",
    "uid_txn_count_before_this": "Prior Transaction Count",
    "seconds_since_last_txn": "Time Since Last Purchase",
    "email_txn_count_before_this": "Email Domain Activity Level",
    "account_age_days": "Account Age (Days)",
    "identity_linkage_score": "Linked Addresses/Devices Count",
    "match_flag_count": "Failed Identity Checks",
    "hour_of_day": "Time-of-Day Pattern",
    "day_of_week": "Day-of-Week Pattern",
    "no_identity_high_velocity": "Rapid Transaction with No ID",
    "card1": "Card Reference Number",
}
TOP_REASONS = 5
#: Decisions of one table of contributions, which has a column for each way they can come out.
MOST_DECISIONS = 9
#: Leaves beyond so many bytes of tables are computed row by row, like those with more decisions.
MOST_BYTES = 100_000_000
#: Rows that meet a table at once, and leaves whose contributions are made at once.
TABLE_ROWS = 5_000
LEAVES = 500


def feature_means(features: DataFrame) -> dict[str, float]:
    """Mean model input over all rows (unknown as the model sees it); 13 numbers."""
    row = features.agg(
        *[
            F.avg(F.coalesce(F.col(c).cast("double"), F.lit(MISSING))).alias(c)
            for c in MODEL_FEATURES
        ]
    ).first()
    return row.asDict()


def linear_contributions(
    features: DataFrame, weights: dict[str, float], means: dict[str, float]
) -> DataFrame:
    """Add ``c_<feature>`` = weight * (value - mean) for a linear score."""
    return features.withColumns(
        {
            f"c_{c}": F.lit(weights[c])
            * (F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) - F.lit(means[c]))
            for c in MODEL_FEATURES
        }
    )


def ranked(contributions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per transaction an array of reasons, strongest first, beside columns ``keep``.

    The 13 entries are sorted inside their row, so nothing is shuffled.
    """
    entries = F.array(
        *[
            F.struct(
                (-F.abs(F.col(f"c_{c}"))).alias("by"),
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
                F.col(f"c_{c}").alias("contribution"),
            )
            for c in MODEL_FEATURES
        ]
    )
    return contributions.select("transactionid", *keep, F.array_sort(entries).alias("reasons"))


def reasons(contributions: DataFrame, top: int | None = None) -> DataFrame:
    """One row per transaction and feature, with its rank from 1."""
    array = ranked(contributions)
    if top is not None:
        array = array.withColumn("reasons", F.slice("reasons", 1, top))
    return array.select(
        "transactionid", F.expr("reasons[0].by AS strongest"), F.posexplode("reasons")
    ).select(
        "transactionid",
        (F.col("pos") + 1).alias("rank"),
        "col.feature",
        "col.value",
        "col.contribution",
        (-F.col("strongest")).alias("strongest"),
    )


def reasons_display(long: DataFrame) -> DataFrame:
    """Add the shown name, direction words, and the share of the strongest."""
    names = long.sparkSession.createDataFrame(
        list(DISPLAY_NAMES.items()), "feature string, display_name string"
    )
    # 13 fixed rows.
    return long.join(F.broadcast(names), "feature", "left").select(
        "transactionid",
        "rank",
        F.coalesce("display_name", "feature").alias("display_name"),
        "value",
        "contribution",
        F.coalesce(
            F.abs("contribution") / F.nullif(F.col("strongest"), F.lit(0.0)), F.lit(0.0)
        ).alias("relative_share"),
        F.when(F.col("contribution") > 0, "toward FRAUD")
        .otherwise("toward normal")
        .alias("direction"),
        F.when(F.col("contribution") > 0, "increases risk")
        .otherwise("decreases risk")
        .alias("effect"),
    )


# --- boosted trees ----------------------------------------------------------


def tree_nodes(model: GBTClassificationModel, spark) -> list[dict]:
    """The model's own node table: as many rows as the model has nodes."""
    path = workspace(spark, "model")
    model.write().save(path)
    weights = model.treeWeights
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    return [
        {
            "tree": r["treeID"],
            "weight": weights[r["treeID"]],
            "id": r["id"],
            "value": r["prediction"],
            "cover": r["rawCount"],
            "left": r["leftChild"],
            "right": r["rightChild"],
            "feature": r["split"]["featureIndex"],
            "threshold": (r["split"]["leftCategoriesOrThreshold"] or [None])[0],
        }
        for r in rows
    ]


def _leaves(nodes: list[dict]):
    """Each leaf as (value, {feature: [low, high, share of rows that stay]})."""
    trees: dict[int, dict[int, dict]] = {}
    for node in nodes:
        trees.setdefault(node["tree"], {})[node["id"]] = node
    for tree in trees.values():
        stack = [(tree[0], {})]
        while stack:
            node, path = stack.pop()
            if node["left"] < 0:
                yield 2.0 * node["weight"] * node["value"], path
                continue
            f, t = node["feature"], node["threshold"]
            for child, low, high in (
                (tree[node["left"]], -np.inf, t),
                (tree[node["right"]], t, np.inf),
            ):
                old = path.get(f, (-np.inf, np.inf, 1.0))
                share = old[2] * child["cover"] / node["cover"]
                stack.append((child, {**path, f: (max(old[0], low), min(old[1], high), share)}))


def leaf_groups(nodes: list[dict]) -> tuple[float, list[tuple]]:
    """Base value, and the leaves by path length m: features, bounds and shares (leaves, m), values."""
    leaves = list(_leaves(nodes))
    base = 0.0
    for value, path in leaves:
        base += value * float(np.prod([b[2] for b in path.values()]))
    return base, _grouped(leaves)


def _grouped(found: list[tuple]) -> list[tuple]:
    by_length = {}
    for value, path in found:
        if path:
            by_length.setdefault(len(path), []).append((list(path), list(path.values()), value))
    groups = []
    for leaves in by_length.values():
        bounds = np.array([b for _, b, _ in leaves])
        groups.append(
            (
                np.array([f for f, _, _ in leaves]),
                *(bounds[:, :, k] for k in range(3)),
                np.array([v for _, _, v in leaves]),
            )
        )
    return groups


def shapley_values(x: np.ndarray, groups: list[tuple]) -> np.ndarray:
    """Contribution of each feature to each row, in log-odds.

    A leaf depends on a row only through which of its path conditions the row meets; a
    feature left out counts with the share of training rows that take its branch. With
    o = 1 where the condition is met and z the share, the Shapley value of feature i is
    value * (o_i - z_i) times the integral over u from 0 to 1 of the product, over the
    other features, of z (1 - u) + o u: a polynomial, so Gauss's points give it exactly.
    """
    out = np.zeros_like(x)
    for used, low, high, share, value in groups:
        leaves, m = used.shape
        place = np.zeros((leaves * m, x.shape[1]))
        place[np.arange(leaves * m), used.ravel()] = 1.0
        rows = max(1, 2_000_000 // (leaves * m))
        for at in range(0, len(x), rows):
            v = x[at : at + rows][:, used]
            gain = _gains(((v > low) & (v <= high)).astype(float), share, value)
            out[at : at + rows] += gain.reshape(len(gain), -1) @ place
    return out


def _gains(met: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The Shapley values above for (rows, leaves, m) conditions that are met (1.0) or not."""
    points, weights = np.polynomial.legendre.leggauss((share.shape[1] + 1) // 2)
    gain = np.zeros_like(met)
    for u, w in zip((points + 1) / 2, weights / 2):
        factor = share * (1 - u) + met * u
        before, after = np.ones_like(met), np.ones_like(met)
        np.cumprod(factor[:, :, :-1], axis=2, out=before[:, :, 1:])
        after[:, :, :-1] = np.cumprod(factor[:, :, :0:-1], axis=2)[:, :, ::-1]
        gain += w * before * after
    return gain * (met - share) * value[:, None]


@dataclass(frozen=True)
class ContributionTables:
    """Shapley values looked up instead of computed for every row.

    What a few leaves contribute depends on a row only through the decisions (feature <= threshold) on their paths.
    Neighbouring leaves share most of these, so they are taken together up to MOST_DECISIONS, and their contributions
    summed for every way the decisions can come out. Leaves with more decisions on their own path, and those of models
    with more leaves than MOST_BYTES of tables hold, stay ``rest``.
    """

    features: np.ndarray
    thresholds: np.ndarray
    #: Numbers of the decisions, features, and contributions (features, outcomes) with the first decision as the lowest bit.
    parts: list[tuple[np.ndarray, list[int], np.ndarray]]
    rest: list[tuple]

    def values(self, x: np.ndarray) -> np.ndarray:
        """Contribution of each feature to each row, as ``shapley_values`` gives them."""
        out = np.zeros((x.shape[1], len(x)))
        for at in range(0, len(x), TABLE_ROWS):
            mine = out[:, at : at + TABLE_ROWS]
            met = (x[at : at + TABLE_ROWS].T[self.features] <= self.thresholds[:, None]).astype(np.uint16)
            for used, of, table in self.parts:
                outcome = np.zeros(mine.shape[1], np.uint16)
                for d in used[::-1]:
                    outcome <<= 1
                    outcome |= met[d]
                outcome = outcome.astype(np.intp)
                for f, contributed in zip(of, table):
                    mine[f] += contributed.take(outcome)
        return out.T + shapley_values(x, self.rest)


def _every_way(share: np.ndarray, value: np.ndarray) -> Iterator[np.ndarray]:
    """For each leaf the contributions of its m features (m, 2^m), for every way its conditions can come out."""
    m = share.shape[1]
    ways = (np.arange(2**m)[:, None] >> np.arange(m) & 1).astype(float)
    for at in range(0, len(value), LEAVES):
        few = slice(at, at + LEAVES)
        yield from _gains(np.repeat(ways[:, None, :], len(value[few]), axis=1), share[few], value[few]).transpose(1, 2, 0)


def contribution_tables(nodes: list[dict]) -> tuple[float, ContributionTables]:
    """Base value and tables of a model."""
    base, groups = leaf_groups(nodes)
    gains = {used.shape[1]: _every_way(share, value) for used, _, _, share, value in groups}
    parts, decisions, held, stored = [], {}, [], 0

    def close() -> None:
        nonlocal stored
        if not held:
            return
        here = list(dict.fromkeys(d for _, ends in held for d in ends))
        come = np.arange(2 ** len(here))[None, :] >> np.arange(len(here))[:, None] & 1
        of = sorted({f for path, _ in held for f in path})
        table = np.zeros((len(of), come.shape[1]))
        for path, _ in held:
            way = np.zeros(come.shape[1], np.intp)
            for k, (f, (low, high, _)) in enumerate(path.items()):
                met = np.ones(come.shape[1], np.intp)
                if low > -np.inf:
                    met &= 1 - come[here.index((f, low))]
                if high < np.inf:
                    met &= come[here.index((f, high))]
                way |= met << k
            for f, gain in zip(path, next(gains[len(path)])):
                table[of.index(f)] += gain[way]
        parts.append((np.array([decisions.setdefault(d, len(decisions)) for d in here]), of, table))
        stored += table.nbytes
        held.clear()

    many: list[tuple] = []
    for value, path in _leaves(nodes):
        ends = [(f, t) for f, (low, high, _) in path.items() for t in (low, high) if np.isfinite(t)]
        if len(ends) > MOST_DECISIONS or stored > MOST_BYTES:
            close()
            many.append((value, path))
            if path and len(path) <= MOST_DECISIONS:
                next(gains[len(path)])
            continue
        if len({d for _, have in held for d in have} | set(ends)) > MOST_DECISIONS:
            close()
        if path:
            held.append((path, ends))
    close()
    features = np.array([f for f, _ in decisions], np.intp)
    thresholds = np.array([t for _, t in decisions], float)
    return base, ContributionTables(features, thresholds, parts, _grouped(many))


def tree_contributions(
    features: DataFrame, model: GBTClassificationModel, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``c_<feature>`` in log-odds, and ``base``; they sum to the score's log-odds.

    Model inputs and the columns ``keep`` stay, so no join back is needed.
    Every batch of rows is handled where it is; only the model's tables, bounded by its
    leaves, travel to the tasks.
    """
    spark = features.sparkSession
    base, tables = contribution_tables(tree_nodes(model, spark))
    shared = spark.sparkContext.broadcast(tables)
    columns = [f"c_{c}" for c in MODEL_FEATURES]
    rows = features.select(
        "transactionid", *keep, *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES]
    )
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    fields += [f"{c} double" for c in columns + ["base"]]

    def contribute(batches):
        for batch in batches:
            out = shared.value.values(batch[MODEL_FEATURES].fillna(MISSING).to_numpy())
            yield pd.concat([batch, pd.DataFrame(out, columns=columns)], axis=1).assign(base=base)

    return rows.mapInPandas(contribute, ", ".join(fields))
