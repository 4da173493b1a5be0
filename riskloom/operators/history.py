"""Stored history of transactions, laid out so that a lookup reads what it needs.

Three tables below one folder:

* ``transactions``, in ranges of ids;
* ``rows``, two narrow rows per transaction, for its customer and for its domain, in folders by kind and time and sorted by
  key and time there;
* ``totals``, number, cents and last time per key and slice of time.

What came before a transaction is the totals of its keys' earlier slices, and the rows of one slice. A lookup
reads the totals of the wanted keys and the rows of the wanted slices; folders without one are not opened, and a key's
other rows are not sorted. How much that is does not depend on how long the history is, but for a short row per
key and slice. More history is appended; totals add up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from riskloom.operators.features import INPUTS, derive_features, prepare, with_identity
from riskloom.operators.slices import NO_TIME, keyed_rows, with_keys
from riskloom.schemas import TRANSACTIONS
from riskloom.session import materialise

#: Seconds of a folder of rows; each holds whole slices.
FOLDER_SECONDS = {"uid": 30 * 86400, "p_emaildomain": 86400}
_SLICE = ["kind", "key", "slice"]


def _folder() -> Column:
    seconds = F.when(F.col("kind") == "uid", FOLDER_SECONDS["uid"]).otherwise(FOLDER_SECONDS["p_emaildomain"])
    return F.floor(F.col("at") / seconds).alias("folder")


@dataclass(frozen=True)
class History:
    spark: SparkSession
    path: str

    def append(self, transactions: DataFrame) -> None:
        """Store more transactions, whose ids are not stored yet."""
        rows = transactions.select(*INPUTS)
        placed = rows.repartitionByRange("transactionid").sortWithinPartitions("transactionid")
        placed.write.mode("append").parquet(f"{self.path}/transactions")
        keyed = keyed_rows(with_keys(rows)).select("*", _folder())
        totals = keyed.groupBy(*_SLICE).agg(
            F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("at").alias("last")
        )
        totals.write.mode("append").parquet(f"{self.path}/totals")
        # Ranges cut a busy hour or key too, so files are of like size.
        order = ["kind", "folder", "key", "at", "id"]
        ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.write.mode("append").partitionBy("kind", "folder").parquet(f"{self.path}/rows")

    def transactions(self) -> DataFrame:
        schema = T.StructType([f for f in TRANSACTIONS.fields if f.name in INPUTS])
        return self.spark.read.schema(schema).parquet(f"{self.path}/transactions").select(*INPUTS)

    def slice_rows(self, slices: DataFrame) -> DataFrame:
        """kind, key, slice, at, id, cents of the stored rows of some distinct slices."""
        folders = slices.select("kind", F.col("folder")).distinct().collect()  # as many as the calendar has
        opened = F.lit(False)
        for kind in FOLDER_SECONDS:
            wanted = [r.folder for r in folders if r.kind == kind]
            opened = opened | ((F.col("kind") == kind) & F.col("folder").isin(wanted))
        schema = "key string, slice long, at long, id long, cents long, kind string, folder long"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows").filter(opened)
        return rows.select(*_SLICE, "at", "id", "cents").join(slices.select(*_SLICE), _SLICE, "left_semi")

    def earlier(self, slices: DataFrame) -> DataFrame:
        """For each of some distinct slices, also such that hold nothing: base_n, base_cents, base_last of the key's earlier ones.

        ``slices`` has what it adds itself in n, cents and last.
        """
        keys = slices.select("kind", "key").distinct()
        stored = self.spark.read.parquet(f"{self.path}/totals").join(keys, ["kind", "key"], "left_semi")
        stored = stored.select(*_SLICE, "n", "cents", "last", F.lit(False).alias("wanted"))
        both = stored.unionByName(slices.select(*_SLICE, "n", "cents", "last", F.lit(True).alias("wanted")))
        each = both.groupBy(*_SLICE).agg(
            F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("last").alias("last"), F.max("wanted").alias("wanted")
        )
        before = Window.partitionBy("kind", "key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        based = {
            "base_n": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "base_cents": F.coalesce(F.sum("cents").over(before), F.lit(0)),
            "base_last": F.coalesce(F.max("last").over(before), F.lit(NO_TIME)),
        }
        return each.withColumns(based).filter("wanted").select(*_SLICE, *based)


def _past(history: History, asked: DataFrame) -> DataFrame:
    """What came before each row of ``asked`` (transactions with a column fresh: whether it is new to the history)."""
    probes = materialise(
        keyed_rows(with_keys(asked.drop("fresh"))).select("*", _folder()).join(
            asked.select(F.col("transactionid").alias("id"), "fresh"), "id"
        ),
        "probes",
    )
    fresh = F.when(F.col("fresh"), 1).otherwise(0)
    slices = probes.groupBy(*_SLICE, "folder").agg(
        F.sum(fresh).alias("n"),
        F.sum(fresh * F.col("cents")).alias("cents"),
        F.max(F.when(F.col("fresh"), F.col("at"))).alias("last"),
    )
    slices = materialise(slices, "wanted-slices")
    stored = history.slice_rows(slices).select("*", F.lit(False).alias("probe"), F.lit(1).alias("one"))
    wanted = probes.select(*_SLICE, "at", "id", (fresh * F.col("cents")).alias("cents"), F.lit(True).alias("probe"), fresh.alias("one"))
    # A probe of a stored row counts nothing itself and stands before it.
    in_order = Window.partitionBy(*_SLICE).orderBy("at", "id", F.desc("probe"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("one") == 1, F.col("at"))
    placed = stored.unionByName(wanted).select(
        *_SLICE,
        "id",
        "probe",
        F.coalesce(F.sum("one").over(before), F.lit(0)).alias("n"),
        F.coalesce(F.sum("cents").over(before), F.lit(0)).alias("cents"),
        F.coalesce(F.max(counted).over(before), F.lit(NO_TIME)).alias("last"),
    )
    joined = placed.filter("probe").join(history.earlier(slices), _SLICE)
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    last = F.greatest("last", "base_last")
    return joined.groupBy(F.col("id").alias("transactionid")).agg(
        of("uid", F.col("n") + F.col("base_n")).alias("uid_txn_count_before_this"),
        of("uid", F.col("cents") + F.col("base_cents")).alias("uid_cents_before_this"),
        of("uid", F.when(last > NO_TIME, last)).alias("uid_last_dt"),
        of("p_emaildomain", F.col("n") + F.col("base_n")).alias("email_txn_count_before_this"),
    )


def _features(history: History, identities: DataFrame, asked: DataFrame) -> DataFrame:
    asked = materialise(asked, "asked")
    rows = prepare(asked).join(_past(history, asked), "transactionid")
    return derive_features(with_identity(rows, identities))


def stored_features(history: History, identities: DataFrame, ids: DataFrame) -> DataFrame:
    """Feature rows of the stored transactions named in ``ids`` (column transactionid)."""
    wanted = ids.select("transactionid").distinct()
    known = history.transactions().join(wanted, "transactionid", "left_semi")
    return _features(history, identities, known.withColumn("fresh", F.lit(False)))


def first_per_id(rows: DataFrame, place: str | None) -> DataFrame:
    """Of rows with one id the one that came first by ``place``; without a place, the least by its values."""
    rest = [c for c in rows.columns if c not in ("transactionid", place)]
    order = [place] if place else []
    least = rows.groupBy("transactionid").agg(F.min(F.struct(*order, *rest)).alias("row"))
    return least.select("transactionid", *[F.col("row")[c].alias(c) for c in rest])


def arrival_features(history: History, identities: DataFrame, arrivals: DataFrame, place: str | None = None) -> DataFrame:
    """Features of transactions that are not stored yet, from what is known of them.

    Columns an arrival lacks are NULL, its label among them. An id that is already stored keeps its stored
    row; of an id sent several times the first counts. Arrivals count in each other's past. Nothing is stored.
    """
    known = [c for c in INPUTS if c in arrivals.columns and c != "isfraud"]
    sent = first_per_id(arrivals.select(*known, *([place] if place else [])), place)
    stored = history.transactions().join(sent.select("transactionid"), "transactionid", "left_semi")
    fresh = sent.join(stored.select("transactionid"), "transactionid", "left_anti").withColumn("fresh", F.lit(True))
    asked = stored.withColumn("fresh", F.lit(False)).unionByName(fresh, allowMissingColumns=True)
    return _features(history, identities, asked)
