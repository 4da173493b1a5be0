"""Live scoring of arriving transactions with Structured Streaming.

Every arrival is stored, computed, scored and logged once: of an id that comes several times the first row
counts, as it does in a load. What happened before an arrival comes from keyed state (``columns.py``), which starts from a stored history and lives in the engine's
state store with the query's checkpoint. What is left for a micro-batch is to put an arrival's two places, its
customer's and its domain's, together with the totals of earlier slices, and to derive the features from them
as the batch job does.

A row older than what its customer or domain has shown in earlier micro-batches is marked late. Its features are those of
all rows known by then, like those of any other row, and it counts in the past of every later row.

Tables are written by micro-batch number, so a micro-batch that is run again overwrites its own folders and changes
nothing else; no micro-batch reads what others have written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.features import INPUTS, OUTPUTS, derive_features, prepare, with_identity
from riskloom.operators.flagging import DECISION_THRESHOLD, flag, is_flagged
from riskloom.operators.lookup import one_per_id
from riskloom.operators.slices import NO_TIME
from riskloom.schemas import PROBABILITY
from riskloom.session import materialise, temporary
from riskloom.streaming.columns import placed
from riskloom.streaming.state import ARRIVING, first_states

# Columns that need the past.
PAST = [
    "uid_avg_amt_before_this", "uid_txn_count_before_this", "seconds_since_last_txn",
    "email_txn_count_before_this", "no_identity_high_velocity",
]
SCORE_COLUMNS = ["transactionid", "transactiondt", "transactionamt", "score"]
STATES = ("seen", "slices", "totals")


@dataclass(frozen=True)
class LiveTables:
    """Where a live job keeps its tables, all below one shared folder."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/batch_id={batch_id}")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))


def seed(history: DataFrame, tables: LiveTables) -> None:
    """What the state begins with, from a history of transactions (it may be empty). Call once, before the first start."""
    tables.write(one_per_id(history.select(*INPUTS)), "transactions", -1)
    stored = tables.read(history.sparkSession, "transactions").drop("batch_id")
    for name, rows in first_states(stored).items():
        rows.write.mode("overwrite").parquet(f"{tables.path('first_state')}/{name}")


def _before(parts: DataFrame, kind: str, names: dict[str, str]) -> DataFrame:
    """An arrival's totals for one kind of key."""
    values = {"n": F.col("n"), "cents": F.col("cents"), "last": F.when(F.col("last") > NO_TIME, F.col("last")), "late": F.col("late")}
    return parts.filter(F.col("kind") == kind).select("id", "whole", *[values[v].alias(name) for v, name in names.items()])


def batch_features(parts: DataFrame, identities: DataFrame) -> DataFrame:
    """Features of a micro-batch from what the state steps gave out."""
    customers = _before(
        parts,
        "uid",
        {"n": "uid_txn_count_before_this", "cents": "uid_cents_before_this", "last": "uid_last_dt", "late": "_late_uid"},
    )
    domains = _before(parts, "p_emaildomain", {"n": "email_txn_count_before_this", "late": "_late_email"})
    history = prepare(customers.select("whole.*")).join(customers.drop("whole").withColumnRenamed("id", "transactionid"), "transactionid")
    history = history.join(domains.drop("whole").withColumnRenamed("id", "transactionid"), "transactionid")
    marked = history.withColumn("is_late", F.col("_late_uid") | F.col("_late_email"))
    features = derive_features(with_identity(marked, identities), keep=("is_late",))
    return features.select(*OUTPUTS, "is_late")


def activity(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """One log row per scored arrival, stamped with the processing time."""
    return scored.select(
        "transactionid",
        "transactionamt",
        F.col("score").cast(PROBABILITY).alias("fraud_probability"),
        is_flagged(threshold=threshold).alias("was_flagged"),
        F.current_timestamp().alias("processed_at"),
    )


def store_batch(
    parts: DataFrame,
    batch_id: int,
    identities: DataFrame,
    tables: LiveTables,
    scorer: Callable[[DataFrame], DataFrame] | None,
    threshold: float = DECISION_THRESHOLD,
) -> None:
    """Store, compute, score, log what came through the state steps. Every output belongs to ``batch_id`` alone."""
    spark = parts.sparkSession
    with temporary(spark):
        parts = materialise(parts, "live-batch")  # the state steps run once
        arrived = parts.filter("kind = 'uid'").select("whole.*")
        tables.write(arrived, "transactions", batch_id)
        tables.write(batch_features(parts, identities), "features", batch_id)
    if scorer is not None:
        features = spark.read.parquet(f"{tables.path('features')}/batch_id={batch_id}")
        scored = scorer(features)
        tables.write(scored.select(*SCORE_COLUMNS), "scores", batch_id)
        scored = spark.read.parquet(f"{tables.path('scores')}/batch_id={batch_id}")
        tables.write(activity(scored, threshold), "activity", batch_id)
        cases = flag(scored, threshold).withColumn("flagged_at", F.current_timestamp())
        tables.write(cases, "flagged", batch_id)


def file_place() -> Column:
    """Where a row of a Parquet file source stands: by time of the file, file, and row in it."""
    at = F.unix_micros("_metadata.file_modification_time").cast("string")
    return F.concat(
        F.lpad(at, 20, "0"), F.lit("/"), F.col("_metadata.file_path"), F.lit("/"),
        F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"),
    )


def arrivals_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New transaction files as a stream; ``max_files`` bounds a micro-batch. Column ``place`` orders its rows."""
    reader = spark.readStream.schema(ARRIVING)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).select("*", file_place().alias("place"))


def start(
    stream: DataFrame,
    identities: DataFrame,
    tables: LiveTables,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = DECISION_THRESHOLD,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the live job on a stream of arrivals (with text column ``place``); it resumes from its checkpoint.

    Keyed state needs the RocksDB state store, which is set for the session.
    """
    spark = stream.sparkSession
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    first = {name: spark.read.parquet(f"{tables.path('first_state')}/{name}") for name in STATES}
    if first["seen"].isEmpty():  # with nothing to begin with, the first micro-batch runs like all others
        first = None

    def handle(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, identities, tables, scorer, threshold)

    writer = placed(stream, first).writeStream.foreachBatch(handle).option(
        "checkpointLocation", tables.path("checkpoint")
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": "3 seconds"}
    return writer.trigger(**trigger).start()
