"""A table that only ever gets rows with new keys, stored in groups with an index of their keys.

Every load adds groups, ranges of keys of like size. The index has a row per group: its least and greatest key, and a Bloom
filter over its keys, cut into PARTS by the key's hash. A load asks the index first: a key outside a group's range isn't there, and
most keys inside are ruled out by the filter. Only groups with a candidate are read, two columns of them, and an exact anti join settles
those candidates. So one old key that is sent again costs the group it lies in, not the whole table.

A load belongs to a run number: a run that is repeated replaces its own groups and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.quality import first_per_key
from riskloom.session import materialise, temporary
from riskloom.sources.tables import exists, runs

#: Keys of one group, bits of the filter per key, bits set per key, parts of a filter.
GROUP_KEYS = 1_000_000
BITS = 12
HASHES = 7
PARTS = 16
CHUNKS = 64
INDEX = "run long, group string, part int, low long, high long, n long, filter binary"


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers for each key (double hashing)."""
    mixed = keys.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    at = (mixed & np.uint64(0xFFFFFFFF))[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return at % np.uint64(bits)


def make_filter(keys: np.ndarray) -> bytes:
    bits = max(64, BITS * len(keys))
    marks = np.zeros(bits, np.uint8)
    marks[_places(keys, bits).ravel()] = 1
    return np.array([bits], "<u8").tobytes() + np.packbits(marks, bitorder="little").tobytes()


def may_have(data: bytes, keys: np.ndarray) -> np.ndarray:
    """False: certainly not there."""
    bits = int(np.frombuffer(data, "<u8", 1)[0])
    marks = np.frombuffer(data, np.uint8, offset=8)
    at = _places(keys, bits)
    return ((marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _part(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


class KeyedTable:
    """Folders ``rows/run=/group=`` and ``index/run=`` below one path; ``key`` is a long."""

    def __init__(self, spark: SparkSession, path: str, key: str = "transactionid") -> None:
        self.spark, self.path, self.key = spark, path, key

    def read(self) -> DataFrame:
        """All rows of the finished runs, which are those in the index."""
        rows = self.spark.read.option("basePath", f"{self.path}/rows")
        done = [f"{self.path}/rows/run={n}" for n in runs(self.spark, f"{self.path}/index")]
        return rows.parquet(*[d for d in done if exists(self.spark, d)]).drop("run", "group")

    def index(self, before: int | None = None) -> DataFrame:
        """Index rows of the runs before a number, or of all."""
        if not exists(self.spark, f"{self.path}/index"):
            return self.spark.createDataFrame([], INDEX)
        rows = self.spark.read.schema(INDEX).parquet(f"{self.path}/index")
        return rows if before is None else rows.filter(F.col("run") < before)

    def candidates(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """(key, run, group) where the key may be stored, for distinct ``keys``.

        Keys meet ranges in cells as wide as a range is on average, of which all groups together have two per
        group at most. A filter meets the keys of its group and part in CHUNKS rows, so no task holds all keys of a group.
        """
        index = self.index(before)
        ranges = index.filter("part = 0").select("run", "group", "low", "high")
        width = int(ranges.agg(F.avg(F.col("high").cast("double") - F.col("low") + 1)).first()[0] or 1)
        cell = lambda c: F.floor(F.col(c) / width)
        ranges = ranges.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
        narrow = keys.select(F.col(self.key).alias("k")).withColumn("cell", cell("k"))
        near = narrow.join(ranges, "cell").filter(F.col("k").between(F.col("low"), F.col("high")))
        near = near.select("k", "run", "group", _part("k").alias("part"))
        filters = index.select("run", "group", "part", "filter")
        gathered = near.withColumn("chunk", F.pmod(F.hash("k"), F.lit(CHUNKS))).groupBy("run", "group", "part", "chunk")
        gathered = gathered.agg(F.collect_list("k").alias("ks"))
        schema = "k long, run long, group string"
        arrow = pa.schema([("k", pa.int64()), ("run", pa.int64()), ("group", pa.string())])

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    run, group, ks, data = (batch.column(c)[at].as_py() for c in ("run", "group", "ks", "filter"))
                    asked = np.array(ks, np.int64)
                    found = asked[may_have(data, asked)]
                    columns = [pa.array(found), pa.array([run] * len(found), pa.int64()), pa.array([group] * len(found), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return gathered.join(filters, ["run", "group", "part"]).mapInArrow(test, schema)

    def groups_to_read(self, candidates: DataFrame) -> list[str]:
        """Folders of the groups that hold a candidate."""
        found = candidates.select("run", "group").distinct().collect()  # some of the index' groups
        return [f"{self.path}/rows/run={r.run}/group={r.group}" for r in found]

    def unknown(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of distinct ``keys`` that are not stored; exact."""
        candidates = materialise(self.candidates(keys, before), "candidates")
        folders = self.groups_to_read(candidates)
        if not folders:
            return keys
        stored = self.spark.read.parquet(*folders).select(F.col(self.key).alias("k"))
        known = candidates.select("k").distinct().join(stored, "k", "left_semi")
        return keys.join(known, keys[self.key] == known["k"], "left_anti")

    def load(self, incoming: DataFrame, run: int, order: str = "ingest_order", defaults: dict | None = None) -> None:
        """Store the rows with new keys, of each the first by ``order``. A row without a key is no row of a keyed table."""
        with temporary(self.spark):
            named = incoming.filter(F.col(self.key).isNotNull())
            first = materialise(first_per_key(named, self.key, order), "first-keys")
            new = self.unknown(first.select(self.key), run)
            new = first.join(new, self.key, "left_semi")
            rows = incoming.join(new, [self.key, order], "left_semi").drop(order)
            for name, value in (defaults or {}).items():
                if name not in rows.columns:
                    rows = rows.withColumn(name, F.lit(value))
            self._store(materialise(rows, "new-rows"), run)

    def _store(self, rows: DataFrame, run: int) -> None:
        """Ranges of keys as groups, then their index rows; a run without an index row was not finished and is not seen."""
        groups = max(1, -(-rows.count() // GROUP_KEYS))
        placed = rows.repartitionByRange(groups, self.key).withColumn("group", F.format_string("g%06d", F.spark_partition_id()))
        placed.write.mode("overwrite").partitionBy("group").parquet(f"{self.path}/rows/run={run}")
        stored = self.spark.read.parquet(f"{self.path}/rows/run={run}") if rows.take(1) else placed
        keys = stored.select(F.col(self.key).alias("k"), "group", _part(self.key).alias("part"))
        span = keys.groupBy("group").agg(F.min("k").alias("low"), F.max("k").alias("high"))
        parts = span.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        held = keys.groupBy("group", "part").agg(F.collect_list("k").alias("ks"))
        schema = "group string, part int, low long, high long, n long, filter binary"
        arrow = pa.schema(
            [("group", pa.string()), ("part", pa.int32()), *[(c, pa.int64()) for c in ("low", "high", "n")], ("filter", pa.binary())]
        )

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ks = np.array(row.pop("ks") or [], np.int64)
                    yield pa.RecordBatch.from_pylist([row | {"n": len(ks), "filter": make_filter(ks)}], schema=arrow)

        index = parts.join(held, ["group", "part"], "left").mapInArrow(make, schema)
        index.write.mode("overwrite").parquet(f"{self.path}/index/run={run}")
