"""Stored tables with foreign keys, from which rows are deleted with all that hangs on them.

A table lies in groups, folders of one range of its key each. A version is a short table of the groups that belong to it. A
delete follows the foreign keys down, writes anew the groups that lose rows and no others, and then
publishes the next version, which names the new groups and all untouched ones. A reader takes one version, the newest whose list
is complete, so it sees every table as before the delete or as after it. Old groups stay until ``forget``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialise, temporary
from riskloom.sources.tables import exists, runs

GROUP_ROWS = 1_000_000


@dataclass(frozen=True)
class Table:
    """Name, key column, and the parent table whose key a column refers to (None: no parent)."""

    name: str
    key: str
    parent: str | None = None
    reference: str | None = None


class Versions:
    """``tables`` stand with parents before children."""

    def __init__(self, spark: SparkSession, path: str, tables: list[Table]) -> None:
        self.spark, self.path, self.tables = spark, path, tables

    def newest(self) -> int:
        """The newest version whose list Spark has committed."""
        return max(v for v in runs(self.spark, f"{self.path}/versions") if exists(self.spark, f"{self._list(v)}/_SUCCESS"))

    def _list(self, version: int) -> str:
        return f"{self.path}/versions/run={version}"

    def groups(self, version: int) -> dict[str, list[str]]:
        """Folders by table; one line per GROUP_ROWS rows."""
        found: dict[str, list[str]] = {t.name: [] for t in self.tables}
        for row in self.spark.read.parquet(self._list(version)).collect():
            found[row.table].append(row.folder)
        return found

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self.groups(self.newest() if version is None else version)[name])

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def _publish(self, groups: dict[str, list[str]], version: int) -> None:
        rows = [(name, folder) for name, folders in groups.items() for folder in folders]
        self.spark.createDataFrame(rows, "table string, folder string").coalesce(1).write.mode("overwrite").parquet(self._list(version))

    def load(self, frames: dict[str, DataFrame]) -> None:
        """Version 0."""
        groups = {}
        for table in self.tables:
            rows = frames[table.name]
            count = max(1, -(-rows.count() // GROUP_ROWS))
            placed = rows.repartitionByRange(count, table.key).withColumn("_group", F.spark_partition_id())
            groups[table.name] = self._write(placed, table.name, 0)
        self._publish(groups, 0)

    def _write(self, rows: DataFrame, name: str, version: int) -> list[str]:
        """Write rows by their column _group; a table that has none left keeps an empty folder with its columns."""
        folder = f"{name}/version={version}"
        target = f"{self.path}/{folder}"
        rows.write.mode("overwrite").partitionBy("_group").parquet(target)
        # The group's number is part of the folder's name, and not a column of the folder.
        found = [r[0] for r in self.spark.read.parquet(target).select("_group").distinct().collect()] if rows.take(1) else []
        if not found:
            rows.drop("_group").limit(0).write.mode("overwrite").parquet(f"{target}/none")
            return [f"{folder}/none"]
        return [f"{folder}/_group={g}" for g in sorted(found)]

    def doomed(self, name: str, keys: DataFrame, groups: dict[str, list[str]]) -> dict[str, DataFrame]:
        """By table the keys of the rows that go: those named, and all that refer to a row that goes."""
        gone: dict[str, DataFrame] = {}
        for table in self.tables:
            if table.name == name:
                gone[name] = materialise(keys.select(table.key).distinct(), "doomed")
            elif table.parent in gone:
                parent = next(t for t in self.tables if t.name == table.parent)
                refers = gone[table.parent].select(F.col(parent.key).alias(table.reference))
                rows = self._read(groups[table.name]).join(refers, table.reference, "left_semi")
                gone[table.name] = materialise(rows.select(table.key).distinct(), "doomed")
        return gone

    def delete(self, name: str, keys: DataFrame, version: int) -> None:
        """Delete the rows of a table with these keys and what hangs on them, as ``version``, one above the version it starts from.

        The same delete again writes the same version once more.
        """
        groups = self.groups(version - 1)
        with temporary(self.spark):
            gone = self.doomed(name, keys, groups)
            for table in [t for t in self.tables if t.name in gone]:
                losing = self._losing(table, gone[table.name], groups[table.name])
                if not losing:
                    continue
                kept = self._read(losing).select("*", _folder_of(self.path)).join(gone[table.name], table.key, "left_anti")
                numbers = {folder: n for n, folder in enumerate(losing)}
                number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("_folder")]
                written = self._write(kept.withColumn("_group", number).drop("_folder"), table.name, version)
                groups[table.name] = [f for f in groups[table.name] if f not in numbers] + written
        self._publish(groups, version)

    def _losing(self, table: Table, gone: DataFrame, folders: list[str]) -> list[str]:
        """Folders with a row that goes; only keys are read."""
        rows = self._read(folders).select(table.key, _folder_of(self.path))
        return sorted(r[0] for r in rows.join(gone, table.key, "left_semi").select("_folder").distinct().collect())

    def forget(self, before: int) -> None:
        """Delete lists of versions below a number, and groups that no later one names."""
        kept = {f for v in runs(self.spark, f"{self.path}/versions") if v >= before for fs in self.groups(v).values() for f in fs}
        old = {f for v in runs(self.spark, f"{self.path}/versions") if v < before for fs in self.groups(v).values() for f in fs}
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        targets = [f"{self.path}/{f}" for f in old - kept]
        targets += [self._list(v) for v in runs(self.spark, f"{self.path}/versions") if v < before]
        for target in targets:
            folder = hadoop(target)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _folder_of(path: str):
    """The group's folder, below the tables' path, from a file's path."""
    root = path.split(":", 1)[-1].lstrip("/")
    below = F.substring_index(F.col("_metadata.file_path"), f"{root}/", -1)
    return F.regexp_replace(below, "/[^/]*$", "").alias("_folder")
