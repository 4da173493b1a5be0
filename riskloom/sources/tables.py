"""Reading, loading and publishing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.expressions import day_number
from riskloom.operators.quality import first_per_key
from riskloom.operators.split import first_rows
from riskloom.schemas import IDENTITIES, TRANSACTIONS
from riskloom.session import grown


def read_table(
    spark: SparkSession,
    path: str | None = None,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    **options,
) -> DataFrame:
    """Any Spark source, with an explicit schema where one is given.

    For a database table use ``fmt="jdbc"`` with its url, dbtable and the
    partition options, so that executors read it in parallel.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns matched by header name in any letter case, typed by ``schema``.

    Columns the file lacks are left out and columns the schema lacks are not
    parsed. A value that does not fit its type becomes NULL; ``read_text`` keeps it
    for the table rules.
    """
    text = read_text(spark, path, schema)
    types = {f.name: f.dataType for f in schema.fields}
    return text.select(*[F.col(c).try_cast(types[c]).alias(c) for c in text.columns])


def read_text(
    spark: SparkSession, path: str, schema: T.StructType, order: str | None = None
) -> DataFrame:
    """The schema's columns of a CSV file or folder as text, under lower-case names.

    A folder whose files differ in their header fails with an error that names the
    file: columns are never taken by position from another header. ``order`` adds a
    column that ranks rows by file and place in it.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = {f.name for f in schema.fields}
    text = (
        spark.read.schema(T.StructType([T.StructField(h, T.StringType()) for h in header]))
        .option("enforceSchema", False)
        .csv(path, header=True)
    )
    columns = [F.col(f"`{h}`").alias(h.lower()) for h in header if h.lower() in names]
    if order is not None:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        columns.append(place.alias(order))
    return text.select(*columns)


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", sample_rows: int | None = None
) -> DataFrame:
    """Card transactions; ``sample_rows`` keeps the first rows by id."""
    rows = (
        read_csv(spark, path, TRANSACTIONS)
        if fmt == "csv"
        else read_table(spark, path, TRANSACTIONS, fmt)
    )
    return rows if sample_rows is None else sample_transactions(rows, sample_rows)


def read_identities(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, IDENTITIES)
    return read_table(spark, path, IDENTITIES, fmt)


def sample_transactions(rows: DataFrame, n: int) -> DataFrame:
    return first_rows(rows, ["transactionid"], n)


def sample_identities(identities: DataFrame, sampled: DataFrame) -> DataFrame:
    """Identity rows of the sampled transactions."""
    return identities.join(grown(sampled.select("transactionid")), "transactionid", "left_semi")


def keep_first(rows: DataFrame, key: str = "transactionid", order: str = "ingest_order"):
    """The first row of each key. ``order`` is unique and stored with the rows.

    First keys are settled on a narrow (key, order) table in which copies have
    collapsed; the wide rows then join it on both columns, which no copy shares.
    """
    return rows.join(grown(first_per_key(rows, key, order)), [key, order], "left_semi")


def load_if_absent(
    incoming: DataFrame,
    existing: DataFrame,
    key: str = "transactionid",
    order: str = "ingest_order",
    defaults: dict | None = None,
) -> DataFrame:
    """Rows of ``incoming`` to append: new keys only, the first row of each.

    ``defaults`` fills columns the load does not bring.
    """
    new = first_per_key(incoming, key, order).join(
        grown(existing.select(key).distinct()), key, "left_anti"
    )
    rows = incoming.join(grown(new), [key, order], "left_semi").drop(order)
    for name, value in (defaults or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    return rows


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_target(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A target table; one that nothing was loaded into yet is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_in_time_order(rows: DataFrame, path: str) -> None:
    """Write a transaction or feature table so that time filters skip files.

    Ranges of (time, id) balance the tasks however uneven the days are; the day
    is a partition column, and rows of a file are ordered by time.
    """
    (
        rows.repartitionByRange("transactiondt", "transactionid")
        .sortWithinPartitions("transactiondt", "transactionid")
        .withColumn("day", day_number())
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def write_in_order(rows: DataFrame, path: str, order: list[str]) -> None:
    """Write a table in one global order: files by name, and rows in each file.

    Ranges are of all order columns, so a value of the first one that holds a third of the rows is cut by the
    next ones, and the files are of like size. Nothing is sorted in one task.
    """
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def with_file_position(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a Parquet folder with their place in file order; only one row per file is added up."""
    at = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = spark.read.parquet(path).select("*", *at)
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def publish_refresh(rows: DataFrame, path: str, run: int) -> None:
    """Write a full refresh as run number ``run``; older runs stay as archive. A run
    that is repeated replaces itself only."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs below a folder, found among folder names."""
    if not exists(spark, path):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return [int(n.removeprefix("run=")) for n in names if n.startswith("run=")]


def latest_refresh(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest run; no other run is read."""
    return spark.read.parquet(f"{path}/run={max(runs(spark, path))}")
