"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of anything but space and the ASCII white space controls.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay, unlike lower()."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words_of(text: Column) -> Column:
    """Array of words; empty for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def packed(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs meets one that an operator adds."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("_row")


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns again, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in docs.columns]


def doc_hash_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    return to_arrow_schema(StructType.fromDDL(schema))


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str
) -> DataFrame:
    """Column lists in, column lists out, one Arrow batch at a time.

    make() runs once per task and returns the function for its batches.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(batch.to_pydict())
            yield pa.RecordBatch.from_pydict({n: out[n] for n in arrow.names}, schema=arrow)

    return df.mapInArrow(run, schema)


def span_digests(df: DataFrame, kinds: list[str], base: list[str], passing: list[str]) -> DataFrame:
    """n_<kind> for base kinds, base_sha256 and spans from an array of spans.

    `spans` holds structs (kind, start, end, ...), in code points, end exclusive.
    """
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    ordered = F.transform(
        F.array_sort(
            F.transform(
                "spans",
                lambda s: F.struct(
                    s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")
                ),
            )
        ),
        lambda s: F.struct(
            s["kind"].alias("kind"),
            F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("label"),
        ),
    )
    out = df.withColumn("_o", ordered)
    joined = F.array_join(F.transform("_o", lambda s: s["label"]), ",")
    of_base = F.array_join(F.transform(F.filter("_o", lambda s: s["kind"].isin(base)), lambda s: s["label"]), ",")
    count = lambda kind: F.size(F.filter("_o", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in base]
    return out.select(*passing, *counts, F.sha2(of_base, 256).alias("base_sha256"), joined.alias("spans"))
