"""A Merkle manifest of a dataset: aligned blocks of an 8-ary tree in van Emde Boas order.

Every row is a leaf, the SHA-256 of its fields. Leaves of one group (a language) are numbered in the order of their
keys; runs of FAN neighbours are hashed into one node until one is left, the group's subroot, and the subroots in the groups' order
form a tree of the same kind, whose top is the root.

A tree is cut into aligned blocks of HEIGHT levels, FAN ** HEIGHT leaves each. A block is one row: its nodes lie in one
array of digests in van Emde Boas order, that is, the block is split at half height, first the upper subtree, then the lower ones
from left to right, each laid out in the same way. Where a node lies follows from its depth and number alone
(``address``), both when a block is made and when the siblings of a leaf are fetched, and a way from leaf
to top touches few places however large the pages are. The roots of a tier's blocks are the leaves of the next tier.

Spark does the rest: ranges of (group, key, leaf) and counts per range give every leaf its number without one
big sort or task, however many rows a group has; blocks are made by (group, block), so no task holds more than a block; and paths come down from
the top tier by joins of one row per block. Each table is written to the shared folder before it is used, so a lost
executor costs the step it works on.

Any column may be null: a null field is hashed as "-", a null group is a group of its own and comes first, null keys come first. Rows that
share a key are ordered by their leaf; repeated rows have equal leaves side by side, each with its own proof. A null id is not tampered
with in the digests. Empty and very long texts are hashed like others. An empty table has no root and no
proofs. Columns that are not hashed are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise, workspace

from .common import arrow_schema, ascii_lower

FAN = 8
HEIGHT = 4
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Rows of one tier: `total` nodes has the tree there; `nodes` is the block.
BLOCKS = "tree string, block long, total long, n long, nodes binary, top binary"


# --- one block ----------------------------------------------------------------


def tree_size(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def address(depth: int, number: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes with these numbers at one depth (0: the top) of a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(depth, number, upper)
    below = depth - upper
    leaves = FAN**below
    lower = tree_size(levels - upper)
    return tree_size(upper) + number // leaves * lower + address(below, number % leaves, levels - upper)


@lru_cache(maxsize=16)
def addresses(height: int) -> list[np.ndarray]:
    """By depth, of all nodes; the leaves are at depth ``height``."""
    return [address(depth, np.arange(FAN**depth), height + 1) for depth in range(height + 1)]


def height_of(total: int, most: int) -> int:
    """Levels that a block of a tree with ``total`` leaves climbs: all of them, or until one node is left."""
    height = 0
    while height < most and FAN**height < total:
        height += 1
    return height


def counts(n: int, height: int) -> list[int]:
    """Nodes at each depth above n leaves."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def hashed(digests: bytes) -> bytes:
    """H of digests, which are hashed as hexadecimal text."""
    return sha256(digests.hex().encode()).digest()


def block_of(leaves: list[bytes], height: int) -> bytes:
    """All nodes over these leaves, in place; nodes that a short last run leaves out are zero."""
    places, held = addresses(height), counts(len(leaves), height)
    nodes = np.zeros((tree_size(height + 1), SIZE), np.uint8)
    nodes[places[height][: len(leaves)]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, SIZE)
    for depth in range(height, 0, -1):
        level = nodes[places[depth][: held[depth]]].tobytes()
        step = FAN * SIZE
        above = b"".join(hashed(level[i : i + step]) for i in range(0, len(level), step))
        nodes[places[depth - 1][: held[depth - 1]]] = np.frombuffer(above, np.uint8).reshape(-1, SIZE)
    return nodes.tobytes()


class BlockPaths:
    """The siblings of each leaf of a block, from its run up to below the top."""

    def __init__(self, nodes: bytes, n: int, height: int) -> None:
        places, held = addresses(height), counts(n, height)
        table = np.frombuffer(nodes, np.uint8).reshape(-1, SIZE)
        self.levels = [table[places[d][: held[d]]].tobytes() for d in range(height, 0, -1)]

    def path(self, number: int) -> bytes:
        """Per level: place in the run, length of the run, and the others' digests."""
        out = []
        for level in self.levels:
            run, at = divmod(number, FAN)
            digests = level[run * FAN * SIZE : (run + 1) * FAN * SIZE]
            out.append(bytes((at, len(digests) // SIZE)) + digests[: at * SIZE] + digests[(at + 1) * SIZE :])
            number = run
        return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    """Place in the run and the siblings, level by level."""
    at = 0
    while at < len(path):
        end = at + 2 + (path[at + 1] - 1) * SIZE
        yield path[at], path[at + 2 : end]
        at = end


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for place, others in steps(path):
        leaf = hashed(others[: place * SIZE] + leaf + others[place * SIZE :])
    return leaf


# --- trees --------------------------------------------------------------------


def leaf_digest(row: dict[str, Column]) -> Column:
    """H of the fields: "-" for null, else the byte count, ":" and the value."""
    parts = []
    for value in row.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _matched(left: DataFrame, right: DataFrame, *rest: str) -> DataFrame:
    """Join on equal tree (null is a tree too) and other columns, which both sides have."""
    keys = ("tree", *rest)
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    same = F.col("tree").eqNullSafe(F.col("_right_tree"))
    for name in rest:
        same = same & (F.col(name) == F.col(f"_right_{name}"))
    return left.join(right, same).drop(*[f"_right_{c}" for c in keys])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `position`, the place of a row in its `tree` by ``order``, and `total`, the rows of the tree.

    Rows are put in ranges and sorted there; written down, each range counts its rows by tree, and only these
    counts are added up.
    """
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumns({"_at": F.monotonically_increasing_id(), "_range": F.spark_partition_id()})
    ranged = materialise(ranged, "merkle-order")
    ranges = ranged.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "tree",
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(tree).alias("total"),
    )
    placed = _matched(ranged, ranges, "_range")
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("position"), "total")


_BLOCKS_ARROW = pa.schema(
    [("tree", pa.string()), *[(c, pa.int64()) for c in ("block", "total", "n")], ("nodes", pa.binary()), ("top", pa.binary())]
)


def _block(height: int) -> Column:
    return F.floor(F.col("position") / FAN**height)


def build_trees(leaves: DataFrame, folder: str, height: int) -> list[DataFrame]:
    """The tiers of all trees, lowest first, from rows (tree, position, total, digest).

    Rows come to a task sorted by tree, block and position, and a block is made when its last row has come.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        key = None

        def finished() -> dict:
            tree, block, total = key
            nodes = block_of(held, height_of(total, height))
            top = nodes[:SIZE]  # the first place of every layout
            return {"tree": tree, "block": block, "total": total, "n": len(held), "nodes": nodes, "top": top}

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("tree", "block", "total", "digest")]):
                if row[:3] != key:
                    if held:
                        yield pa.RecordBatch.from_pylist([finished()], schema=_BLOCKS_ARROW)
                    key, held = row[:3], []
                held.append(row[3])
        if held:
            yield pa.RecordBatch.from_pylist([finished()], schema=_BLOCKS_ARROW)

    spark = leaves.sparkSession
    size = FAN**height
    most = leaves.agg(F.max("total")).first()[0] or 0
    tiers: list[DataFrame] = []
    while True:
        rows = leaves.select("tree", _block(height).alias("block"), "position", "total", "digest")
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
        path = f"{folder}/tier={len(tiers)}"
        rows.mapInArrow(make, BLOCKS).write.parquet(path)
        tiers.append(spark.read.schema(BLOCKS).parquet(path))
        if most <= size:
            return tiers
        leaves = tiers[-1].filter(F.col("total") > size).select(
            "tree",
            F.col("block").alias("position"),
            F.ceil(F.col("total") / size).alias("total"),
            F.col("top").alias("digest"),
        )
        most = -(-most // size)


def tops(tiers: list[DataFrame], height: int) -> DataFrame:
    """tree, top: of each tree the last block's."""
    found = [t.filter(F.col("total") <= FAN**height).select("tree", "top") for t in tiers]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def _descend(tiers: list[DataFrame], above: DataFrame, height: int) -> tuple[DataFrame, str]:
    """The lowest blocks, each with the path from its top to what is above its tree, and the columns of ``above``.

    ``above`` has a row per tree: tree, path and whatever goes with it. Rows come down tier by tier: a block with its path gives each
    of its leaves, the blocks of the next tier, theirs.
    """
    passing = [c for c in above.columns if c not in ("tree", "path")]
    kinds = "".join(f", {c} {above.schema[c].dataType.simpleString()}" for c in passing)
    schema = "tree string, block long, path binary" + kinds
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths = BlockPaths(row["nodes"], row["n"], height_of(row["total"], height))
                kept = {c: row[c] for c in ("tree", *passing)}
                first = row["block"] * FAN**height
                out = [kept | {"block": first + i, "path": paths.path(i) + row["path"]} for i in range(row["n"])]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    known = None
    for tier in reversed(tiers):
        top = tier.filter(F.col("total") <= FAN**height)
        joined = _matched(top, above)
        if known is not None:
            rest = tier.filter(F.col("total") > FAN**height)
            joined = joined.unionByName(_matched(rest, known, "block"))
        if tier is tiers[0]:
            return joined, kinds
        known = joined.mapInArrow(run, schema)
    raise ValueError("no tiers")


@dataclass(frozen=True)
class Manifest:
    """Tables of a dataset's trees, all below one folder."""

    leaves: DataFrame  # tree, position, total, digest, and the columns given with it
    trees: list[DataFrame]
    groups: DataFrame  # the groups' subroots: group, and tree, position, total, digest of the upper tree
    forest: list[DataFrame]
    height: int

    def root(self) -> DataFrame:
        """One row, or none of an empty dataset."""
        return tops(self.forest, self.height).select("top")


def build_manifest(leaves: DataFrame, order: list[str], folder: str | None = None, height: int = HEIGHT) -> Manifest:
    """Trees over rows (tree: text, digest: 32 bytes, and the columns of ``order``), and a tree over their tops by the tree's name."""
    spark = leaves.sparkSession
    folder = folder or workspace(spark, "merkle")
    numbered(leaves, [*order, "digest"]).write.parquet(f"{folder}/leaves")
    leaves = spark.read.parquet(f"{folder}/leaves")
    trees = build_trees(leaves.select("tree", "position", "total", "digest"), f"{folder}/trees", height)
    subroots = tops(trees, height).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("digest"))
    numbered(subroots, ["group"]).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    forest = build_trees(groups.select("tree", "position", "total", "digest"), f"{folder}/forest", height)
    return Manifest(leaves, trees, groups, forest, height)


def _with_paths(
    rows: DataFrame, tiers: list[DataFrame], above: DataFrame, kept: list[str], height: int
) -> DataFrame:
    """Rows (tree, position, the columns kept) with their path and the columns of ``above``.

    Rows of one block meet its nodes in one row; at most a block's leaves come together if a position is asked for once.
    """
    blocks, kinds = _descend(tiers, above, height)
    asked = rows.groupBy("tree", _block(height).alias("block")).agg(F.collect_list(F.struct("position", *kept)).alias("asked"))
    passing = [c for c in above.columns if c not in ("tree", "path")]
    fields = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    schema = "path binary" + fields + kinds
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                paths = BlockPaths(row["nodes"], row["n"], height_of(row["total"], height))
                shared = {c: row[c] for c in passing}
                first = row["block"] * FAN**height
                out = [
                    {c: leaf[c] for c in kept} | shared | {"path": paths.path(leaf["position"] - first) + row["path"]}
                    for leaf in row["asked"]
                ]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _matched(blocks, asked, "block").mapInArrow(run, schema)


def proofs(manifest: Manifest, wanted: DataFrame, kept: list[str]) -> DataFrame:
    """Path, subroot, root and the columns kept of the leaves in ``wanted``, rows of manifest.leaves with any columns added."""
    no_path = tops(manifest.forest, manifest.height).select("tree", F.lit(b"").alias("path"), F.col("top").alias("root"))
    groups = manifest.groups.withColumn("subroot", F.col("digest"))
    upper = _with_paths(groups, manifest.forest, no_path, ["group", "subroot"], manifest.height)
    above = upper.withColumnRenamed("group", "tree")
    return _with_paths(wanted, manifest.trees, above, kept, manifest.height)


def checked(proved: DataFrame, claim: str, kept: list[str]) -> DataFrame:
    """The columns kept, proof_sha256 (H of all siblings), folded_root (from the claimed leaf and the siblings), verified; digests as text."""
    binary = [c for c in ("subroot", "root", *kept) if proved.schema[c].dataType.typeName() == "binary"]
    names = list(dict.fromkeys(["subroot", "root", *kept]))
    fields = [f"{c} {'string' if c in binary else proved.schema[c].dataType.simpleString()}" for c in names]
    schema = ", ".join([*fields, "proof_sha256 string", "folded_root string", "verified boolean"])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                folded = fold(row[claim], row["path"])
                siblings = b"".join(others for _, others in steps(row["path"]))
                values = {c: row[c].hex() if c in binary else row[c] for c in names}
                proof = hashed(siblings).hex()
                out.append(values | {"proof_sha256": proof, "folded_root": folded.hex(), "verified": folded == row["root"]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return proved.mapInArrow(run, schema)


# --- documents ----------------------------------------------------------------


def document_leaves(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a row of documents, or what it would be with another text."""
    row = {c: docs[c] for c in FIELDS}
    return leaf_digest(row if text is None else row | {"text": text})


def document_manifest(docs: DataFrame, folder: str | None = None, height: int = HEIGHT) -> Manifest:
    """Leaves by language and doc_id. The texts are read here only."""
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long"), document_leaves(docs).alias("digest"))
    return build_manifest(materialise(rows, "merkle-leaves"), ["doc_id"], folder, height)


def tamper_digests(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Each document's proof, and the root that follows when a third of the texts has lost its capitals.

    The leaf that a document claims is written with the true one, so texts are read once.
    """
    lower = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    text = F.when(lower, ascii_lower(docs["text"])).otherwise(docs["text"])
    rows = docs.select(
        F.col("lang").alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        document_leaves(docs).alias("digest"),
        document_leaves(docs, text).alias("claim"),
    )
    manifest = build_manifest(materialise(rows, "merkle-leaves"), ["doc_id"], height=height)
    wanted = manifest.leaves.withColumn("leaf", F.col("digest"))
    proved = proofs(manifest, wanted, ["doc_id", "leaf", "claim"])
    out = checked(proved, "claim", ["doc_id", "leaf", "claim"])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
