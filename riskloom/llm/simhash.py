"""SimHash near-dedup: fuzzy keys by the Golay code, then exact verification.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to the 23
bits of the perfect Golay code. The keys of a segment are the codewords within four bits
of it: one, or six. Two segments at most two bits apart share such a key: whatever lies
between them is within three bits of some codeword, and so both are within four. Four differing bits
leave at most one of three segments with more than two, so two fingerprints that
link share the keys of at least two segments: the bucket is a pair of segments with a
codeword of each (24 bits).

Equal fingerprints are one node. Within a bucket every node is compared with those not
yet reached (a breadth-first walk), so a dense bucket gives a spanning forest of verified
links instead of all its pairs. A bucket beyond BUCKET nodes is not gathered: its nodes
are linked exactly by joining on the fingerprints two bits away from each, in time linear in its size.

A null text, or one without words, has fingerprint zero and links like any other.
Repeated rows give one row each; a null doc_id is never a component's smallest; a
component of such rows alone has a null component_id. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise

from .common import ASCII_UPPER, map_rows, packed, unpacked
from .components import connected_components

SEED = 42
SHINGLE = 4
MOST_BITS = 4
#: Bits from the top of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Nodes of a bucket that one task may hold: 16 MB. If none of so many link, the walk compares each with each, some 5e11
#: comparisons in one task.
BUCKET = 1_000_000
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())
_SPACE = bytes((32, *range(9, 14)))
_TO_SPACE = bytes.maketrans(_SPACE, b" " * len(_SPACE))


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().translate(_LOWER).translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = max(1, len(words) - SHINGLE + 1)
    stops = ends[min(SHINGLE, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_digest
    data = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops.tolist())])
    return majority(np.frombuffer(data, np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """Big-endian hashes (n, 8 bytes) to one, a block at a time."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes())


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The remainders of the 2^12 data parts, and for each of 2^11 syndromes the error
    patterns of up to four bits that have it: one or six, -1 filled.

    Codewords are data * 2^11 + remainder. For a word with syndrome s, the codewords within
    four bits are the word ^ e for the patterns e of s.
    """
    # Fixed value: the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
    generator = 0b101011100011
    rest = np.zeros(1 << 12, np.int64)
    for data in range(1 << 12):
        left = data << 11
        for bit in range(22, 10, -1):
            if left >> bit & 1:
                left ^= generator << (bit - 11)
        rest[data] = left
    near = np.full((1 << 11, 6), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = rest[e >> 11] ^ (e & 0x7FF)
            near[s, filled[s]] = e
            filled[s] += 1
    return rest, near


def segment_keys(values: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of each segment: (n, 6), -1 filled."""
    rest, near = golay()
    values = values.astype(np.int64)
    errors = near[rest[values >> 11] ^ (values & 0x7FF)]
    return np.where(errors < 0, -1, (values[:, None] ^ errors) >> 11)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket of every fingerprint."""
    keys = [segment_keys((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)) for at, n in SEGMENTS]
    rows, out = [], []
    for number, (i, j) in enumerate(PAIRS):
        pair = (keys[i][:, :, None] << 12 | keys[j][:, None, :]) | number << 24
        fits = (keys[i][:, :, None] >= 0) & (keys[j][:, None, :] >= 0)
        rows.append(np.nonzero(fits)[0])
        out.append(pair[fits])
    return np.concatenate(rows), np.concatenate(out)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long), text_hash."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def work(batch: dict[str, list]) -> dict[str, list]:
            prints = [signed(fingerprint(t)) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "print": prints, "text_hash": batch["text_hash"]}

        return work

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return map_rows(rows, make, "doc_id long, print long, text_hash long")


def _forest(prints: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the verified links among the nodes of one bucket."""
    links, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = np.bitwise_count(prints[rest] ^ prints[at]) <= MOST_BITS
            if close.any():
                reached, rest = rest[close], rest[~close]
                links += [(int(nodes[at]), int(nodes[x])) for x in reached]
                queue += reached.tolist()
    return links


def bucket_links(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in; out: links (a, b), and nodes (key, print, a) of buckets too large to hold."""

    def emit(links: list, key: int | None = None, prints=None, nodes=None) -> pa.RecordBatch:
        n = len(links) if key is None else len(nodes)
        columns = [
            pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key), pa.int64()),
            pa.nulls(n, pa.int64()) if key is None else pa.array(prints.view(np.int64), pa.int64()),
            pa.array([x[0] for x in links] if key is None else nodes, pa.int64()),
            pa.array([x[1] for x in links], pa.int64()) if key is None else pa.nulls(n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["key", "print", "a", "b"])

    def whole(keys, prints, nodes) -> list:
        """Links of complete buckets."""
        bounds = np.flatnonzero(np.diff(keys)) + 1
        starts, stops = np.concatenate(([0], bounds)), np.concatenate((bounds, [len(keys)]))
        links = []
        pairs = starts[stops - starts == 2]  # most shared buckets: compared at once
        close = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= MOST_BITS]
        links += zip(nodes[close].tolist(), nodes[close + 1].tolist())
        for a, b in zip(starts[stops - starts > 2].tolist(), stops[stops - starts > 2].tolist()):
            links += _forest(prints[a:b], nodes[a:b])
        return links

    held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]
    too_large = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        columns[1] = columns[1].view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, columns)]
        if len(held[0]) == 0:
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
        done, held = [x[:cut] for x in held], [x[cut:] for x in held]
        if too_large is not None:  # the rest of a bucket that was given out
            n = int(np.searchsorted(done[0], too_large, "right"))
            if n:
                yield emit([], too_large, done[1][:n], done[2][:n])
            done = [x[n:] for x in done]
            if held[0][0] != too_large:
                too_large = None
        if len(done[0]):
            yield emit(whole(*done))
        if too_large is not None or len(held[0]) > bucket:
            too_large = int(held[0][0])
            yield emit([], too_large, held[1], held[2])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield emit(whole(*held))


def large_bucket_links(members: DataFrame) -> DataFrame:
    """Links (a, b) among members (key, print, a) of large buckets, without pairs: two fingerprints at
    most four bits apart have one at most two bits from both, so each is sent to all those and linked to the least there."""

    def flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = [1 << i for i in range(64)]
        masks = np.array([0, *ones, *[a | b for i, a in enumerate(ones) for b in ones[:i]]], np.uint64)
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            nodes = batch.column(1).to_numpy()
            for at in range(0, len(nodes), 256):
                near = (prints[at : at + 256, None] ^ masks).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.view(np.int64)), pa.array(np.repeat(nodes[at : at + 256], len(masks)))],
                    names=["near", "a"],
                )

    sent = members.select("print", "a").distinct().mapInArrow(flips, "near long, a long")
    least = sent.groupBy("near").agg(F.min("a").alias("b"), F.max("a").alias("c")).filter("b < c")
    return sent.join(least, "near").filter("a <> b").select("a", "b").distinct()


def fingerprint_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all nodes (print, a) whose fingerprints are at most four bits apart."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(ids), 4096):
                rows, keys = bucket_keys(prints[at : at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(prints[at : at + 4096][rows].view(np.int64)), pa.array(ids[at : at + 4096][rows])],
                    names=["key", "print", "a"],
                )

    rows = nodes.select("print", "a").mapInArrow(keyed, "key long, print long, a long")
    rows = rows.repartition("key").sortWithinPartitions("key")
    found = rows.mapInArrow(lambda batches: bucket_links(batches, bucket), "key long, print long, a long, b long")
    found = materialise(found, "simhash-links")
    links = found.filter("key is null").select("a", "b")
    large = found.filter("key is not null")
    return links.union(large_bucket_links(large)).distinct()


def _grouped(docs: DataFrame, bucket: int) -> DataFrame:
    """doc_id, print, text_hash, component (a fingerprint of it), component_id for every row. Nodes are fingerprints, so
    rows that share an id, or have none, carry links like any other."""
    prints = materialise(with_fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("a", F.col("print"))
    components = connected_components(fingerprint_links(nodes.select("print", "a"), bucket))
    nodes = nodes.join(components, nodes["a"] == components["node"], "left")
    nodes = nodes.select("print", "least", F.coalesce("component", "a").alias("component"))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(names, "component").drop("least"), "print")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, print, component_id for every row."""
    return _grouped(docs, bucket).select("doc_id", "print", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: that with the smallest id, once if its row is
    repeated. An id may be the smallest of several groups; several of its texts in one group are told apart by their
    hash, the least stays. Documents without an id can't be named and stay."""
    first = _grouped(docs, BUCKET).filter("doc_id = component_id").groupBy("component").agg(
        F.min("doc_id").alias("_keep"), F.min("text_hash").alias("_text")
    )
    hashed = docs.select(packed(docs), F.col("doc_id").alias("_named"), F.xxhash64("text").alias("_hash"))
    on = (F.col("_named") == F.col("_keep")) & (F.col("_hash") == F.col("_text"))
    kept = hashed.join(first.select("_keep", "_text"), on, "left_semi").dropDuplicates(["_named", "_hash"])
    return kept.select(*unpacked(docs)).union(docs.filter(F.col("doc_id").isNull()))


def near_duplicate_digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
