"""Token ids as files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents, each followed by an end id. Its file:

    magic | block 0 | block 1 | ... | index | trailer

A block holds BLOCK ids (the last one fewer). The block's minimum is taken off; the rest is packed at the
width that the PERCENTILE of the block's ids needs. Ids that need more keep their low bits in place and
leave position and high bits in the block's exception list. The index names the byte where every block starts,
and of every document its id and the place of its first token, so a slice of a shard is read
without the blocks around it. All numbers are little-endian.

Documents are cut into shards by range of (doc_id, hash of the text), so a third of all rows under one id
still spreads, and one task writes one shard as its rows come, in blocks. Executors may be lost: a task's file has a name
that no other attempt uses, and only files that the manifest names (a Parquet table, committed by Spark when
all tasks are done) are part of the result. Files are written and read through pyarrow's
file systems (file, hdfs, s3, gs, abfs by the folder's scheme).

A null text counts as empty: one id, the end. A null doc_id comes first and stays null. Rows with one doc_id are
ordered by the text's hash, so repeated rows stand side by side, and each has its place. An
empty table gives an empty manifest and no file. Other columns are not read. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from riskloom.operators.prefix import prefix_aggregate, profile_order
from riskloom.session import workspace

from .common import arrow_schema

BLOCK = 1024
#: Share of a block's ids that fit the packed width.
PERCENTILE = 0.95
END_ID = 2
MAGIC = b"PFORIDS1"
#: Blocks packed, and pieces remembered, at a time.
BLOCKS_AT_ONCE = 64
MAX_PIECES = 500_000
#: Texts of these characters are split here, by rules that all Unicode versions share; others by the library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA0\xA1-\xB1\xB4-\xB8\xBA\xBB\xBF-ɏ‐-‧]*")
_LETTERS = r"[A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-ɏ]+"
#: The byte-level pattern over PLAIN characters; what a piece begins with decides, so the commonest kinds stand first.
PIECES = re.compile(rf" ?{_LETTERS}| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

_BLOCK_HEAD = np.dtype([("low", "<u4"), ("count", "<u2"), ("width", "u1"), ("high_bytes", "u1"), ("exceptions", "<u4")])
_TRAILER = np.dtype([("blocks", "<u8"), ("documents", "<u8"), ("ids", "<u8"), ("index_at", "<u8"), ("index_crc", "<u8"), ("magic", "S8")])
MANIFEST = "shard long, file string, n_docs long, n_ids long, n_bytes long"


# --- blocks ------------------------------------------------------------------


def bits_needed(values: np.ndarray) -> np.ndarray:
    """Width of each number; 0 for 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def packed_bits(numbers: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each row's numbers side by side, as bytes. Eight numbers fill ``width`` bytes, each of them always the same ones."""
    rows, count = numbers.shape
    eights = -(-count // 8)
    padded = np.zeros((rows, eights * 8), np.uint64)
    padded[:, :count] = numbers & np.uint32((1 << width) - 1)
    out = np.zeros((rows, eights, width), np.uint8)
    for place in range(8):
        begin, shift = divmod(place * width, 8)
        moved = padded[:, place::8] << np.uint64(shift)
        for n in range((shift + width + 7) // 8):
            out[:, :, begin + n] |= (moved >> np.uint64(8 * n)).astype(np.uint8)
    return out.reshape(rows, -1)[:, : (count * width + 7) // 8]


def unpacked_bits(data: bytes, count: int, width: int) -> np.ndarray:
    """The numbers again: each is cut from the eight bytes that begin with its first bit's."""
    held = np.frombuffer(data + b"\0" * 8, np.uint8)
    at = np.arange(count, dtype=np.int64) * width
    octets = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))[at >> 3]
    return ((octets >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Rows of ids (uint32), each to the bytes of a block."""
    count = ids.shape[1]
    low = ids.min(axis=1)
    rest = ids - low[:, None]
    kth = min(count - 1, int(np.ceil(PERCENTILE * count)) - 1)
    widths = bits_needed(np.partition(rest, kth, axis=1)[:, kth])
    over = rest >> widths.astype(np.uint32)[:, None] if widths.max(initial=0) < 32 else _high_bits(rest, widths)
    packed: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for row, data in zip(rows, packed_bits(rest[rows], int(width))):
            packed[row] = data.tobytes()
    out = []
    for row in range(len(ids)):
        at = np.flatnonzero(over[row])
        high = over[row][at]
        most = int(high.max(initial=0))
        size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
        head = np.array((low[row], count, widths[row], size, len(at)), _BLOCK_HEAD)
        out.append(head.tobytes() + packed[row] + at.astype("<u2").tobytes() + high.astype(f"<u{size}").tobytes())
    return out


def _high_bits(rest: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """A shift by all 32 bits is no shift for the processor, so such widths go through longer numbers."""
    return (rest.astype(np.uint64) >> widths.astype(np.uint64)[:, None]).astype(np.uint32)


def unpack_block(data: bytes) -> np.ndarray:
    """The ids of a block, as uint32."""
    low, count, width, high_bytes, exceptions = np.frombuffer(data, _BLOCK_HEAD, 1)[0].item()
    begin = _BLOCK_HEAD.itemsize
    at = begin + (count * width + 7) // 8
    rest = unpacked_bits(data[begin:at], count, width)
    if exceptions:
        where = np.frombuffer(data, "<u2", exceptions, at)
        high = np.frombuffer(data, f"<u{high_bytes}", exceptions, at + 2 * exceptions).astype(np.uint32)
        rest[where] |= high << np.uint32(width)
    return rest + np.uint32(low)


# --- files -------------------------------------------------------------------


class ShardWriter:
    """Takes documents one after the other; holds less than BLOCKS_AT_ONCE blocks of ids, and the index."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.ids = sink, 0, 0
        self.waiting = array("I")
        self.block_starts, self.starts = array("Q"), array("Q")
        self.doc_ids, self.unnamed = array("q"), array("Q")
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: array) -> None:
        if doc_id is None:
            self.unnamed.append(len(self.doc_ids))
        self.doc_ids.append(doc_id or 0)
        self.starts.append(self.ids)
        self.ids += len(ids)
        for begin in range(0, len(ids), BLOCK * BLOCKS_AT_ONCE):
            self.waiting.extend(ids[begin : begin + BLOCK * BLOCKS_AT_ONCE])
            self._flush()

    def _flush(self) -> None:
        whole = len(self.waiting) // BLOCK
        if whole < BLOCKS_AT_ONCE:
            return
        self._write(np.frombuffer(self.waiting[: whole * BLOCK], np.uint32).reshape(whole, BLOCK))
        self.waiting = self.waiting[whole * BLOCK :]

    def _write(self, rows: np.ndarray) -> None:
        for begin in range(0, len(rows), BLOCKS_AT_ONCE):
            for data in pack_blocks(rows[begin : begin + BLOCKS_AT_ONCE]):
                self.block_starts.append(self.at)
                self._put(data)

    def close(self) -> tuple[int, int, int]:
        """Documents, ids, bytes."""
        whole = len(self.waiting) // BLOCK * BLOCK
        for part in (self.waiting[:whole], self.waiting[whole:]):
            if part:
                self._write(np.frombuffer(part, np.uint32).reshape(-1, min(BLOCK, len(part))))
        index_at = self.at
        self.block_starts.append(index_at)
        self.starts.append(self.ids)
        parts = [(self.block_starts, "<u8"), (self.starts, "<u8"), (self.doc_ids, "<i8"), (self.unnamed, "<u8")]
        index = b"".join(np.array(numbers, kind).tobytes() for numbers, kind in parts)
        self._put(index)
        end = (len(self.block_starts) - 1, len(self.doc_ids), self.ids, index_at, zlib.crc32(index), MAGIC)
        self._put(np.array(end, _TRAILER).tobytes())
        return len(self.doc_ids), self.ids, self.at


class Shard:
    """Reads a shard through its index."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        trailer = np.frombuffer(self._bytes(size - _TRAILER.itemsize, size), _TRAILER, 1)[0]
        begin = int(trailer["index_at"])
        index = self._bytes(begin, size - _TRAILER.itemsize)
        if trailer["magic"] != MAGIC or zlib.crc32(index) != trailer["index_crc"]:
            raise ValueError("not a whole shard")
        blocks, documents, self.n_ids = int(trailer["blocks"]), int(trailer["documents"]), int(trailer["ids"])
        self.block_starts = np.frombuffer(index, "<u8", blocks + 1)
        self.starts = np.frombuffer(index, "<u8", documents + 1, 8 * (blocks + 1))
        self.doc_ids = np.frombuffer(index, "<i8", documents, 8 * (blocks + documents + 2))
        self.unnamed = set(np.frombuffer(index, "<u8", -1, 8 * (blocks + 2 * documents + 2)).tolist())

    def _bytes(self, begin: int, end: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(end - begin)

    def chunks(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from start to stop, some blocks at a time; no other blocks are read."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        for begin in range(first, last, BLOCKS_AT_ONCE):
            end = min(last, begin + BLOCKS_AT_ONCE)
            edges = self.block_starts[begin : end + 1].astype(np.int64)
            data = self._bytes(int(edges[0]), int(edges[-1]))
            edges -= edges[0]
            ids = np.concatenate([unpack_block(data[a:b]) for a, b in zip(edges, edges[1:])])
            yield ids[max(start - begin * BLOCK, 0) : stop - begin * BLOCK]

    def slice(self, start: int, stop: int) -> np.ndarray:
        stop = min(stop, self.n_ids)
        return np.concatenate([np.empty(0, np.uint32), *self.chunks(start, stop)]) if start < stop else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """Id, start, length and the ids in parts, of each document; parts must be used up in order."""
        source = self.chunks(0, self.n_ids)
        held = [np.empty(0, np.uint32)]

        def parts(n: int) -> Iterator[np.ndarray]:
            while n:
                if not len(held[0]):
                    held[0] = next(source)
                part, held[0] = held[0][:n], held[0][n:]
                n -= len(part)
                yield part

        for at, doc_id in enumerate(self.doc_ids.tolist()):
            start, stop = int(self.starts[at]), int(self.starts[at + 1])
            yield None if at in self.unnamed else doc_id, start, stop - start, parts(stop - start)


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The folder's file system, and its path there."""
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(folder)


# --- ids ---------------------------------------------------------------------


class Encoder:
    """Ids by the tokenizer library. Texts of PLAIN characters are split into pieces here and every distinct piece goes to the
    library's merges; the library's own splitting, which takes most of its time, serves all other texts."""

    def __init__(self, tokenizer: str) -> None:
        library = Tokenizer.from_str(tokenizer)
        library.encode_special_tokens = True
        kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(0x100, 0x200))
        #: The byte-level alphabet: bytes that print stand for themselves, the others for the next letters.
        letters = {byte: chr(byte if byte in kept else next(spare)) for byte in range(0x100)}
        if set(letters.values()) != set(ByteLevel.alphabet()):
            raise ValueError("the library's byte alphabet is another one")
        merges = Tokenizer.from_str(tokenizer).model
        merges._resize_cache(0)  # pieces come here once
        merged, number = merges.tokenize, attrgetter("id")

        class Pieces(dict):
            """What was met lately; the generation before is asked before the library."""

            older: dict = {}

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= MAX_PIECES:
                    self.older = dict(self)
                    self.clear()
                found = self.older.get(piece)
                if found is None:
                    found = array("I", map(number, merged(piece.encode().decode("latin-1").translate(letters)))).tobytes()
                self[piece] = found
                return found

        self.library, self.pieces = library, Pieces()

    def encode(self, text: str) -> array:
        if PLAIN.fullmatch(text):
            return array("I", b"".join(map(self.pieces.__getitem__, PIECES.findall(text))))
        return array("I", self.library.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=1)
def worker_encoder(tokenizer: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(tokenizer)


# --- operators ---------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> str:
    """Encode, add end_id to each document, write shards and their manifest. Returns the folder."""
    spark = docs.sparkSession
    folder = folder or workspace(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as file:  # a vocabulary: of fixed size
        tokenizer = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    arrow = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        encoder = worker_encoder(tokenizer.value)
        for batch in batches:
            if writer is None and batch.num_rows:
                shard = batch.column("shard")[0].as_py()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.pfor"
                store, path = opened(folder)
                store.create_dir(path, recursive=True)
                sink = store.open_output_stream(f"{path}/{name}")
                writer = ShardWriter(sink)
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encoder.encode(text.as_py() or "")
                ids.append(end_id)
                writer.add(doc_id.as_py(), ids)
        if writer is not None:
            done = writer.close()
            sink.close()
            row = dict(zip(("shard", "file", "n_docs", "n_ids", "n_bytes"), (shard, name, *done)))
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    shards = placed.select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text").mapInArrow(run, MANIFEST)
    shards.write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard; first_id is the number of ids in all shards before."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    placed = prefix_aggregate(shards, ["shard"], profile_order(shards, "shard"), sums={"first_id": "n_ids"})
    return placed.fillna(0, ["first_id"])


def _over_shards(spark: SparkSession, folder: str, read, schema: str) -> DataFrame:
    """read(shard, first id) makes columns; a task reads a shard, however few and small the manifest's rows are."""
    shards = manifest(spark, folder)
    n = max(1, shards.count())
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = opened(folder)
                with store.open_input_file(f"{path}/{row['file']}") as file:
                    for rows in read(Shard(file), row["first_id"]):
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return shards.repartitionByRange(n, "shard").mapInArrow(run, schema)


def _batched(rows: Iterator[dict], weight: str, most: int = 1_000_000) -> Iterator[list[dict]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + row[weight]
        if size > most:
            yield held
            held, size = [], 0
    yield held


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document."""

    def read(shard: Shard, first: int) -> Iterator[list[dict]]:
        rows = (
            {"doc_id": doc_id, "start": first + start, "n_tokens": n, "ids": np.concatenate(list(parts)).astype(np.int32)}
            for doc_id, start, n, parts in shard.documents()
        )
        return _batched(rows, "n_tokens")

    return _over_shards(spark, folder, read, "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, whose ids are held in parts only."""

    def read(shard: Shard, first: int) -> Iterator[list[dict]]:
        def rows() -> Iterator[dict]:
            for doc_id, start, n, parts in shard.documents():
                crc = 0
                for part in parts:
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                yield {"doc_id": doc_id, "start": first + start, "n_tokens": n, "ids_crc32": crc, "few": 0}

        return _batched(rows(), "few")

    return _over_shards(spark, folder, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_windows(spark: SparkSession, folder: str, windows: DataFrame) -> DataFrame:
    """window, ids: the ids from `start` up to start + `length` of the whole corpus, for each row of windows.

    Windows are dealt to the shards they touch (a join on ranges of shards' first ids cut to equal steps); a task reads the
    blocks of its windows only. Parts of a window that spans shards are put together by its row number.
    """
    shards = manifest(spark, folder)
    step = max(1, shards.agg(F.max("n_ids")).first()[0] or 1)
    cut = lambda first, end: F.sequence(F.floor(first / step), F.floor((end - 1) / step))
    stop = F.col("first_id") + F.col("n_ids")
    held = shards.filter("n_ids > 0").withColumn("cell", F.explode(cut(F.col("first_id"), stop)))
    asked = windows.select("window", F.col("start").alias("from_id"), (F.col("start") + F.col("length")).alias("to_id"))
    asked = asked.filter("to_id > from_id").withColumn("cell", F.explode(cut(F.col("from_id"), F.col("to_id"))))
    met = asked.join(held, "cell").filter((F.col("from_id") < stop) & (F.col("to_id") > F.col("first_id")))
    met = met.drop("cell").distinct()

    schema = "window long, at long, part array<int>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name = file = shard = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["file"], store.open_input_file(f"{path}/{row['file']}")
                    shard = Shard(file)
                start = max(row["from_id"] - row["first_id"], 0)
                part = shard.slice(start, row["to_id"] - row["first_id"])
                rows.append({"window": row["window"], "at": row["first_id"] + start, "part": part.astype(np.int32)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if file is not None:
            file.close()

    parts = met.repartition("file").sortWithinPartitions("file", "from_id").mapInArrow(run, schema)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]))
    return parts.groupBy("window").agg(joined.alias("ids"))


def token_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Written, and read back: doc_id, start, n_tokens, ids_crc32."""
    return read_digests(docs.sparkSession, write_token_files(docs, tokenizer_path))
