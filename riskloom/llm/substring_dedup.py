"""Substring dedup: winnowed anchors as seeds, extended both ways over windows.

A window is WINDOW consecutive words. Its anchor is the gram of ANCHOR words in it with the
least hash (the last of equals), so equal windows have equal anchors at equal offsets,
wherever they are. Neighbouring windows mostly share their anchor: such a run, with the
words it spans as context, is one seed. Then

1. anchors are counted; a run whose anchor occurs once has no repeated window;
2. runs are joined with the repeated anchors. Equal runs (same anchor, same context) are repeated as
   a whole: the match extends over all their windows;
3. where runs with one anchor differ, one run of each kind is extended window by window, and windows
   are counted over the kinds. No pairs of occurrences are made.

The spans that remain are the maximal repeats of WINDOW words and more, in union. All counts are
pre-aggregated; rows carry hashes, and text moves in two joins on the document only. A span is known by
two 64-bit hashes, the anchor's and the context's or window's, over the whole corpus.

A null text has no words. Documents are told apart by doc_id and text, so repeated rows are
copies of each other and lose all their windows, and rows that share an id but not the text are judged apart; a
null id is an id. Texts below WINDOW words are kept. Extra columns pass through remove_repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise, tidy

from .common import packed, unpacked

WINDOW = 35
ANCHOR = 12
CACHE = 200_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any span of words in constant time: sums of word hashes times powers, modulo 2^64, in two lanes."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
        self.down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BACK))))
        lanes = hashes, mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * up[:-1]))) for h in lanes]

    def lane(self, number: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((self.sums[number][stops] - self.sums[number][starts]) * self.down[starts])

    def both(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed(self.lane(0, starts, stops) + np.uint64(3) * self.lane(1, starts, stops))


def seeds(hashes: np.ndarray, lengths: np.ndarray, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Runs of windows that share their anchor, over texts laid end to end.

    row: the text; first, n: the first window's start in it and the number of windows;
    anchor, context: 64-bit hashes of the anchor and of all words of the run, with its place there.
    """
    starts = np.cumsum(lengths) - lengths
    rows = np.flatnonzero(lengths >= window)
    if not len(rows):
        empty = np.empty(0, np.int64)
        return {"row": empty, "first": empty, "n": empty, "anchor": empty, "context": empty}
    spans = Spans(hashes)
    grams = np.arange(len(hashes) - anchor + 1)
    value = spans.both(grams, grams + anchor)
    # Least value in each stretch of window - anchor + 1 grams and its place, by doubling stretches.
    width, stretch, least, place = 1, window - anchor + 1, value, grams

    def joined(by: int):
        later = least[by:] <= least[:-by]
        return np.where(later, least[by:], least[:-by]), np.where(later, place[by:], place[:-by])

    while width * 2 <= stretch:
        least, place = joined(width)
        width *= 2
    if width < stretch:
        least, place = joined(stretch - width)
    at = np.concatenate([np.arange(starts[r], starts[r] + lengths[r] - window + 1) for r in rows])
    place = place[at]
    begins = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
    n = np.diff(np.append(begins, len(at)))
    first, gram = at[begins], place[begins]
    row = np.repeat(rows, lengths[rows] - window + 1)[begins]
    shape = (n + 64 * (gram - first)).astype(np.uint64)
    context = mixed(spans.both(first, first + n - 1 + window) + shape)
    return {
        "row": row,
        "first": first - starts[row],
        "n": n,
        "anchor": value[gram].view(np.int64),
        "context": context.view(np.int64),
    }


#: Texts analysed at once: so many words, or one text.
SLICE = 1 << 17


def _sliced(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Parts of a batch: their place, word hashes end to end, words per text."""
    at = 0
    while at < len(texts):
        begin, parts, n = at, [], 0
        while at < len(texts) and (not parts or n < SLICE):
            words = WORDS.findall(texts[at].as_py() or "")
            parts.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
            n += len(words)
            at += 1
        yield slice(begin, at), np.concatenate(parts), np.array(list(map(len, parts)), np.int64)


_HASHES = WordHashes()
RUNS = "doc_id long, text_hash long, first int, n int, anchor long, context long"
WINDOWS = "doc_id long, text_hash long, first int, kinds long, anchor long, context long"


def seed_rows(ided: DataFrame, window: int, anchor: int) -> DataFrame:
    """The runs of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_hashes = batch.column("doc_id"), batch.column("text_hash")
            for part, hashes, lengths in _sliced(batch.column("text")):
                found = seeds(hashes, lengths, window, anchor)
                row = pa.array(found["row"] + part.start)
                columns = [ids.take(row), text_hashes.take(row), *[pa.array(found[k], pa.int32()) for k in ("first", "n")]]
                columns += [pa.array(found[k], pa.int64()) for k in ("anchor", "context")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "first", "n", "anchor", "context"])

    return ided.mapInArrow(run, RUNS)


def window_rows(listed: DataFrame, window: int) -> DataFrame:
    """Each window of the listed runs: its hash as context, and how many runs are of its run's kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, runs in enumerate(batch.column("runs")):
                runs, words = runs.as_py(), WORDS.findall(batch.column("text")[i].as_py())
                spans = Spans(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
                n = np.array([r["n"] for r in runs])
                of_run = np.repeat(np.arange(len(runs)), n)
                first = np.array([r["first"] for r in runs])[of_run] + np.arange(len(of_run)) - (np.cumsum(n) - n)[of_run]
                row = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(row),
                        batch.column("text_hash").take(row),
                        pa.array(first, pa.int32()),
                        pa.array(np.array([r["kinds"] for r in runs])[of_run], pa.int64()),
                        pa.array(np.array([r["anchor"] for r in runs])[of_run], pa.int64()),
                        pa.array(spans.both(first, first + window).view(np.int64)),
                    ],
                    names=["doc_id", "text_hash", "first", "kinds", "anchor", "context"],
                )

    return listed.mapInArrow(run, WINDOWS)


def _joined(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """On the document, null ids included."""
    lists = lists.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    on = docs["doc_id"].eqNullSafe(lists["_id"]) & docs["text_hash"].eqNullSafe(lists["_hash"])
    return docs.join(lists, on, how).drop("_id", "_hash")


def repeated_windows(ided: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text_hash, spans: (first, n) for n repeated windows from the one that starts at word `first`."""
    spark = ided.sparkSession
    ided = ided.select("doc_id", "text_hash", "text")
    runs = seed_rows(ided, window, anchor)
    often = runs.groupBy("anchor").agg(F.count("*").alias("runs")).filter("runs > 1").select("anchor")
    # Written, so that both sides of the join are plain exchanges and a hot anchor can be split.
    often = materialise(often, "anchors")
    tidy(spark)
    repeated = materialise(runs.join(often, "anchor"), "runs")
    tidy(spark)
    one = F.min(F.struct("doc_id", "text_hash", "first", "n")).alias("one")
    kinds = materialise(repeated.groupBy("anchor", "context").agg(F.count("*").alias("kinds"), one), "kinds")
    whole = repeated.join(kinds.filter("kinds > 1").select("anchor", "context"), ["anchor", "context"], "left_semi")
    unlike = kinds.groupBy("anchor").agg(F.count("*").alias("unlike")).filter("unlike > 1").select("anchor")
    listed = (
        kinds.join(unlike, "anchor")
        .groupBy("one.doc_id", "one.text_hash")
        .agg(F.collect_list(F.struct("one.first", "one.n", "kinds", "anchor")).alias("runs"))
    )
    windows = materialise(window_rows(_joined(ided, listed, "inner"), window), "windows")
    tidy(spark)
    held = windows.groupBy("anchor", "context").agg(F.sum("kinds").alias("held")).filter("held > 1")
    single = windows.filter("kinds = 1").join(held.select("anchor", "context"), ["anchor", "context"], "left_semi")
    columns = ["doc_id", "text_hash", "first"]
    found = whole.select(*columns, "n").union(single.select(*columns, F.lit(1).alias("n")))
    spans = materialise(
        found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "n")).alias("spans")), "spans"
    )
    tidy(spark)
    return spans


def kept_words(text: str | None, spans: list[dict] | None, window: int) -> tuple[list[str], int]:
    """The words outside of repeated windows, and the number of all words."""
    words = WORDS.findall(text or "")
    if not spans:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s["first"] for s in spans], 1)
    np.add.at(change, [s["first"] + s["n"] - 1 + window for s in spans], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)], len(words)


def with_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds text_hash and spans (null: nothing repeated) to doc_id, text and other columns of other names."""
    ided = docs.withColumn("text_hash", F.xxhash64("text"))
    return _joined(ided, repeated_windows(ided, window), "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns; a text that repeats becomes its kept words, joined by one space."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        return pd.Series([" ".join(kept_words(t, list(s), window)[0]) for t, s in zip(texts, spans)], dtype=object)

    marked = with_spans(docs.select(packed(docs), "doc_id", "text"), window)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", F.coalesce("spans", F.array())))
    return marked.select(*unpacked(docs, text=text))


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def digest(text: str | None, spans: list[dict] | None) -> tuple[int, int, str]:
        kept, n = kept_words(text, spans, window)
        return n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)],
                    pa.array([x[2] for x in found], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    marked = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return marked.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
