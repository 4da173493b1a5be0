"""Runs of periodic words by an enhanced suffix array and branching tandems.

A run is a longest stretch of words with a smallest period q, long enough (MIN_LENGTH words and MIN_EXPONENT
periods). The words of a pack of documents, each document with its own alphabet and end mark, are put in suffix order
by prefix doubling, so copies of one document cost no more than other ones; with it go the inverse (ISA) and the lengths
of common prefixes (LCP). A tree's node is an LCP interval: the suffixes between two positions
with smaller values, of one common depth d; its children lie between the positions of value d. No nodes are kept, all
intervals of a pack are handled as arrays. For each interval all children but the largest are listed
(n log n suffixes in all): a suffix i whose partner i + d or i - d lies in the interval, but in another child,
by its place in ISA, begins or ends a square of period d whose next word breaks the period. Every run ends in just one
such square for its period. Squares that a smaller period at the same end explains are dropped; the rest are rotated to
the left, word by word as long as they fit, and a square with its rotations is a run.

A null text has no words and no run. Runs are found per row, so repeated rows and ids are judged alike, and extra columns
pass through collapse_runs under their own names. A long document is one row: its arrays (some 8 + 4 log n bytes a
word) are all that a task holds beside a pack. In the digests a null doc_id stands for no planted period.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words of the documents handled at once, and suffixes listed at once.
PACK = 300_000
LISTED = 1_000_000

Run = tuple[int, int, int]


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and for each k the rank of every suffix by its first 2^k symbols; the last is ISA.

    The last symbol of a document occurs once, so no comparison runs over it.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    sizes, heads = _groups(symbols[order])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(heads, sizes)
    levels = [rank]
    open_ = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    step = 1
    while len(open_):
        at = order[open_]
        pairs = rank[at].astype(np.int64) * n + rank[at + step]
        turn = np.argsort(pairs)
        at = order[open_] = at[turn]
        sizes, heads = _groups(pairs[turn])
        rank = rank.copy()
        rank[at] = np.repeat(open_[heads], sizes)
        levels.append(rank)
        open_ = open_[np.repeat(sizes, sizes) > 1]
        step *= 2
    return order, levels


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and first places of runs of equal values."""
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return np.diff(np.append(heads, len(ordered))), heads


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the one before it; 0 at both ends."""
    first = levels[0][order]
    at = np.flatnonzero(first[1:] == first[:-1]) + 1
    left, right = order[at - 1].astype(np.int64), order[at].astype(np.int64)
    found = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][left] == levels[k][right]).astype(np.int64) << k
        left, right, found = left + same, right + same, found + same
    lcp = np.zeros(len(order) + 1, np.int64)
    lcp[at] = found
    return lcp


def nearest_smaller(values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place the next one in a direction with a smaller value, by jumps over whole stretches."""
    to = np.arange(len(values)) + step
    live = at
    while len(live):
        live = live[values[to[live]] >= values[live]]
        to[live] = to[to[live]]
    return to[at]


def branching_squares(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Rows (end, period) of the squares that the next word breaks, in this order."""
    place, lcp = levels[-1], common_prefixes(order, levels)
    edges = np.flatnonzero(lcp > 0)
    nothing = np.empty((0, 2), np.int64)
    if not len(edges):
        return nothing
    left, right = nearest_smaller(lcp, edges, -1), nearest_smaller(lcp, edges, 1)
    # Edges of one interval side by side: same left end, same depth.
    turn = np.lexsort((edges, lcp[edges], left))
    edges, left, right = edges[turn], left[turn], right[turn]
    depth = lcp[edges]
    begins = np.concatenate([[True], (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])])
    heads, interval = np.flatnonzero(begins), np.cumsum(begins) - 1
    # A child starts at the interval's left end or at an edge, and ends at the next edge or the right end.
    starts = np.concatenate([left[heads], edges])
    following = np.append(edges[1:], 0)
    ends = np.concatenate([edges[heads], np.where(np.append(begins[1:], True), right, following)])
    of = np.concatenate([np.arange(len(heads)), interval])
    sizes = ends - starts
    by_size = np.lexsort((-sizes, of))
    largest = by_size[np.concatenate([[True], of[by_size][1:] != of[by_size][:-1]])]
    small = np.setdiff1d(np.arange(len(sizes)), largest, assume_unique=True)
    out = [nothing]
    total = np.cumsum(sizes[small])
    for part in np.split(small, np.searchsorted(total, np.arange(LISTED, total[-1], LISTED)) + 1) if len(small) else []:
        out.append(_tandems(order, place, part, starts, ends, sizes, depth[heads][of], left[heads][of], right[heads][of]))
    return np.unique(np.concatenate(out), axis=0)


def _tandems(order, place, children, starts, ends, sizes, depth, left, right) -> np.ndarray:
    """Squares that have a half in one of these children and the other in a sister."""
    sizes = sizes[children]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    member = np.repeat(children, sizes)
    i = order[starts[member] + np.arange(len(member)) - first].astype(np.int64)
    d = depth[member]
    found = []
    for partner, start in ((i + d, i), (i - d, i - d)):
        inside = partner >= 0
        at = place[np.where(inside, partner, 0)]
        inside &= (at >= left[member]) & (at < right[member]) & ~((at >= starts[member]) & (at < ends[member]))
        found.append(np.stack([start[inside] + 2 * d[inside], d[inside]], axis=1))
    return np.concatenate(found)


def rotations(symbols: np.ndarray, start: int, period: int) -> int:
    """How many words the square at start can be rotated to the left."""
    made, span = 0, 64
    while True:
        end = start - made
        begin = max(end - span, 0)
        unlike = np.flatnonzero(symbols[begin:end] != symbols[begin + period : end + period])
        if len(unlike):
            return made + end - begin - 1 - int(unlike[-1])
        made, span = made + end - begin, span * 2
        if begin == 0:
            return made


def runs_of_symbols(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """(start, length, period) of every run; exponents below 2 are no squares."""
    order, levels = suffix_order(symbols)
    squares = branching_squares(order, levels)
    # A run of so many periods goes on to the left: the word before the square fits, and those whole periods before.
    start, period = squares[:, 0] - 2 * squares[:, 1], squares[:, 1]
    probes = [lambda q: np.ones_like(q), *[lambda q, k=k: k * q for k in range(1, min_exponent - 1)]]
    for back in probes if min_exponent > 2 else []:
        first = start - back(period)
        fits = (first >= 0) & (symbols[first] == symbols[first + period])
        start, period = start[fits], period[fits]
    runs: list[Run] = []
    end, here = -1, []
    for i, q in zip(start.tolist(), period.tolist()):
        if i + 2 * q != end:
            end, here = i + 2 * q, []
        if any(q % smaller == 0 and i >= begun for begun, smaller in here):
            continue
        begun = i - rotations(symbols, i, q)
        length = end - begun
        if length >= min_exponent * q:
            here.append((begun, q))
            if length >= min_length:
                runs.append((begun, length, q))
    return runs


def find_runs(texts: list[list[str]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[Run]]:
    """Runs of each list of words, by start, then period; packs of documents go together."""
    out: list[list[Run]] = [[] for _ in texts]
    pack, size = [], 0
    for at, words in enumerate(texts):
        if len(words) >= min_length:
            pack.append(at)
            size += len(words)
        if pack and (size >= PACK or at == len(texts) - 1):
            codes: dict[str, int] = {}
            coded = [np.array([codes.setdefault(w, len(codes)) for w in texts[n]], np.int64) for n in pack]
            ends = np.cumsum([len(c) + 1 for c in coded])
            symbols = np.concatenate(
                [part for n, c in enumerate(coded) for part in (c + n * len(codes), [len(pack) * len(codes) + n])]
            )
            for start, length, period in runs_of_symbols(symbols, min_length, min_exponent):
                n = int(np.searchsorted(ends, start, "right"))
                out[pack[n]].append((start - (int(ends[n - 1]) if n else 0), length, period))
            pack, size = [], 0
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words but those of a run after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


def with_period(words: list[str], doc_id: int | None) -> list[str]:
    """For a tenth of all ids, from some word on, a few words over and over."""
    code = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or code % 10 or not n:
        return words
    start = code // 10 % n
    period = 1 + (n - start) // (3 + code // 10 % 8)
    return words[:start] + (words[start : start + period] * ((n - start) // period + 1))[: n - start]


def document_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, runs: an array of (start, length, period), numbered by words."""

    def make():
        def work(batch: dict[str, list]) -> dict[str, list]:
            found = find_runs([WORDS.findall(t or "") for t in batch["text"]], min_length, min_exponent)
            names = ("start", "length", "period")
            return {"doc_id": batch["doc_id"], "runs": [[dict(zip(names, r)) for r in runs] for runs in found]}

        return work

    schema = "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The documents with every run cut to its first period; a text without runs stays as it is."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            words = [WORDS.findall(t or "") for t in texts]
            found = find_runs(words, min_length, min_exponent)
            kept = [" ".join(collapsed(w, runs)) if runs else t for t, w, runs in zip(texts, words, found)]
            columns = list(batch.columns)
            columns[at] = pa.array(kept, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the one with most periods, and digests of all runs and of what stays."""

    def make():
        def work(batch: dict[str, list]) -> dict[str, list]:
            words = [with_period(WORDS.findall(t or ""), i) for i, t in zip(batch["doc_id"], batch["text"])]
            out: dict[str, list] = {name: [] for name in (*_BEST, "n_runs", "runs_sha256", "collapsed_sha256")}
            out["doc_id"] = batch["doc_id"]
            for kept, runs in zip(words, find_runs(words)):
                out["n_runs"].append(len(runs))
                for name, value in zip(_BEST, strongest(runs)):
                    out[name].append(value)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(" ".join(collapsed(kept, runs)).encode()).hexdigest())
            return out

        return work

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long"
    schema += ", runs_sha256 string, collapsed_sha256 string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


_BEST = ("start", "length", "period", "exponent_milli")


def strongest(runs: list[Run]) -> tuple[int | None, ...]:
    """The run with the greatest length / period, compared without rounding; the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
