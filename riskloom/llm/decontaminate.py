"""Benchmark decontamination: a BM25 index of test items, queried with every passage.

The index holds the test items; passages of training documents (two strides of words, a
new one every stride) are the queries. Weights are BM25's, divided by the item's score for itself,
so one threshold serves all items: 1 means that every term is there. The index is inverted: for each term its postings,
the items that have it with its weight there, in blocks of BLOCK neighbouring items with the block's greatest weight. Retrieval is exact
and in the manner of block-max WAND: a passage without any of the terms that an item needs to
reach the threshold is skipped; for the others the greatest weights of their terms are added up block by block, postings of
blocks whose sum stays below the threshold are skipped, and the postings of the rest are scored. Of what is retrieved, 5-word shingles of
question and answer must both be found to 0.8 or more. The answer is an item's last sentence,
or its second half if it has one sentence only.

Items are dealt to shards by their length, to the next power of two, and of at most SHARD items, one broadcast index each (tens of MB); a
long item makes the passages long for its shard only. PASS shards are searched in one pass over the documents, so what is broadcast
at a time is bounded whatever the benchmark's size; frequencies are those of all items.

Null or wordless texts match nothing; a null doc_id is reported as null; repeated documents give
repeated rows, repeated item rows one. Items are told apart by id and text, so one id may name several, and an
item without an id is searched and reported with a null one. No items: no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise

from .common import map_rows

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
LEAST_STRIDE = 64
BLOCK = 16
SHARD = 32_768
PASS = 8
CACHE = 400_000
#: Postings and maxima added up at once.
AT_ONCE = 1 << 21
SENTENCE = re.compile(r"[.!?]+\s+|\n+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def normal(word: str) -> str:
    return EDGES.sub("", word.lower())


def terms(text: str | None) -> list[str]:
    return [n for w in (text or "").split() if (n := normal(w))]


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words."""
    sentences = [s for part in SENTENCE.split(text) if (s := terms(part))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = terms(text)
    middle = (len(words) + 1) // 2
    return words[:middle], words[middle:]


def shingles(words: list) -> set[tuple]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def share(part: set[tuple], passage: list) -> float:
    """How much of an item's part the passage holds; an empty part is held."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    return len(part & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(part)


class Ids(dict):
    """Raw word to term: -1 not in the index, -2 no word."""

    def __init__(self, place: dict[str, int]) -> None:
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        name = normal(word)
        self[word] = found = self.place.get(name, -1) if name else -2
        return found

    def __reduce__(self):
        return Ids, (self.place,)


def spread(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - begins
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of equal values."""
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return begins, np.append(begins[1:], len(values))[: len(begins)]


class Index:
    """Items of one shard: postings by term, their blocks, and the terms each item can't do without."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[str, int], n_items: int, mean_words: float, threshold: float) -> None:
        self.threshold = threshold
        self.items = [i for i, _ in items]
        self.place: dict[str, int] = {}
        postings, needed = [], set()
        for item, (_, text) in enumerate(items):
            counts = Counter(terms(text))
            length = K1 * (1 - B + B * sum(counts.values()) / mean_words)
            idf = {t: math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in counts}
            row = {t: idf[t] * n * (K1 + 1) / (n + length) for t, n in counts.items()}
            own = sum(row.values())
            left = 0.0
            for t, w in sorted(((self.place.setdefault(t, len(self.place)), w / own) for t, w in row.items()), key=lambda x: x[1]):
                postings.append((t, item, w))
                left += w
                if left >= threshold - 1e-6:  # the lightest terms alone stay below the threshold
                    needed.add(t)
        postings.sort()
        of_term = np.array([t for t, _, _ in postings], np.int64)
        self.item = np.array([i for _, i, _ in postings], np.int64)
        self.weight = np.array([w for _, _, w in postings])
        #: A block: the postings of one term with BLOCK neighbouring items. Terms name their first block, blocks their first posting.
        heads, _ = _runs(of_term * len(items) + self.item // BLOCK)
        self.block = self.item[heads] // BLOCK
        self.most = np.maximum.reduceat(self.weight, heads) if len(heads) else np.empty(0)
        self.first_posting = np.append(heads, len(postings))
        self.first_block = np.searchsorted(of_term[heads], np.arange(len(self.place) + 1))
        self.needed = np.zeros(len(self.place), bool)
        self.needed[list(needed)] = True
        self.parts = [[shingles([self.place[t] for t in half]) for half in halves(text)] for _, text in items]
        self.stride = max([LEAST_STRIDE, *(len(terms(text)) for _, text in items)])
        self.ids = Ids(self.place)

    @property
    def weights(self) -> np.ndarray:
        """Term by item, written out; for small indexes."""
        out = np.zeros((len(self.place), len(self.items)))
        blocks = np.repeat(np.arange(len(self.place)), np.diff(self.first_block))
        out[np.repeat(blocks, np.diff(self.first_posting)), self.item] = self.weight
        return out

    def scored(self, passages: np.ndarray, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold, from the words in each candidate passage."""
        codes = np.unique(passages.astype(np.int64) * len(self.place) + words)
        passages, words = codes // len(self.place), codes % len(self.place)
        blocks = self.first_block[words + 1] - self.first_block[words]
        found = []
        # Passages are cut into parts by how many blocks they reach.
        part = np.cumsum(blocks) // AT_ONCE
        part = part[np.searchsorted(passages, passages)]  # that of the passage's first term
        for begin, end in zip(*_runs(part)):
            own, own_words = passages[begin:end], words[begin:end]
            at = spread(self.first_block[own_words], self.first_block[own_words + 1])
            of = np.repeat(own, blocks[begin:end])
            reached, which = np.unique(of * len(self.items) + self.block[at], return_inverse=True)
            live = np.bincount(which, self.most[at], minlength=len(reached)) >= self.threshold - 1e-9
            at, of = at[live[which]], of[live[which]]
            sizes = self.first_posting[at + 1] - self.first_posting[at]
            posting = spread(self.first_posting[at], self.first_posting[at + 1])
            pairs, which = np.unique(np.repeat(of, sizes) * len(self.items) + self.item[posting], return_inverse=True)
            scores = np.bincount(which, self.weight[posting], minlength=len(pairs))
            hits = np.flatnonzero(scores >= self.threshold)
            found += zip((pairs[hits] // len(self.items)).tolist(), (pairs[hits] % len(self.items)).tolist(), scores[hits].tolist())
        return found

    def search(self, texts: list[str | None]) -> list[tuple[int, int | None, float, float, float]]:
        """(row, item id, score, question and answer overlap), the best passage of each row and item."""
        each = [np.array(list(map(self.ids.__getitem__, t.split())) if t else [], np.int32) for t in texts]
        each = [x[x > -2] for x in each]
        lengths = np.array([len(x) for x in each], np.int64)
        chunks = -(-lengths // self.stride)
        first_chunk = np.cumsum(chunks) - chunks
        first_word = np.cumsum(lengths) - lengths
        words = np.concatenate([*each, np.empty(0, np.int32)])
        known = np.flatnonzero(words >= 0)
        if not len(known):
            return []
        row = np.repeat(np.arange(len(texts)), lengths)[known]
        chunk = first_chunk[row] + (known - first_word[row]) // self.stride
        hit = np.zeros(int(chunks.sum()) + 1, bool)
        hit[chunk[self.needed[words[known]]]] = True
        live = hit.copy()  # a passage is a chunk and the next one of the same text
        row_of = np.repeat(np.arange(len(texts)), chunks)
        follows = row_of[1:] == row_of[:-1]
        live[:-2] |= hit[1:-1] & follows
        joins = np.concatenate(([False], follows))[chunk]
        own, before = live[chunk], joins & live[chunk - 1]
        terms_here = words[known]
        passages = np.concatenate((chunk[own], chunk[before] - 1))
        best: dict[tuple[int, int], tuple] = {}
        if len(passages):
            for passage, item, score in self.scored(passages, np.concatenate((terms_here[own], terms_here[before]))):
                r = int(row_of[passage])
                begin = (passage - int(first_chunk[r])) * self.stride
                held = each[r][begin : begin + 2 * self.stride].tolist()
                overlaps = tuple(share(part, held) for part in self.parts[item])
                if min(overlaps) >= OVERLAP:
                    best[r, item] = max(best.get((r, item), ()), (score, *overlaps))
        return [(r, self.items[item], *x) for (r, item), x in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document that holds an item."""
    found = [_search(docs, indexes) for indexes in _indexes(items, threshold, shard)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], RESULT)


def _indexes(items: DataFrame, threshold: float, shard: int) -> Iterator[list]:
    """For each pass its shards' indexes, broadcast; the next pass's are made when it is asked for."""
    spark = items.sparkSession
    items = items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))

    def make_terms():
        def work(batch: dict[str, list]) -> dict[str, list]:
            rows = [(i, t, n) for i, text in zip(batch["item"], batch["text"]) for t, n in Counter(terms(text)).items()]
            return dict(zip(("item", "term", "n"), zip(*rows))) if rows else {"item": [], "term": [], "n": []}

        return work

    postings = materialise(map_rows(items, make_terms, "item long, term string, n long"), "item-terms")
    total = postings.agg(F.count_distinct("item"), F.sum("n")).first()
    if not total[0]:
        return
    frequency = postings.groupBy("term").agg(F.count("*").alias("items"))
    lengths = postings.groupBy("item").agg(F.ceil(F.log2(F.greatest(F.sum("n"), F.lit(LEAST_STRIDE)))).alias("class"))
    sizes = {r[0]: r[1] for r in lengths.groupBy("class").count().collect()}  # powers of two: a few dozen
    dealt = [(of, n, -(-size // shard)) for of, size in sorted(sizes.items()) for n in range(-(-size // shard))]
    for begin in range(0, len(dealt), PASS):
        yield [_index(spark, items, postings, frequency, lengths, of, total, threshold) for of in dealt[begin : begin + PASS]]


def _index(spark, items, postings, frequency, lengths, of: tuple[int, int, int], total, threshold: float):
    """The index of one shard: of one class of lengths, the part of it that the item's hash deals to this number."""
    length, number, shards = of
    mine = lengths.filter((F.col("class") == length) & (F.pmod("item", F.lit(shards)) == number)).select("item")
    listed = [tuple(r) for r in items.join(mine, "item", "left_semi").select("item_id", "text").collect()]
    wanted = postings.join(mine, "item", "left_semi").select("term").distinct()
    counts = {r[0]: r[1] for r in frequency.join(wanted, "term").collect()}
    listed.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return spark.sparkContext.broadcast(Index(listed, counts, total[0], total[1] / total[0], threshold))


def _search(docs: DataFrame, indexes: list) -> DataFrame:
    def make():
        def work(batch: dict[str, list]) -> dict[str, list]:
            ids = batch["doc_id"]
            rows = []
            for index in indexes:
                search = index.value.search
                for at in range(0, len(ids), 500):
                    rows += [(ids[at + r], *rest) for r, *rest in search(batch["text"][at : at + 500])]
            columns = zip(*rows) if rows else [[]] * 5
            return dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap"), columns))

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, RESULT)


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """The documents that hold no item, with all their columns: each row goes or stays by its own text,
    whatever its id."""
    for indexes in _indexes(items, threshold, shard):
        docs = _without(docs, indexes)
    return docs


def _without(docs: DataFrame, indexes: list) -> DataFrame:
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for index in indexes:
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, *_ in index.value.search(part.column(at_text).to_pylist())]] = False
                    part = part if clean.all() else part.filter(pa.array(clean))
                yield part

    return docs.mapInArrow(run, docs.schema)
