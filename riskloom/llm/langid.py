"""Language identification: known words first, then ever shorter character n-grams.

Words and n-grams of the training documents are counted per language by Spark, in one
pass over the texts: a batch counts its words, the longest n-grams over its distinct words, and shorter ones over those,
before rows move. The model keeps words and n-grams with at least LEAST_SHARE of their language's total, so it has at most
1 / LEAST_SHARE entries per language and order whatever the corpus, each a language and a number, and may be broadcast.
A word in the model scores its log frequency in each language; an unseen one the mean
over its n-grams of the longest order that has a known one. The words that a batch brings for the first time are scored together.

lang_pred is `und` with score 0 for a null text or one without a letter, and for every
text if nothing could be learned. Ties go to the language that sorts first. The score is the
posterior of the prediction. Training ignores null texts and null languages; repeated
rows count as often as they stand. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise

from .common import doc_hash_mod, map_rows

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
LEAST_SHARE = 2e-5
#: More languages than this are an error: the model would have no bound.
MOST_LANGUAGES = 200
#: Pseudo-share of what a language has never shown, relative to LEAST_SHARE.
UNSEEN = 0.1
HELD_OUT_OF = 5
#: Words remembered (fewer with over 16 languages), and words scored at once.
CACHE = 200_000
WORDS_AT_ONCE = 200_000


def held_out(doc_id: Column) -> Column:
    return doc_hash_mod(doc_id, HELD_OUT_OF) == 0


def padded(word: str) -> str:
    """No word has the marks of its ends, as neither is a letter."""
    return f"^{word}$"


def grams_of(words: dict[str, int]) -> dict[int, dict[str, int]]:
    """Counts of the n-grams of each order; a padded word shorter than that is its own gram.

    Only the longest are cut from words. One order less are the beginnings of longer ones, and the end of each word.
    """
    longest = ORDERS[0]
    seen: dict[str, int] = defaultdict(int)
    for word, times in words.items():
        marked = padded(word)
        for i in range(max(1, len(marked) - longest + 1)):
            seen[marked[i : i + longest]] += times
    out = {longest: seen}
    for n in ORDERS[1:]:
        shorter: dict[str, int] = defaultdict(int)
        for gram, times in out[n + 1].items():
            if len(gram) <= n:
                shorter[gram] += times
                continue
            shorter[gram[:n]] += times
            if gram[n] == "$":
                shorter[gram[1:]] += times
        out[n] = shorter
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """ord, lang, gram, n: words (order 0) and n-grams over all rows with a text and a language.

    The n-grams of a batch are counted over its distinct words, weighted by their counts.
    """

    def make():
        def work(batch: dict[str, list]) -> dict[str, list]:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            out: dict[str, list] = {"ord": [], "lang": [], "gram": [], "n": []}
            for lang, words in counts.items():
                for order, seen in {0: words, **grams_of(words)}.items():
                    out["ord"] += [order] * len(seen)
                    out["lang"] += [lang] * len(seen)
                    out["gram"] += seen.keys()
                    out["n"] += seen.values()
            return out

        return work

    known = docs.select("lang", "text").filter("lang is not null and text is not null")
    rows = map_rows(known, make, "ord int, lang string, gram string, n long")
    return rows.groupBy("ord", "lang", "gram").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, least_share: float) -> DataFrame:
    """ord, lang, gram, share of the grams with at least least_share of their language and order."""
    total = counts.groupBy("ord", "lang").agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(total), ["ord", "lang"])  # a row per language and order
        .withColumn("share", F.col("n") / F.col("total"))
        .filter(F.col("share") >= least_share)
        .select("ord", "lang", "gram", "share")
    )


def train(docs: DataFrame, least_share: float = LEAST_SHARE) -> dict:
    """The model: languages, and per order (0: words) a map from gram to the log shares by language."""
    counts = materialise(gram_counts(docs), "gram-counts")
    found = counts.filter("ord = 0").select("lang").distinct()
    languages = sorted(r[0] for r in found.limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = frequent(counts, least_share).orderBy("ord", "gram", "lang").toArrow().to_pydict()
    place = {lang: i for i, lang in enumerate(languages)}
    floor = math.log(least_share * UNSEEN)
    orders, grams = np.array(rows["ord"], np.int64), rows["gram"]
    above = (np.log(np.array(rows["share"], np.float64)) - floor).astype(np.float32)
    spoken = np.array([place[lang] for lang in rows["lang"]], np.int16)
    tables = {}
    for order in (0, *ORDERS):
        at = np.flatnonzero(orders == order)
        mine = [grams[i] for i in at]
        first = [i for i, gram in enumerate(mine) if not i or mine[i - 1] != gram]
        entries = {mine[i]: n for n, i in enumerate(first)}
        begins = np.array([*first, len(mine)], np.int64)
        tables[order] = (entries, begins, spoken[at], above[at])
    return {"languages": languages, "floor": floor, "tables": tables}


class Scorer:
    def __init__(self, model: dict) -> None:
        self.languages, self.floor, self.tables = model["languages"], model["floor"], model["tables"]
        self.most = max(1, min(CACHE, CACHE * 16 // max(1, len(self.languages))))
        self._forget()

    def _forget(self) -> None:
        #: Words met lately, and their log shares row by row.
        self.rows: dict[str, int] = {}
        self.logs = np.empty((0, len(self.languages)), np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log share of every word in each language; 0 for words of which nothing is known."""
        out = np.zeros((len(words), len(self.languages)))
        pending = np.arange(len(words))
        for order in (0, *ORDERS):
            entries, begins, spoken, above = self.tables[order]
            if order:
                cut = [padded(words[i]) for i in pending]
                cut = [[w[j : j + order] for j in range(max(1, len(w) - order + 1))] for w in cut]
            else:
                cut = [[words[i]] for i in pending]
            found = np.fromiter(map(entries.get, chain.from_iterable(cut), repeat(-1)), np.int64)
            owner = np.repeat(np.arange(len(pending)), [len(c) for c in cut])[found >= 0]
            found = found[found >= 0]
            number = np.bincount(owner, minlength=len(pending))
            sizes = begins[found + 1] - begins[found]
            at = np.repeat(begins[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            cells = np.repeat(owner, sizes) * out.shape[1] + spoken[at]
            sums = np.bincount(cells, above[at], minlength=len(pending) * out.shape[1]).reshape(len(pending), out.shape[1])
            known = number > 0
            out[pending[known]] = self.floor + sums[known] / number[known, None]
            pending = pending[~known]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, held, size = [], [], 0
        for text in texts:
            words = LETTERS.findall(text.lower()) if text and self.languages else []
            held.append(words)
            size += len(words)
            if size >= WORDS_AT_ONCE:
                out += self._predict(held)
                held, size = [], 0
        return out + self._predict(held)

    def _predict(self, held: list[list[str]]) -> list[tuple[str, float]]:
        if len(self.rows) > self.most:
            self._forget()
        rows, begun = self.rows, len(self.rows)
        at = [rows.setdefault(w, len(rows)) for words in held for w in words]
        if len(rows) > begun:
            self.logs = np.concatenate([self.logs, self.score_words(list(rows)[begun:]).astype(np.float32)])
        out, end = [], 0
        for words in held:
            begin, end = end, end + len(words)
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.logs[at[begin:end]].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    def make():
        scorer = Scorer(sent.value)

        def work(batch: dict[str, list]) -> dict[str, list]:
            found = scorer.predict(batch["text"])
            return {"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows that are not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
