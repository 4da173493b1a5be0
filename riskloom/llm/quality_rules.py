"""Quality rules by line frequency across documents, in DataFrame functions only.

Lines are normalised (lower case, digits as 0, white space as one space) and hashed. For
every host, here the source, the distinct documents that hold a line are counted: only whole
copies count once. Lines above a share of the host's documents (and a
floor of a few, for small hosts) are removed; the share falls with the square root of the host's size,
by one formula from a host of four documents to one of millions, and a document that loses most of its words is rejected.

The texts are read once for all rules: what is written down is the hash of the text, the base counts, and hash and
words of each line. Everything else works on these, one row per host and distinct text; counts are pre-aggregated, and AQE splits the join
with the frequent lines where one of them is in a third of all documents.

A null text has no words and fails the base rule; a null source is a host of its own.
Repeated rows are judged alike and count as one document. Extra columns are passed through by
filter_documents and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise

from .common import packed, unpacked, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
#: A line in a larger share of a host's documents, and in more than so many, is boilerplate. The share
#: is that of a host of SHARE_AT documents and falls with the square root of the host's size.
MOST_SHARE = 0.02
SHARE_AT = 2_500
MOST_DOCUMENTS = 3
#: A document that loses a larger share of its words is depleted.
MOST_REMOVED = 0.7


def repeated_words(words: Column) -> Column:
    """Words in windows found twice or more. Linear but for one sort of the windows' hashes."""

    def count(hashes: Column) -> Column:
        def flagged(order: Column) -> Column:
            same = lambda j: (j >= 0) & (j < F.size(order))
            h = lambda j: F.get(order, j)["h"]
            twin = lambda j, k: same(k) & h(j).eqNullSafe(h(k))
            return F.filter(order, lambda e, j: twin(j, j - 1) | twin(j, j + 1))

        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = F.sort_array(F.transform(F.transform(F.array(order), flagged)[0], lambda e: e["i"]))
        begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        add = lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")
        )
        covered = F.aggregate(starts, begin, add, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)

    def windows(hashed: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1))
        return F.transform(at, lambda i: F.xxhash64(F.slice(hashed, i, F.lit(WINDOW))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  computes value once
    return F.when(F.size(words) > WINDOW, once(once(hashed, windows), count)).otherwise(F.lit(0))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn(
        "_n",
        F.transform(
            F.array(F.struct(words_of(F.col("text")).alias("words"), lines.alias("lines"))),
            lambda x: F.struct(
                F.size(x["words"]).alias("n_words"),
                (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).alias("n_dup_lines"),
                repeated_words(x["words"]).alias("n_repeat_words"),
            ),
        )[0],
    )
    n, repeats = F.col("_n.n_words").cast("long"), F.col("_n.n_repeat_words").cast("long")
    return counted.withColumns(
        {
            "n_words": n,
            "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": F.col("_n.n_dup_lines").cast("long"),
            "n_repeat_words": repeats,
            "base_failed": (n < 20) | (100 * repeats > 30 * n),
        }
    ).drop("_n")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\s ]+", " "))


def line_facts(line: Column) -> Column:
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.struct(F.xxhash64(normalised(line)).alias("line"), words.alias("words"))


def with_lines(docs: DataFrame) -> DataFrame:
    """Adds _lines: hash and number of words of every line that has a word."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_facts)
    return docs.withColumn("_lines", F.filter(lines, lambda line: line["words"] > 0))


def text_facts(docs: DataFrame) -> DataFrame:
    """The one pass over the texts, written down: doc_id, host, key (the hash of the text), the base columns, _lines."""
    named = docs.select("doc_id", F.col("source").alias("host"), "text")
    facts = with_lines(with_base(named)).withColumn("key", F.xxhash64("text")).drop("text")
    return materialise(facts, "text-facts")


def frequent_lines(rows: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """host, line of the lines in more documents of their host than both limits; rows name host, line and the document's key."""
    once = rows.select("host", "line", "key").distinct()
    return _over_limits(once, rows.select("host", "key").distinct(), most_documents, most_share)


def _over_limits(once: DataFrame, documents: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """The same from rows that name a host's line once per document, and documents that are named once."""
    counts = once.groupBy("host", "line").agg(F.count("*").alias("documents"))
    common = counts.filter(F.col("documents") > most_documents)
    hosts = documents.groupBy(F.col("host").alias("_h")).agg(F.count("*").alias("_all"))
    ranked = common.join(hosts, common["host"].eqNullSafe(hosts["_h"]))
    limit = most_share * F.sqrt(F.lit(SHARE_AT) * F.col("_all"))
    return ranked.filter(F.col("documents") > limit).select("host", "line")


def removals(facts: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """host, key, n_removed (words in frequent lines), _frequent (their hashes) of the texts that hold some.

    Copies on one host are one text: they are counted once and lose the same lines.
    """
    texts = facts.select("host", "key", "_lines").dropDuplicates(["host", "key"])
    lines = F.array_distinct(F.transform("_lines", lambda line: line["line"]))
    once = texts.select("host", F.explode(lines).alias("line"))
    frequent = _over_limits(once, texts, most_documents, most_share)
    rows = texts.select("host", "key", F.explode("_lines").alias("l")).select("host", "key", "l.line", "l.words")
    same = F.col("r.line").eqNullSafe(F.col("f.line")) & F.col("r.host").eqNullSafe(F.col("f.host"))
    hits = rows.alias("r").join(frequent.alias("f"), same)
    return hits.groupBy(F.col("r.host").alias("_host"), F.col("r.key").alias("_key")).agg(
        F.sum("r.words").alias("n_removed"), F.collect_set("r.line").alias("_frequent")
    )


def with_verdict(facts: DataFrame, most_documents: int, most_share: float, most_removed: float) -> DataFrame:
    """Adds n_removed, _frequent (null for none) and kept to the facts."""
    found = removals(facts, most_documents, most_share)
    on = facts["host"].eqNullSafe(found["_host"]) & (facts["key"] == found["_key"])
    judged = facts.join(found, on, "left").drop("_host", "_key")
    judged = judged.withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    depleted = F.col("n_removed") > most_removed * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted)


def is_frequent(line: Column) -> Column:
    return F.coalesce(F.array_contains("_frequent", line), F.lit(False))


BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge_documents(
    docs: DataFrame,
    most_documents: int = MOST_DOCUMENTS,
    most_share: float = MOST_SHARE,
    most_removed: float = MOST_REMOVED,
) -> DataFrame:
    """doc_id, the base columns, kept, n_removed for every row. No text moves."""
    return with_verdict(text_facts(docs), most_documents, most_share, most_removed).select(
        F.col("doc_id").cast("long").alias("doc_id"), *BASE_COLUMNS, "kept", "n_removed"
    )


def filter_documents(
    docs: DataFrame,
    most_documents: int = MOST_DOCUMENTS,
    most_share: float = MOST_SHARE,
    most_removed: float = MOST_REMOVED,
) -> DataFrame:
    """The kept documents with all their columns, without their frequent lines; n_chars, if there, follows."""
    judged = with_verdict(text_facts(docs), most_documents, most_share, most_removed).filter("kept")
    # The verdict depends on host and text alone, so of repeated ones one is enough.
    verdicts = judged.select(F.col("host").alias("_host"), F.col("key").alias("_key"), "_frequent").dropDuplicates(["_host", "_key"])
    rows = docs.select(packed(docs)).withColumns({"_source": F.col("_row.source"), "_hash": F.xxhash64("_row.text")})
    found = rows.join(verdicts, F.col("_source").eqNullSafe(F.col("_host")) & (F.col("_hash") == F.col("_key")))
    old, untouched = F.col("_row.text"), F.col("_frequent").isNull()
    rest = F.filter(F.split(old, "\n", -1), lambda line: ~is_frequent(line_facts(line)["line"]))
    changed = {"text": F.when(untouched, old).otherwise(F.array_join(rest, "\n"))}
    if "n_chars" in docs.columns:
        length = F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(untouched, F.col("_row.n_chars")).otherwise(length)
    return found.select(*unpacked(docs, **changed))
