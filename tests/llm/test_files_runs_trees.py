"""Token files, periodic runs and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import decontaminate, langid, line_crf, merkle, periodic_runs, pii, quality_rules, secret_scan, simhash
from riskloom.llm import token_files, url_filter
from riskloom.llm.queries import QUERIES, TOKENIZER
from tests.llm.test_base_operators import SF, empty, messy, plain_base, rows_of  # noqa: F401  fixtures
from tests.llm.test_pipeline import plain_mask

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(value):
    return (value is not None, value or 0)


# --- language identification: a plain version --------------------------------


def plain_languages(docs):
    """(doc_id, lang_pred): words, then ever shorter n-grams, by the definition and without batches."""
    letters = re.compile(r"[^\W\d_]+")
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(max(1, len(w) + 3 - n))]
    counts = {n: {} for n in (0, *langid.ORDERS)}
    for d in docs:
        if d.lang is None or d.text is None or zlib.crc32(("" if d.doc_id is None else str(d.doc_id)).encode()) % 5 == 0:
            continue
        for word in letters.findall(d.text.lower()):
            counts[0].setdefault(d.lang, Counter())[word] += 1
            for n in langid.ORDERS:
                counts[n].setdefault(d.lang, Counter()).update(grams(word, n))
    languages = sorted(counts[0])
    floor = math.log(langid.LEAST_SHARE * langid.UNSEEN)
    logs = {n: {} for n in counts}
    for n, by_lang in counts.items():
        for lang, seen in by_lang.items():
            total = sum(seen.values())
            for gram, times in seen.items():
                if times / total >= langid.LEAST_SHARE:
                    logs[n].setdefault(gram, dict.fromkeys(languages, floor))[lang] = math.log(times / total)
    known = {}

    def score(word):
        if word not in known:
            found = [logs[0][word]] if word in logs[0] else []
            for n in langid.ORDERS:
                found = found or [logs[n][g] for g in grams(word, n) if g in logs[n]]
            known[word] = {x: sum(f[x] for f in found) / len(found) if found else 0.0 for x in languages}
        return known[word]

    out = {}
    for d in docs:
        words = [score(w) for w in letters.findall((d.text or "").lower())]
        total = {x: sum(w[x] for w in words) for x in languages}
        best = max(languages, key=lambda x: (total[x], [-ord(c) for c in x])) if words else None
        out[d.doc_id] = (best, 1 / sum(math.exp(total[x] - total[best]) for x in languages)) if words else ("und", 0.0)
    return out


def test_languages_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = plain_languages(docs.collect())
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_documents(docs).collect()}
    assert got.keys() == expected.keys()
    assert all(got[i][0] == expected[i][0] and abs(got[i][1] - expected[i][1]) < 1e-4 for i in got)


def test_words_are_scored_alike_in_any_pieces(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    texts = [r.text for r in docs.select("text").collect()] + [None, "", "12 !", "zzzq ßßß \u4e2d\u6587"]
    whole = langid.Scorer(model).predict(texts)
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(langid, "CACHE", 20)
    pieces = langid.Scorer(model).predict(texts)
    assert [x for x, _ in whole] == [x for x, _ in pieces] and whole[-4:-1] == [("und", 0.0)] * 3
    assert all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(whole, pieces))


# --- rules, secrets, personal data: verdicts and time --------------------------


def test_verdicts_where_lines_go_and_documents_are_depleted(spark):
    """The whole verdict against the definition, on hosts where lines are frequent."""
    draw = random.Random(5)
    line = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k))
    rows = []
    for i in range(260):
        host = ["big", "big", "small", None][i % 4]
        shared = [line(f"s{draw.randrange(12) ** 2}", 8) for _ in range(draw.randrange(9))]
        own = [line(f"o{i}_{n}", 7) for n in range(draw.randrange(12))]
        text = "\n".join(draw.sample(shared + own, len(shared) + len(own)))
        rows.append((i, text, host))
        if i % 9 == 0:
            rows.append((1000 + i, text, host))
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string")
    texts, holders = {}, {}
    for _, text, host in rows:
        texts.setdefault(host, set()).add(text)
        for x in set(text.split("\n")) - {""}:
            holders.setdefault((host, re.sub("[0-9]", "0", x)), set()).add(text)
    limit = {h: max(quality_rules.MOST_DOCUMENTS, quality_rules.MOST_SHARE * math.sqrt(quality_rules.SHARE_AT * len(t))) for h, t in texts.items()}
    frequent = {k for k, t in holders.items() if len(t) > limit[k[0]]}
    expected = Counter()
    for i, text, host in [*rows, rows[5]]:
        base = plain_base(text)
        removed = sum(len(x.split()) for x in text.split("\n") if (host, re.sub("[0-9]", "0", x)) in frequent)
        expected[i, not base[-1] and not removed > quality_rules.MOST_REMOVED * base[0], removed] += 1
    got = Counter((r.doc_id, r.kept, r.n_removed) for r in quality_rules.judge_documents(docs).collect())
    assert got == expected
    assert sum(r[2] > 0 for r in expected) > 50 and sum(r[2] > 0 and not r[1] for r in expected) > 3
    kept = {r.doc_id: r.text for r in quality_rules.filter_documents(docs).collect()}
    assert kept.keys() == {i for i, ok, _ in expected if ok}
    for i, text, host in rows:
        if i in kept:
            assert kept[i] == "\n".join(x for x in text.split("\n") if (host, re.sub("[0-9]", "0", x)) not in frequent)


def test_many_secrets_take_time_in_proportion():
    def seconds(n):
        text = " ".join(f"{i:032x} Zx8Kq2Lm9Vt4Rw7Yp1Nd{i}" for i in range(n))
        begun = time.perf_counter()
        assert len(secret_scan.scan(text, lambda s: 1.0, 2.2)) == 2 * n
        return time.perf_counter() - begun

    seconds(100)
    assert seconds(16_000) < 14 * seconds(2_000)


@pytest.mark.parametrize("kinds", [["email"], ["email", "ip", "card"]])
def test_many_hits_in_one_text(spark, kinds):
    """Spans and masks of a text with more hits than two levels of blocks hold, and in time near proportion."""
    shown = {"email": lambda i: f"user{i}@host{i}.org", "ip": lambda i: f"10.0.{i % 256}.7", "card": lambda i: "4111 1111 1111 1111"}

    def text_of(n):
        return " é ".join(shown[kinds[i % len(kinds)]](i) + "x" * (i % 3) for i in range(n))

    seconds = {}
    for n in (500, 1000, 8000):
        text = text_of(n)
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        masked = pii.mask_documents(docs).first().text
        seconds[n] = time.perf_counter() - begun
        assert masked == plain_mask(text)
        spans = pii.find_personal_data(docs).first().spans
        assert len(spans) == masked.count("<")
    assert seconds[8000] < 16 * seconds[1000]


# --- token files -------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(
    st.integers(1, 40), st.integers(1, token_files.BLOCK), st.sampled_from([1, 2, 1000, 50_257, 2**32 - 1]),
    st.integers(0, 2**32 - 1), st.integers(0, 5),
)
def test_blocks_round_trip(rows, count, most, seed, outliers):
    draw = np.random.default_rng(seed)
    ids = draw.integers(0, most, (rows, count), dtype=np.uint64, endpoint=True).astype(np.uint32)
    ids[:, draw.integers(0, count, outliers)] = 2**32 - 1
    for row, data in zip(ids, token_files.pack_blocks(ids)):
        assert (token_files.unpack_block(data) == row).all()


def test_width_is_the_percentile_and_the_rest_are_exceptions():
    ids = np.arange(1000, 2024, dtype=np.uint32)[None] % 256 + 7
    ids[0, :40] = 1 << 20
    (data,) = token_files.pack_blocks(ids)
    head = np.frombuffer(data, token_files._BLOCK_HEAD, 1)[0]
    assert (head["low"], head["width"], head["exceptions"]) == (7, 8, 40)
    assert len(data) == token_files._BLOCK_HEAD.itemsize + 1024 + 40 * 2 + 40 * int(head["high_bytes"])


def test_pieces_are_those_of_the_library():
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read())
    pattern = regex.compile(public_tokenizers.PATTERN)
    draw = random.Random(3)
    plain = [c for c in map(chr, [*range(9, 14), *range(32, 0x250), *range(0x2010, 0x2028)]) if token_files.PLAIN.fullmatch(c)]
    odd = list("字éλ😀\x85\x1c  ²½́") + ["<|endoftext|>"]
    for i in range(4000):
        some = plain if i % 4 else plain + odd * 20
        text = "".join(draw.choice(some) if draw.random() < 0.6 else draw.choice(" 's'll\n\t_1aé") for _ in range(draw.randint(0, 30)))
        if token_files.PLAIN.fullmatch(text):
            assert pattern.findall(text) == token_files.PIECES.findall(text)
        assert list(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def expected_tokens(docs):
    """(doc_id, n_tokens, crc) in file order, and all ids; rows that share an id stand in any order here."""
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    return {r: array("I", library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in docs}


def test_token_files(spark, messy, empty):  # noqa: F811
    docs = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    ids = expected_tokens(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a shard per range, however small
    folder = token_files.write_token_files(messy, TOKENIZER)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(token_files.read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d[0] for d in docs), key=by_id)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:n]) for n in range(len(got))]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (d[0], len(ids[d]), zlib.crc32(ids[d].tobytes())) for d in docs
    )
    full = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in full) == Counter((d[0], tuple(ids[d])) for d in docs)
    flat = [i for r in full for i in r.ids]
    shards = token_files.manifest(spark, folder).collect()
    assert sum(s.n_ids for s in shards) == len(flat) and sum(s.n_docs for s in shards) == len(docs) and len(shards) > 1
    draw = random.Random(2)
    cuts = [(n, draw.randrange(len(flat)), draw.choice([0, 1, 1024, 5000, len(flat)])) for n in range(20)]
    windows = spark.createDataFrame(cuts, "window long, start long, length long")
    found = {r.window: list(r.ids) for r in token_files.read_windows(spark, folder, windows).collect()}
    assert found == {n: flat[s : s + length] for n, s, length in cuts if length}
    assert rows_of(token_files.token_file_digests(empty, TOKENIZER)) == Counter()


def test_files_that_no_manifest_names_do_not_count(spark, messy):  # noqa: F811
    """A task that ran twice leaves a file of its own."""
    folder = token_files.write_token_files(messy.limit(20), TOKENIZER)
    before = rows_of(token_files.read_digests(spark, folder))
    store, path = token_files.opened(folder)
    with store.open_output_stream(f"{path}/shard-000000-lost.pfor") as sink:
        sink.write(b"half a file")
    assert rows_of(token_files.read_digests(spark, folder)) == before
    with pytest.raises(Exception, match="not a whole shard"):
        token_files.Shard(_Bytes(b"x" * 100))


class _Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


# --- periodic runs -----------------------------------------------------------


def brute_runs(words, least=6, exponent=4):
    """Every stretch that keeps a period and no neighbour extends; those with a smaller period are not its own."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q):
                if not any(all(words[x] == words[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


words_strategy = st.lists(st.sampled_from("abc"), max_size=25)
block = st.tuples(words_strategy, st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 9))
documents = st.lists(st.lists(block, max_size=4).map(lambda bs: [w for a, u, n in bs for w in a + u * n]), min_size=1, max_size=5)


@settings(max_examples=150, deadline=None)
@given(documents)
def test_runs_equal_brute_force(docs):
    assert periodic_runs.find_runs(docs) == [brute_runs(d) for d in docs]


@settings(max_examples=80, deadline=None)
@given(documents, st.sampled_from([2, 3]))
def test_runs_of_fewer_periods(docs, exponent):
    assert periodic_runs.find_runs(docs, 2, exponent) == [brute_runs(d, 2, exponent) for d in docs]


def test_packs_and_chunks_change_nothing(monkeypatch):
    draw = random.Random(8)
    docs = [[draw.choice("abcd") for _ in range(draw.randint(0, 80))] * draw.randint(1, 6) for _ in range(30)]
    whole = periodic_runs.find_runs(docs)
    assert whole == [brute_runs(d) for d in docs]
    monkeypatch.setattr(periodic_runs, "PACK", 50)
    monkeypatch.setattr(periodic_runs, "LISTED", 7)
    assert periodic_runs.find_runs(docs) == whole


def test_long_runs_take_no_square_of_time():
    text = ["a"] * 200_000 + ["b", "c"] * 100_000
    assert periodic_runs.find_runs([text]) == [[(0, 200_000, 1), (200_000, 200_000, 2)]]


def brute_run_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words) if n < 3000 else [r for r in periodic_runs.find_runs([words])[0]]
    dropped = {w for s, length, q in runs for w in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_run_digests(spark, messy, empty):  # noqa: F811
    docs = messy.select("doc_id", "text").collect()
    assert rows_of(periodic_runs.run_digests(messy)) == Counter(brute_run_row(*r) for r in docs)
    assert rows_of(periodic_runs.run_digests(empty)) == Counter()
    given_docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = given_docs.filter(F.length("text") < 6000)
    expected = Counter(brute_run_row(*r) for r in short.select("doc_id", "text").collect())
    assert rows_of(periodic_runs.run_digests(short)) == expected and sum(r[1] > 0 for r in expected) > 3


def test_collapse_keeps_other_columns(messy):  # noqa: F811
    out = periodic_runs.collapse_runs(messy)
    assert out.columns == messy.columns
    expected = Counter()
    for row in messy.collect():
        words = WORD.findall(row.text or "")
        runs = periodic_runs.find_runs([words])[0]
        gone = {w for s, n, q in runs for w in range(s + q, s + n)}
        text = " ".join(w for i, w in enumerate(words) if i not in gone) if runs else row.text
        expected[tuple(text if c == "text" else row[c] for c in messy.columns)] += 1
    assert rows_of(out) == expected
    found = {r.doc_id: r.runs for r in periodic_runs.document_runs(messy).collect()}
    assert found[9001] == [] and len(found[9007]) >= 1


# --- Merkle manifest -----------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    shown = ["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS]
    return H(*shown)


def levels_over(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    for level in levels[:-1]:
        begin = at // 8 * 8
        yield at - begin, level[begin:at] + level[at + 1 : begin + 8]
        at //= 8


def brute_proofs(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (by_id(r["doc_id"]), leaf_of(r)))
        trees.append(levels_over([leaf_of(r) for r in groups[name]]))
    top = levels_over([t[-1][0] for t in trees])
    out = Counter()
    for g, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = [*siblings(trees[g], i), *siblings(top, g)]
            changed = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                changed["text"] = row["text"].translate(LOWER)
            folded = leaf_of(changed)
            for place, others in path:
                folded = H(*others[:place], folded, *others[place:])
            proof = H(*[s for _, others in path for s in others])
            root = top[-1][0]
            out[row["doc_id"], leaf_of(row), trees[g][-1][0], root, proof, folded, folded == root] += 1
    return out


@pytest.mark.parametrize("height", [1, 2, 4])
def test_proofs(messy, empty, height):  # noqa: F811
    """Trees of one to three tiers; null and many groups, null and repeated ids, repeated rows."""
    docs = messy.withColumn("n_chars", F.length("text"))
    for name in ("tree", "position", "total", "digest", "claim"):
        docs = docs.withColumn(name, F.lit(1))
    assert rows_of(merkle.tamper_digests(docs, height)) == brute_proofs([r.asDict() for r in docs.collect()])
    many = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("é"), F.col("doc_id") % 17)))
    if height == 1:
        assert rows_of(merkle.tamper_digests(many, height)) == brute_proofs([r.asDict() for r in many.collect()])
        assert rows_of(merkle.tamper_digests(empty.withColumn("n_chars", F.lit(1)), height)) == Counter()


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(1, "Text", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.tamper_digests(docs).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H()


def test_addresses_are_a_van_emde_boas_order():
    """Every place once; the upper half first, then each lower tree in one piece."""
    for height in range(6):
        places = merkle.addresses(height)
        assert sorted(np.concatenate(places)) == list(range(merkle.tree_size(height + 1)))
    upper = merkle.tree_size(2)
    places = merkle.addresses(4)
    assert set(np.concatenate(places[:2])) == set(range(upper))
    size = merkle.tree_size(3)
    for n in range(64):
        below = np.concatenate([places[2][n : n + 1], places[3][8 * n : 8 * n + 8], places[4][64 * n : 64 * n + 64]])
        assert set(below) == set(range(upper + n * size, upper + (n + 1) * size))


def test_changed_leaf_is_found(spark):
    """The general interface: build once, prove some rows later."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    built = merkle.document_manifest(docs, height=2)
    some = built.leaves.filter("doc_id % 50 = 0").withColumn("claim", F.when(F.col("doc_id") == 50, F.unhex(F.lit("00" * 32))).otherwise(F.col("digest")))
    out = merkle.checked(merkle.proofs(built, some, ["doc_id", "claim"]), "claim", ["doc_id"]).collect()
    assert {r.doc_id: r.verified for r in out} == {i: i != 50 for i in range(0, 200, 50)}
    assert {r.root for r in out} == {built.root().first().top.hex()}


@pytest.mark.parametrize("name", ["op11_token_files", "op12_periodic_runs", "op13_merkle"])
def test_queries_give_a_row_per_document(spark, name):
    assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == 200


# --- decontamination and near-dedup: shards, passes, shared and missing ids -------


def test_items_of_many_lengths_in_shards_and_passes(spark, monkeypatch):
    """Items from 12 to 700 words: whole ones are found wherever they stand, halves and strangers are not; any number of shards and passes."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    made = [[word() for _ in range(n)] for n in [12, 40, 64, 65, 130, 300, 700] * 20]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "item_id long, text string")
    texts, want = [], set()
    for i in range(0, len(made), 3):
        around = [word() for _ in range(draw.randrange(900))]
        at = draw.randrange(len(around) + 1)
        texts.append(" ".join(around[:at] + made[i] + around[at:]))
        want.add((len(texts) - 1, i))
    texts += [" ".join(w[: len(w) // 2]) for w in made[1::3]] + [" ".join(word() for _ in range(800)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shard, passes in ((decontaminate.SHARD, 8), (15, 2)):
        monkeypatch.setattr(decontaminate, "PASS", passes)
        found = decontaminate.contaminated(docs, bench, shard=shard).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
        clean = {r.doc_id for r in decontaminate.without_contaminated(docs, bench, shard=shard).collect()}
        assert clean == set(range(len(texts))) - {d for d, _ in want}


def test_postings_are_the_weights(monkeypatch):
    """Also when passages are cut into many parts."""
    draw = np.random.default_rng(9)
    items = [(i, " ".join(draw.choice([f"t{k}" for k in range(90)], 15))) for i in range(200)]
    frequency = Counter(t for _, x in items for t in set(x.split()))
    index = decontaminate.Index(items, frequency, len(items), 15.0, 0.4)
    dense = index.weights
    assert np.allclose(dense.sum(axis=0), 1.0)
    passages = [np.unique(draw.integers(0, len(index.place), 50)) for _ in range(60)]
    query = np.repeat(np.arange(60), [len(x) for x in passages]), np.concatenate(passages)
    want = {(p, int(i)) for p, x in enumerate(passages) for i in np.flatnonzero(dense[x].sum(axis=0) >= 0.4)}
    for at_once in (decontaminate.AT_ONCE, 100):
        monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
        assert {(p, i) for p, i, _ in index.scored(*query)} == want


def test_links_through_rows_that_share_an_id_or_have_none(spark, monkeypatch):
    """Components of fingerprints, named by ids afterwards; of each one document stays."""
    far, near = (1 << 40) - 1, lambda n: (1 << n) - 1
    prints = [
        (1, near(0), 10), (None, near(4), 11), (3, near(8), 12),  # 3 hangs on 1 by a row without an id
        (5, far, 13), (5, far ^ near(20) << 44, 14), (7, far ^ near(20) << 44 ^ 1, 15),  # one id in two groups
        (5, far ^ 1, 16), (None, near(30) << 34, 17),
    ]
    signed = [(i, p - (1 << 64) if p >> 63 else p, h) for i, p, h in prints]
    made = spark.createDataFrame(signed, "doc_id long, print long, text_hash long")
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs: made)
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(made).collect())
    assert got == Counter([(1, 1), (None, 1), (3, 1), (5, 5), (5, 5), (7, 5), (5, 5), (None, None)])


def test_texts_that_share_an_id_are_kept_apart(spark):
    body = lambda c: " ".join(f"{c}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80))
    rows = [(5, body("x"), 1), (5, body("y"), 2), (5, body("y"), 3), (6, body("x"), 4), (None, body("z"), 5), (None, body("y"), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(5, body("x")), (5, body("y")), (None, body("z")), (None, body("y"))]
    )


# --- urls and line quality ---------------------------------------------------------


def test_vocabulary_from_a_table(spark):
    """Terms of several languages, of both kinds, without a kind; repeated rows and very long urls."""
    terms = [("Glücksspiel", "strict"), ("wette", "soft"), ("apuesta", "soft"), ("wette", "strict"), ("pari", None), (None, "soft"), ("bonus", "soft")]
    vocabulary = spark.createDataFrame(terms, "term string, kind string")
    long = "http://a.org/" + "x" * 200_000
    urls = {
        1: "http://a.org/glücksspiel/1", 2: "http://a.org/wette", 3: "http://a.org/apuesta", 4: "http://a.org/apuesta-bonus",
        5: "http://a.org/apuestas/bonus", 6: "http://a.org/pari/casino", 7: long + "/wette", 8: long + "wette", 9: None,
        10: "http://x.net/fr/1", 11: "no url wette",
    }
    rows = [*urls.items(), (2, urls[2]), (7, urls[7])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = Counter((r.page_id, r.verdict) for r in url_filter.judge_by_table(pages, vocabulary).collect())
    blocked = {1, 2, 4, 7, 10}
    assert got == Counter((i, "block" if i in blocked else "allow") for i, _ in rows)
    none = url_filter.judge_by_table(pages, vocabulary.filter("false")).collect()
    assert {r.page_id for r in none if r.verdict == "block"} == {10}


def plain_line_features(line):
    groups = {c: n for n, group in enumerate(line_crf.GROUPS, 1) for c in group}
    count = [0] * line_crf.N_CLASSES
    for c in line:
        if c in " \t\n\v\f\r":
            kind = line_crf.SPACE
        elif c in groups:
            kind = groups[c]
        elif ord(c) >= 0x80 and ord(c) < 0xFFFF and c.isalpha():
            kind = line_crf.OTHER_UPPER if c.isupper() else line_crf.OTHER_LOWER
        else:
            kind = line_crf.SPACE if ord(c) >= 0x80 and c.isspace() else line_crf.REST
        count[kind] += 1
    words, n = line.split(), max(len(line), 1)
    share = max(len(words), 1)
    ends = line.rstrip()[-1:] in (".", "?", "!", ":", '"')
    return [x / n for x in count] + [math.log1p(len(words)), len(set(words)) / share, len(line) / share / 10, float(ends), float(not words)]


def plain_quality(model, text):
    """The chain one line at a time, with sums of products instead of logarithms of arrays."""
    lines = (text or "").split("\n")
    own = [(np.array(plain_line_features(x)) - model["mean"]) / model["scale"] for x in lines]
    nothing = np.zeros(line_crf.N_FEATURES)
    unary = []
    for i, x in enumerate(own):
        before, after = own[i - 1] if i else nothing, own[i + 1] if i + 1 < len(own) else nothing
        unary.append(float(np.concatenate([x, before, after, [i == 0, i + 1 == len(own), 1.0]]) @ model["weights"]))
    moves = model["moves"]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward = [[0.0, unary[0]]]
    for u in unary[1:]:
        a = forward[-1]
        forward.append([add(a[0] + moves[0][j], a[1] + moves[1][j]) + u * j for j in (0, 1)])
    back = [[0.0, 0.0]]
    for u in reversed(unary[1:]):
        b = back[0]
        back.insert(0, [add(moves[i][0] + b[0], moves[i][1] + u + b[1]) for i in (0, 1)])
    total = add(*forward[-1])
    ones = [math.exp(f[1] + b[1] - total) for f, b in zip(forward, back)]
    weights = [max(len(x), 1) for x in lines]
    mean = sum(o * w for o, w in zip(ones, weights)) / sum(weights)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(math.log(mean / (1 - mean)) * model["line"][0] + model["line"][1])))


def test_line_quality_equals_a_plain_chain(spark, messy):  # noqa: F811
    """Every score of the query; labels that are repeated teach once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = line_crf.train(docs, labels.filter(~line_crf.held_out(F.col("doc_id"))))
    both = {r.doc_id: r.score for r in line_crf.judge_documents(docs, labels.union(labels)).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert both.keys() == texts.keys()
    assert all(abs(both[i] - plain_quality(model, t)) < 1e-6 for i, t in texts.items())
    odd = messy.filter("doc_id >= 9000").select("doc_id", "text")
    got = {r.doc_id: r.score for r in line_crf.score_documents(odd, model).collect()}
    assert all(abs(got[r.doc_id] - plain_quality(model, r.text)) < 1e-6 for r in odd.collect())
