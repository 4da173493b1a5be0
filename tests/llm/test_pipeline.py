"""The whole pipeline against plain Python on a small table."""

import re
from collections import Counter

import corpus_pipeline
from riskloom.llm import pii, quality_rules

from .test_base_operators import CARD, EMAIL, IP, OWN, PHONE, SF, luhn, plain_base, plain_components, plain_print

PLAIN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE} | {
    kind: re.compile(pattern) for kind, pattern, _ in pii.RULES[4:]
}


def plain_lines(docs):
    """Frequent lines of each host, by the definition."""
    norm = lambda line: re.sub(r"[\s\xa0]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")
    seen, hosts = {}, {}
    for d in docs:
        lines = {norm(x) for x in (d.text or "").split("\n") if x.strip(" \t\n\v\f\r")}
        hosts.setdefault(d.source, set()).add(d.text)
        for line in lines:
            seen.setdefault((d.source, line), set()).add(d.text)
    limit = lambda host: max(quality_rules.MOST_DOCUMENTS, quality_rules.MOST_SHARE * len(hosts[host]))
    return {k for k, texts in seen.items() if len(texts) > limit(k[0])}


def plain_mask(text):
    def bare(m):
        return re.sub("[^0-9]", "", m[0])

    def rotated(iban):
        return iban[4:] + iban[:4]

    def score(kind, m, end_before, start_after):
        holds = {
            "email": lambda: True,
            "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
            "card": lambda: 12 <= len(bare(m)) <= 19 and luhn(bare(m)),
            "phone": lambda: 9 <= len(bare(m)) <= 15,
            "iban": lambda: int("".join(str(int(c, 36)) for c in rotated(m[0].replace(" ", "")))) % 97 == 1,
        }
        near = text[max(end_before, m.start() - 40) : m.start()] + " " + text[m.end() : min(start_after, m.end() + 40)]
        base = 0.4 if kind not in holds else 0.8 * holds[kind]()
        return base + 0.2 * bool(re.search(f"(?i)(?:^|[^a-z])(?:{pii.CONTEXT[kind]})(?:[^a-z]|$)", near))

    spans = []
    for kind, pattern in PLAIN.items():
        found = list(pattern.finditer(text))
        for i, m in enumerate(found):
            before = found[i - 1].end() if i else 0
            after = found[i + 1].start() if i + 1 < len(found) else len(text)
            if score(kind, m, before, after) >= pii.NEEDED:
                spans.append((m.start(), m.end(), kind))
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not plain_lines(docs)
    kept = {d.doc_id: d.text for d in docs if not plain_base(d.text)[-1]}
    prints = {i: plain_print(t) for i, t in kept.items()}
    roots = plain_components(sorted(kept), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    kept = {i: t for i, t in kept.items() if not any(x in t for x in items)}
    want = {i: OWN.encode_ordinary(plain_mask(t)) for i, t in kept.items()}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns_and_survive_untidy_rows(spark):
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (None, "w " * 30, "en", "a", 60), (None, None, None, None, None),
        (3, " ".join(f"t{chr(97 + i)}" for i in range(26)), "en", "a", 77), (3, " ".join(f"t{chr(97 + i)}" for i in range(26)), "en", "a", 77),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.filter("false")):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()]
        assert Counter(ids) == (Counter([3]) if start is docs else Counter())


def test_pipeline_removes_lines_and_depleted_documents(spark, tmp_path):
    """A line on every page of a small host goes, and a page of little else goes as a whole."""
    word = lambda i, k: f"w{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}"
    body = lambda i, n: " ".join(word(i, k) for k in range(n))
    footer = " ".join(f"foot{chr(97 + k)}" for k in range(20))
    rows = [(i, f"{body(i, 200)}\n{footer}", "en", "small", 0) for i in range(5)]
    rows += [(5, f"{body(5, 6)}\n{footer}", "en", "small", 0), (6, f"{body(6, 200)}\n{footer}", "en", "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, "an item that no document holds. Not at all")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i: body(i, 200) for i in range(5)} | {6: rows[6][1]}
    assert got == {i: OWN.encode_ordinary(t) for i, t in want.items()}
