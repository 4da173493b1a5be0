"""Secret scan: base patterns, plus random strings by token efficiency.

Random strings take many tokens under a vocabulary made for language, so few
characters per token expose them. Candidates are runs of key characters; digests of
known lengths, UUIDs, times and strings without letters are left out, and letters without digits
unless a capital follows a small letter: prose has runs of one case that take as many tokens.
Short strings and those without digits must pass a stricter limit.

A null text counts as empty and has no spans. Repeated rows are scanned alike; other
columns are not looked at. Whole texts are scanned, in time linear in their length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, span_digests

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_HINT = re.compile(r"pass|secret|token|api", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
#: Strings below so many characters, and those without digits, must have so many fewer characters per token.
SHORT = 20
STRICTER = 0.4
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
KNOWN = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9-]+(T[0-9]+Z?)?")
KINDS = ["assign", "access", "hex", "random"]
BASE = KINDS[:3]
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoding(ranks_file: bytes):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(text: str) -> bool:
    """A digest, identifier or time, or without letters, or without digits and unmixed in case."""
    return bool(
        KNOWN.fullmatch(text)
        or (len(text) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text))
        or not re.search("[0-9]|[a-z][A-Z]", text)
        or not re.search("[A-Za-z]", text)
    )


def scan(text: str, ratio: Callable[[str], float], most: float) -> list[dict]:
    """All spans of one text."""
    spans = []
    if ASSIGN_HINT.search(text):
        spans += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    # Base spans that begin no later than the candidate, as both go through the text: does one reach over its end?
    taken, at, reach = sorted((a, b) for _, a, b, _ in spans), 0, -1
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] <= m.start():
            reach = max(reach, taken[at][1])
            at += 1
        if reach < m.end() and not known(m[0]):
            per_token = ratio(m[0])
            strict = len(m[0]) < SHORT or not re.search("[0-9]", m[0])
            if per_token <= most - STRICTER * strict:
                spans.append(("random", *m.span(), per_token))
    return [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans]


def find_secrets(docs: DataFrame, vocab_path: str, most_chars_per_token: float = 2.2) -> DataFrame:
    """doc_id and its spans; score: characters per token of random strings, 1 for base kinds."""
    # The vocabulary has a fixed size, below 1 MB; workers need no file of their own.
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))

    def make():
        encoding = _encoding(ranks.value)
        ratio = lambda s: len(s) / len(encoding.encode_ordinary(s))

        def work(batch: dict[str, list]) -> dict[str, list]:
            found = [scan(t or "", ratio, most_chars_per_token) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "spans": found}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, SPANS)


def secret_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    return span_digests(find_secrets(docs, vocab_path), KINDS, BASE, ["doc_id"])
