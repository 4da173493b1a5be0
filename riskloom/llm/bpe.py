"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if every token encodes to
itself and every pair of neighbours encodes to that pair. So an encoding can be grown
byte by byte: each prefix has one encoding, whose last token ends it and fits the
encoding of the shorter prefix before it. A state of the transducer holds every
position from which a longer token could still come: the trie node of the bytes since
then and the token that ends there. Each byte leads to one next state and one token
that ends at it. Tokens that lead to all open positions are certain and are emitted;
at most LOOKAHEAD bytes and one token wait. States are made when first reached and reused.

Null text counts as empty: no tokens. Repeated rows are encoded alike; other columns
are not looked at. Whole texts are encoded.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: States, token pairs and word results kept per worker; beyond it they are made anew.
MAX_STATES = 150_000
MAX_PAIRS = 300_000
MAX_WORDS = 150_000
#: Bytes after which certain tokens are emitted; well over the longest token.
LOOKAHEAD = 1024


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class State:
    __slots__ = ("after", "open")

    def __init__(self, open_: tuple) -> None:
        #: For each open position, oldest first: the trie node of the bytes since, which has children, and the
        #: token that ends there (-1: the start). The last one is the end itself.
        self.open = open_
        #: Byte to the next state and the token that ends there.
        self.after: dict[int, tuple[State, int]] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: token for token, i in ranks.items()}
        #: Trie of the tokens: node * 256 + byte to the next node, node to its token. 0 is the root.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.depth = {0: 0}
        for token, i in ranks.items():
            node = 0
            for n, byte in enumerate(token, 1):
                node = self.child.setdefault(node << 8 | byte, len(self.child) + 1)
                self.depth[node] = n
            self.token_at[node] = i
        #: Whether a node has children: from the others no longer token can come.
        self.inner = bytearray(len(self.child) + 1)
        for edge in self.child:
            self.inner[edge >> 8] = 1
        self.length = {i: len(token) for token, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Two tokens, as one number, to the token that their bytes are.
        self.many = max(ranks.values(), default=0) + 2
        self.joined: dict[int, int] = {}
        for token, i in ranks.items():
            for n in range(1, len(token)):
                left, right = ranks.get(token[:n]), ranks.get(token[n:])
                if left is not None and right is not None:
                    self.joined[left * self.many + right] = i
        self.fitting: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.states[(0, -1),] = State(((0, -1),))

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merges in rank order, by definition, until so many parts are left; for a token's bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (-1, -1) for a byte, None if no merges lead to it."""
        if token not in self.halves:
            data = self.bytes_of[token]
            left = self.merge(data, 2)
            made = len(left) == 2 and all(p in self.ranks for p in left)
            self.halves[token] = (-1, -1) if len(data) == 1 else (self.ranks[left[0]], self.ranks[left[1]]) if made else None
        return self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbours stay apart: no merge across their border comes before theirs.

        Takes the tokens apart again, the later merge first, and looks at the pair then at the border.
        """
        pair = left * self.many + right
        known = self.fitting.get(pair)
        if known is None:
            if len(self.fitting) > MAX_PAIRS:
                self.fitting.clear()
            known = self.fitting[pair] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        if self.parts(right) is None:
            return False
        if left < 0:
            return True
        before, many, joined, halves = sys.maxsize, self.many, self.joined, self.halves
        while True:
            if joined.get(left * many + right, sys.maxsize) < before:
                return False
            of_left = halves[left] if left in halves else self.parts(left)
            of_right = halves[right] if right in halves else self.parts(right)
            if of_left[0] >= 0 and (of_right[0] < 0 or left > right):
                before, left = left, of_left[1]
            elif of_right[0] >= 0:  # merges of one rank go from left to right
                before, right = right + 1, of_right[0]
            else:
                return True

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """The next state and the token that ends there; exactly one fits."""
        ended, open_ = -1, []
        child, token_at, fitting, many, inner = self.child, self.token_at, self.fitting, self.many, self.inner
        for position in state.open:
            node = child.get(position[0] << 8 | byte)
            if node is not None:
                last = position[1]
                if inner[node]:
                    open_.append((node, last))
                if ended < 0 and (token := token_at.get(node)) is not None:
                    fits = fitting.get(last * many + token)
                    if fits or fits is None and self.fits(last, token):
                        ended = token
        if ended < 0:
            raise ValueError("the vocabulary can't encode this byte")
        open_.append((0, ended))
        key = tuple(open_)
        following = self.states.get(key)
        if following is None:
            following = self.states[key] = State(key)
        return following, ended

    def trace(self, ends: list[int], at: int) -> list[int]:
        """Tokens up to a position, by the token that ends at each."""
        out, length = [], self.length
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def settled(self, ends: list[int], state: State) -> tuple[list[int], int]:
        """Tokens that lead to every open position, and their bytes: certain whatever follows."""
        depths = [self.depth[node] for node, _ in state.open]
        traces = [self.trace(ends, len(ends) - d) for d in depths]
        shared = []
        for at in zip(*traces):
            if len(set(at)) > 1:
                break
            shared.append(at[0])
        return shared, sum(len(self.bytes_of[t]) for t in shared)

    def stream(self, data: Iterable[int]) -> Iterator[list[int]]:
        """Tokens in lists, each as soon as it is certain and LOOKAHEAD bytes wait."""
        if len(self.states) > self.max_states:
            self._restart()
        state, ends = self.start, []
        for byte in data:
            following = state.after.get(byte)
            if following is None:
                following = state.after[byte] = self.step(state, byte)
            state, token = following
            ends.append(token)
            if len(ends) >= LOOKAHEAD:
                tokens, n = self.settled(ends, state)
                ends = ends[n:]
                yield tokens
        yield self.trace(ends, len(ends))

    def encode(self, data: bytes) -> list[int]:
        if len(data) >= LOOKAHEAD:
            return [token for tokens in self.stream(data) for token in tokens]
        if len(self.states) > self.max_states:
            self._restart()
        state, ends = self.start, []
        for byte in data:
            following = state.after.get(byte)
            if following is None:
                following = state.after[byte] = self.step(state, byte)
            state = following[0]
            ends.append(following[1])
        return self.trace(ends, len(ends))


class Encoder:
    """Splits text by the pattern and encodes each match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pieces = regex.compile(pattern).findall
        transducer = Transducer(ranks)

        class Words(dict):
            """What was encoded lately; when it is full, the words met since it was begun stay for another round."""

            older: dict = {}

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= MAX_WORDS:
                    self.older = dict(self)
                    self.clear()
                found = self.older.get(piece)
                if found is None:
                    found = array("I", transducer.encode(piece.encode())).tobytes()
                self[piece] = found
                return found

        self.words = Words()

    def encode(self, text: str) -> array:
        return array("I", b"".join(map(self.words.__getitem__, self.pieces(text))))


class Decoder:
    """Tokens to text as they come: the state is the start of an unfinished character."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {i: token for token, i in ranks.items()}
        #: Text of tokens that start and end between characters.
        self.whole: dict[int, str | None] = {}
        for i, token in self.bytes_of.items():
            try:
                self.whole[i] = token.decode()
            except UnicodeDecodeError:
                self.whole[i] = None
        self.after: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        """Finished characters and the new state; bytes that fit nowhere become U+FFFD."""
        if not pending and (text := self.whole[token]) is not None:
            return text, b""
        known = self.after.get((pending, token))
        if known is None:
            known = self.after[pending, token] = utf8_step(pending + self.bytes_of[token])
        return known

    def decode(self, ids) -> str:
        parts = list(map(self.whole.__getitem__, ids))
        if None in parts:
            pending, parts = b"", []
            for token in ids:
                text, pending = self.step(pending, token)
                parts.append(text)
            if pending:
                parts.append("�")
        return "".join(parts)


def utf8_step(data: bytes) -> tuple[str, bytes]:
    """UTF-8 by states: what is complete, and the unfinished rest of at most three bytes.

    A state is how many continuation bytes are due and the range of the next one.
    """
    out, at, begun = [], 0, 0
    due, low, high = 0, 0x80, 0xBF
    while at < len(data):
        byte = data[at]
        if not due:
            begun = at
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                due = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
            at += 1
        elif low <= byte <= high:
            due, low, high = due - 1, 0x80, 0xBF
            at += 1
            if not due:
                out.append(data[begun:at].decode())
        else:  # cut short: this byte begins anew
            out.append("�")
            due, low, high = 0, 0x80, 0xBF
    return "".join(out), data[begun:] if due else b""


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (the tokens) of every row."""
    ranks_file = _broadcast(docs, vocab_path)

    def make():
        encoder, _ = worker_tools(ranks_file.value, pattern)
        return lambda batch: {"doc_id": batch["doc_id"], "ids": [encoder.encode(t or "") for t in batch["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, text of every row of ids."""
    ranks_file = _broadcast(tokens, vocab_path)

    def make():
        _, decoder = worker_tools(ranks_file.value, None)
        return lambda batch: {"doc_id": batch["doc_id"], "text": [decoder.decode(i or []) for i in batch["ids"]]}

    return map_rows(tokens.select("doc_id", "ids"), make, "doc_id long, text string")


@lru_cache(maxsize=2)
def worker_tools(ranks_file: bytes, pattern: str | None) -> tuple[Encoder | None, Decoder]:
    """One encoder and decoder for all tasks of a Python worker.

    States live long and are many: the default thresholds would have them all searched for cycles over and over.
    """
    gc.set_threshold(100_000, 50, 100)
    ranks = read_ranks(ranks_file)
    return Encoder(ranks, pattern) if pattern else None, Decoder(ranks)


def _broadcast(df: DataFrame, vocab_path: str):
    """The rank file, of fixed size (below 1 MB), read once by the driver."""
    with open(vocab_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def token_digests(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""
    ranks_file = _broadcast(docs, vocab_path)

    def make():
        encoder, decoder = worker_tools(ranks_file.value, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def work(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch["text"]:
                ids = encoder.encode(text or "")
                decoded = decoder.decode(ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(digest(ids.tobytes()))
                out["decoded_sha256"].append(digest(decoded.encode()))
            return out

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)
