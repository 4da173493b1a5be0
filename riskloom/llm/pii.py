"""Personal data by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans; Luhn, mod 97, digit counts and value ranges confirm them; words
just before or after raise the score. Base kinds (email, ip, card, phone) count once
confirmed. IBANs need their checksum; national numbers and local phone numbers, which
have none, need a context word.

Positions come from the gaps between matches: split() and regexp_extract_all() walk the
text by the same matcher, so each start is a sum of lengths. Loops in the patterns are
possessive, so very long runs neither backtrack nor deepen the stack. Sums are folded in blocks and texts are
cut by pieces, so a text with many hits takes time in proportion to them.

A null text counts as empty and has no spans. Repeated rows are treated alike; other
columns are passed through by mask_documents and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, span_digests, unpacked

LOCAL = r"[A-Za-z0-9._%+-]"
#: Kind to pattern. A guard keeps a failed run from being tried again at each of its characters;
#: \G lets a match begin right behind the one before.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
KINDS = ["email", "ip", "card", "phone", "iban", "national", "local_phone"]
BASE = KINDS[:4]
#: Words that speak for a kind when they stand within CONTEXT_CHARS of it.
CONTEXT = {
    "email": "e-?mail|contact|write to",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|tel|call|fax|mobile|whatsapp",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "national": "ssn|social security|tax id|national id|sozialversicherung",
    "local_phone": "phone|tel|call|fax|mobile|whatsapp",
}
CONTEXT_CHARS = 40
#: Elements folded in one go, and code points of a piece of text.
BLOCK = 64
PIECE = 512
#: Score of a confirmed span and of one whose form alone speaks for it; what context adds; what is needed.
CONFIRMED, FORM_ONLY, CONTEXT_BONUS, NEEDED = 0.8, 0.4, 0.2, 0.6


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def add(total: Column, at: Column) -> Column:
        value = F.substring(digits(match), -at, F.lit(1)).cast("int") * F.when(at % 2 == 0, 2).otherwise(1)
        return total + F.when(value > 9, value - 9).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits(match))), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's letters and digits leave 1 when divided by 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (F.aggregate(moved, F.lit(0), add) == 1)


def small_parts(match: Column) -> Column:
    """Whether all four numbers are at most 255."""
    small = "^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
    return F.forall(F.split(match, r"\."), lambda part: part.rlike(small))


def _between(low: int, high: int):
    return lambda match: F.length(digits(match)).between(low, high)


#: Kind, pattern, confirmation (None: the form alone).
RULES = [
    ("email", EMAIL, lambda match: F.lit(True)),
    ("ip", IP, small_parts),
    ("card", CARD, lambda match: _between(12, 19)(match) & luhn(match)),
    ("phone", PHONE, _between(9, 15)),
    ("iban", IBAN, mod97),
    ("national", NATIONAL, None),
    ("local_phone", LOCAL_PHONE, None),
]


def no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, not wherever it is named."""
    return F.transform(F.array(value), use)[0]


def scanned(values: Column, add, zero: int, levels: int = 2) -> Column:
    """For each element of a filled array of int the fold of those before it.

    A fold that appends copies all it has at each step, so arrays are cut into blocks of BLOCK: each is folded by itself,
    and the blocks' totals in the same way, so the time is linear.
    """

    def plain(part: Column) -> Column:
        begin = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(
            add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        )
        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    if not levels:
        return plain(values)

    def by_blocks(all_: Column) -> Column:
        count = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda n: F.slice(all_, n * BLOCK + 1, F.lit(BLOCK)))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(zero), add))
        return _once(
            scanned(totals, add, zero, levels - 1),
            lambda base: F.flatten(
                F.transform(blocks, lambda block, n: F.transform(plain(block), lambda x: add(base[n], x)))
            ),
        )

    return _once(_once(values, by_blocks), joined)


def spans_of(text: Column, kind: str, pattern: str, confirm) -> Column:
    """Spans of one kind: array of (kind, start, end, score), code points, end exclusive."""
    near = f"(?i)(?:^|[^a-z])(?:{CONTEXT[kind]})(?:[^a-z]|$)"

    def collect(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]

        def span(begin: Column, match: Column, i: Column) -> Column:
            start = begin + F.length(gaps[i])
            around = F.concat_ws(" ", F.right(gaps[i], F.lit(CONTEXT_CHARS)), F.left(gaps[i + 1], F.lit(CONTEXT_CHARS)))
            base = F.lit(FORM_ONLY) if confirm is None else F.when(confirm(match), CONFIRMED).otherwise(0.0)
            score = base + F.when(around.rlike(near), CONTEXT_BONUS).otherwise(0.0)
            end = start + F.length(match)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

        lengths = F.transform(hits, lambda match, i: F.length(gaps[i]) + F.length(match))
        return _once(
            scanned(lengths, lambda a, b: a + b, 0),
            lambda begins: F.filter(
                F.transform(hits, lambda match, i: span(begins[i], match, i)), lambda s: s["score"] >= NEEDED
            ),
        )

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )
    return F.when(text.rlike(pattern), _once(found, collect)).otherwise(no_spans())


def all_spans(text: Column) -> Column:
    return F.coalesce(F.concat(*[spans_of(text, *rule) for rule in RULES]), no_spans())


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of its text."""
    return docs.select(F.col("doc_id").cast("long"), all_spans(F.col("text")).alias("spans"))


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that a place in it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end (exclusive)."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    at = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
    within = F.substring(at(first), start - first * PIECE + 1, end - start)
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(at(first), start - first * PIECE + 1, F.lit(PIECE)), middle, F.left(at(last), end - last * PIECE))
    return F.when(first == last, within).otherwise(across)


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by <kind>; of overlapping spans the first names the whole."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )

    def replaced(found: Column) -> Column:
        in_order, pieces = found["spans"], found["pieces"]

        def joined(reached: Column) -> Column:
            """reached: how far the spans before each one go. Those that begin beyond start anew."""
            before = lambda s, i: F.concat(cut(pieces, reached[i], s["start"]), F.lit("<"), s["kind"], F.lit(">"))
            parts = F.transform(in_order, lambda s, i: F.when(s["start"] >= reached[i], before(s, i)).otherwise(""))
            last = F.greatest(F.element_at(reached, -1), F.element_at(in_order, -1)["end"])
            return F.concat(F.array_join(parts, ""), cut(pieces, last, F.length(text)))

        ends = F.transform(in_order, lambda s: s["end"])
        return _once(scanned(ends, lambda a, b: F.greatest(a, b), 0), joined)

    found = F.struct(ordered.alias("spans"), pieces_of(text).alias("pieces"))
    return F.when(F.size(spans) > 0, _once(found, replaced)).otherwise(text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data in text masked; null texts stay null."""
    marked = docs.select(packed(docs), all_spans(docs["text"]).alias("_pii"))
    return marked.select(*unpacked(docs, text=masked(F.col("_row.text"), F.col("_pii"))))


def personal_data_digests(docs: DataFrame) -> DataFrame:
    return span_digests(find_personal_data(docs), KINDS, BASE, ["doc_id"])
