"""Keyed state of the live job row by row: what the steps of ``columns.py``, which the job runs, do with whole blocks.

Three stateful steps stand one behind the other:

* ``Seen``, by block of ids: which ids have come. An id that has come before, or comes again in one micro-batch
  after another row, goes no further.
* ``Slices``, by (customer or e-mail domain, slice of time): the rows of the slice. It gives every arrival the number, sum and
  last time of the rows before it in its slice, and sends one row of totals per slice on.
* ``Totals``, by customer or domain: totals per slice. It answers with the totals of all earlier slices.

Arrivals meet their slice only, and a busy domain has many slices, so no task holds all rows of a domain; what meets in
``Totals`` is one row per slice. A row that comes late finds its place by the rows of one slice and the totals of the others, so
it costs the same however long the history is.

Rows cost by their number and columns on their way to and from Python. So an arrival's own columns travel as one text (JSON,
written and read by the engine), and the arrivals of a slice leave the second step as one text that passes the third beside the slice's totals
(``PackedSlices``, ``PackedTotals``; ``Slices`` and ``Totals`` alone give one row per arrival).

A key of the engine's state costs more than its rows: some calls, each a round trip from Python. So the engine's keys are BLOCKS blocks of customers
and of domains, and a block's state is read and written once per slice and micro-batch (``BlockSlices``, ``BlockTotals``). What an arrival reads
grows with the customers of a block, that is with their number / BLOCKS, a late one's with the rows that they have in the slice.

A slice's rows are kept as chunks of numbers (24 bytes a row); they are read only when a row comes that is not newer than
all of them. The last few rows of a slice, and the totals of a customer with few slices, are one value: most customers cost a read and a
write per step and micro-batch. Totals of more slices are kept in groups of GROUP slices, so an arrival reads the sums of whole groups and one group.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.slices import NO_TIME, keyed_rows, with_keys
from riskloom.schemas import INPUTS, TRANSACTIONS

#: Ids of one block of Seen.
BLOCK_IDS = 4096
#: Blocks of customers, and of domains, by hash. A live job keeps its number: its state is stored by it.
BLOCKS = 4096
#: Slices whose totals are kept together.
GROUP = 64
#: Rows of a slice that are kept beside its totals, and not as chunks: a call to the state store costs more than they do.
FEW_ROWS = 64
#: Keys under which arrivals pass Totals.
SPREAD = 64
#: Rows of a slice that the first state gets at once.
FIRST_ROWS = 100_000

ARRIVING = T.StructType([f for f in TRANSACTIONS.fields if f.name in INPUTS])


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


_TEXT, _LONG = T.StringType(), T.LongType()
FRESH = T.StructType([*ARRIVING.fields, *_fields(_TEXT, "uid"), *_fields(_LONG, "cents")])
#: One row per arrival and kind of key; the customer's has the whole arrival with it.
_KEYED = [*_fields(_TEXT, "kind", "key"), *_fields(_LONG, "slice", "at", "id", "cents"), T.StructField("whole", ARRIVING)]
#: The same with what came before, and rows of totals; ``to_kind`` and ``to_key`` lead to the next step.
_PAST = _fields(_LONG, "n", "sum_cents", "last_at", "latest_at", "latest_id")
PLACED = T.StructType([*_fields(_TEXT, "to_kind", "to_key"), *_KEYED, *_PAST])
#: An arrival's place in its slice, and what a slice's arrivals travel as.
_ARRIVAL = ["at", "id", "n", "sum_cents", "last_at", "whole"]


# --- rows for the steps --------------------------------------------------------


def fresh_columns(arrivals: DataFrame, *more: str) -> DataFrame:
    """Arrivals with customer and cents. A row without an id is none (the table rules reject it)."""
    rows = arrivals.filter(F.col("transactionid").isNotNull())
    return with_keys(rows).select(*FRESH.names, *more)


def block_rows(fresh: DataFrame, whole: Column | None = None) -> DataFrame:
    """``keyed_rows`` with the block of the key."""
    return keyed_rows(fresh, whole).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(BLOCKS)))


# --- the steps -------------------------------------------------------------------


class Seen(StatefulProcessor):
    """Key: block of ids. State: one bit per id. Lets the first row of each id through, by ``place`` in a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "bits binary")

    def _bits(self) -> bytearray:
        known = self.bits.get()
        return bytearray(known[0]) if known is not None else bytearray(BLOCK_IDS // 8)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bits, first = self._bits(), {}
        for row in rows:
            at = row.transactionid % BLOCK_IDS
            if not bits[at >> 3] >> (at & 7) & 1 and (at not in first or row.place < first[at].place):
                first[at] = row
        for at in first:
            bits[at >> 3] |= 1 << (at & 7)
        if first:
            self.bits.update((bytes(bits),))
        for row in first.values():
            yield Row(**{c: row[c] for c in row.__fields__ if c not in ("place", "block")})

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        bits = self._bits()
        for at in initialState.places:
            bits[at >> 3] |= 1 << (at & 7)
        self.bits.update((bytes(bits),))


class Slices(StatefulProcessor):
    """Key: kind, key, slice. State: totals and rows of the slice. Places every arrival in its slice."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, cents long, at long, id long, few binary")
        self.chunks = handle.getListState("rows", "chunk binary")

    def _known(self, known: tuple) -> tuple[np.ndarray, tuple]:
        """Rows (at, id, cents) in their order, and the totals; what was read from chunks is kept as one chunk."""
        few = np.frombuffer(known[4], np.int64).reshape(-1, 3)
        if len(few) == known[0]:
            return few[np.lexsort((few[:, 1], few[:, 0]))], known
        chunks = [np.frombuffer(c[0], np.int64).reshape(-1, 3) for c in self.chunks.get()]
        rows = np.concatenate([*chunks, few])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        self.chunks.put([(rows.tobytes(),)])
        return rows, (*known[:4], b"")

    def _add(self, rows: np.ndarray, known: tuple | None) -> None:
        n, cents, at, id_, few = known if known is not None else (0, 0, NO_TIME, NO_TIME, b"")
        at, id_ = max((at, id_), tuple(rows[-1, :2].tolist()))
        few = bytes(few) + rows.tobytes()
        if len(few) > FEW_ROWS * 24:
            self.chunks.appendValue((few,))
            few = b""
        self.totals.update((n + len(rows), cents + int(rows[:, 2].sum()), at, id_, few))

    def place(self, rows: Iterator[Row]) -> tuple[list[Row], np.ndarray, list, list, list]:
        """The rows in order, as numbers, and the number, cents and last time before each of them in the slice."""
        arrived = sorted(rows, key=lambda r: (r.at, r.id))
        new = np.array([(r.at, r.id, r.cents) for r in arrived], np.int64)
        known = self.totals.get()
        n, cents, last = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.full(len(new), NO_TIME)
        if known is not None and tuple(known[2:4]) < (arrived[0].at, arrived[0].id):
            n, cents, last = n + known[0], cents + known[1], np.full(len(new), known[2])
        elif known is not None:  # not newer than all the slice has: its rows tell what came before
            have, known = self._known(known)
            sums = np.concatenate([[0], np.cumsum(have[:, 2])])
            times = np.concatenate([[NO_TIME], have[:, 0]])
            n = _places(have, new)
            cents, last = sums[n], times[n]
        self._add(new, known)
        own = np.arange(len(new))
        n = n + own
        cents = cents + np.concatenate([[0], np.cumsum(new[:-1, 2])])
        last = np.maximum(last, np.concatenate([[NO_TIME], new[:-1, 0]]))
        return arrived, new, n.tolist(), cents.tolist(), last.tolist()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived, new, n, cents, last = self.place(rows)
        kind, name, slice_ = key
        for i, row in enumerate(arrived):
            yield _placed("row", str(row.id % SPREAD), row, n[i], cents[i], last[i])
        total = Row(kind=kind, key=name, slice=slice_, at=arrived[-1].at, id=arrived[-1].id, cents=0, whole=None)
        yield _placed(kind, name, total, len(new), int(new[:, 2].sum()), arrived[-1].at)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        rows = sorted(zip(initialState.times, initialState.ids, initialState.amounts))
        self._add(np.array(rows, np.int64), self.totals.get())


class PackedSlices(Slices):
    """The same, with one row per slice: its totals and, as one text, the arrivals."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived, new, n, cents, last = self.place(rows)
        kind, name, slice_ = key
        texts = [row.whole for row in arrived]
        arrivals = json.dumps([dict(zip(_ARRIVAL, r)) for r in zip(new[:, 0].tolist(), new[:, 1].tolist(), n, cents, last, texts)])
        at, id_ = new[-1, :2].tolist()
        yield Row(kind=kind, key=name, slice=slice_, at=at, id=id_, n=len(new), sum_cents=int(new[:, 2].sum()), last_at=at, arrivals=arrivals)


class Totals(StatefulProcessor):
    """Key: kind, key. State: the newest row, totals per slice in groups, and of the groups. Arrivals pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "totals binary, at long, id long, few binary")
        self.slices = handle.getMapState("slices", "group long", "totals binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] == "row":
            yield from rows
            return
        for row, base, before in self.bases(rows):
            yield _placed(key[0], key[1], row, *base, *before)

    def bases(self, rows: Iterator[Row]) -> Iterator[tuple[Row, tuple, tuple]]:
        """Each row of totals, which are added to the state, with number, sum and last time of all rows in earlier slices, and the newest row."""
        arrived = sorted(rows, key=lambda r: r.slice)
        groups, few, newest = self._head()
        if few is not None:
            for row in arrived:
                yield row, _sums(few[few[:, 0] < row.slice]), newest or (None, None)
                few = _with(few, row.slice, (row.n, row.sum_cents, row.last_at))
        else:
            for group, some in groupby(arrived, key=lambda r: r.slice // GROUP):
                slices = self._group(group, groups)
                for row in some:
                    base = _sums(np.concatenate([groups[groups[:, 0] < group], slices[slices[:, 0] < row.slice]]))
                    slices = _with(slices, row.slice, (row.n, row.sum_cents, row.last_at))
                    groups = _with(groups, group, (row.n, row.sum_cents, row.last_at))
                    yield row, base, newest or (None, None)
                self.slices.updateValue((group,), (slices.tobytes(),))
        self._keep(groups, few, newest, max((r.at, r.id) for r in arrived))

    def _head(self) -> tuple[np.ndarray, np.ndarray | None, tuple | None]:
        """Totals of groups; those of the slices where there are few, and no groups yet; the newest row."""
        head = self.head.get()
        if head is None:
            return _table(None), _table(None), None
        groups = _table(head)
        return groups, None if len(groups) else _table((head[3],)), (head[1], head[2])

    def _keep(self, groups: np.ndarray, few: np.ndarray | None, newest: tuple | None, come: tuple) -> None:
        if few is not None and len(few) > GROUP:
            for group in np.unique(few[:, 0] // GROUP).tolist():
                slices = few[few[:, 0] // GROUP == group]
                self.slices.updateValue((group,), (slices.tobytes(),))
                groups = _with(groups, group, _sums(slices))
            few = None
        latest = come if newest is None else max(newest, come)
        self.head.update((groups.tobytes(), *latest, b"" if few is None else few.tobytes()))

    def _group(self, group: int, groups: np.ndarray) -> np.ndarray:
        """Totals of a group's slices, which are stored if the groups name it."""
        return _table(self.slices.getValue((group,)) if (groups[:, 0] == group).any() else None)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        row, more = initialState, (initialState.n, initialState.sum_cents, initialState.last_at)
        groups, few, newest = self._head()
        if few is not None:
            few = _with(few, row.slice, more)
        else:
            group = row.slice // GROUP
            self.slices.updateValue((group,), (_with(self._group(group, groups), row.slice, more).tobytes(),))
            groups = _with(groups, group, more)
        self._keep(groups, few, newest, (row.latest_at, row.latest_id))


class PackedTotals(Totals):
    """The same for rows that carry their slice's arrivals."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row, (n, cents, last), (at, id_) in self.bases(rows):
            yield Row(
                kind=key[0], base_n=n, base_cents=cents, base_last=last, latest_at=at, latest_id=id_, arrivals=row.arrivals
            )


class _Values:
    """One value of state with the values of all keys of a block, read at ``load`` and written at ``store``; in between the value of ``key``."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: str) -> None:
        lists = [f"{c} array<{kind}>" for c, kind in (column.split() for column in f"key string, {columns}".split(", "))]
        self.state = handle.getValueState(name, ", ".join(lists))

    def load(self) -> None:
        known = self.state.get()
        self.values = {} if known is None else dict(zip(known[0], zip(*known[1:])))

    def store(self) -> None:
        self.state.update(([*self.values], *map(list, zip(*self.values.values()))))

    def get(self) -> tuple | None:
        return self.values.get(self.key)

    def update(self, value: tuple) -> None:
        self.values[self.key] = value


class _Chunks:
    """The same for one list of state with the chunks of all keys, which is read only when those of a key are."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getListState(name, "key string, chunk binary")

    def load(self) -> None:
        self.known, self.new, self.changed = None, [], False

    def store(self) -> None:
        if self.changed:
            self.state.put([(key, chunk) for key, chunks in self.known.items() for chunk, in chunks] + self.new)
        elif self.new:
            self.state.appendList(self.new)

    def get(self) -> list[tuple]:
        if self.known is None:
            self.known = {}
            for key, chunk in self.state.get():
                self.known.setdefault(key, []).append((chunk,))
        return self.known.get(self.key, [])

    def put(self, chunks: list[tuple]) -> None:
        self.known[self.key], self.changed = chunks, True

    def appendValue(self, chunk: tuple) -> None:
        self.new.append((self.key, *chunk))


class _Groups:
    """The same for a map of state, whose entries are read and written one by one."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getMapState(name, "key string, group long", "totals binary")

    def getValue(self, group: tuple) -> tuple:
        return self.state.getValue((self.key, *group))

    def updateValue(self, group: tuple, value: tuple) -> None:
        self.state.updateValue((self.key, *group), value)


def _by_key(names: Iterable[str], rows: Iterable) -> dict[str, list]:
    found: dict[str, list] = {}
    for name, row in zip(names, rows):
        found.setdefault(name, []).append(row)
    return found


class BlockSlices(PackedSlices):
    """Key: kind, block, slice. What ``PackedSlices`` does, for all keys of the block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = _Values(handle, "totals", "n long, cents long, at long, id long, few binary")
        self.chunks = _Chunks(handle, "rows")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kind, block, slice_ = key
        rows = list(rows)
        self.totals.load(), self.chunks.load()
        for name, some in _by_key((r.key for r in rows), rows).items():
            self.totals.key = self.chunks.key = name
            for row in super().handleInputRows((kind, name, slice_), some, timerValues):
                yield Row(block=block, **row.asDict())
        self.totals.store(), self.chunks.store()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.totals.load(), self.chunks.load()
        for name, some in _by_key(initialState.names, zip(initialState.times, initialState.ids, initialState.amounts)).items():
            self.totals.key = self.chunks.key = name
            super().handleInitialState(key, Row(**dict(zip(("times", "ids", "amounts"), zip(*some)))), timerValues)
        self.totals.store(), self.chunks.store()


#: Columns of a slice's totals in the first state.
_TOTAL = ["slice", "n", "sum_cents", "last_at", "latest_at", "latest_id"]


class BlockTotals(PackedTotals):
    """Key: kind, block. What ``PackedTotals`` does, for all keys of the block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = _Values(handle, "head", "totals binary, at long, id long, few binary")
        self.slices = _Groups(handle, "slices")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        self.head.load()
        for name, some in _by_key((r.key for r in rows), rows).items():
            self.head.key = self.slices.key = name
            yield from super().handleInputRows((key[0], name), some, timerValues)
        self.head.store()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.head.load()
        for name, *total in zip(initialState.names, *(initialState[c] for c in _TOTAL)):
            self.head.key = self.slices.key = name
            super().handleInitialState(key, Row(**dict(zip(_TOTAL, total))), timerValues)
        self.head.store()


def _places(have: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How many rows of ``have`` are before each of ``new``, both in their order."""
    both = np.concatenate([have, new])
    order = np.lexsort((both[:, 1], both[:, 0]))
    is_new = order >= len(have)
    return np.cumsum(~is_new)[is_new]


def _table(value) -> np.ndarray:
    """Rows (number of the slice or group, n, cents, last time)."""
    return np.frombuffer(value[0], np.int64).reshape(-1, 4) if value is not None else np.empty((0, 4), np.int64)


def _sums(table: np.ndarray) -> tuple[int, int, int]:
    """Number, sum and last time of some rows of a table."""
    return int(table[:, 1].sum()), int(table[:, 2].sum()), int(table[:, 3].max(initial=NO_TIME))


def _with(table: np.ndarray, number: int, more: tuple[int, int, int]) -> np.ndarray:
    n, cents, last = more
    at = np.flatnonzero(table[:, 0] == number)
    if not len(at):
        return np.concatenate([table, np.array([(number, n, cents, last)], np.int64)])
    table = table.copy()
    row = table[at[0]]
    row[1:] = row[1] + n, row[2] + cents, max(row[3], last)
    return table


def _placed(to_kind: str, to_key: str, row: Row, n: int, cents: int, last: int, latest_at=None, latest_id=None) -> Row:
    kept = {f.name: row[f.name] for f in _KEYED}
    return Row(
        to_kind=to_kind, to_key=to_key, **kept, n=n, sum_cents=cents, last_at=last, latest_at=latest_at, latest_id=latest_id
    )


# --- the first state ---------------------------------------------------------------------


def first_states(history: DataFrame) -> dict[str, DataFrame]:
    """What the three steps begin with, from stored transactions (one row per id). Each row is bounded: a block's ids, FIRST_ROWS rows
    of a block's slice, or totals of as many slices."""
    fresh = fresh_columns(history)
    block = F.floor(F.col("transactionid") / BLOCK_IDS)
    place = (F.col("transactionid") - block * BLOCK_IDS).cast("int")
    seen = fresh.groupBy(block.alias("block")).agg(F.collect_set(place).alias("places"))
    keyed = block_rows(fresh)
    totals = keyed.groupBy("kind", "block", "key", "slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cents").alias("sum_cents"),
        F.max(F.struct("at", "id")).alias("latest"),
    )
    totals = totals.select(
        "kind", "block", "key", "slice", "n", "sum_cents",
        F.col("latest.at").alias("last_at"), F.col("latest.at").alias("latest_at"), F.col("latest.id").alias("latest_id"),
    )

    def lots(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
        largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        lot = F.pmod(F.xxhash64(*columns), F.lit(1 + 2 * largest // FIRST_ROWS))
        return rows.groupBy(*by, lot.alias("lot")).agg(F.collect_list(F.struct(*columns)).alias("rows")).drop("lot")

    slices = lots(keyed, ["kind", "block", "slice"], "key", "at", "id", "cents")
    parts = {"names": "key", "times": "at", "ids": "id", "amounts": "cents"}
    slices = slices.select("kind", "block", "slice", *[F.col("rows")[c].alias(name) for name, c in parts.items()])
    totals = lots(totals, ["kind", "block"], "key", *_TOTAL)
    totals = totals.select("kind", "block", *[F.col("rows")[c].alias(name) for c, name in zip(["key", *_TOTAL], ["names", *_TOTAL])])
    return {"seen": seen, "slices": slices, "totals": totals}
