"""The state steps of the live job over packed rows.

They do what ``Seen``, ``BlockSlices`` and ``BlockTotals`` of ``state.py`` say row by row, and keep the same rules. There a row costs on its
way to and from Python by its cells, three times, and a customer some Python calls in each step. Here the rows of one key of the engine's state
are packed into one row before a step: numbers as the bytes of an array, the arrivals' texts as one value that no step opens. A step then
handles all customers of its block at once, and its rows are unpacked after it.

State, by block of ids: one bit per id. By block of customers or domains and slice: names, totals and chunks of rows, which are
read only when a row comes that is not newer than all its customer or domain has there. By block: names, newest rows, totals of groups of GROUP slices,
and a map with the totals of each group's slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.slices import NO_TIME
from riskloom.streaming.state import ARRIVING, BLOCK_IDS, FRESH, GROUP, block_rows, fresh_columns

#: Rows that are packed at once, and about how many leave at once when they are unpacked.
PACK_ROWS = 100_000

_PACKED_IDS = "block long, ids binary, places binary, texts binary"
_UNSEEN = "keep binary, texts array<binary>"
_PACKED_ROWS = "kind string, block long, slice long, names array<string>, numbers binary, texts binary"
_SLICED = "kind string, block long, slice long, names array<string>, totals binary, numbers binary, texts array<binary>"
_BASED = "kind string, numbers binary, texts array<binary>"
_PLACED = "kind string, id long, n long, cents long, last long, late boolean, whole string"


# --- packing ---------------------------------------------------------------------


def packed_texts(texts: pa.StringArray) -> bytes:
    """Texts as one value: their number, where each begins, the characters."""
    begin = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    characters = data[begin[0] : begin[-1]].to_pybytes() if data is not None else b""
    return np.int64(len(texts)).tobytes() + (begin - begin[0]).tobytes() + characters


def unpacked_texts(value: bytes) -> pa.StringArray:
    n = int(np.frombuffer(value, np.int64, 1)[0])
    buffer, end = pa.py_buffer(value), 8 + 4 * (n + 1)
    return pa.StringArray.from_buffers(n, buffer.slice(8, end - 8), buffer.slice(end))


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches in tables of PACK_ROWS rows or some more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where another key begins in rows that are sorted by these."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(first)


def pack_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, transactionid, place, whole as one row per block."""
    for table in _tables(batches):
        table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))
        block, ids = (_one(table[c]).to_numpy(zero_copy_only=False) for c in ("block", "transactionid"))
        places, texts = (_one(table[c].cast(pa.string())) for c in ("place", "whole"))
        starts = _starts(block)
        cuts = [slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(block)])]
        columns = [block[starts], [ids[c].tobytes() for c in cuts]]
        columns += [[packed_texts(of[c]) for c in cuts] for of in (places, texts)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "ids", "places", "texts"])


def pack_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows kind, block, slice, key, at, id, cents, whole as one row per kind, block and slice; whole goes along where it is given."""
    for table in _tables(batches):
        kinds, keys = (_one(table[c]).dictionary_encode() for c in ("kind", "key"))
        names, key = np.array(keys.dictionary.to_pylist(), object), keys.indices.to_numpy()
        kind, (block, slice_) = kinds.indices.to_numpy(), (_one(table[c]).to_numpy() for c in ("block", "slice"))
        order = np.lexsort((key, slice_, block, kind))
        kind, block, slice_, key = kind[order], block[order], slice_[order], key[order]
        numbers = np.stack([np.zeros(len(key), np.int64), *(_one(table[c]).to_numpy()[order] for c in ("at", "id", "cents"))], axis=1)
        whole = _one(table["whole"].cast(pa.string())).take(pa.array(order))
        given = ~whole.is_null().to_numpy(zero_copy_only=False)
        out: dict[str, list] = {c: [] for c in ("kind", "block", "slice", "names", "numbers", "texts")}
        starts = _starts(kind, block, slice_)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            firsts = _starts(key[a:b])
            numbers[a:b, 0] = np.repeat(np.arange(len(firsts)), np.diff([*firsts, b - a]))
            out["kind"].append(kinds.dictionary[int(kind[a])].as_py())
            out["block"].append(int(block[a]))
            out["slice"].append(int(slice_[a]))
            out["names"].append(names[key[a:b][firsts]].tolist())
            out["numbers"].append(numbers[a:b].tobytes())
            out["texts"].append(packed_texts(whole[a:b]) if given[a] else None)
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], [*out])


def _whole(values: list[bytes]) -> pa.StringArray:
    return pa.concat_arrays([unpacked_texts(v) for v in values])


def _in_lots(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _tables(rows):
        yield from table.to_batches()


def unpack_unseen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that are kept."""

    def each() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keep, texts in zip(batch.column("keep"), batch.column("texts")):
                kept = _whole(texts.as_py()).filter(pa.array(np.frombuffer(keep.as_py(), bool)))
                yield pa.RecordBatch.from_arrays([kept], ["whole"])

    return _in_lots(each())


def unpack_placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per arrival and kind of key."""

    def each() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, numbers, texts in zip(*(batch.column(c) for c in ("kind", "numbers", "texts"))):
                rows, texts = _matrix(numbers.as_py(), 5), texts.as_py()
                columns = [pa.array(rows[:, i]) for i in range(4)]
                whole = _whole(texts) if texts else pa.nulls(len(rows), pa.string())
                columns = [pa.array([kind.as_py()] * len(rows), pa.string()), *columns, pa.array(rows[:, 4] == 1), whole]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "id", "n", "cents", "last", "late", "whole"])

    return _in_lots(each())


def _matrix(value: bytes, width: int) -> np.ndarray:
    return np.frombuffer(value, np.int64).reshape(-1, width)


def _numbered(names: Iterable[str], codes: dict[str, int]) -> np.ndarray:
    """The numbers of names; new ones are added."""
    return np.array([codes.setdefault(n, len(codes)) for n in names], np.int64)


def _sooner(at: np.ndarray, id_: np.ndarray, than_at: np.ndarray, than_id: np.ndarray) -> np.ndarray:
    return (at < than_at) | ((at == than_at) & (id_ < than_id))


def _newest(old: np.ndarray, codes: np.ndarray, come: np.ndarray) -> np.ndarray:
    """Newest rows (at, id) by code with more of them; ``codes`` are distinct."""
    old = old.copy()
    later = _sooner(old[codes, 0], old[codes, 1], come[:, 0], come[:, 1])
    old[codes[later]] = come[later]
    return old


def _grown(table: np.ndarray, rows: int, fill: tuple) -> np.ndarray:
    """A table with a row for every code."""
    return np.concatenate([table, np.tile(np.array(fill, np.int64), (rows - len(table), 1))])


def _before(codes: np.ndarray, n: np.ndarray, cents: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sorted entries the number, cents and last time of those before it that have its code."""
    starts = _starts(codes)
    first = np.repeat(starts, np.diff([*starts, len(codes)]))
    out = np.stack([np.cumsum(n) - n, np.cumsum(cents) - cents, np.concatenate([[NO_TIME], at[:-1]])], axis=1)
    out[:, :2] -= out[first, :2]
    out[starts, 2] = NO_TIME
    return out


# --- the steps -------------------------------------------------------------------


class ColumnSeen(StatefulProcessor):
    """Key: block of ids. State: one bit per id. Keeps the first row of each id, by place in a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "bits binary")

    def _known(self) -> np.ndarray:
        known = self.bits.get()
        if known is None:
            return np.zeros(BLOCK_IDS, bool)
        return np.unpackbits(np.frombuffer(known[0], np.uint8), bitorder="little").astype(bool)

    def _keep(self, known: np.ndarray) -> None:
        self.bits.update((np.packbits(known, bitorder="little").tobytes(),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows, known = list(rows), self._known()
        at = np.concatenate([np.frombuffer(r.ids, np.int64) for r in rows]) % BLOCK_IDS
        fresh = np.flatnonzero(~known[at])
        if len(np.unique(at[fresh])) < len(fresh):
            places = [p for r in rows for p in unpacked_texts(r.places).to_pylist()]
            fresh = np.array(sorted(fresh.tolist(), key=places.__getitem__))
            fresh = fresh[np.unique(at[fresh], return_index=True)[1]]
        if len(fresh):
            known[at[fresh]] = True
            self._keep(known)
            keep = np.zeros(len(at), bool)
            keep[fresh] = True
            yield Row(keep=keep.tobytes(), texts=[bytes(r.texts) for r in rows])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        known = self._known()
        known[np.array(initialState.places, np.intp)] = True
        self._keep(known)


class ColumnSlices(StatefulProcessor):
    """Key: kind, block, slice. State: totals and rows of the block's customers or domains in the slice. Places every arrival in its slice."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "names array<string>, sums binary")
        self.chunks = handle.getListState("rows", "chunk binary")

    def _known(self) -> tuple[dict[str, int], np.ndarray]:
        """Numbers of the names, and per number n, cents, at and id of the newest row."""
        known = self.totals.get()
        if known is None:
            return {}, np.empty((0, 4), np.int64)
        return {name: i for i, name in enumerate(known[0])}, _matrix(known[1], 4)

    def _add(self, codes: dict[str, int], sums: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals with more rows (code, at, id, cents; by code and time), and what these come to by code."""
        starts = _starts(ordered[:, 0])
        ends = np.concatenate([starts[1:], [len(ordered)]])
        which = ordered[starts, 0]
        more = np.stack([ends - starts, np.add.reduceat(ordered[:, 3], starts), ordered[ends - 1, 1], ordered[ends - 1, 2]], axis=1)
        sums = _grown(sums, len(codes), (0, 0, NO_TIME, -(1 << 63)))
        sums[which, :2] += more[:, :2]
        sums[:, 2:] = _newest(sums[:, 2:], which, more[:, 2:])
        self.totals.update(([*codes], sums.tobytes()))
        return which, more

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        codes, sums = self._known()
        had, lots = len(codes), []
        for row in rows:
            lot = _matrix(row.numbers, 4).copy()
            lot[:, 0] = _numbered(row.names, codes)[lot[:, 0]]
            lots.append(lot)
        new = np.concatenate(lots)
        ordered = new[np.lexsort((new[:, 2], new[:, 1], new[:, 0]))]
        first = ordered[_starts(ordered[:, 0])]
        first = first[first[:, 0] < had]
        newest = sums[first[:, 0]]
        in_time = _sooner(newest[:, 2], newest[:, 3], first[:, 1], first[:, 2])
        # What is known of a code: its totals as one entry before all that come, or its rows where some come among them.
        timely, late = first[in_time, 0], first[~in_time, 0]
        known = np.column_stack([timely, sums[timely][:, [2, 3, 1, 0]]])
        if len(late):
            have = np.concatenate([_matrix(c[0], 4) for c in self.chunks.get()])
            self.chunks.put([(np.concatenate([have, new]).tobytes(),)])
            have = have[np.isin(have[:, 0], late)]
            known = np.concatenate([known, np.column_stack([have, np.ones(len(have), np.int64)])])
        else:
            self.chunks.appendValue((new.tobytes(),))
        entries = np.concatenate([known, np.column_stack([new, np.ones(len(new), np.int64)])])
        order = np.lexsort((entries[:, 2], entries[:, 1], entries[:, 0]))
        code, at, _, cents, n = entries[order].T
        before = np.empty((len(entries), 3), np.int64)
        before[order] = _before(code, n, cents, at)
        which, more = self._add(codes, sums, ordered)
        names = [*codes]
        numbers = np.column_stack([np.searchsorted(which, new[:, 0]), new[:, 1:3], before[len(known) :]])
        kind, block, slice_ = key
        yield Row(
            kind=kind, block=block, slice=slice_, names=[names[c] for c in which], totals=more.tobytes(), numbers=numbers.tobytes(),
            texts=[bytes(r.texts) for r in rows if r.texts is not None],
        )

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        codes, sums = self._known()
        parts = _numbered(initialState.names, codes), initialState.times, initialState.ids, initialState.amounts
        rows = np.column_stack([np.array(p, np.int64) for p in parts])
        self._add(codes, sums, rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))])
        self.chunks.appendValue((rows.tobytes(),))


def _merged(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (code, number of the slice or group, n, cents, last time) with one of each code and number, sorted, and where each has gone."""
    order = np.lexsort((entries[:, 1], entries[:, 0]))
    entries = entries[order]
    starts = _starts(entries[:, 0], entries[:, 1])
    into = np.empty(len(order), np.intp)
    into[order] = np.repeat(np.arange(len(starts)), np.diff([*starts, len(order)]))
    if not len(starts):
        return entries, into
    sums = np.add.reduceat(entries[:, 2:4], starts)
    return np.column_stack([entries[starts, :2], sums, np.maximum.reduceat(entries[:, 4], starts)]), into


class ColumnTotals(StatefulProcessor):
    """Key: kind, block. State: totals per slice in groups, and of the groups; newest rows. Adds to each arrival what earlier slices hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "names array<string>, newest binary, groups binary")
        self.slices = handle.getMapState("slices", "group long", "totals binary")

    def _known(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        known = self.head.get()
        if known is None:
            return {}, np.empty((0, 2), np.int64), np.empty((0, 5), np.int64)
        return {name: i for i, name in enumerate(known[0])}, _matrix(known[1], 2), _matrix(known[2], 5)

    def _add(self, codes: dict[str, int], newest: np.ndarray, groups: np.ndarray, new: np.ndarray, latest: np.ndarray) -> np.ndarray:
        """Adds entries of distinct codes and slices, with the newest row of each, to the state; number, cents and last time of the slices before each."""
        base = np.empty((len(new), 3), np.int64)
        of = new[:, 1] // GROUP
        for group in np.unique(of).tolist():
            here = of == group
            known = _matrix(self.slices.getValue((group,))[0], 5) if (groups[:, 1] == group).any() else np.empty((0, 5), np.int64)
            earlier = groups[groups[:, 1] < group].copy()
            earlier[:, 1] = -(1 << 63)
            each, into = _merged(np.concatenate([earlier, known, new[here]]))
            base[here] = _before(each[:, 0], *each[:, 2:].T)[into[len(earlier) + len(known) :]]
            self.slices.updateValue((group,), (each[each[:, 1] > -(1 << 63)].tobytes(),))
            more = new[here].copy()
            more[:, 1] = group
            groups = _merged(np.concatenate([groups, more]))[0]
        newest = _grown(newest, len(codes), (-(1 << 63), -(1 << 63)))
        order = np.lexsort((latest[:, 1], latest[:, 0], new[:, 0]))
        ends = np.concatenate([_starts(new[order, 0])[1:], [len(new)]]) - 1
        newest = _newest(newest, new[order[ends], 0], latest[order[ends]])
        self.head.update(([*codes], newest.tobytes(), groups.tobytes()))
        return base

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        codes, newest, groups = self._known()
        parts, latest = [], []
        for row in rows:
            totals = _matrix(row.totals, 4)
            parts.append(np.column_stack([_numbered(row.names, codes), np.full(len(totals), row.slice), totals[:, :3]]))
            latest.append(totals[:, 2:])
        base = self._add(codes, newest, groups, np.concatenate(parts), np.concatenate(latest))
        newest = _grown(newest, len(codes), (-(1 << 63), -(1 << 63)))  # of earlier micro-batches; of none, no row is late
        begin = 0
        for row, part in zip(rows, parts):
            own = _matrix(row.numbers, 6)
            mine, known = base[begin : begin + len(part)][own[:, 0]], newest[part[own[:, 0], 0]]
            begin += len(part)
            late = _sooner(own[:, 1], own[:, 2], known[:, 0], known[:, 1])
            numbers = np.column_stack([own[:, 2], own[:, 3:5] + mine[:, :2], np.maximum(own[:, 5], mine[:, 2]), late])
            yield Row(kind=key[0], numbers=numbers.tobytes(), texts=[bytes(t) for t in row.texts])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        codes, newest, groups = self._known()
        code = _numbered(initialState.names, codes)
        new = np.column_stack([code, *(np.array(initialState[c], np.int64) for c in ("slice", "n", "sum_cents", "last_at"))])
        latest = np.column_stack([np.array(initialState[c], np.int64) for c in ("latest_at", "latest_id")])
        self._add(codes, newest, groups, new, latest)


# --- the chain ---------------------------------------------------------------------


def placed(arrivals: DataFrame, first: dict[str, DataFrame] | None) -> DataFrame:
    """The stream of arrivals (with ``place``, their order in a micro-batch) through the three steps, which begin with ``first``.

    Two rows per arrival, for its customer and for its domain: kind, id; n, cents, last of the rows before it; whether it is older than the newest
    row of earlier micro-batches; with the customer's the arrival itself.
    """
    rows = fresh_columns(arrivals, "place").withColumn("block", F.floor(F.col("transactionid") / BLOCK_IDS))
    place = F.coalesce("place", F.lit("")).alias("place")
    texts = rows.select("block", "transactionid", place, F.to_json(F.struct(*FRESH.names)).alias("whole"))

    def step(rows: DataFrame, by: list[str], processor: StatefulProcessor, schema: str, name: str) -> DataFrame:
        state = None if first is None else first[name].groupBy(*by)
        return rows.groupBy(*by).transformWithState(processor, schema, outputMode="append", timeMode="none", initialState=state)

    def packed(rows: DataFrame, pack: Callable, schema: str, by: list[str]) -> DataFrame:
        """All rows of a key meet before they are packed, so a key has few packed rows."""
        return rows.repartition(*by).mapInArrow(pack, schema)

    fresh = step(packed(texts, pack_ids, _PACKED_IDS, ["block"]), ["block"], ColumnSeen(), _UNSEEN, "seen").mapInArrow(unpack_unseen, "whole string")
    fresh = fresh.select(F.from_json("whole", FRESH).alias("row"), "whole").select("row.*", "whole")
    keyed = block_rows(fresh, F.col("whole"))
    by = ["kind", "block", "slice"]
    sliced = step(packed(keyed, pack_rows, _PACKED_ROWS, by), by, ColumnSlices(), _SLICED, "slices")
    based = step(sliced, by[:2], ColumnTotals(), _BASED, "totals").mapInArrow(unpack_placed, _PLACED)
    return based.withColumn("whole", F.from_json("whole", ARRIVING))
