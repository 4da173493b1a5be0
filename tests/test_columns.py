"""The state steps over packed rows, against the row by row ones; packing and unpacking."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import Row

from riskloom.operators import slices as SL
from riskloom.streaming import columns as C
from riskloom.streaming import state as S
from tests.test_state import BlockStep, Step, arrival, block_steps, in_block, placed

BY = ["kind", "block", "slice"]
KEYED = pa.schema([*((c, pa.string()) for c in ("kind", "key", "whole")), *((c, pa.int64()) for c in ("block", "slice", "at", "id", "cents"))])


def steps():
    return BlockStep(C.ColumnSlices(), BY), BlockStep(C.ColumnTotals(), BY[:2])


def unpacked(rows, slices, totals, draw):
    """(id, kind): number, cents and last time before it, whether it is late, and what went along."""
    batches = pa.Table.from_pylist([r.asDict() for r in rows], KEYED).to_batches(max_chunksize=7)
    packed = [Row(**r) for batch in C.pack_rows(batches) for r in batch.to_pylist()]
    out = totals.run(slices.run(packed, draw), draw)
    types = {"kind": pa.string(), "numbers": pa.binary(), "texts": pa.list_(pa.binary())}
    placed_rows = C.unpack_placed([pa.RecordBatch.from_pylist([r.asDict() for r in out], pa.schema([*types.items()]))])
    return {(r["id"], r["kind"]): (r["n"], r["cents"], r["last"], r["late"], r["whole"]) for b in placed_rows for r in b.to_pylist()}


def expected(rows, slices, totals, draw):
    own = {(r.id, r.kind): r for r in rows}
    found = {}
    for at, (n, cents, last, newest) in placed(rows, slices, totals, draw).items():
        row = own[at]
        found[at] = (n, cents, last, newest is not None and (row.at, row.id) < newest, row.whole)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_packed_steps_say_what_the_rows_say(seed, monkeypatch):
    """Customers and domains of two blocks, in time and late, ties, missing times, many slices and groups, several packed rows of a key."""
    monkeypatch.setattr(C, "PACK_ROWS", 150)
    draw = random.Random(seed)
    plain = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
    packed = steps()
    for batch in range(7):
        rows = []
        for n in range(draw.choice([1, 5, 400])):
            kind = draw.choice(list(SL.SLICE_SECONDS))
            width = SL.SLICE_SECONDS[kind]
            at = draw.choice([draw.randrange(3 * width), draw.randrange(-width, 90 * width), draw.randrange(3) * 7, SL.NO_TIME])
            key = draw.choice(["", "=", "=a", "=b"])
            row = arrival(kind, key, at, draw.randrange(10**6) * 1000 - batch * 500 - n, draw.randrange(-50, 1000))
            rows.append(Row(**(row.asDict() | {"block": len(key), "whole": f"ä {row.id}" if kind == "uid" else None})))
        rows = list({r.id: r for r in rows}.values())
        assert unpacked(rows, *packed, draw) == expected(rows, *plain, draw)


@pytest.mark.parametrize("kind", SL.SLICE_SECONDS)
def test_first_state_is_what_the_rows_would_have_left(kind):
    draw = random.Random(6)
    width = SL.SLICE_SECONDS[kind]

    def some(ids):
        return [Row(**(arrival(kind, draw.choice(["", "=k", "=l"]), draw.randrange(150 * width), n, n).asDict() | {"block": 3, "whole": None})) for n in ids]

    rows = some(range(400))
    fed, begun = steps(), steps()
    unpacked(rows, *fed, draw)
    for slice_ in {r.slice for r in rows}:
        begun[0].store.key = (kind, 3, slice_)
        mine = [r for r in rows if r.slice == slice_]
        for part in (mine[::2], mine[1::2]):
            if part:
                columns = zip(("names", "times", "ids", "amounts"), zip(*[(r.key, r.at, r.id, r.cents) for r in part]))
                begun[0].processor.handleInitialState(begun[0].store.key, Row(**dict(columns)), None)
    sums = []
    for key, slice_ in {(r.key, r.slice) for r in rows}:
        mine = [r for r in rows if (r.key, r.slice) == (key, slice_)]
        latest = max((r.at, r.id) for r in mine)
        sums.append((key, slice_, len(mine), sum(r.cents for r in mine), latest[0], *latest))
    begun[1].store.key = (kind, 3)
    for part in (sums[::2], sums[1::2]):
        begun[1].processor.handleInitialState((kind, 3), Row(**dict(zip(["names", *S._TOTAL], zip(*part)))), None)
    more = some(range(1000, 1100))
    assert unpacked(more, *fed, draw) == unpacked(more, *begun, draw)


def test_of_an_id_the_first_row_counts():
    seen, draw = Step(C.ColumnSeen(), ["block"]), random.Random(0)
    schema = pa.schema([("block", pa.int64()), ("transactionid", pa.int64()), ("place", pa.string()), ("whole", pa.string())])

    def kept(*rows):
        batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, (i // S.BLOCK_IDS, i, place, f"{i} {place}"))) for i, place in rows], schema)
        out = seen.run([Row(**r) for b in C.pack_ids([batch[:1], batch[1:]]) for r in b.to_pylist()], draw)
        types = pa.schema([("keep", pa.binary()), ("texts", pa.list_(pa.binary()))])
        found = C.unpack_unseen([pa.RecordBatch.from_pylist([r.asDict() for r in out], types)])
        return sorted(t for b in found for t in b.column("whole").to_pylist())

    assert kept((5, "b"), (5, "a"), (S.BLOCK_IDS + 5, "c"), (-1, "d")) == sorted(["5 a", "-1 d", f"{S.BLOCK_IDS + 5} c"])
    assert kept((5, "0"), (-1, "0")) == []
    seen.store.key = (0,)
    seen.processor.handleInitialState((0,), Row(places=[7]), None)
    assert kept((7, "a"), (8, "a")) == ["8 a"]


def test_rows_of_a_block_cost_no_python_calls_each():
    """40,000 purchases of 80 customers in one block and slice: three calls of state, and less than a third of the time row by row."""
    draw = random.Random(7)
    rows = [in_block(arrival("uid", f"=k{n % 80}", n, n, n % 97)) for n in range(40_000)]
    packed, by_row = steps(), block_steps()
    table = pa.Table.from_pylist([r.asDict() for r in rows], KEYED)
    seconds = []
    for run in (
        lambda: [packed[0].run([Row(**r) for b in C.pack_rows(table.to_batches()) for r in b.to_pylist()], draw)],
        lambda: [by_row[0].run(rows, draw)],
    ):
        begun = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - begun)
    assert packed[0].store.calls == ["get", "appendValue", "update"]
    assert seconds[0] < seconds[1] / 3
