"""The state steps of the live job, fed by hand: every arrival against a search through all that came before."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskloom.operators import slices as SL
from riskloom.sources import fixtures as X
from riskloom.streaming import state as S

SF = "/root/testdata/sf0.01"


class Store:
    """Stands for the engine's state: one value, list or map per name and key; counts the chunks that are read."""

    def __init__(self):
        self.values, self.lists, self.maps = {}, defaultdict(list), defaultdict(dict)
        self.key, self.read = None, 0

    def getValueState(self, name, schema):
        return _Value(self, name)

    def getListState(self, name, schema):
        return _List(self, name)

    def getMapState(self, name, key, value):
        return _Map(self, name)


class _State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def at(self):
        return self.store.key, self.name


class _Value(_State):
    def get(self):
        return self.store.values.get(self.at())

    def update(self, value):
        self.store.values[self.at()] = value


class _List(_State):
    def get(self):
        chunks = self.store.lists[self.at()]
        self.store.read += sum(len(c[0]) // 24 for c in chunks)
        return iter(list(chunks))

    def put(self, chunks):
        self.store.lists[self.at()] = list(chunks)

    def appendValue(self, chunk):
        self.store.lists[self.at()].append(chunk)


class _Map(_State):
    def containsKey(self, key):
        return key in self.store.maps[self.at()]

    def getValue(self, key):
        return self.store.maps[self.at()][key]

    def updateValue(self, key, value):
        self.store.maps[self.at()][key] = value


class Step:
    def __init__(self, processor, by):
        self.processor, self.by, self.store = processor, by, Store()
        processor.init(self.store)

    def run(self, rows, draw):
        groups = defaultdict(list)
        for row in rows:
            groups[tuple(row[c] for c in self.by)].append(row)
        out = []
        for key, group in groups.items():
            draw.shuffle(group)
            self.store.key = key
            out += list(self.processor.handleInputRows(key, iter(group), None))
        return out


def arrival(kind, key, at, id_, cents):
    return Row(kind=kind, key=key, slice=at // SL.SLICE_SECONDS[kind], at=at, id=id_, cents=cents, whole=None)


def placed(rows, slices, totals, draw):
    """(id, kind): number, cents and last time before it, and the newest row of earlier batches, as the live job adds them up."""
    out = totals.run(slices.run(rows, draw), draw)
    base = {(r.kind, r.key, r.slice): r for r in out if r.to_kind != "row"}
    found = {}
    for r in out:
        if r.to_kind == "row":
            b = base[r.kind, r.key, r.slice]
            newest = (b.latest_at, b.latest_id) if b.latest_at is not None else None
            found[r.id, r.kind] = (r.n + b.n, r.sum_cents + b.sum_cents, max(r.last_at, b.last_at), newest)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_arrival(seed):
    """Late rows, ties, missing times, negative times, several slices and groups of slices."""
    draw = random.Random(seed)
    slices, totals = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
    come, number = [], 0
    for _ in range(8):
        batch = []
        for _ in range(draw.randint(1, 60)):
            number += 1
            kind = draw.choice(list(SL.SLICE_SECONDS))
            width = SL.SLICE_SECONDS[kind]
            at = draw.choice([draw.randrange(-width, 200 * width), draw.randrange(3) * 7, SL.NO_TIME])
            batch.append(arrival(kind, draw.choice(["", "=a"]), at, draw.randrange(10**6) * 1000 + number, draw.randrange(1000)))
        found = placed(batch, slices, totals, draw)
        for row in batch:
            mine = [r for r in come + batch if (r.kind, r.key) == (row.kind, row.key)]
            before = [r for r in mine if (r.at, r.id) < (row.at, row.id)]
            earlier = [(r.at, r.id) for r in come if (r.kind, r.key) == (row.kind, row.key)]
            expected = (
                len(before), sum(r.cents for r in before), max((r.at for r in before), default=SL.NO_TIME), max(earlier, default=None)
            )
            assert found[row.id, row.kind] == expected
        come += batch


def test_a_late_row_reads_one_slice_however_long_the_history():
    draw = random.Random(1)
    read = []
    for days in (5, 50):
        slices, totals = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
        for day in range(days):
            placed([arrival("p_emaildomain", "=x", day * 86400 + n * 360, day * 1000 + n, 1) for n in range(200)], slices, totals, draw)
        assert slices.store.read == 0  # rows in time need none
        late = arrival("p_emaildomain", "=x", 3 * 86400 + 7, 10**9, 1)
        assert placed([late], slices, totals, draw)[10**9, "p_emaildomain"][0] == 3 * 200 + 1
        read.append(slices.store.read)
    assert read[0] == read[1] <= 10


def test_first_state_is_what_the_rows_would_have_left():
    draw = random.Random(4)
    rows = [arrival("uid", "=k", draw.randrange(10**8), n, n) for n in range(300)]
    fed = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
    placed(rows, *fed, draw)
    begun = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
    groups = defaultdict(list)
    for r in rows:
        groups[r.kind, r.key, r.slice].append(r)
    for key, group in groups.items():
        begun[0].store.key, begun[1].store.key = key, key[:2]
        for part in (group[::2], group[1::2]):
            if part:
                columns = [[r[c] for r in part] for c in ("at", "id", "cents")]
                begun[0].processor.handleInitialState(key, Row(**dict(zip(("times", "ids", "amounts"), columns))), None)
        at, id_ = max((r.at, r.id) for r in group)
        total = Row(slice=key[2], n=len(group), sum_cents=sum(r.cents for r in group), last_at=at, latest_at=at, latest_id=id_)
        begun[1].processor.handleInitialState(key[:2], total, None)
    more = [arrival("uid", "=k", draw.randrange(10**8), 1000 + n, n) for n in range(100)]
    assert placed(more, *fed, draw) == placed(more, *begun, draw)


def test_a_customer_costs_two_calls_a_step():
    """The third purchase of a customer: one read and one write of state in each step, whatever its history of few rows."""
    draw = random.Random(2)
    slices, totals = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
    for n in range(3):
        calls = []
        for step in (slices, totals):
            for name in ("getValueState", "getListState", "getMapState"):
                made = getattr(Store, name)
                setattr(step.store, name, lambda *a, made=made, step=step: _Counted(made(step.store, *a), calls))
            step.processor.init(step.store)
        assert placed([arrival("uid", "=k", n * 40 * 86400, n, 1)], slices, totals, draw)[n, "uid"][0] == n
    assert calls == ["get", "update"] * 2


class _Counted:
    def __init__(self, state, calls):
        self.state, self.calls = state, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.state, name)


def test_packed_rows_say_the_same():
    """One row per slice with its arrivals as a text, against one row per arrival; few rows and slices, and many."""
    draw = random.Random(3)
    plain = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
    packed = Step(S.PackedSlices(), ["kind", "key", "slice"]), Step(S.PackedTotals(), ["kind", "key"])
    for batch in range(6):
        rows = [arrival("p_emaildomain", draw.choice(["", "=a"]), draw.randrange(90 * 3600), 1000 * batch + n, n) for n in range(300)]
        rows = [Row(**(r.asDict() | {"whole": f'{{"x": "{r.id}"}}'})) for r in rows]
        found = {}
        for out in packed[1].run(packed[0].run(rows, draw), draw):
            newest = (out.latest_at, out.latest_id) if out.latest_at is not None else None
            for a in json.loads(out.arrivals):
                assert a["whole"] == f'{{"x": "{a["id"]}"}}'
                found[a["id"], out.kind] = (a["n"] + out.base_n, a["sum_cents"] + out.base_cents, max(a["last_at"], out.base_last), newest)
        assert found == placed(rows, *plain, draw)


def test_of_an_id_the_first_row_counts():
    seen = Step(S.Seen(), ["block"])
    blank = dict.fromkeys(S.FRESH.names)

    def row(id_, place, card):
        return Row(**(blank | {"transactionid": id_, "card1": card}), place=place, block=id_ // S.BLOCK_IDS)

    draw = random.Random(0)
    out = seen.run([row(5, "b", 2), row(5, "a", 1), row(S.BLOCK_IDS + 5, "c", 3), row(-1, "d", 4)], draw)
    assert sorted((r.transactionid, r.card1) for r in out) == [(-1, 4), (5, 1), (S.BLOCK_IDS + 5, 3)]
    assert seen.run([row(5, "0", 9), row(-1, "0", 9)], draw) == []
    seen.store.key = (0,)
    seen.processor.handleInitialState((0,), Row(places=[7]), None)
    assert [r.transactionid for r in seen.run([row(7, "a", 1), row(8, "a", 1)], draw)] == [8]


def test_a_busy_domain_meets_in_many_small_groups(spark):
    """45 % of all rows share a domain; the groups that the state steps get hold under 1 % each."""
    rows = X.transactions(spark, SF)
    keyed = SL.keyed_rows(S.fresh_columns(rows)).filter("kind = 'p_emaildomain'")
    n = rows.count()
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] > 0.4 * n
    assert keyed.groupBy("key", "slice").count().agg(F.max("count")).first()[0] < 0.01 * n


class _Appended(_List):
    def appendList(self, chunks):
        self.store.lists[self.at()] += list(chunks)


class BlockStore(Store):
    """As the engine's store, counting calls by kind."""

    def __init__(self):
        super().__init__()
        self.calls = []

    def getValueState(self, name, schema):
        return _Counted(super().getValueState(name, schema), self.calls)

    def getListState(self, name, schema):
        return _Counted(_Appended(self, name), self.calls)

    def getMapState(self, name, key, value):
        return _Counted(super().getMapState(name, key, value), self.calls)


class BlockStep(Step):
    def __init__(self, processor, by):
        self.processor, self.by, self.store = processor, by, BlockStore()
        processor.init(self.store)


def in_block(row, block=3):
    return Row(**(row.asDict() | {"whole": f'{{"x": "{row.id}"}}', "block": block}))


def block_steps():
    return BlockStep(S.BlockSlices(), ["kind", "block", "slice"]), BlockStep(S.BlockTotals(), ["kind", "block"])


def unpacked(outs):
    found = {}
    for out in outs:
        newest = (out.latest_at, out.latest_id) if out.latest_at is not None else None
        for a in json.loads(out.arrivals):
            assert a["whole"] == f'{{"x": "{a["id"]}"}}'
            found[a["id"], out.kind] = (a["n"] + out.base_n, a["sum_cents"] + out.base_cents, max(a["last_at"], out.base_last), newest)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_keys_of_a_block_do_not_mix(seed):
    """Several customers and domains in one block, in time and late, few rows and chunks, few slices and groups, against every key by itself."""
    draw = random.Random(seed)
    plain = Step(S.Slices(), ["kind", "key", "slice"]), Step(S.Totals(), ["to_kind", "to_key"])
    slices, totals = block_steps()
    for batch in range(6):
        rows = []
        for n in range(draw.choice([5, 400])):
            kind = draw.choice(list(SL.SLICE_SECONDS))
            width = SL.SLICE_SECONDS[kind]
            at = draw.choice([draw.randrange(3 * width), draw.randrange(-width, 90 * width), SL.NO_TIME])
            rows.append(arrival(kind, draw.choice(["", "=", "=a", "=b"]), at, 1000 * batch + n, draw.randrange(-50, 1000)))
        expected = placed(rows, *plain, draw)
        assert unpacked(totals.run(slices.run([in_block(r) for r in rows], draw), draw)) == expected


def test_customers_of_a_block_share_their_calls():
    """Forty customers of one block: one read and one write of state in each step, not one per customer."""
    draw = random.Random(5)
    steps = block_steps()
    for n in range(3):
        rows = [in_block(arrival("uid", f"=k{k}", n * 40 * 86400 + k, 100 * n + k, 1)) for k in range(40)]
        for step in steps:
            step.store.calls.clear()
        found = unpacked(steps[1].run(steps[0].run(rows, draw), draw))
        assert [step.store.calls for step in steps] == [["get", "update"]] * 2
        assert {v[0] for v in found.values()} == {n}


def test_first_state_of_a_block():
    """A block's first state, in two lots, is what its rows would have left."""
    draw = random.Random(6)
    rows = [arrival("uid", draw.choice(["", "=k", "=l"]), draw.randrange(10**8), n, n) for n in range(400)]
    fed, begun = block_steps(), block_steps()
    fed[1].run(fed[0].run([in_block(r) for r in rows], draw), draw)
    of_slice, of_key = defaultdict(list), defaultdict(list)
    for r in rows:
        of_slice[r.slice].append(r)
        of_key[r.key, r.slice].append(r)
    for slice_, some in of_slice.items():
        begun[0].store.key = ("uid", 3, slice_)
        for part in (some[::2], some[1::2]):
            columns = [[r[c] for r in part] for c in ("key", "at", "id", "cents")]
            if part:
                state = Row(**dict(zip(("names", "times", "ids", "amounts"), columns)))
                begun[0].processor.handleInitialState(begun[0].store.key, state, None)
    sums = []
    for (key, slice_), some in of_key.items():
        at, id_ = max((r.at, r.id) for r in some)
        cents = sum(r.cents for r in some)
        sums.append(Row(key=key, slice=slice_, n=len(some), sum_cents=cents, last_at=at, latest_at=at, latest_id=id_))
    begun[1].store.key = ("uid", 3)
    for part in (sums[::2], sums[1::2]):
        columns = {c: [r[c] for r in part] for c in part[0].__fields__}
        begun[1].processor.handleInitialState(("uid", 3), Row(names=columns.pop("key"), **columns), None)
    more = [in_block(arrival("uid", draw.choice(["", "=k", "=l"]), draw.randrange(10**8), 1000 + n, n)) for n in range(100)]
    found = [unpacked(steps[1].run(steps[0].run(more, draw), draw)) for steps in (fed, begun)]
    assert found[0] == found[1] and len(found[0]) == 100
