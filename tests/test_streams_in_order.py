"""Streams whose rows arrive out of order over several batches give what the batch form gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlab.streaming import live, ordered

START = dt.datetime(2024, 1, 1)
KEYS = ["participant", "session"]


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def shuffled_batches(rows, late_by):
    """Rows in an arrival order that is at most ``late_by`` seconds behind the event order, cut into three files."""
    rng = random.Random(3)
    arrival = sorted(rows, key=lambda r: r[2].timestamp() + rng.random() * late_by)
    cut = len(arrival) // 3
    return arrival[:cut], arrival[cut : 2 * cut], arrival[2 * cut :]


def run(spark, tmp_path, schema, batches, make):
    source, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/b{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    made = make(stream)
    query = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(str(out))


def test_majority_follows_event_order_across_batches(spark, rocksdb, tmp_path):
    rng = random.Random(1)
    schema = "participant int, session int, ts timestamp, event_id long, hit int"
    rows = [(p, 0, START + dt.timedelta(seconds=20 * k + p), 100 * k + p, rng.randrange(2)) for k in range(60) for p in (1, 2)]
    last = [(9, 9, START + dt.timedelta(days=2), 10**6, 1)]  # moves the watermark past all others
    got = run(spark, tmp_path, schema, [*shuffled_batches(rows, 300), last], lambda s: ordered.smooth_majority(s, KEYS, "event_id", "hit", 5, "ts", "30 days", "10 minutes"))
    want = live.smooth_majority_batch(spark.createDataFrame(rows, schema), KEYS, ["ts", "event_id"], "hit", 5)
    assert sorted((r.participant, r.event_id, r.smoothed) for r in got.collect()) == sorted((r.participant, r.event_id, r.smoothed) for r in want.collect())


def test_intervals_follow_event_order_and_open_ones_come_out(spark, rocksdb, tmp_path):
    rng = random.Random(2)
    schema = "participant int, session int, ts timestamp, event_id long, marker string"
    names = ["start_activity", "end_activity", "Start_Fatigue", "end_fatigue", "tick", None]
    rows = [(p, 0, START + dt.timedelta(seconds=20 * k + p), 100 * k + p, rng.choice(names)) for k in range(60) for p in (1, 2)]
    tail = [(9, 9, START + dt.timedelta(days=2), 10**6, "tick")]
    batches = [*shuffled_batches(rows, 300), tail, [(9, 9, START + dt.timedelta(days=3), 10**6 + 1, "tick")]]
    got = run(spark, tmp_path, schema, batches, lambda s: ordered.marker_intervals(s, ["activity", "fatigue"], KEYS, "marker", "event_id", "ts", "12 hours", "10 minutes"))
    want = []
    for p in (1, 2):
        opened = {}
        for _, _, ts, number, marker in sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[3])):
            for label in ("activity", "fatigue"):
                at = ts.timestamp() * 1000 - START.timestamp() * 1000
                if f"start_{label}" in (marker or "").lower():
                    opened[label] = at
                elif f"end_{label}" in (marker or "").lower() and label in opened:
                    want.append((p, opened.pop(label), at, label, number))
        want += [(p, at, None, label, None) for label, at in opened.items()]
    base = got.agg(F.min("start")).first()[0]
    low = min(w[1] for w in want)
    seen = [(r.participant, r.start - base + low, None if r.end is None else r.end - base + low, r.label, r.ord) for r in got.collect()]
    assert sorted(seen, key=repr) == sorted(want, key=repr) and any(w[2] is None for w in want)


def test_a_keys_rows_cost_one_call_of_the_state_store():
    import pandas as pd
    from pyspark.sql import types as T

    from sessionlab.streaming import ordered

    calls = []

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    class Rows:
        held = ()

        def get(self):
            return iter(self.held)

        def appendList(self, rows):
            calls.append("append")
            self.held = [*self.held, *rows]

        def put(self, rows):
            calls.append("put")
            self.held = list(rows)

        def clear(self):
            calls.append("clear")
            self.held = ()

    class Handle:
        def getListState(self, name, schema):
            return Rows()

        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            pass

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    class Plain(ordered.InOrder):
        def open_state(self, handle):
            pass

        def take(self, key, ms, number, value):
            return [(*key, ms, number, value)]

    plain = Plain(["k"], "ts", "n", "v", T.IntegerType(), 10**9, ["k", "ms", "n", "v"])
    plain.init(Handle())
    clock = Clock()
    rows = pd.DataFrame({"ts": pd.to_datetime([30, 10, 20, 20], unit="ms"), "n": [3, 1, 2, 2], "v": [7, 8, 9, 5]})
    assert list(plain.handleInputRows((1,), iter([rows]), clock)) == []
    clock.now = 20
    assert [tuple(r) for r in next(plain.handleExpiredTimer((1,), clock, None)).itertuples(index=False)] == [(1, 10, 1, 8), (1, 20, 2, 5)]
    clock.now = 40
    assert [tuple(r) for r in next(plain.handleExpiredTimer((1,), clock, None)).itertuples(index=False)] == [(1, 30, 3, 7)]
    assert calls == ["append", "put", "clear"]


@pytest.mark.parametrize("buckets", [1, 64])
def test_keys_that_share_a_call_keep_their_own_starts_and_limits(spark, tmp_path, buckets):
    day = dt.timedelta(days=1)
    schema = "participant int, session int, ts timestamp, event_id long, at double, marker string"
    # key (1, 0) falls silent after the first file, (None, 0) pairs across files, (3, 0) closes what it never opened
    files = [
        [(1, 0, START, 1, 1.0, "Start_a"), (None, 0, START, 2, 2.0, "start_a"), (3, 0, START, 3, 3.0, "end_a"), (1, 0, START, 4, 4.0, "tick")],
        [(None, 0, START + 3 * day, 6, 6.0, "END_A"), (None, 0, START + 3 * day, 5, 5.0, "start_b"), (3, 0, START + 3 * day, 7, 7.0, None)],
        [(3, 0, START + 6 * day, 8, 8.0, "start_b"), (3, 0, START + 6 * day, 9, 9.0, "end_b")],
    ]
    made = run(spark, tmp_path, schema, files, lambda s: live.marker_intervals_stream(s, ["a", "b"], KEYS, "at", "marker", "event_id", "ts", "2 days", "1 hour", buckets=buckets))
    assert [(f.name, f.dataType.simpleString()) for f in made.schema][:2] == [("participant", "int"), ("session", "int")]
    found = sorted(map(tuple, made.collect()), key=str)
    # once the third file has moved the watermark past their limits, open starts come out without an end
    assert found == sorted([(None, 0, 2.0, 6.0, "a", 6), (1, 0, 1.0, None, "a", None), (None, 0, 5.0, None, "b", None), (3, 0, 8.0, 9.0, "b", 9)], key=str)


def test_keys_of_a_group_share_the_calls_of_the_state_store():
    import pandas as pd
    from pyspark.sql import types as T

    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return iter(self.held or ()) if isinstance(self.held, list) or self.held is None and self.rows else self.held

        def __init__(self, rows):
            self.rows = rows

        def appendList(self, rows):
            calls.append("append")
            self.held = [*(self.held or []), *rows]

        def put(self, rows):
            calls.append("put")
            self.held = list(rows)

        def update(self, x):
            calls.append("update")
            self.held = x

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        def getListState(self, name, schema):
            return State(True)

        def getValueState(self, name, schema):
            return State(False)

        def registerTimer(self, at):
            calls.append(at)

        def deleteTimer(self, at):
            calls.append(-at)

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    smooth = ordered.Majority(2, keys=["k"], ts="ts", order="n", value="v", value_type=T.IntegerType(), ttl_ms=50, names=["k", "n", "smoothed"])
    smooth.init(Handle())
    clock, keys, made = Clock(), [f'{{"k":{k}}}' for k in range(300)], []
    for batch, (clock.now, stamps) in enumerate([(0, (30, 10, 20)), (20, (40, 25, 60)), (59, ())]):
        rows = pd.DataFrame([(pd.Timestamp(ms, unit="ms"), ms, int(ms != 20), k) for ms in stamps for k in keys], columns=["ts", "n", "v", ordered.KEY])
        list(smooth.handleInputRows((1,), iter([rows]), clock))
        made += [tuple(r) for pdf in smooth.handleExpiredTimer((1,), clock, None) for r in pdf.itertuples(index=False)]
    assert sorted(made) == sorted((k, n, s) for k in keys for n, s in ((10, 1), (20, 0), (25, 0), (30, 1), (40, 1)))
    assert len(calls) < 40  # however many keys
    clock.now = 200
    assert [r for pdf in smooth.handleExpiredTimer((1,), clock, None) for r in pdf["n"]] == [60] * 300
    assert smooth.carried.held is None and smooth.waiting.held is None and smooth.timer.held is None
