"""Streaming operators that follow event order even when rows arrive out of order.

Rows wait in a list state, with event time and order number, until the watermark has passed them; it is written and read as a whole, since
every call of the state store costs the same, whether for a row or for all of a key; an event-time timer then hands
them on in order, one after another, to a small step that carries a list or map state. So the result is that of the batch twin for
every row that is not later than the watermark allows, however micro-batches cut the stream. A key that stays idle for ``ttl`` of
event time is closed and forgotten. The state store must be RocksDB (``use_rocksdb``).

Keys are dealt to groups, since a call of the state store costs about the same whatever it holds: a group's rows of a micro-batch are one entry, its keys'
lists and maps one value, and it has one timer.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Groups that keys are dealt to, the column that has a row's group, and that of its key as JSON; Spark makes named tuples of rows, so names begin with a letter.
BUCKETS, BUCKET, KEY = 1024, "dealt_to", "dealt_key"
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them; subclasses define ``open_state``, ``take`` and ``finish``."""

    def __init__(self, keys: Sequence[str], ts: str, order: str, value: str, value_type: T.DataType, ttl_ms: int, names: Sequence[str]):
        self.keys, self.ts, self.order, self.value, self.value_type, self.ttl, self.names = list(keys), ts, order, value, value_type, ttl_ms, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = T.StructType([T.StructField("ms", T.LongType()), T.StructField("number", T.LongType()), T.StructField("value", self.value_type)])
        self.waiting = handle.getListState("waiting", row)
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("ms", T.LongType())]))
        self.open_state(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.latest.get()
        first, last, new = None, None if before is None else before[0], []
        for pdf in rows:
            stamps = (pdf[self.ts].astype("int64") // {"datetime64[ns]": 10**6, "datetime64[us]": 10**3, "datetime64[ms]": 1}[str(pdf[self.ts].dtype)]).tolist()
            for ms, number, value in zip(stamps, pdf[self.order].tolist(), pdf[self.value].tolist(), strict=True):
                new.append((ms, int(number), value))
                first = ms if first is None else min(first, ms)
                last = ms if last is None else max(last, ms)
        if first is None:
            return
        self.waiting.appendList(new)
        if before is None or last > before[0]:
            self.latest.update((last,))
        self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        self.handle.registerTimer(last + self.ttl)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {(ms, number): value for ms, number, value in self.waiting.get()}  # of rows equal in both the last counts
        out, left = [], []
        for (ms, number), value in sorted(held.items(), key=lambda x: x[0]):
            if ms > now:
                left.append((ms, number, value))
            else:
                out += self.take(key, ms, number, value)
        if left:
            self.handle.registerTimer(left[0][0])
            if len(left) < len(held):
                self.waiting.put(left)
        else:
            if held:
                self.waiting.clear()
            latest = self.latest.get()
            if latest is not None and latest[0] + self.ttl <= now:
                out += self.finish(key)
                self.latest.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def finish(self, key) -> list[tuple]:
        return []


class Dealt(InOrder):
    """As ``InOrder`` for a group of keys, which rows name by KEY; subclasses define ``opened``, ``take`` and ``finish``, which get what they carry for a row's key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.carried = handle.getValueState("carried", T.StructType([T.StructField("keys", T.StringType())]))
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("ms", T.LongType())]))

    def opened(self):
        """What a key carries at first, as JSON can hold it."""
        raise NotImplementedError

    def wake(self, ms: int) -> None:
        before = self.timer.get()
        if before is None or ms < before[0]:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def held(self, key, ms, number, value) -> tuple:
        kind = pa.int32() if isinstance(self.value_type, T.IntegerType) else pa.string()
        columns = [pa.array(key, pa.string()), pa.array(ms, pa.int64()), pa.array(number, pa.int64()), pa.array(value, kind, from_pandas=True)]
        batch, sink = pa.RecordBatch.from_arrays(columns, names=["key", "ms", "number", "value"]), io.BytesIO()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return (sink.getvalue(),)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = [], None
        for pdf in rows:
            if len(pdf):
                ms = pdf[self.ts].astype("int64") // {"datetime64[ns]": 10**6, "datetime64[us]": 10**3, "datetime64[ms]": 1}[str(pdf[self.ts].dtype)]
                new.append(self.held(pdf[KEY], ms, pdf[self.order], pdf[self.value]))
                first = int(ms.min()) if first is None else min(first, int(ms.min()))
        if new:
            self.waiting.appendList(new)
            self.wake(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), {}
        entries = [x[0] for x in self.waiting.get()]
        for entry in entries:
            for batch in pa.ipc.open_stream(entry):
                who, ms, number, value = (c.to_pylist() for c in batch.columns)
                held.update(zip(zip(ms, number, who), value))  # of a key's rows equal in both the last counts
        before = self.carried.get()
        keys, out, left = {} if before is None else json.loads(before[0]), [], []
        for (ms, number, who), value in sorted(held.items(), key=lambda x: x[0]):
            if ms > now:
                left.append((who, ms, number, value))
                continue
            mine = keys.setdefault(who, [ms, self.opened()])
            mine[0] = max(mine[0], ms)
            out += self.take(mine[1], who, ms, number, value)
        waiting = {x[0] for x in left}
        for who in [k for k, (latest, _) in keys.items() if latest + self.ttl <= now and k not in waiting]:
            out += self.finish(keys.pop(who)[1], who)
        if len(left) < len(held):
            if left:
                self.waiting.put([self.held(*zip(*left))])
            else:
                self.waiting.clear()
        if keys:
            self.carried.update((json.dumps(keys),))
        elif before is not None:
            self.carried.clear()
        self.timer.clear()
        times = [*(x[1] for x in left[:1]), *(max(latest + self.ttl, now + 1) for latest, _ in keys.values())]
        if times:
            self.wake(min(times))
        if out:
            yield pd.DataFrame(out, columns=self.names)


class Majority(Dealt):
    """1 if more than half of a key's last n decisions are 1."""

    def __init__(self, n: int, **given):
        super().__init__(**given)
        self.n = n

    def opened(self) -> list:
        return []

    def take(self, hits, key, ms, number, value) -> list[tuple]:
        hits.append(int(value or 0))
        del hits[: -self.n]
        return [(key, number, int(sum(hits) / len(hits) > 0.5))]

    def finish(self, hits, key) -> list[tuple]:
        return []


class Intervals(Dealt):
    """Pairs a key's start and end markers; starts that are open when a key is forgotten come out with a null end."""

    def __init__(self, labels: Sequence[str], origin_ms: int, **given):
        super().__init__(**given)
        self.labels, self.origin = list(labels), origin_ms

    def opened(self) -> dict:
        return {}

    def take(self, starts, key, ms, number, value) -> list[tuple]:
        text, at, out = (value or "").lower(), float(ms - self.origin), []
        for label in self.labels:
            if f"start_{label}" in text:
                starts[label] = at
            elif f"end_{label}" in text and label in starts:
                out.append((key, starts.pop(label), at, label, number))
        return out

    def finish(self, starts, key) -> list[tuple]:
        return [(key, start, None, label, None) for label, start in starts.items()]


def _run(stream: DataFrame, keys: Sequence[str], ts: str, lateness: str, processor: Dealt, schema: T.StructType, buckets: int) -> DataFrame:
    """The processor over groups of keys; ``schema`` is that of its rows, which name their key by KEY."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias(BUCKET)
    needed = [F.col(c) for c in dict.fromkeys((ts, processor.order, processor.value))]
    timed = stream.withWatermark(ts, lateness).select(bucket, F.to_json(F.struct(*keys), JSON).alias(KEY), *needed)
    found = timed.groupBy(BUCKET).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    key_schema, rest = T.StructType([stream.schema[k] for k in keys]), schema.names[1:]
    return found.select(F.from_json(KEY, key_schema, JSON).alias(KEY), *rest).select(f"{KEY}.*", *rest)


def smooth_majority(
    stream: DataFrame, keys: Sequence[str], order: str, flag: str, n: int, ts: str, ttl: str, lateness: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """(keys..., order, smoothed): last-``n`` majority per key by event time, then ``order``; a row comes out once the watermark has passed it."""
    schema = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(order, T.LongType()), T.StructField("smoothed", T.IntegerType())])
    given = {"keys": keys, "ts": ts, "order": order, "value": flag, "value_type": T.IntegerType(), "ttl_ms": _ms(ttl), "names": schema.names}
    return _run(stream, keys, ts, lateness, Majority(n, **given), schema, buckets)


def marker_intervals(
    stream: DataFrame, labels: Sequence[str], keys: Sequence[str], marker: str, order: str, ts: str, ttl: str, lateness: str = "1 hour", origin_ms: int = 0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(keys..., start, end, label, ord): marker pairing by event time, then ``order``; times in ms since ``origin_ms``."""
    schema = T.StructType([
        T.StructField(KEY, T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("label", T.StringType()),
        T.StructField("ord", T.LongType()),
    ])
    given = {"keys": keys, "ts": ts, "order": order, "value": marker, "value_type": T.StringType(), "ttl_ms": _ms(ttl), "names": schema.names}
    return _run(stream, keys, ts, lateness, Intervals(labels, origin_ms, **given), schema, buckets)


def _ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)
