"""Structured Streaming forms of the session operators.

Every operator takes and returns a DataFrame and also runs on a batch one where noted, so the
batch twin states the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import scan


# ---------------------------------------------------------------- last-n majority
def smooth_majority_batch(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, n: int) -> DataFrame:
    """``smoothed`` = 1 if more than half of the last ``n`` 0/1 decisions (this one included) are 1.

    Running counts n rows apart give the window sum, so a long session stays chunked.
    """
    s = scan(df, keys, order, {"_r": ("rank",), "_c": ("cumsum", flag)})
    back = s.select(*keys, (F.col("_r") + n).alias("_r"), F.col("_c").alias("_b"))
    out = s.join(back, [*keys, "_r"], "left")
    hits = F.col("_c") - F.coalesce("_b", F.lit(0))
    return out.withColumn("smoothed", (hits / F.least(F.col("_r"), F.lit(n)) > 0.5).cast("int")).select(*df.columns, "smoothed")


def _expire_after(state: GroupState, stamps: pd.Series, ttl_ms: int) -> None:
    """Forget a key once the watermark is ``ttl_ms`` past its latest event."""
    last = int(stamps.max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_ms)


def smooth_majority(
    stream: DataFrame, keys: Sequence[str], order: str, flag: str, n: int, ts: str, ttl: str, lateness: str = "1 hour"
) -> DataFrame:
    """Streaming last-``n`` majority per key, one output per event, in event order inside a batch.

    The state is the last ``n`` decisions; a key idle for ``ttl`` of event time starts afresh, as a new recording would. Order holds
    inside a micro-batch: a row that arrives in a later batch than its successors is smoothed where it arrives.
    """
    kfields = [stream.schema[k] for k in keys]
    out_schema = T.StructType([*kfields, stream.schema[order], T.StructField("smoothed", T.IntegerType())])
    state_schema = T.StructType([T.StructField("last", T.ArrayType(T.IntegerType()))])
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(order)  # one key's share of one micro-batch, bounded by the source's rate limit
        smoothed = []
        for hit in pdf[flag].astype(int):
            last = [*last, int(hit)][-n:]
            smoothed.append(int(sum(last) / len(last) > 0.5))
        state.update((last,))
        _expire_after(state, pdf[ts], ms)
        yield pd.DataFrame({**{k: [v] * len(pdf) for k, v in zip(keys, key)}, order: pdf[order].to_numpy(), "smoothed": smoothed})

    timed = stream.withWatermark(ts, lateness)
    return timed.groupBy(*keys).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- resampling and windows
def resample_mean_stream(stream: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], period: str, lateness: str) -> DataFrame:
    """Mean per tumbling bin; rows later than the watermark are dropped."""
    w = F.window(ts, period)
    out = stream.withWatermark(ts, lateness).groupBy(*keys, w.alias("_w")).agg(*[F.avg(c).alias(c) for c in cols])
    return out.select(*keys, F.col("_w.start").alias(ts), *cols)


def sliding_stats(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], size: str, step: str, need: int = 1, lateness: str | None = None
) -> DataFrame:
    """Count, mean, std (population), min and max per sliding window with at least ``need`` rows (batch or stream)."""
    src = df.withWatermark(ts, lateness) if lateness else df
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = src.groupBy(*keys, F.window(ts, size, step).alias("_w")).agg(*aggs).where(F.col("n") >= need)
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c not in (*keys, "_w")])


# ---------------------------------------------------------------- markers
#: Groups that the keys of a stream are dealt to. A call of a group's function costs some milliseconds whatever it holds, so keys share them.
BUCKETS = 1024
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def pair_markers(pdf: pd.DataFrame, opened: dict[str, dict[str, float]], labels: Sequence[str], time: str, marker: str, pos: str) -> list[tuple]:
    """(key, start, end, label, ord) of the intervals that rows of many keys (column ``_key``) close, in order ``pos``; ``opened`` holds each key's open starts."""
    rows, meanings = [], {}
    pdf = pdf.sort_values(pos, kind="stable")
    for key, t, text, at in zip(pdf["_key"].tolist(), pdf[time].tolist(), pdf[marker].tolist(), pdf[pos].tolist(), strict=True):
        if text not in meanings:
            low = (text or "").lower()
            meanings[text] = [(label, f"start_{label}" in low) for label in labels if f"start_{label}" in low or f"end_{label}" in low]
        for label, starts in meanings[text]:
            if starts:
                opened.setdefault(key, {})[label] = float(t)
            elif label in opened.get(key, ()):
                rows.append((key, opened[key].pop(label), float(t), label, int(at)))
    return rows


def marker_intervals_stream(
    stream: DataFrame, labels: Sequence[str], keys: Sequence[str], time: str, marker: str, pos: str, ts: str, ttl: str, lateness: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """Online marker pairing: one row per closed interval, absolute times, in file order ``pos`` inside a batch.

    Starts still open ``ttl`` after a key's last event come out with a null end before they are forgotten, so none is lost unseen. Keys are
    dealt to ``buckets`` groups; a group's state holds the open starts and the time limit of each of its keys.
    """
    key_schema = T.StructType([stream.schema[k] for k in keys])
    out_schema = T.StructType(
        [
            T.StructField("_key", T.StringType()),
            T.StructField("start", T.DoubleType()),
            T.StructField("end", T.DoubleType()),
            T.StructField("label", T.StringType()),
            T.StructField("ord", T.LongType()),
        ]
    )
    state_schema = T.StructType(
        [
            T.StructField("open", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
            T.StructField("until", T.MapType(T.StringType(), T.LongType())),
        ]
    )
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(bucket, frames: Iterator[pd.DataFrame], state: GroupState):
        now, rows = state.getCurrentWatermarkMs(), []
        opened, until = ({k: dict(v) for k, v in state.get[0].items()}, dict(state.get[1])) if state.exists else ({}, {})
        if not state.hasTimedOut:
            pdf = pd.concat(list(frames))  # a bucket's share of one micro-batch
            rows = pair_markers(pdf, opened, labels, time, marker, pos)
            for key, last in pdf.groupby("_key")[ts].max().items():
                until[key] = max(int(last.timestamp() * 1000), now) + ms
        # as with a limit of its own for every key: those without rows in this batch end once the watermark is past their limit
        for key in [k for k, limit in until.items() if limit < now]:
            rows += [(key, start, None, label, None) for label, start in opened.pop(key, {}).items()]
            del until[key]
        if until:
            state.update(({k: v for k, v in opened.items() if v}, until))
            state.setTimeoutTimestamp(min(until.values()))
        else:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=out_schema.names)

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    needed = [F.col(c) for c in dict.fromkeys((ts, time, marker, pos))]
    timed = stream.withWatermark(ts, lateness).select(bucket, F.to_json(F.struct(*keys), _JSON).alias("_key"), *needed)
    found = timed.groupBy("_bucket").applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("_key", key_schema, _JSON).alias("_keys"), "start", "end", "label", "ord").select("_keys.*", "start", "end", "label", "ord")


# ---------------------------------------------------------------- deduplication
def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, lateness: str) -> DataFrame:
    """First row of every (keys..., stamp) within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*keys, ts])
