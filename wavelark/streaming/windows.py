"""The same windows on event streams: watermarked aggregates, and trigger sessions with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavelark.functions.scalar import pearson


def sliding_density(events: DataFrame, size: str, step: str, late: str, time: str = "ts", channel: str = "event_type", active: Column | None = None) -> DataFrame:
    """(window, n_events, n_active) per sliding window: rows, and the channels (some dozens) that have an active row in it; without a
    condition every row is active. Watermarks need a TIMESTAMP, so the time is cast."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    on = F.col(channel) if active is None else F.when(active, F.col(channel))
    return e.groupBy(F.window(time, size, step)).agg(F.count("*").alias("n_events"), F.size(F.collect_set(on)).cast("long").alias("n_active"))


def sliding_correlation(samples: DataFrame, size: str, step: str, late: str, time: str = "ts") -> DataFrame:
    """(window, a, b, r) of samples (ts, key, value): every two series' correlation in sliding windows, null if either is constant. Samples
    of one time meet by a stream-stream join, whose state the watermark bounds; the moments are one windowed aggregate."""
    e = samples.withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", late)
    one, two = e.select("ts", F.col("key").alias("a"), F.col("value").alias("x")), e.select("ts", F.col("key").alias("b"), F.col("value").alias("y"))
    met = one.join(two, "ts").where("a < b")
    return met.groupBy(F.window("ts", size, step), "a", "b").agg(pearson(F.col("x"), F.col("y")).alias("r"))


def stream_sessions(events: DataFrame, key: str, max_gap: float, min_duration: float, late: str, time: str = "ts", value: str = "event_type") -> DataFrame:
    """(key, start, end, trigger_value): sessions that break at a gap of max_gap or a change of value. Built-in session
    windows merge at the exact gap and ignore values, so the open session of each key is kept as state; it is
    closed when the watermark has passed its end by max_gap."""
    e = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("string").alias("v")).withWatermark("ts", late)

    def step(name, frames, state: GroupState):
        open_ = list(state.get) if state.exists else None
        done = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["ts", "v"])
            for t, v in zip(rows["ts"].map(lambda x: x.timestamp()), rows["v"], strict=True):
                if open_ and t - open_[1] < max_gap and v == open_[2]:
                    open_[1] = t
                else:
                    done += [open_] if open_ else []
                    open_ = [t, t, v]
        else:
            done, open_ = [open_], None
        if open_:
            state.update(tuple(open_))
            state.setTimeoutTimestamp(max(int((open_[1] + max_gap) * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        keep = [s for s in done if s[1] - s[0] >= min_duration]
        yield pd.DataFrame({"key": [name[0]] * len(keep), "start": [s[0] for s in keep], "end": [s[1] for s in keep], "trigger_value": [s[2] for s in keep]})

    return e.groupBy("key").applyInPandasWithState(step, "key string, start double, end double, trigger_value string", "start double, end double, value string", "append", GroupStateTimeout.EventTimeTimeout)


_RUN = "times array<double>, numbers array<double>, waiting array<double>, last_time double, last_value double, start double, first double"


def stream_trends(samples: DataFrame, keys: tuple[str, ...], min_duration: float, late: str, rising: bool = True, time: str = "ts", value: str = "value", mask: bool = False) -> DataFrame:
    """(keys, start_sec, end_sec, height) of the maximal rising (or falling) runs of each series of a stream, as `segments.trends` gives them;
    with mask, (keys, time, active) of each sample instead, 1 within a run that is long enough.

    A series keeps the samples that the watermark hasn't passed, since a late one may still fall between them, and its open run. What the
    watermark has passed is settled in order of time; a run is told when it breaks, or, for the mask, its samples then. A timer
    settles what is left when no new samples come."""
    e = samples.select(*keys, F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    names = ["time", "active"] if mask else ["start_sec", "end_sec", "height"]

    def step(key, frames, state: GroupState):
        held = list(state.get) if state.exists else [[], [], [], None, None, None, None]
        times, numbers, waiting = (list(h) for h in held[:3])  # waiting: a mask's samples of the open run
        last_time, last_value, start, first = held[3:]
        for pdf in frames if not state.hasTimedOut else []:
            times += [t.timestamp() for t in pdf["ts"]]
            numbers += pdf["value"].tolist()
        passed = state.getCurrentWatermarkMs() / 1000
        out = []
        order = sorted(range(len(times)), key=times.__getitem__)
        ready = [k for k in order if times[k] <= passed]
        rest = [k for k in order if times[k] > passed]

        def close(end_time, end_value):
            if start is None:
                return
            good = end_time - start >= min_duration
            if mask:
                out.extend((t, int(good)) for t in waiting)
                waiting.clear()
            elif good:
                out.append((start, end_time, end_value - first))

        for k in ready:
            t, v = times[k], numbers[k]
            up = last_value is not None and (v > last_value if rising else v < last_value)
            if up and start is None:
                start, first = t, v
            elif not up:
                close(last_time, last_value)
                start = first = None
            if mask:
                if up:
                    waiting.append(t)
                else:
                    out.append((t, 0))
            last_time, last_value = t, v
        state.update(([times[k] for k in rest], [numbers[k] for k in rest], waiting, last_time, last_value, start, first))
        if rest:
            state.setTimeoutTimestamp(max(int(times[rest[0]] * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        columns = dict(zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True))
        yield pd.DataFrame({**{k: [x] * len(out) for k, x in zip(keys, key, strict=True)}, **{c: list(v) for c, v in columns.items()}}, dtype=object if not out else None)

    kinds = ", ".join(f"{k} {dict(e.dtypes)[k]}" for k in keys)
    schema = f"{kinds}, time double, active int" if mask else f"{kinds}, start_sec double, end_sec double, height double"
    return e.groupBy(*keys).applyInPandasWithState(step, schema, _RUN, "append", GroupStateTimeout.EventTimeTimeout)
