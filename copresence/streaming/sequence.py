"""What follows each ping, as a stream: legs, speeds, presence in gaps and overnight stays of the pings as they come.

A person's pings wait in state until the watermark has passed them, so that they are taken in the order of time whatever order they came in; then
each is given out once, with the ping that follows it, or without where none follows within the longest gap. Event-time timers do both. What
the batch operators compute from a ping and its successor is the same column expressions here (`*_between` in clean.py and presence.py).

State of a person: the pings of the last `lateness`, and three single pings. Pings behind the watermark are late and dropped, as Spark does before
any stateful operator; pings in time give the rows of the batch operators. The last ping of a person is given out once the
watermark has passed it by the longest gap. Without jitter, a person's second ping that leaps waits for a third, which drops it as the batch filter
does; where none comes within the longest gap it is kept.

Rows come out when the watermark has already passed them, so a later stage with a watermark of its own reads them from a table that this
stage writes, and not in the same query. The state needs the RocksDB provider (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import cos, radians, sqrt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from copresence.config import Config
from copresence.functions.geo import METERS_A_DEGREE
from copresence.functions.rules import MICROS_HOUR
from copresence.operators.clean import legs_between, speed_to
from copresence.operators.presence import made_up_between, stays_between

PING = T.StructType().add("us", "long").add("ping_id", "long").add("lat", "double").add("lon", "double")
FOLLOWED = T.StructType([T.StructField("person", T.IntegerType()), *PING.fields, T.StructField("n", PING)])


def use_rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks with timers and maps, which the in-memory provider has not."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _leaps(before: tuple, now: tuple) -> bool:
    """clean.leaps for two pings (us, ping_id, lat, lon)."""
    hours = (now[0] - before[0]) / MICROS_HOUR
    if not 0 < hours < 0.5:
        return False
    dy = (now[2] - before[2]) * METERS_A_DEGREE
    dx = (now[3] - before[3]) * METERS_A_DEGREE * cos(radians((before[2] + now[2]) * 0.5))
    return sqrt(dy * dy + dx * dx) / 1000.0 / hours > 1000


class NextPing(StatefulProcessor):
    """Pings of a person -> each ping with its successor. max_gap_us: after which a ping has none; drop_leaps: without jitter."""

    def __init__(self, max_gap_us: int, drop_leaps: bool):
        self.max_gap_us, self.drop_leaps = max_gap_us, drop_leaps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PING)
        self.last = handle.getValueState("last", T.StructType([T.StructField("seen", T.LongType()), T.StructField("before", PING), T.StructField("open", PING), T.StructField("held", PING)]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, new = timerValues.getCurrentWatermarkInMs() * 1000, []
        for r in rows:
            if r.us > passed:
                new.append((r.us, r.ping_id, r.lat, r.lon))
        if new:
            self.waiting.appendList(new)
            # the earliest is enough: a timer takes all that the watermark has passed, and sets the next one
            self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-rest[0][0] // 1000))
        state = self.last.get()
        seen, before, open_, held = (0, None, None, None) if state is None else (state[0], *(None if s is None else tuple(s) for s in state[1:]))
        out = []

        def follow(ping: tuple | None) -> tuple | None:
            if open_ is not None:
                out.append((open_, ping if ping is not None and ping[0] - open_[0] <= self.max_gap_us else None))
            return ping

        for now in ready:
            seen += 1
            if held is not None:  # a third ping: the second was jitter, unless it has been kept by now
                if now[0] - held[0] > self.max_gap_us:
                    open_ = follow(held)
                held = None
            leap = self.drop_leaps and before is not None and _leaps(before, now)
            before = now
            if leap:
                held = now if seen == 2 else None
            else:
                open_ = follow(now)
        if held is not None and passed > held[0] + self.max_gap_us:
            open_, held = follow(held), None
        if open_ is not None and passed > open_[0] + self.max_gap_us:
            open_ = follow(None)
        for ping in (open_, held):
            if ping is not None:
                self.handle.registerTimer((ping[0] + self.max_gap_us) // 1000 + 1)
        self.last.update((seen, before, open_, held))
        for ping, following in out:
            yield Row(person=key[0], us=ping[0], ping_id=ping[1], lat=ping[2], lon=ping[3], n=following)

    def close(self) -> None:
        pass


def followed(pings: DataFrame, max_gap_hours: float, lateness: str = "1 hour", drop_leaps: bool = False) -> DataFrame:
    """Streaming pings(person, ping_id, ts timestamp, lat, lon) -> (person, us, ping_id, lat, lon, n): what follows each within the gap."""
    read = pings.select("person", "ts", F.unix_micros("ts").alias("us"), "ping_id", "lat", "lon").withWatermark("ts", lateness)
    processor = NextPing(int(max_gap_hours * MICROS_HOUR), drop_leaps)
    return read.groupBy("person").transformWithState(statefulProcessor=processor, outputStructType=FOLLOWED, outputMode="Append", timeMode="EventTime")


def legs_stream(pings: DataFrame, config: Config, lateness: str = "1 hour", drop_leaps: bool = False) -> DataFrame:
    """The rows of clean.segments (of drop_jitter, where leaps are dropped)."""
    return legs_between(followed(pings, config.travel_max_gap_hours, lateness, drop_leaps), config.travel_max_gap_hours)


def presence_stream(pings: DataFrame, config: Config, lateness: str = "1 hour") -> DataFrame:
    """The rows of presence.interpolated."""
    return made_up_between(legs_stream(pings, config, lateness))


def overnight_stream(pings: DataFrame, homes: DataFrame, config: Config, lateness: str = "1 hour") -> DataFrame:
    """The rows of presence.overnight_fill; homes are a table."""
    return stays_between(followed(pings, config.travel_max_gap_hours, lateness), homes, config)


def speed_stream(pings: DataFrame, lateness: str = "1 hour", drop_leaps: bool = False) -> DataFrame:
    """(person, ping_id, ts, us, lat, lon, speed_kmh): the speeds of clean.with_speed."""
    c = F.col
    found = followed(pings, 2.0, lateness, drop_leaps)
    return found.select("person", "ping_id", F.timestamp_micros("us").alias("ts"), "us", "lat", "lon", speed_to(c("n.us") - c("us"), c("lat"), c("lon"), c("n.lat"), c("n.lon")).alias("speed_kmh"))
