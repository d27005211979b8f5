"""Streaming detectors that remember a little per user, and give the rows of their batch twins.

New devices keep a map of a user's devices with the first login of each; logins may come in any order, as an
alert that an earlier login overturns is withdrawn. The others need a user's rows in order of
time: rows wait in the user's state until the watermark has passed them, a timer releases them
in order, and what later rows need of them is a few values, whatever the history holds: the
last types for the sequence model, and the last failures for brute force.

A batch costs its own rows and those it releases; nothing of earlier batches is read again. State
is RocksDB's, kept under the job's checkpoint, so a batch that is run again after a failure starts
from the state before it. Users are dealt to buckets by a hash, and a task is handed a bucket's rows of a batch at
once, in Arrow frames; a user's state is one entry of the bucket's map, read and written once a batch. Where a
user's rows can be merged before that (logins from one device), they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskline.config import RuleConfig
from riskline.functions import scalar as S
from riskline.operators.markov import MarkovModel
from riskline.session import ship, work_dir
from riskline.sources.activity import activity_events
from riskline.streaming.jobs import BATCH, _each_batch, _write

ship(__name__)

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
# Groups that users are dealt to by a hash; a checkpoint holds for this number only.
BUCKETS = 1024
# Values that an entry of a user holds, the others having entries of their own; and the name of that entry.
INLINE, RECORD = 500, "*"


@contextmanager
def _keyed(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """The settings that a query with keyed state takes when it starts, and keeps."""
    wanted = {STORE: ROCKS} | ({PARTITIONS: str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def _bucket(column: str):
    """The grouping key of the state: a call for each user would cost far more than the user's rows."""
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def named(value) -> str:
    """A text for a key of a map state, which takes no null."""
    return "" if value is None else f"={value}"


def _plain(column: pd.Series) -> list:
    """Python values, None for missing ones."""
    return column.astype(object).where(column.notna(), None).tolist()


class Devices(StatefulProcessor):
    """First login of a user from each device; the user's first login at all is no alert.

    A user's devices are one entry of the map; those beyond ``INLINE`` have entries of their own.
    """

    def __init__(self, expiry_ms: int | None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("devices", "user string, device string", "json string", self.expiry_ms)
        # The first login is not forgotten.
        self.opening = handle.getMapState("opening", "user string", "at long, event_id string, device_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first: dict = {}
        for frame in rows:
            for user, device, at, event in zip(*(_plain(frame[c]) for c in ("user_id", "device_id", "at", "event_id"))):
                mine = first.setdefault(user, {})
                if device not in mine or (at, event) < mine[device]:
                    mine[device] = (at, event)
        now = None if self.expiry_ms is None else timerValues.getCurrentProcessingTimeInMs()
        out = [row for user, mine in first.items() for row in self._changes(user, mine, now)]
        if out:
            yield pd.DataFrame(out, columns=["user_id", "device_id", "at", "event_id", "withdrawn"])

    def _changes(self, user, first: dict, now: int | None) -> list[tuple]:
        who, until = named(user), None if now is None else now + self.expiry_ms
        stored = self.seen.getValue((who, RECORD))
        record = {"devices": {}, "more": False} if stored is None else json.loads(stored[0])
        known = {d: v for d, v in record["devices"].items() if now is None or v[2] > now}
        changed, kept = {}, False
        for device, got in first.items():
            name = named(device)
            before = known.get(name)
            apart = before is None and record["more"] and self.seen.getValue((who, name))
            if apart:
                before = json.loads(apart[0])
            if before is not None and got >= tuple(before[:2]):
                continue
            changed[device] = got
            if apart or (name not in known and len(known) >= INLINE):
                self.seen.updateValue((who, name), (json.dumps([*got, until]),))
                kept = kept or not record["more"]
                record["more"] = True
            else:
                known[name] = [*got, until]
                kept = True
        if not changed:
            return []
        # With an expiry the record lasts as long as what it says of others.
        if kept or now is not None:
            self.seen.updateValue((who, RECORD), (json.dumps({**record, "devices": known}),))
        opened = self.opening.getValue((who,))
        opened = None if opened is None else tuple(opened)
        device = min(changed, key=changed.get)
        opening = (*changed[device], device)
        if opened is None or opening[:2] < opened[:2]:
            self.opening.updateValue((who,), opening)
            if opened is not None and opened[2] not in changed:
                # What was the first login is a login from a new device now.
                changed[opened[2]] = opened[:2]
        else:
            opening = opened
        return [(user, device, *got, got == opening[:2]) for device, got in changed.items()]

    def close(self) -> None:
        pass


def _earliest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of each user and device, before they are sent to the user's task."""
    for frame in frames:
        yield frame.sort_values(["at", "event_id"], kind="stable").drop_duplicates(["user_id", "device_id"])


def new_devices(
    events: DataFrame, out: str, trigger: str | None = None, expiry: str | None = None, partitions: int | None = None
) -> StreamingQuery:
    """First login of a user from a device, unless it is the user's first login at all.

    Exact for logins in any order: :func:`latest_new_devices` gives the rows of the batch rule
    over all that has come. Logins without a time are left out; ties go to the smaller event id. ``expiry``
    (as "90 days") forgets a device that long after its first login was recorded, by the clock, and so
    needs a ``trigger``: a query that ends with its input has no clock to go by.
    """
    if expiry is not None and trigger is None:
        raise ValueError("expiry needs a trigger")
    spark = events.sparkSession
    expiry_ms = None if expiry is None else spark.range(1).select((F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {expiry}")) / 1000).cast("long")).first()[0]
    logins = events.filter(S.is_login() & F.col("timestamp").isNotNull()).select("user_id", "device_id", F.unix_micros("timestamp").alias("at"), "event_id")
    first = logins.mapInPandas(_earliest, logins.schema)
    with _keyed(spark, partitions):
        changes = first.withColumn("bucket", _bucket("user_id")).groupBy("bucket").transformWithStateInPandas(
            Devices(expiry_ms),
            "user_id string, device_id string, at long, event_id string, withdrawn boolean",
            "Update",
            "None" if expiry is None else "ProcessingTime",
        )
        return _each_batch(changes, out, lambda df, i: _write(df, out, "alerts", i), "update", trigger)


def latest_new_devices(spark: SparkSession, out: str) -> DataFrame:
    """The last word on each user and device: user_id, device_id, timestamp, event_id."""
    changes = spark.read.parquet(f"{out}/alerts")
    last = F.max_by(F.struct("at", "event_id", "withdrawn"), BATCH).alias("x")
    found = changes.groupBy("user_id", "device_id").agg(last).filter("NOT x.withdrawn")
    return found.select("user_id", "device_id", F.timestamp_micros("x.at").alias("timestamp"), "x.event_id")


class InOrder(StatefulProcessor):
    """Hands a user's rows on in order of time, once the watermark says that no earlier one can come.

    Rows have ``user_id``, ``at`` (microseconds), ``event_id`` and the columns ``names``. They wait together, a list
    of each batch. What a subclass needs of a user's released rows, a short list, is an entry of a map.
    """

    names: tuple[str, ...] = ()
    made: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "json string")
        self.memory = handle.getMapState("memory", "user string", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            columns = [_plain(frame[c]) for c in ("user_id", "at", "event_id", *self.names)]
            self.waiting.appendValue((json.dumps(list(zip(*columns))),))
            earliest = min(columns[1])
            least = earliest if least is None else min(least, earliest)
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = {}, []
        for (text,) in self.waiting.get() if self.waiting.exists() else ():
            for user, *row in json.loads(text):
                if row[0] <= passed:
                    ready.setdefault(user, []).append(row)
                else:
                    rest.append((user, *row))
        if not ready:
            return
        if rest:
            self.waiting.put([(json.dumps(rest[i : i + 10_000]),) for i in range(0, len(rest), 10_000)])
            self._wake(min(row[1] for row in rest))
        else:
            self.waiting.clear()
        out = []
        for user, rows in ready.items():
            rows.sort(key=lambda row: (row[0], row[1] is not None, row[1] or ""))
            who = (named(user),)
            stored = self.memory.getValue(who)
            before = [] if stored is None else json.loads(stored[0])
            after = self.advance(user, rows, before, out)
            if stored is None or after != before:
                self.memory.updateValue(who, (json.dumps(after),))
        yield pd.DataFrame(out, columns=list(self.made))

    def _wake(self, at: int) -> None:
        # A timer has milliseconds; it must not go off before the row's own time.
        self.handle.registerTimer(-(-at // 1000))

    def advance(self, user, rows: list[list], memory: list, out: list[tuple]) -> list:
        """Add what the user's rows give to ``out``; the memory after them."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class LastTypes(InOrder):
    """The types of the events before each one, as many as the model's order."""

    names = ("event_type",)
    made = ("user_id", "at", "event_id", "event_type", "prefix")

    def __init__(self, order: int):
        self.order = order

    def advance(self, user, rows: list[list], memory: list, out: list[tuple]) -> list:
        types = memory
        for at, event, kind in rows:
            out.append((user, at, event, kind, types if len(types) == self.order else None))
            types = [*types, kind][-self.order :]
        return types


class LastFailures(InOrder):
    """Logins at which the user has enough failures in the closed window that ends there.

    The window holds that many exactly if the failure so many back is not older than the window, so
    the last ``failures`` times are all that is kept.
    """

    names = ("failed",)
    made = ("user_id", "at", "event_id")

    def __init__(self, failures: int, span: int):
        self.failures, self.span = failures, span

    def advance(self, user, rows: list[list], memory: list, out: list[tuple]) -> list:
        times, i = memory, 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            # Rows of one instant are in each other's windows.
            at = rows[i][0]
            times = [*times, *(at for row in rows[i:j] if row[2])][-self.failures :]
            if len(times) == self.failures and times[0] >= at - self.span:
                out += [(user, at, row[1]) for row in rows[i:j]]
            i = j
        return times


def _in_order(
    events: DataFrame, columns: list, processor: InOrder, schema: str, out: str, delay: str, partitions: int | None,
    trigger: str | None, finish: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    timed = events.filter(F.col("timestamp").isNotNull()).withWatermark("timestamp", delay)
    rows = timed.select(_bucket("user_id"), "user_id", "timestamp", F.unix_micros("timestamp").alias("at"), "event_id", *columns)
    with _keyed(events.sparkSession, partitions):
        released = rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")
        return _each_batch(released, out, lambda df, i: _write(finish(df), out, "alerts", i), "append", trigger)


def sequence_scores(
    events: DataFrame, out: str, model: MarkovModel, delay: str = "1 hour", trigger: str | None = None, partitions: int | None = None
) -> StreamingQuery:
    """Log-probability of every event under a fitted sequence model, once the watermark has passed it.

    Events up to ``delay`` late are scored as if they had come in order, which are the batch scores.
    Later ones are dropped and counted in the query's progress (numRowsDroppedByWatermark), and so
    are events without a time left out; neither is in the context of others.
    """
    def score(df: DataFrame) -> DataFrame:
        scored = model.label(model.score(df.withColumn("timestamp", F.timestamp_micros("at"))))
        return scored.select("user_id", "timestamp", "event_id", "event_type", "markov_raw", "markov_is_anomaly")

    schema = "user_id string, at long, event_id string, event_type string, prefix array<string>"
    return _in_order(events, ["event_type"], LastTypes(model.cfg.order), schema, out, delay, partitions, trigger, score)


def brute_force(
    events: DataFrame, out: str, minutes: float = RuleConfig.brute_force_minutes, failures: int = RuleConfig.brute_force_failures,
    delay: str = "1 hour", trigger: str | None = None, partitions: int | None = None,
) -> StreamingQuery:
    """Login events with at least ``failures`` failed logins of the user in the minutes up to them.

    The rows of the batch rule, each once, when the watermark has passed it. Events more than
    ``delay`` late are dropped and counted in the query's progress; events without a time are left out.
    """
    logins = events.filter(S.is_login())
    failed = F.coalesce(~F.col("success"), F.lit(False)).alias("failed")
    processor = LastFailures(failures, round(minutes * 60 * S.MICROS))
    return _in_order(logins, [failed], processor, "user_id string, at long, event_id string", out, delay, partitions, trigger)


def replay(
    spark: SparkSession, folder: str, start: Callable[[DataFrame, str], StreamingQuery], read: Callable[[SparkSession, str], DataFrame],
    batches: int = 4, files: int = 4, spread: str | None = None, closing: str | None = None,
) -> DataFrame:
    """Run a job over an activity table in micro-batches of ``files`` files each.

    Batches are by time (rows without one come first), each row moved by up to ``spread`` either way, or by a hash of the id where that
    is None, which mixes all times into every batch. ``closing`` adds a last batch of one event so much after
    all others, which brings the watermark past them.
    """
    table = spark.read.parquet(f"{folder}/events.parquet")
    home = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    chance = F.xxhash64("event_id")
    if spread is None:
        number = F.pmod(chance, F.lit(batches))
    else:
        width = spark.range(1).select(F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {spread}"))).first()[0]
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        if width:
            at = at + F.pmod(chance, F.lit(2 * width)) - width
        cuts = table.select(at.cast("double").alias("at")).approxQuantile("at", [i / batches for i in range(1, batches)], 0.01)
        number = sum(((at > cut).cast("int") for cut in cuts), F.lit(0))
    numbered = table.withColumn(BATCH, F.coalesce(number, F.lit(0)))
    for n in range(batches):
        numbered.filter(F.col(BATCH) == n).drop(BATCH).repartition(files).write.mode("append").parquet(f"{home}/in")
    if closing is not None:
        last = table.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {closing}")).alias("ts"))
        last = last.select([F.col(c).cast(t) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in table.dtypes])
        last.withColumn("event_type", F.lit("error")).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{home}/in")
    start(activity_events(stream), f"{home}/out").awaitTermination()
    return read(spark, f"{home}/out")
