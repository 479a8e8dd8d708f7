"""Structured Streaming forms of the incremental jobs."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def document_day(stream: DataFrame, key: str, ts: str, group: Sequence[str], lateness: str = "2 days") -> DataFrame:
    """Documents -> (day, group) counts and sums; duplicates inside the watermark drop out."""
    d = stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
    return d.groupBy(F.window(ts, "1 day").alias("w"), *group).agg(
        F.count("*").alias("n_articles"), F.sum("value").alias("total"), F.stddev_pop("value").alias("dispersion")
    ).select(F.to_date("w.start").alias("date"), *group, "n_articles", "total", "dispersion")


def day_status(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """ok / partial / missing per expected (date, n_files) against what arrived."""
    return expected.join(seen, "date", "left").select(
        "date", F.when(F.coalesce("n_seen", F.lit(0)) == 0, "missing").when(F.col("n_seen") < F.col("n_files"), "partial").otherwise("ok").alias("status"))


def window_prints(stream: DataFrame, key: str, ts: str, price: str, window: str = "6 hours", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """First and last print per key and (sliding) window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, lateness).groupBy(w.alias("w"), key).agg(
        F.min_by(price, ts).alias("first_print"), F.max_by(price, ts).alias("last_print"), F.count("*").alias("n")
    ).select(F.col("w.start").alias("start"), key, "first_print", "last_print", "n")


def activity_sessions(stream: DataFrame, key: str, ts: str, gap: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Runs of activity: a session ends after ``gap`` without an event."""
    return stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("s"), key).agg(
        F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def by_day(stream: DataFrame, ts: str, keys: Sequence[str], lateness: str, **sums) -> DataFrame:
    """One row per (keys, day), emitted once the watermark has passed the day.

    All rows of a day enter its row, in whatever order they come; rows later than
    ``lateness`` are dropped and counted in the query's progress (``late_rows``).  Days leave
    in date order, so that what is keyed behind it sees each key's days in order.  ``_at`` is
    their event time, which carries the watermark on to the timers of what follows.
    """
    d = stream.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(*[c.alias(n) for n, c in sums.items()])
    return d.select(*keys, F.to_date("w.start").alias("date"), *sums, F.window_time("w").alias("_at"))


#: Buckets of keys; a bucket's state is read and written at once.
BUCKETS = 4096


class Forgetful(StatefulProcessor):
    """A rule over the days of every key, given in date order, that frees what it has forgotten.

    ``days`` takes a key's state, which is None or a tuple, and its next days, and gives the
    new state, the last day on which that state counts (NULL: for good) and the rows to emit.
    There are very many keys with a few days each, so they come in buckets by their hash: one
    read, one write and one timer serve all keys of a bucket.  The timer stays where it is
    while days come; when it expires, it is set anew for the keys that count for longer.

    A timer only frees what the rule counts as forgotten anyway, so results do not depend on
    when it runs; state that the watermark has already passed is not written at all.
    """

    keys: tuple[str, ...]
    schema: str
    output: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        one = ", ".join([*[f"{k} string" for k in self.keys], self.schema, "until date"])
        self.state = handle.getValueState("bucket", f"held array<struct<{one}>>, timer long")

    def days(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, dt.date | None, list[tuple]]:
        raise NotImplementedError

    def _read(self) -> tuple[dict[tuple, tuple], int | None]:
        held, timer = self.state.get() or ((), None)
        n = len(self.keys)
        return {tuple(h[:n]): tuple(h[n:]) for h in held}, timer

    def _keep(self, held: dict[tuple, tuple], timer: int | None, watermark: int, stored: bool) -> None:
        """Write what counts at this watermark; ``timer`` is the one that is pending."""
        held = {k: s for k, s in held.items() if s[-1] is None or expiry(s[-1]) > watermark}
        ends = [s[-1] for s in held.values() if s[-1] is not None]
        if timer is not None and not ends:
            self.handle.deleteTimer(timer)
            timer = None
        elif timer is None and ends:
            timer = expiry(min(ends))
            self.handle.registerTimer(timer)
        if held:
            self.state.update(([(*k, *s) for k, s in held.items()], timer))
        elif stored:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._read()
        stored, out, of = bool(held), [], {}
        pdf = pd.concat(list(rows)).sort_values("date", kind="stable")
        for k, r in zip(zip(*(pdf[c] for c in self.keys)), pdf.itertuples(index=False)):
            of.setdefault(tuple(map(known, k)), []).append(r)
        for k, some in of.items():
            state = held.pop(k, None)
            now, until, found = self.days(k, state and state[:-1], some)
            out += found
            if now is not None:
                held[k] = (*now, until)
        self._keep(held, timer, timerValues.getCurrentWatermarkInMs(), stored)
        yield pd.DataFrame(out, columns=self.output.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._read()
        self._keep(held, None, timerValues.getCurrentWatermarkInMs(), bool(held))
        return iter([])

    def close(self) -> None:
        pass


def by_bucket(days: DataFrame, processor: Forgetful, buckets: int | None = None) -> DataFrame:
    """The rows that ``processor`` emits for the days of every key."""
    bucket = F.pmod(F.xxhash64(*processor.keys), F.lit(buckets or BUCKETS))
    return days.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="EventTime")


def expiry(day: dt.date) -> int:
    """The end of ``day`` as a timer's event time."""
    return (min(day, LAST_DAY) - EPOCH).days * DAY_MS + DAY_MS


def known(x):
    """NaN stands for NULL."""
    return None if x is None or x != x else x


def late_rows(query) -> int:
    """Rows that a finished or running query has dropped as too late."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p.get("stateOperators", []))


DAY_MS, EPOCH, LAST_DAY = 86_400_000, dt.date(1970, 1, 1), dt.date(9999, 1, 1)


def days_after(day: dt.date, days: int) -> dt.date:
    return day + dt.timedelta(days=min(days, (LAST_DAY - day).days))


DETECTOR_OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("detector", T.StringType()), ("entity", T.StringType()), ("date", T.DateType()), ("status", T.StringType()), ("severity", T.DoubleType()),
    ("first_seen", T.DateType()), ("days_active", T.LongType()))])


class DetectorState(Forgetful):
    """Status of each (detector, entity) over successive days, given in date order.

    A NULL severity says the detector ran and did not fire.  Only active detections have
    state: it is cleared when one is resolved, or when ``expiry`` days have passed without a
    day of the key, after which the next one is new; an event-time timer frees keys that stay
    silent.
    """

    keys = ("detector", "entity")
    schema = "severity double, first_seen date, last_date date, days_active long"
    output = DETECTOR_OUT

    def __init__(self, expiry: int = 90):
        self.expiry = expiry

    def days(self, key, state, rows):
        cur, out = state, []
        for r in rows:
            if cur is not None and (r.date - cur[2]).days > self.expiry:
                cur = None
            severity = known(r.severity)
            if severity is not None and cur is None:
                cur = (severity, r.date, r.date, 1)
                out.append((*key, r.date, "new", severity, r.date, 1))
            elif severity is not None:
                ps, ns = abs(cur[0]), abs(severity)
                status = "intensifying" if ps > 0 and ns >= 1.2 * ps else "fading" if ps > 0 and ns <= 0.8 * ps else "persisting"
                cur = (severity, cur[1], r.date, cur[3] + 1)
                out.append((*key, r.date, status, severity, cur[1], cur[3]))
            elif cur is not None:
                out.append((*key, r.date, "resolved", 0.0, cur[1], cur[3]))
                cur = None
        return cur, cur and days_after(cur[2], self.expiry), out


def detector_states(stream: DataFrame, ts: str = "ts", lateness: str = "2 days", expiry: int = 90) -> DataFrame:
    """stream (detector, entity, ts, severity) -> statuses; the strongest firing of a day counts."""
    days = by_day(stream, ts, ["detector", "entity"], lateness, severity=F.max("severity"))
    return by_bucket(days, DetectorState(expiry))


EPISODE_OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("episode_key", T.StringType()), ("date", T.DateType()), ("instance", T.LongType()), ("event", T.StringType()), ("move", T.DoubleType()), ("age", T.LongType()))])


class EpisodeState(Forgetful):
    """One open episode per key: open on a trigger, mark with each day's move, close when
    absorbed or too old; the instance number counts re-openings.

    A key without an episode has no state.  ``forget`` days after its last episode closed a
    key is as new: its next episode is number 1, and an event-time timer frees its state.
    """

    keys = ("episode_key",)
    schema = "instance long, opened date, cum double, closed date"
    output = EPISODE_OUT

    def __init__(self, absorbed: float = 0.03, max_age: int = 63, forget: int = 3_650):
        self.absorbed, self.max_age, self.forget = absorbed, max_age, forget

    def days(self, key, state, rows):
        inst, opened, cum, closed = state or (0, None, 0.0, None)
        out = []
        for r in rows:
            if opened is None:
                if closed is not None and (r.date - closed).days > self.forget:
                    inst, closed = 0, None
                if r.trigger:
                    inst, opened, cum, closed = inst + 1, r.date, 0.0, None
                    out.append((key[0], r.date, inst, "open", 0.0, 0))
                continue
            cum = (1 + cum) * (1 + float(r.ret)) - 1
            age = (r.date - opened).days
            event = "absorbed" if cum >= self.absorbed else "expired" if age > self.max_age else "mark"
            out.append((key[0], r.date, inst, event, known(cum), age))
            if event != "mark":
                opened, closed = None, r.date
        return (inst, opened, cum, closed) if inst else None, closed and days_after(closed, self.forget), out


def episode_events(stream: DataFrame, absorbed: float = 0.03, max_age: int = 63, ts: str = "ts", lateness: str = "2 days", forget: int = 3_650) -> DataFrame:
    """stream (episode_key, ts, trigger, ret) -> open / mark / absorbed / expired events; a day
    triggers if any of its rows does, and its returns add up."""
    days = by_day(stream, ts, ["episode_key"], lateness, trigger=F.bool_or("trigger"), ret=F.sum("ret"))
    return by_bucket(days, EpisodeState(absorbed, max_age, forget))


SMOOTH_OUT = T.StructType([T.StructField(n, t) for n, t in (("entity", T.StringType()), ("date", T.DateType()), ("value", T.DoubleType()), ("ewm", T.DoubleType()), ("z", T.DoubleType()))])


class SmoothState(Forgetful):
    """Running exponential mean and prior-history z (Welford) per entity.

    An entity without a value for more than ``forget`` days begins anew; an event-time timer
    frees the state of those that stay silent.
    """

    keys = ("entity",)
    schema = "n long, mean double, m2 double, ewm double, last date"
    output = SMOOTH_OUT

    def __init__(self, span: int = 10, minimum: int = 5, forget: int = 3_650):
        self.alpha, self.minimum, self.forget = 2 / (span + 1), minimum, forget

    def days(self, key, state, rows):
        n, mean, m2, ewm, last = state or (0, 0.0, 0.0, None, None)
        out = []
        for r in rows:
            x = known(r.value)
            if x is None:
                continue
            if last is not None and (r.date - last).days > self.forget:
                n, mean, m2, ewm = 0, 0.0, 0.0, None
            last = r.date
            sd = (m2 / n) ** 0.5 if n else 0.0
            z = (x - mean) / sd if n >= self.minimum and sd > 0 else None
            ewm = x if ewm is None else (1 - self.alpha) * ewm + self.alpha * x
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
            out.append((key[0], r.date, x, known(ewm), known(z)))
        return (n, mean, m2, ewm, last) if last is not None else None, last and days_after(last, self.forget), out


def smoothed(stream: DataFrame, span: int = 10, minimum: int = 5, ts: str = "ts", lateness: str = "2 days", forget: int = 3_650) -> DataFrame:
    """stream (entity, ts, value) -> smoothed daily means."""
    days = by_day(stream, ts, ["entity"], lateness, value=F.avg("value"))
    return by_bucket(days, SmoothState(span, minimum, forget))


def upsert_sink(keys: Sequence[str], path: str, order: Sequence[str] = (), every: int = 20) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the latest batch wins per key, inside a batch the last by ``order``.

    Every batch is one immutable folder, so a batch replayed after a failure overwrites only
    itself.  Every ``every`` batches the folder holds the whole folded table instead, and
    readers start from the last such one.
    """

    def write(df: DataFrame, epoch: int) -> None:
        d = df.withColumn("batch", F.lit(epoch).cast("long"))
        full = epoch > 0 and epoch % every == 0
        if full:
            before = df.sparkSession.read.parquet(path).filter(F.col("epoch") < epoch)
            d = _folded(_since_full(before).unionByName(d.withColumn("full", F.lit(True))), keys, order)
        d.drop("full", "epoch").withColumn("full", F.lit(full)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def _since_full(stored: DataFrame) -> DataFrame:
    start = stored.filter("full").agg(F.coalesce(F.max("epoch"), F.lit(-1))).first()[0]
    return stored.filter(F.col("epoch") >= start).drop("epoch")


def _folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *order)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_upserts(spark, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    return _folded(_since_full(spark.read.parquet(path)), keys, order).drop("batch", "full")


def drain(df: DataFrame, folder: str) -> StreamingQuery:
    """Drain the available input in append mode into ``folder``; the finished query tells its progress."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return q


def run_to_end(df: DataFrame, folder: str) -> DataFrame:
    """Drain the available input in append mode into ``folder`` and read the result back.

    The sink and the state live in ``folder``, which driver and executors share; what the
    watermark has not closed stays in the state for the next run.
    """
    drain(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


#: Event time of the row that closes a bounded replay; later than any data.
END = "9999-12-01 00:00:00"


def replay_to_end(stream: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Run ``job`` over a bounded stream into ``folder``, close every open window, read all back.

    After the input is drained, a second run over the same state reads one more row with event
    time ``END``, which moves the watermark past all data.  The windows of that row itself end
    after the watermark, so that it enters no result.  Rows that come to ``folder`` afterwards
    are late: an unbounded feed goes through ``run_to_end``.
    """
    spark, end = stream.sparkSession, f"{folder}/end"
    last = spark.range(1).select(*[F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in stream.schema])
    last.limit(0).write.parquet(end)
    df = job(stream.unionByName(spark.readStream.schema(last.schema).parquet(end)))
    run_to_end(df, folder)
    last.write.mode("append").parquet(end)
    return run_to_end(df, folder)
