"""Live jobs: passages of arriving documents, cursors, measurements, places, sessions, stale events, rolling captions.

Most take a static or a streaming DataFrame alike. Stateful ones keep a watermark, and state goes when event time has passed it by.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.text import normalize_text
from ..operators.captions import _words, overlap_of
from ..operators.documents import PRESETS, PassagePreset, build_passages

GAP = "1200 milliseconds"
REPORTED = ["session", "doc_id", "passage_index"]
#: Setting of sessions that run ``reject_stale`` or ``stream_dedupe_cues`` as streams: their state is typed and has timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_passages(docs: DataFrame, preset: str | PassagePreset = "balanced") -> DataFrame:
    """Passages of documents (doc_id, text) as they arrive; no state."""
    chosen = PRESETS[preset] if isinstance(preset, str) else preset
    return build_passages(docs.select("doc_id", normalize_text(F.col("text")).alias("text")), chosen)


def stream_cursor(events: DataFrame, passages: DataFrame) -> DataFrame:
    """events (session, doc_id, passage_index, char_index, elapsed) with the absolute cursor and the position in seconds.

    ``passages`` is static and has ``before``, the seconds ahead of each.
    """
    p = passages.select("doc_id", "passage_index", F.col("start").alias("_start"), F.length("text").alias("_n"), "before")
    cursor = F.col("_start") + F.least("char_index", "_n")
    return events.join(p, ["doc_id", "passage_index"]).select(*events.columns, cursor.alias("cursor"), (F.col("before") + F.col("elapsed")).alias("position"))


def last_elapsed(events: DataFrame) -> DataFrame:
    """(session, doc_id, passage_index, elapsed, rate): the last report of each passage that was not resumed midway."""
    latest = F.max_by(F.struct("elapsed", "rate"), F.struct("ts", "elapsed"))
    return events.where("NOT resumed").groupBy(*REPORTED).agg(latest.alias("l")).select(*REPORTED, "l.elapsed", "l.rate")


def live_elapsed(events: DataFrame, watermark: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """The live twin of ``last_elapsed``, for update mode: (session, doc_id, passage_index, ts, elapsed, rate).

    State is held by passage and ``window`` of event time, and goes when the watermark has passed the window's end; reports
    that come later than that are dropped. A passage reported in several windows has a row from each, so what is made of
    them keeps the newest by ts and elapsed (``measurement_sink`` does).
    """
    fresh = events.where("NOT resumed").withWatermark("ts", watermark)
    latest = F.max_by(F.struct("ts", "elapsed", "rate"), F.struct("ts", "elapsed"))
    return fresh.groupBy(*REPORTED, F.window("ts", window)).agg(latest.alias("l")).select(*REPORTED, "l.ts", "l.elapsed", "l.rate")


def measured_seconds() -> Column:
    """Seconds at rate 1 of a report (elapsed, rate) beside its passage's est_seconds; null for what is no measurement.

    One counts with more than 0.05 s heard, and within a factor of eight of the estimate.
    """
    seconds, estimate = F.col("elapsed") * F.col("rate"), F.col("est_seconds")
    return F.when((F.col("elapsed") > 0.05) & (seconds <= estimate * 8) & (seconds >= estimate / 8), seconds)


def guard_measurements(reports: DataFrame, passages: DataFrame) -> DataFrame:
    """(session, doc_id, passage_index, seconds) of the reports that are measurements of known passages."""
    joined = reports.join(passages.select("doc_id", "passage_index", "est_seconds"), ["doc_id", "passage_index"])
    return joined.withColumn("seconds", measured_seconds()).where("seconds IS NOT NULL").select(*REPORTED, "seconds")


MEASURED = "session long, doc_id long, passage_index int, ts timestamp, elapsed double, seconds double"


def measurement_sink(spark: SparkSession, path: str, passages: DataFrame, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` behind ``live_elapsed``: joins a batch with the static ``passages``, guards it, and upserts it.

    The newest report of a passage is kept even where it is no measurement (its seconds are null then): it takes back what an
    earlier one had measured, as in the batch. A batch that runs again changes nothing. ``measurements`` reads the table.
    """
    merge = upsert(spark, path, REPORTED, "ts", buckets)
    static = passages.select("doc_id", "passage_index", "est_seconds")

    def sink(batch: DataFrame, epoch: int) -> None:
        guarded = batch.join(static, ["doc_id", "passage_index"], "left").withColumn("seconds", measured_seconds())
        merge(guarded.select(*REPORTED, "ts", "elapsed", "seconds"), epoch)

    return sink


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """(session, doc_id, passage_index, seconds) from the table that ``measurement_sink`` keeps."""
    return upserted(spark, path, MEASURED).where("seconds IS NOT NULL").select(*REPORTED, "seconds")


KEPT_MANIFESTS = 2


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, as Hadoop sees it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests below ``path``, oldest first."""
    fs, at = _folder(spark, f"{path}/manifests")
    if not fs.exists(at):
        return []
    return sorted(int(n) for n in (x.getPath().getName() for x in fs.listStatus(at)) if n.isdigit())


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Of each bucket that has rows, the version that holds them."""
    row = spark.read.text(f"{path}/manifests/{number}", wholetext=True).head()
    return {int(b): v for b, v in json.loads(row[0]).items()}


def _commit(spark: SparkSession, path: str, number: int, versions: dict[int, int]) -> None:
    """Puts a manifest in its place whole: written beside it, then renamed over whatever an earlier attempt left."""
    fs, at = _folder(spark, f"{path}/manifests/{number}")
    draft = _folder(spark, f"{path}/manifests/{number}.draft")[1]
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(versions).encode()))
    out.close()
    fs.delete(at, True)
    fs.rename(draft, at)


def upsert(spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the latest row by ``order`` of each key in a table below ``path``; ``upserted`` reads it.

    Keys are dealt over ``buckets`` by hash. A batch reads the buckets that its keys fall into and writes all of them in one
    job, as version n of batch n; a small manifest then names the version of every bucket, and only that makes the batch
    visible. Batch n starts from the last manifest before n, so a batch that runs again gives the same table. Versions that
    the last KEPT_MANIFESTS manifests don't name are deleted.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        others = [c for c in batch.columns if c not in keys]
        by = F.struct(order, *(c for c in others if c != order))
        newest = lambda rows: rows.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*others), by).alias("l")).select("_bucket", *keys, *(f"l.{c}" for c in others))
        fresh = newest(batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))).persist()
        try:
            touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most ``buckets``
            before = [n for n in _manifests(spark, path) if n < epoch]
            versions = _manifest(spark, path, before[-1]) if before else {}
            rows = fresh
            if held := [f"{path}/v={versions[b]}/_bucket={b}" for b in touched if b in versions]:
                # the base path makes _bucket a column again
                old = spark.read.schema(batch.schema).option("basePath", path).parquet(*held).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
                rows = newest(rows.unionByName(old.select(*rows.columns)))
            if touched:
                rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v={epoch}")
            now = versions | dict.fromkeys(touched, epoch)
            _commit(spark, path, epoch, now)
            kept = {(v, b) for n in before[-(KEPT_MANIFESTS - 1) :] for b, v in _manifest(spark, path, n).items()} | {(v, b) for b, v in now.items()}
            for n in before[: -(KEPT_MANIFESTS - 1)]:
                for b, v in _manifest(spark, path, n).items():
                    if (v, b) not in kept:
                        fs, at = _folder(spark, f"{path}/v={v}/_bucket={b}")
                        fs.delete(at, True)
                fs, at = _folder(spark, f"{path}/manifests/{n}")
                fs.delete(at, True)
        finally:
            fresh.unpersist()

    return merge


def upserted(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table that ``upsert`` keeps below ``path``, as its last manifest has it."""
    numbers = _manifests(spark, path)
    versions = _manifest(spark, path, numbers[-1]) if numbers else {}
    paths = [f"{path}/v={v}/_bucket={b}" for b, v in versions.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_places(places: DataFrame) -> DataFrame:
    """The batch twin of an upsert of places (reader_id, place_key, passage_index, at)."""
    return places.groupBy("reader_id", "place_key").agg(F.max(F.struct("at", "passage_index")).alias("l")).select("reader_id", "place_key", "l.passage_index", "l.at")


def reading_sessions(events: DataFrame, watermark: str = "10 seconds", gap: str = GAP) -> DataFrame:
    """(session, started, ended, events): activity with pauses of at most the gap; an event just at the gap still belongs."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    grouped = source.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select("session", F.col("w.start").alias("started"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("ended"), "events")


class Kept(StatefulProcessor):
    """What is known of a key, as one typed row, until ``idle_ms`` of event time have passed without anything new of it.

    Subclasses have ``FIELDS``, and ``step`` that gives output and the row to keep. Timers follow the watermark, so state ends
    in batches without data as well.
    """

    FIELDS = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.FIELDS)

    def step(self, key: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        out, held = self.step(key, given, self.held.get() if self.held.exists() else None)
        self.held.update(held)
        ends = int(given["ts"].max().timestamp() * 1000) + self.idle_ms
        known = list(self.handle.listTimers())
        if not known or max(known) < ends:
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ends)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Newest(StatefulProcessor):
    """Events of a session that aren't below the newest epoch it has shown; a key is a bucket of sessions.

    What is known of a bucket is one row: its sessions, the newest epoch of each, when each ends (``idle_ms`` of event time
    behind its last event), and the bucket's timer, which stands no later than its first session ends. State is then asked
    for and written once a bucket that a batch meets, not once a session.
    """

    FIELDS = "session array<{}>, newest array<int>, ends array<long>, timer long"

    def __init__(self, idle_ms: int, of: str):
        self.idle_ms, self.fields = idle_ms, self.FIELDS.format(of)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.fields)

    def keep(self, known: dict, timer: int | None) -> None:
        if not known:
            return self.held.clear()
        first = min(ends for _, ends in known.values())
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.held.update((list(known), [n for n, _ in known.values()], [e for _, e in known.values()], timer))

    def known(self) -> tuple[dict, int | None]:
        held = self.held.get()
        return ({}, None) if held is None else (dict(zip(held[0], zip(held[1], held[2]))), held[3])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, timer = self.known()
        for r in sorted((r for r in rows if r.epoch is not None), key=lambda r: (r.us, r.event_id is not None, r.event_id)):
            newest, ends = known.get(r.session, (r.epoch, 0))
            known[r.session] = max(newest, r.epoch), max(ends, r.us // 1000 + self.idle_ms)
            if r.epoch >= newest:
                yield Row(session=r.session, event_id=r.event_id, epoch=r.epoch, us=r.us)
        self.keep(known, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.keep({s: (n, e) for s, (n, e) in self.known()[0].items() if e > passed}, None)
        return iter(())

    def close(self) -> None:
        pass


def reject_stale(events: DataFrame, watermark: str = "10 minutes", idle_ms: int = 3_600_000, buckets: int = 4096) -> DataFrame:
    """Events (session, event_id, epoch, ts) whose epoch isn't below the newest that their session had shown before, by ts.

    As a stream, for append mode: events behind the watermark are dropped, and a session is forgotten when the watermark has
    passed its last event by ``idle_ms``. Sessions are dealt over ``buckets`` by hash, and a bucket's state is read and written
    whole, so it should hold some thousands at most. The session needs STATE_STORE.
    """
    if not events.isStreaming:
        w = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return events.withColumn("_newest", F.max("epoch").over(w)).where("epoch >= _newest").drop("_newest")
    rows = events.select("session", "event_id", "epoch", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    rows = rows.withColumns({"us": F.unix_micros("ts"), "_bucket": F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int")})
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = ", ".join(f"{c} {kind[c]}" for c in ("session", "event_id", "epoch", "us"))
    fresh = rows.groupBy("_bucket").transformWithState(Newest(idle_ms, kind["session"]), made, "Append", "EventTime")
    return fresh.select("session", "event_id", "epoch", F.timestamp_micros("us").alias("ts"))


def dedupe_inflight(requests: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """One of the requests (key, ts) that ask for the same clip while the watermark holds; in a batch, the first by ts."""
    if requests.isStreaming:
        return requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key"])
    others = [c for c in requests.columns if c != "key"]
    first = requests.groupBy("key").agg(F.min(F.struct("ts", *(c for c in others if c != "ts"))).alias("f"))
    return first.select("key", *(f"f.{c}" for c in others)).select(*requests.columns)


LIVE_CUES = "track_id long, cue_no long, kind string, start double, end double, text string"


class LastCue(Kept):
    """Cues of a track without what its last kept cue said."""

    FIELDS = "cue_no long, end double, text string"

    def step(self, key: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        no, end, text = held if held is not None else (-1, 0.0, "")
        made = []
        for r in rows.sort_values(["start", "cue_no"]).itertuples(index=False):
            n = overlap_of(text, r.text) if no >= 0 else 0
            words = _words(r.text)
            if n and n == len(words):
                end = max(end, r.end)
                made.append((key[0], no, "extend", r.start, end, ""))
                continue
            no, end, text = int(r.cue_no), float(r.end), " ".join(words[n:]) if n else r.text
            made.append((key[0], no, "cue", r.start, end, text))
        return pd.DataFrame(made, columns=[x.split()[0] for x in LIVE_CUES.split(", ")]), (no, end, text)


def stream_dedupe_cues(cues: DataFrame, watermark: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Live cues (track_id, cue_no, start, end, text, ts) without what the track's last kept cue already said.

    Output only grows, so a cue that adds nothing is a row of kind "extend" with the kept cue's number and the later end. Cues
    behind the watermark on ts are dropped; a track is forgotten when the watermark has passed its last cue by ``idle_ms``.
    The session needs STATE_STORE.
    """
    return cues.withWatermark("ts", watermark).groupBy("track_id").transformWithStateInPandas(LastCue(idle_ms), LIVE_CUES, "Append", "EventTime")
