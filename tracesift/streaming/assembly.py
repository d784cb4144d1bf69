"""Live traces: keyed state and timers gather a trace until it's due, then decide it in a batch plan.

The stateful operator does assembly only: it holds a trace's records until the root's delay, the timeout or the record limit, and
then hands them on, marked with the time and reason. What arrives later is handed on at once, marked late. Decisions are taken per
micro-batch by the same plan as in batch, kept in a table, and late records meet the decision of their trace there.
"""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from tracesift.operators import timing as T
from tracesift.plans.decide import tally
from tracesift.sources.spans import Spans
from tracesift.streaming.memory import Counts, Decisions

#: For so long a sent trace and the samplers' counts are remembered.
MEMORY_MS = 24 * 3600 * 1000
#: Traces share so many keys of state. Fixed, as a checkpoint holds its traces by them.
BUCKETS = 1024


class Assembler(StatefulProcessor):
    """State by bucket of traces: its open records, and of each trace the due time, count, root flag and whether it was sent.

    Records carry ``at_ms``, their arrival. In a replay these are the clock and the watermark drives the timers; else the
    cluster's time does both. Columns: trace_id, is_root, at_ms and any others. Each access to state is a message to the
    executor's JVM and each call makes a frame, which costs far more than a record does; so a call takes a whole bucket, whose
    state is read once and written once. Its one timer is that of the trace that is due first. Records wait as pickled columns,
    a chunk a batch, which are read only when one of their traces is sent. A sent trace is remembered for ``memory_ms``."""

    def __init__(self, schema: StructType, timing: T.Timing, replay: bool, memory_ms: int = MEMORY_MS):
        self.schema, self.timing, self.replay, self.memory_ms = schema, timing, replay, memory_ms
        self.names = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", StructType([StructField("columns", BinaryType())]))
        self.status = handle.getValueState("status", StructType([StructField("timer", LongType()), StructField("traces", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[self.names] for pdf in rows], ignore_index=True)
        if not self.replay:
            new["at_ms"] = timerValues.getCurrentProcessingTimeInMs()
        timer, traces = self._traces()
        ids, ats, roots = new["trace_id"].tolist(), new["at_ms"].tolist(), new["is_root"].tolist()
        late = [False] * len(ids)
        waiting, now_sent = {t for t, x in traces.items() if not x[3]}, set()
        timeout, delay, limit = 1000 * self.timing.timeout(), 1000 * self.timing.delay(), self.timing.limit
        for i in sorted(range(len(ids)), key=ats.__getitem__):
            at = int(ats[i])
            send_by, n, has_root, sent = traces.get(ids[i]) or (None, 0, False, False)
            if not sent and send_by is not None and at > send_by:
                sent = True
                now_sent.add(ids[i])
                traces[ids[i]] = (send_by, n, has_root, True)
            if sent:
                late[i] = True
                continue
            send_by = at + timeout if send_by is None else send_by
            n += 1
            if roots[i]:
                send_by, has_root = min(send_by, at + delay), True
            if limit and n > limit:
                send_by = min(send_by, at)
            traces[ids[i]] = (send_by, n, has_root, False)
        late_, goes = pd.Series(late, dtype=bool), new["trace_id"].isin(now_sent)
        held = self._taken(now_sent) if now_sent & waiting else new[:0]
        out = [self._marked(held, traces), self._marked(new[goes & ~late_], traces), self._marked(new[late_], traces, True)]
        stays = new[~goes & ~late_]
        if len(stays):
            self.open.appendValue((self._packed(stays),))
        self._remember(timer, traces)
        yield from (x for x in out if len(x))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.replay else timerValues.getCurrentProcessingTimeInMs()
        now = max(now, expiredTimerInfo.getExpiryTimeInMs())
        _, traces = self._traces()
        traces = {t: x for t, x in traces.items() if not x[3] or x[0] + self.memory_ms > now}
        due = {t for t, x in traces.items() if not x[3] and x[0] <= now}
        if due:
            out = self._marked(self._taken(due), traces)
            for t in due:
                traces[t] = (*traces[t][:3], True)
        self._remember(None, traces)
        if due:
            yield out

    def _traces(self) -> tuple[int | None, dict]:
        """The timer that is set, and by trace (send_by, n, has_root, sent)."""
        known = self.status.get()
        return (known[0], pickle.loads(bytes(known[1]))) if known is not None else (None, {})

    def _remember(self, timer: int | None, traces: dict) -> None:
        """``timer``: the one that is set. Without any trace nothing is remembered."""
        first = min((x[0] + self.memory_ms if x[3] else x[0] for x in traces.values()), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.status.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.status.update((first, pickle.dumps(traces, 5)))

    def _packed(self, rows: pd.DataFrame) -> bytes:
        return pickle.dumps([rows[c].to_numpy() for c in self.names], 5)

    def _taken(self, traces: set) -> pd.DataFrame:
        """The open records of these traces, which are open no longer."""
        chunks = [pd.DataFrame(dict(zip(self.names, pickle.loads(bytes(x[0])), strict=True))) for x in self.open.get()]
        rows = pd.concat(chunks, ignore_index=True)
        goes = rows["trace_id"].isin(traces)
        if goes.all():
            self.open.clear()
        else:
            self.open.put([(self._packed(rows[~goes]),)])
        return rows[goes]

    def _marked(self, rows: pd.DataFrame, traces: dict, late: bool = False) -> pd.DataFrame:
        known = [traces[t] for t in rows["trace_id"].tolist()]
        reasons = T.LATE if late else [self._reason(x[1], x[2]) for x in known]
        return rows.assign(send_by_ms=pd.Series([x[0] for x in known], rows.index, dtype="int64"), send_reason=reasons, late=late)

    def _reason(self, n: int, has_root: bool) -> str:
        return T.GOT_ROOT if has_root else T.LIMIT if self.timing.limit and n > self.timing.limit else T.EXPIRED

    def close(self) -> None:
        pass


ADDED = [StructField("send_by_ms", LongType()), StructField("send_reason", StringType()), StructField("late", BooleanType())]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def assembled(records: DataFrame, timing: T.Timing, replay: str | None = None, memory_ms: int = MEMORY_MS) -> DataFrame:
    """The stream of records (trace_id, is_root, at_ms, others) as sent: with send_by_ms, send_reason and late.

    ``replay``: how late records may come in a replay by their own times (column ``ts``); a trace is handed on once the
    watermark has passed its due time. Needs the RocksDB state store (``STATE_STORE``), which spills to disk: open traces
    needn't fit in memory."""
    schema = records.schema
    if replay is not None:
        records = records.withWatermark("ts", replay)
    records = records.withColumn("_bucket", F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)))
    return records.groupBy("_bucket").transformWithStateInPandas(Assembler(schema, timing, replay is not None, memory_ms), StructType([*schema.fields, *ADDED]), "Append", "ProcessingTime" if replay is None else "EventTime")


def run(records: DataFrame, timing: T.Timing, decide: Callable[..., DataFrame], out: str, checkpoint: str, replay: str | None = None, trigger: dict | None = None, memory_ms: int = MEMORY_MS):
    """Starts the job: ``out``/decisions gets a row a trace, ``out``/kept the kept records with rate, reason and send_reason.

    ``decide`` is called for each micro-batch, so a reloaded set of rules takes effect with the next one. It gets the batch's spans and, if
    it takes two arguments, the dynamic samplers' counts so far (``history`` of ``plans.decide.decide``), without which each batch
    would start them anew. Each batch's files lie in a folder named by its id and are overwritten when it is repeated, so each record
    is written once. Counts and decisions are remembered for ``memory_ms``, and late records read the decisions of their own time only."""
    spark = records.sparkSession
    counts, decided = Counts(spark, f"{out}/counts", memory_ms // 1000), Decisions(spark, f"{out}/decisions", memory_ms)
    live = len(inspect.signature(decide).parameters) > 1

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            on_time, late = batch.where("NOT late"), batch.where("late")
            arrival = F.struct("at_ms", *[c for c in ("event_id",) if c in batch.columns])
            spans = Spans(on_time.withColumn("arrival", arrival))
            decisions = decide(spans, counts.before(epoch)) if live else decide(spans)
            due = on_time.groupBy("trace_id").agg(F.first("send_reason").alias("send_reason"), F.first("send_by_ms").alias("send_by_ms"))
            decisions = decisions.join(due, "trace_id").persist()
            try:
                decided.add(epoch, decisions)
                if live:
                    counts.add(epoch, tally(decisions))
                result = ["trace_id", "rate", "keep", "reason"]
                kept = on_time.join(decisions.select(*result).where("keep"), "trace_id")
                known = decided.of(late)
                if known is not None:
                    again = late.join(known.select(*result).where("keep").dropDuplicates(["trace_id"]), "trace_id")
                    kept = kept.unionByName(again.withColumn("reason", F.concat("reason", F.lit(f" - {T.LATE_REASON}"))))
                kept.drop("keep").write.mode("overwrite").parquet(f"{out}/kept/epoch={epoch}")
            finally:
                decisions.unpersist()
        finally:
            batch.unpersist()

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_STORE)  # a query takes it up as it starts
    try:
        writer = assembled(records, timing, replay, memory_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def kept(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/kept").parquet(f"{out}/kept").drop("epoch")
