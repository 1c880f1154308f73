"""The same work on streams: exchanges through the gates, a rejection log with its rebuild signal, retrieval hits, streamed texts.

Sources are file streams; every stream runs as far as its input goes (availableNow) unless a trigger is given.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import gates
from ..operators.upkeep import tended
from ..plans.settings import Settings


def gated(stream: DataFrame, least: int = 80, pre_gate: float = 0.35) -> DataFrame:
    """Exchanges (id, user_msg, answer, score, reply) with the stage that each ends in."""
    return stream.withColumn("stage", gates.gate(F.col("user_msg"), F.col("answer"), F.col("score"), F.col("reply"), least, pre_gate))


class RejectionLog(StatefulProcessor):
    """Keeps the last `most` rejected texts of a key; every `every` rejections gives a row that asks for new noise prototypes."""

    def __init__(self, most: int = 500, every: int = 25):
        self.most, self.every = most, every

    def init(self, handle) -> None:
        self.log = handle.getListState("log", "text string")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        fresh = [t for pdf in rows for t in pdf.sort_values("id")["answer"]]
        before = self.seen.get()[0] if self.seen.exists() else 0
        kept = [r[0] for r in self.log.get()] + [t[:500] for t in fresh]
        self.log.put([(t,) for t in kept[-self.most :]])
        self.seen.update((before + len(fresh),))
        signals = (before + len(fresh)) // self.every - before // self.every
        if signals:
            yield pd.DataFrame({"log": [key[0]], "seen": [before + len(fresh)], "kept": [min(self.most, len(kept))], "signals": [signals]})

    def close(self) -> None:
        pass


def rejection_signals(rejected: DataFrame, most: int = 500, every: int = 25) -> DataFrame:
    """log, seen, kept and signals, from rejected exchanges (log, id, answer). Keys keep apart the logs, such as one a source."""
    return rejected.groupBy("log").transformWithStateInPandas(RejectionLog(most, every), "log string, seen bigint, kept bigint, signals bigint", "update", "none")


def hits(stream: DataFrame, wait: str = "1 hour") -> DataFrame:
    """memory_id, hits and last_retrieved as retrieval events (memory_id, at: timestamp) arrive."""
    return stream.withWatermark("at", wait).groupBy("memory_id").agg(F.count("*").alias("hits"), F.max("at").alias("last_retrieved"))


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs work on every batch once: the write path after the gates, or a sweep."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def sweeps(ticks: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], now: Callable[[], Column], checkpoint: str, every: str | None = None, settings: Settings = Settings()):
    """The sweep (see upkeep.tended) at each batch of ticks, over what read() gives then; write keeps its rows. The started query.

    every: a trigger's interval, as "1 hour" for a stream of the rate source; without one, the ticks that are there are
    taken and the query ends. A batch that fails is run again, so write should replace what an earlier run wrote.
    """
    work = lambda batch, _: None if batch.isEmpty() else write(tended(read(), now(), settings))
    writer = ticks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rebuilt_noise(signals: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, settings: Settings = Settings()):
    """At each batch that has a rebuild signal, the newest rejected texts of read() (id, answer) go to write, as the noise prototypes from then on. The started query."""
    newest = lambda: read().orderBy(F.desc("id")).limit(settings.noise_prototypes).select("id", F.substring("answer", 1, 500).alias("prototype"))
    work = lambda batch, _: None if batch.isEmpty() else write(newest())
    return signals.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_pieces(events: DataFrame) -> DataFrame:
    """message, place, piece, ends and at of streamed reply events (message, place, data, at): data is an event in JSON; what is no text delta has an empty piece; a message_stop ends its message."""
    kind, delta = F.get_json_object("data", "$.type"), F.get_json_object("data", "$.delta.type")
    piece = F.when(delta == "text_delta", F.get_json_object("data", "$.delta.text"))
    return events.select("message", "place", F.coalesce(piece, F.lit("")).alias("piece"), F.coalesce(kind == "message_stop", F.lit(False)).alias("ends"), "at")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """message and said of text_pieces that are all there: the batch form."""
    parts = F.array_sort(F.collect_set(F.struct("place", "piece")))
    return pieces.groupBy("message").agg(parts.alias("p")).select("message", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("said"))


class PieceBuffer(StatefulProcessor):
    """Keeps a message's pieces until its end and all places before it (from 0) are there, or until no piece has come for `wait` seconds of event time; then gives the text in order, once."""

    def __init__(self, wait: float):
        self.wait = int(wait * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "place bigint", "piece string")
        self.state = handle.getValueState("state", "last bigint, timer bigint, given boolean")

    def give(self, key, complete: bool):
        found = sorted((k[0], v[0]) for k, v in self.pieces.iterator())
        self.pieces.clear()
        return pd.DataFrame({"message": [key[0]], "said": ["".join(p for _, p in found)], "complete": [complete]})

    def handleInputRows(self, key, rows, timerValues):
        last, timer, given = self.state.get() if self.state.exists() else (-1, 0, False)
        newest = timer
        for frame in rows:
            if given:
                continue  # what comes after the text was given comes too late
            for place, piece, ends, at in zip(frame["place"], frame["piece"], frame["ends"], frame["at"]):
                if not self.pieces.containsKey((int(place),)):
                    self.pieces.updateValue((int(place),), (piece,))
                last = int(place) if ends else last
                newest = max(newest, int(at.timestamp() * 1000) + self.wait)
        if not given and last >= 0 and sum(1 for k in self.pieces.keys() if k[0] <= last) == last + 1:
            yield self.give(key, True)
            given = True
        if newest != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest)
        self.state.update((last, newest, given))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, _, given = self.state.get()
        self.state.clear()
        if not given:
            yield self.give(key, False)

    def close(self) -> None:
        pass


def streamed_texts(pieces: DataFrame, wait: float = 60.0) -> DataFrame:
    """message (long), said and complete of a stream of text_pieces: once a message's pieces are all there, in whatever order they came; what there is of it, with complete false, when none has come for `wait` seconds. Pieces of a given message that still come are dropped."""
    timed = pieces.withWatermark("at", f"{wait} seconds")
    return timed.groupBy("message").transformWithStateInPandas(PieceBuffer(wait), "message bigint, said string, complete boolean", "append", "eventTime")


def learning_gate(stream: DataFrame, prototypes: str, out: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str, settings: Settings = Settings()):
    """Exchanges (id, user_msg, answer, reply) through the gates, by a scorer that is read anew for each batch. The started query.

    prototypes: a StoredTable (id, kind: good or noise, text) of what the scorer goes by. out gets, by batch: the
    exchanges with content_score, stage and scorer, the version that judged them. When the rejected ones pass a multiple
    of settings.rebuild_every, the newest settings.noise_prototypes of them become the noise, as a new version, for the
    batches from the next one on. A batch that is run again is judged by the version that judged it before.
    """
    from ..operators.scoring import scored
    from ..sources.store import StoredTable

    spark = stream.sparkSession

    def judged_before(number: int) -> int | None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={number}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return None
        row = spark.read.parquet(f"{out}/batch={number}").select("scorer").first()
        return None if row is None else row.scorer

    def work(batch: DataFrame, number: int) -> None:
        table = StoredTable(spark, prototypes, judged_before(number))
        vectors = {kind: [list(r["embedding"]) for r in embed(table.rows().filter(F.col("kind") == kind).select("id", "text")).orderBy("id").collect()] for kind in ("good", "noise")}  # some hundreds
        rows = scored(embed(batch.withColumn("text", F.col("answer"))), vectors["good"], vectors["noise"]).drop("embedding", "text")
        told = gated(rows.withColumn("score", F.col("content_score")), settings.ingest_bytes, settings.pre_gate).withColumn("scorer", F.lit(table.version))
        told.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rejected = spark.read.parquet(out).filter((F.col("stage") != "stored") & (F.col("batch") <= number))
        counts = rejected.agg(F.count("*").alias("now"), F.count_if(F.col("batch") < number).alias("before")).first()
        if counts.now // settings.rebuild_every > counts.before // settings.rebuild_every and table.version == StoredTable(spark, prototypes).version:
            newest = rejected.orderBy(F.desc("batch"), F.desc("id")).limit(settings.noise_prototypes).select(F.xxhash64("batch", "id").alias("id"), F.lit("noise").alias("kind"), F.substring("answer", 1, 500).alias("text"))
            table.replaced(table.rows().filter("kind = 'noise'").select("id"), newest)

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
