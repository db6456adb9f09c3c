"""Edits as they come, replayed over transcripts as they come: keyed state by episode.

The state of an episode is its newest transcript (lines, automatic names, cues, and when it was made) and the edits since. What comes in adds to
it, in whatever order: a newer transcript replaces the old one and makes edits before it late, late edits are dropped, an edit that comes
twice counts once. Each batch gives, for the episodes that it touches, the lines after all edits by id: the same as ``edits.apply_edits`` over
all that has come. State is bounded by an episode's lines and edits; it lives in the query's checkpoint, so a query that starts again goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from palaver.operators.edits import LINES, replay
from palaver.operators.joins import upsert

#: A store that keeps more than one kind of state by key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INPUT = "ep string, what string, id bigint, ts bigint, body string"
SNAPSHOT = f"ep string, version bigint, made bigint, lines array<struct<{', '.join(c.replace(' ', ': ') for c in LINES.split(', '))}>>"


def edit_events(edits: DataFrame) -> DataFrame:
    """Edits (ep, id, kind, t, orig, label, value, ts) as events."""
    body = F.to_json(F.struct("id", "kind", "t", "orig", "label", "value"))
    return edits.select(F.col("ep").cast("string").alias("ep"), F.lit("edit").alias("what"), F.col("id").cast("bigint").alias("id"), F.col("ts").cast("bigint").alias("ts"), body.alias("body"))


def transcript_events(transcripts: DataFrame) -> DataFrame:
    """Transcripts (ep, made, lines, names, cues; arrays of structs) as events."""
    body = F.to_json(F.struct("lines", "names", "cues"))
    return transcripts.select(F.col("ep").cast("string").alias("ep"), F.lit("transcript").alias("what"), F.lit(None).cast("bigint").alias("id"), F.col("made").cast("bigint").alias("ts"), body.alias("body"))


class Replay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.transcript = handle.getValueState("transcript", "made bigint, version bigint, body string")
        self.log = handle.getMapState("log", "id bigint", "ts bigint, body string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made, version, body = self.transcript.get() or (None, 0, None)
        for frame in rows:
            for r in frame.itertuples():
                if r.what == "edit":
                    self.log.updateValue((int(r.id),), (int(r.ts), r.body))
                elif made is None or r.ts > made:
                    made, body = int(r.ts), r.body
        log = []
        for (i,), (ts, edit) in list(self.log.iterator()):
            if made is not None and ts < made:
                self.log.removeKey((i,))
            else:
                log.append(json.loads(edit))
        if made is None:  # edits wait for their transcript
            return
        self.transcript.update((made, version + 1, body))
        t = json.loads(body)
        lines = [{c: x.get(c) for c in ("id", "t", "spk", "src", "label", "text")} for x in t.get("lines") or []]
        names = {n["label"]: (n.get("spk", ""), n.get("src", "")) for n in t.get("names") or []}
        edits = [{c: e.get(c) for c in ("id", "kind", "t", "orig", "label", "value")} for e in log]
        done, _ = replay(lines, edits, names, [(c["start"], c["end"], c.get("text") or "") for c in t.get("cues") or []])
        yield pd.DataFrame([(key[0], version + 1, made, json.dumps(done))], columns=["ep", "version", "made", "lines"])

    def close(self) -> None:
        pass


def snapshots(events: DataFrame) -> DataFrame:
    """(ep, version, made, lines): for each batch, the episodes it touches with their lines after all edits; versions count up."""
    out = events.groupBy("ep").transformWithStateInPandas(Replay(), "ep string, version bigint, made bigint, lines string", "Update", "None")
    kind = SNAPSHOT.split("lines ", 1)[1]
    return out.withColumn("lines", F.from_json("lines", kind))


def follow(events: DataFrame, checkpoint: str, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> StreamingQuery:
    """Start the replay: each batch's episodes replace those stored. ``read`` gives the stored lines (None: none yet), ``write`` stores them.

    A batch that runs again after a failure writes the same rows.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def store(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            new = batch.select("ep", F.explode("lines").alias("x")).select("ep", "x.*")
            old = read()
            if old is None:
                write(new)
            else:
                write(upsert(old.join(batch.select("ep"), "ep", "left_anti"), new, ["ep"]))
        finally:
            batch.unpersist()

    return snapshots(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events from JSON files as they come into a folder."""
    return spark.readStream.schema(INPUT).json(folder)
