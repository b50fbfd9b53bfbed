"""Live input: windows over event time, runs that close as their stream goes on, labels that hold, new keys.

The input is any streaming DataFrame; ``event_stream`` reads a folder of Parquet
files as they arrive.  State is kept by key in the state store and
survives restarts with the query's checkpoint.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.operators.runs import next_labels


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Rows of Parquet files as they come into the folder ``path``; of a single file, those of files of its name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="loomwork-stream-")


def windowed(events: DataFrame, ts: str, keys: list[str], length: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and key; a window closes when the watermark has passed it."""
    rows = events.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, length, slide or length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Spans of events that follow each other within the gap, as speech with short pauses does."""
    rows = events.withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def new_keys(events: DataFrame, key: str) -> DataFrame:
    """The first row of every key seen so far."""
    return events.dropDuplicates([key])


def closed_runs(events: DataFrame, longest: int = 30_000) -> DataFrame:
    """Runs of one language in the order of arrival, each emitted once it has ended; ``last_runs`` has those still open when the stream stops.

    Rows have media, s, e, lang (nulls go on with the run before them).  A run that lasts longer than
    ``longest`` is emitted as it is and goes on as a new one, so that nobody waits for it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["s", "e"], kind="stable")
        for s, e, lang in zip(rows["s"], rows["e"], rows["lang"]):
            lang = lang if lang is not None and lang == lang else (run[0] if run else "other")
            if run and run[0] == lang and e - run[1] <= longest:
                run[2], run[3] = max(run[2], int(e)), run[3] + 1
            else:
                if run:
                    out.append((key[0], *run))
                run = [lang, int(s), int(e), 1]
        if run:
            state.update(tuple(run))
        yield pd.DataFrame(out, columns=["media", "lang", "s", "e", "n"])

    return events.groupBy("media").applyInPandasWithState(step, "media long, lang string, s long, e long, n long", "lang string, s long, e long, n long", "append", GroupStateTimeout.NoTimeout)


def last_runs(spark: SparkSession, state: str) -> DataFrame:
    """The runs that were open when the query of ``closed_runs`` with the checkpoint ``state`` stopped: what a final flush emits."""
    rows = spark.read.format("statestore").load(state)
    return rows.select(F.col("key.media").alias("media"), "value.groupState.lang", "value.groupState.s", "value.groupState.e", "value.groupState.n").where("lang IS NOT NULL")


def stable_speakers(turns: DataFrame) -> DataFrame:
    """Turns with labels that hold across passes: each pass takes the labels of the turns before it that its speakers overlap.

    Rows have media, pass, s, e, speaker.  A pass comes whole within a batch; state is the last pass's turns with
    their labels and the number of labels so far, however many passes there were.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["pass", "s", "e"], kind="stable")
        starts, ends, names, used = state.get if state.exists else ([], [], [], 0)
        known, labels = list(zip(starts, ends, names)), []
        for _, one in rows.groupby("pass", sort=True):
            turns = one.to_dict("records")
            own, used = next_labels(known, used, turns)
            known = [(float(t["s"]), float(t["e"]), x) for t, x in zip(turns, own)]
            labels += own
        starts, ends, names = (list(x) for x in zip(*known))
        state.update((starts, ends, names, used))
        yield rows.assign(media=key[0], label=labels)[["media", "pass", "s", "e", "speaker", "label"]]

    return turns.groupBy("media").applyInPandasWithState(
        step, "media long, pass long, s double, e double, speaker string, label string", "starts array<double>, ends array<double>, names array<string>, used long", "append", GroupStateTimeout.NoTimeout
    )


def collected(stream: DataFrame, checkpoint: str, mode: str = "append", rest: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is there now, to the end, into Parquet files beside its checkpoint, and returns these; ``rest`` adds what its state still holds then."""
    where = f"{checkpoint.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).format("parquet").start(f"{where}/rows")
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{where}/rows")).start()
    query.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/rows")
    return out.unionByName(rest(stream.sparkSession, f"{where}/state")) if rest else out
