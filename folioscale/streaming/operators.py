"""Structured Streaming forms of the stateful operators.

Stateless and windowed operators are plain streaming DataFrames. Where what is kept depends on what was admitted before (rate
limits, caches, sentence buffers, last-n windows), state is held by key with ``applyInPandasWithState``; a batch's rows of a
key are put in order of event time first, so results do not depend on how rows arrive within a batch.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscale.operators.lexical import tokens
from folioscale.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, root: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """One Parquet table of a data folder as a stream, whether it is a file or a folder of files."""
    where = f"{root}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(where).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root) if single else reader.parquet(where)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns its result as a table in the shared checkpoint folder.

    append and update write each batch as it comes, complete replaces what was written. Progress and offsets stand in the same
    folder, so a lost executor or driver resumes there.
    """
    spark = stream.sparkSession
    where = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own folder, so results are written once
        batch.write.mode("overwrite").parquet(f"{where}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{where}/out").select(*schema.fieldNames())


def windowed(events: DataFrame, time: str, by: list[str], width: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """by, start, n: events in windows of event time, tumbling or sliding; those later than ``late`` are left out."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return rows.groupBy(*by, F.window("__t", width, slide).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def document_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """term, df as documents arrive; terms are made distinct within each document, so the count adds up over batches."""
    return documents.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def first_of_each(events: DataFrame, key: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Each key's first row within the watermark; later copies are dropped, and state with them once they are too late."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return rows.dropDuplicatesWithinWatermark(key).drop("__t")


def _stateful(rows: DataFrame, key: str, out: str, step: Callable[[str, list[dict], dict], tuple[list[tuple], dict]], order: list[str]) -> DataFrame:
    """Rows made by ``step(key, rows in order, state)`` with a state that JSON can hold, one for each key."""
    names = [f.split()[0] for f in out.split(", ")]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        seen = pd.concat(list(batches)).sort_values(order, kind="stable")
        made, held = step(group[0], seen.to_dict("records"), held)
        state.update((json.dumps(held),))
        yield pd.DataFrame(made, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, out, "held string", "append", GroupStateTimeout.NoTimeout)


def rate_limited(events: DataFrame, client: str, time: str, event: str, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """client, event, allowed: an event passes if fewer than ``most`` passed in the ``seconds`` before it.

    Refused events do not count. Time is in seconds (double); an event exactly ``seconds`` old no longer counts.
    """

    def step(key: str, rows: list[dict], held: dict) -> tuple[list[tuple], dict]:
        passed, out = held.get("passed", []), []
        for r in rows:
            passed = [t for t in passed if r[time] - t < seconds]
            ok = len(passed) < most
            if ok:
                passed.append(r[time])
            out.append((key, r[event], ok))
        return out, {"passed": passed}

    kinds = dict(events.dtypes)
    return _stateful(events, client, f"{client} {kinds[client]}, {event} {kinds[event]}, allowed boolean", step, [time, event])


def last_n_means(events: DataFrame, key: str, time: str, event: str, value: str, n: int = 100) -> DataFrame:
    """key, event, mean: the mean of the key's last ``n`` values at each event."""

    def step(name: str, rows: list[dict], held: dict) -> tuple[list[tuple], dict]:
        last, out = held.get("last", []), []
        for r in rows:
            last = [*last, float(r[value])][-n:]
            out.append((name, r[event], sum(last) / len(last)))
        return out, {"last": last}

    kinds = dict(events.dtypes)
    return _stateful(events, key, f"{key} {kinds[key]}, {event} {kinds[event]}, mean double", step, [time, event])


_SENTENCE = re.compile(r"(?:[^.!?]|[.!?](?!\s|$))*[.!?]+(?=\s|$)")


def complete_sentences(parts: DataFrame, answer: str, order: str, text: str, closing: str) -> DataFrame:
    """answer, sentence: sentences of a text that arrives in parts, each as soon as it is complete and once an answer.

    ``closing`` is true on an answer's last part; what is left in the buffer comes out then.
    """

    def step(name: str, rows: list[dict], held: dict) -> tuple[list[tuple], dict]:
        buffer, told, out = held.get("buffer", ""), set(held.get("told", [])), []
        for r in rows:
            buffer += r[text] or ""
            found, end = [], 0
            for m in _SENTENCE.finditer(buffer):
                if m.end() < len(buffer) or r[closing]:
                    found.append(m.group().strip())
                    end = m.end()
            buffer = buffer[end:]
            if r[closing]:
                found.append(buffer.strip())
                buffer = ""
            for s in found:
                if s and s.lower() not in told:
                    told.add(s.lower())
                    out.append((name, s))
        return out, {"buffer": buffer, "told": sorted(told)}

    kinds = dict(parts.dtypes)
    return _stateful(parts, answer, f"{answer} {kinds[answer]}, sentence string", step, [order])


def cache_hits(requests: DataFrame, cache: str, time: str, event: str, item: str, capacity: int = 100, seconds: float = 3600.0) -> DataFrame:
    """cache, event, hit: requests to a cache of ``capacity`` items that drops the least recently used and those over age.

    An item's age counts from when it was put in; a hit makes it the most recent.
    """

    def step(name: str, rows: list[dict], held: dict) -> tuple[list[tuple], dict]:
        kept, out = dict(held.get("kept", {})), []
        for r in rows:
            k, now = str(r[item]), float(r[time])
            hit = k in kept and now - kept[k] < seconds
            born = kept.pop(k, now) if hit else now
            kept.pop(k, None)
            kept[k] = born
            if len(kept) > capacity:
                del kept[next(iter(kept))]
            out.append((name, r[event], hit))
        return out, {"kept": kept}

    kinds = dict(requests.dtypes)
    return _stateful(requests, cache, f"{cache} {kinds[cache]}, {event} {kinds[event]}, hit boolean", step, [time, event])
