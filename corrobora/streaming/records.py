"""Streams of record files and of recorded attempts."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import strict_json


def stream_records(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(text, value, problem) of JSON lines as files come in; stateless, so any sink and trigger will do."""
    return strict_json(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder).withColumnRenamed("value", "text"), "text")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by time window and kind, open for `late` after the newest event seen."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def loop_states(attempts: DataFrame, rounds: int = 3) -> DataFrame:
    """(record_id, attempt, status, stopped): the attempts of each record that count, in order, up to the first that is
    admitted or goes to an expert or to the last allowed round; state is one counter a record."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        seen, stopped = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("attempt")
        out = []
        for a, s in zip(rows["attempt"], rows["status"]):
            if stopped:
                break
            seen += 1
            stopped = s in ("admitted", "to_expert") or seen >= rounds
            out.append((key[0], int(a), s, stopped))
        state.update((seen, stopped))
        yield pd.DataFrame(out, columns=["record_id", "attempt", "status", "stopped"])

    return attempts.select("record_id", "attempt", "status").groupBy("record_id").applyInPandasWithState(step, "record_id string, attempt int, status string, stopped boolean", "seen int, stopped boolean", "append", GroupStateTimeout.NoTimeout)
