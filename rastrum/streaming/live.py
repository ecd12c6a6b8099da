"""Structured Streaming forms: operators that follow a growing recording in arrival order.

Order is the arrival position, not event time: no watermark is used, and a row that names an
earlier transfer is matched by that name, never by where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.signal import classify_stream as signal_states  # noqa: F401
from ..sources.recording import DATA


def packets(spark, path: str, most: int = 4096) -> DataFrame:
    """A recording that is still written, as a stream of records."""
    return spark.readStream.format("tpc").option("path", path).option("maxRecordsPerTrigger", str(most)).load()


def unwrap_stream(df: DataFrame, keys: list[str], order: str, counter: str) -> DataFrame:
    """keys, order, counter, extended, discontinuity: the counter unwrapped as sequence.unwrap_counter does, across batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, extended = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for r in rows.to_dict("records"):
            c = int(r[counter])
            if last is None:
                extended, odd = c, False
            else:
                step = (c - last) % 65536
                forward = 0 < step < 32768
                extended, odd = extended + (step if forward else 1), step != 1
            last = c
            out.append({**{k: r[k] for k in (*keys, order, counter)}, "extended": extended, "discontinuity": odd})
        if out:
            yield pd.DataFrame(out)
        state.update((last, extended))

    ddl = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (*keys, order, counter)) + ", extended long, discontinuity boolean"
    return df.groupBy(*keys).applyInPandasWithState(run, ddl, "last long, extended long", "append", "NoTimeout")


def gap_stream(df: DataFrame) -> DataFrame:
    """Records that don't follow the one before of their endpoint, as they come: capture_id, endpoint, file_off."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, index = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(parts)).sort_values("file_off").itertuples():
            s, i = int(r.submit_seq), int(r.pkt_index)
            follows = seq is None or (s == seq and i == (index + 1) % 65536) or (s == seq + 1 and i == 0)
            seq, index = s, i
            if not follows:
                out.append((key[0], key[1], int(r.file_off)))
        if out:
            yield pd.DataFrame(out, columns=["capture_id", "endpoint", "file_off"])
        state.update((seq, index))

    data = df.where(F.col("rec_type") == DATA).drop("payload")
    return data.groupBy("capture_id", "endpoint").applyInPandasWithState(run, "capture_id string, endpoint short, file_off long", "seq long, idx long", "append", "NoTimeout")


def health_stream(df: DataFrame) -> DataFrame:
    """Records and bytes by capture, endpoint and kind so far (complete mode)."""
    return df.groupBy("capture_id", "endpoint", "rec_type").agg(F.count("*").alias("records"), F.sum("actual_len").alias("bytes"))
