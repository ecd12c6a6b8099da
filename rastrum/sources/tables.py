"""Strict text sources: the pairing schedule, the decision log, the replay log."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the schedule's format.
SCHEDULE_HEADER = ["first_counter", "pairing", "note"]
MOST_ROWS, MOST_CELL = 65_536, 4096


def parse_schedule(text: str) -> list[tuple[int, str, str]]:
    """Rows of a pairing schedule, or ValueError: exact header, first row 0, rising, known pairings, no NUL, no lone CR, nothing after a closing quote."""
    if "\0" in text:
        raise ValueError("a NUL in the schedule")
    if text.replace("\r\n", "").count("\r"):
        raise ValueError("a carriage return without a line feed")
    rows: list[list[str]] = []
    for row in csv.reader(io.StringIO(text, newline=""), strict=True):
        rows.append(row)
    if not rows or rows[0] != SCHEDULE_HEADER:
        raise ValueError("the header must be " + ",".join(SCHEDULE_HEADER))
    out: list[tuple[int, str, str]] = []
    for n, row in enumerate(rows[1:], 1):
        if len(row) != 3 or any(len(c.encode()) > MOST_CELL for c in row):
            raise ValueError(f"row {n}: three cells of {MOST_CELL} bytes at most")
        first, pairing, note = row
        if not (first.isascii() and first.isdigit()) or int(first) >= 2**63:
            raise ValueError(f"row {n}: first_counter must be a natural number")
        if pairing not in ("aligned", "reversed"):
            raise ValueError(f"row {n}: pairing must be aligned or reversed")
        if int(first) <= out[-1][0] if out else int(first) != 0:
            raise ValueError(f"row {n}: the first counter must be 0 and each greater than the one before")
        out.append((int(first), pairing, note))
        if len(out) > MOST_ROWS:
            raise ValueError(f"over {MOST_ROWS} rows")
    if not out:
        raise ValueError("no rows")
    return out


def schedule(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_schedule(text), "first_counter long, pairing string, note string")


def decision_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A decision log with the columns given; an empty cell is null, not zero; lines that start with # are notes."""
    return spark.read.csv(path, schema=schema, header=True, comment="#", nullValue="", emptyValue="", mode="FAILFAST", enforceSchema=False, positiveInf="inf", escape='"', multiLine=True)


def write_decision_log(df: DataFrame, path: str) -> None:
    """Writes a new log; one that is there already stays, and an error says so."""
    infinite = [F.when(F.col(c) == float("inf"), "inf").otherwise(F.col(c).cast("string")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*infinite).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="", escape='"')


_REPLAY = {
    "V": "counter long, pts_num long, pts_den int, d1 int, d2 int, transport int, audio_pts_known int, audio_pts_num long",
    "A": "sample_ordinal long, pts_num long, pts_den int, n_frames int, flags int, last_resync_counter long, residual long",
    "U": "counter long, format int, kind int, transport int, host_lost int",
}


def replay_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three kinds of rows of a replay's timing log, by first token."""
    lines = spark.read.text(path)
    out = {}
    for kind, schema in _REPLAY.items():
        cells = F.split(F.substring("value", 3, 1 << 20), ",")
        cols = [F.when(F.get(cells, F.lit(i)) != "", F.get(cells, F.lit(i))).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for i, c in enumerate(schema.split(", "))]
        out[kind] = lines.where(F.col("value").startswith(kind + ",")).select(*cols)
    return out


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Gives a finished file or folder its name in one step; fails, and leaves both as they are, if the name is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, goal = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(target)
    system = goal.getFileSystem(conf)
    if system.exists(goal):
        raise FileExistsError(target)
    if not system.rename(source, goal):
        raise OSError(f"{staged} can't be renamed to {target}")


def newest_log(spark: SparkSession, path: str, holding: str = "") -> DataFrame:
    """Lines of the newest file under a path that holds a text: line, file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    newest = lines.where(F.col("line").contains(holding)).agg(F.max_by("file", F.struct("at", "file")).alias("newest"))
    return lines.join(F.broadcast(newest), F.col("file") == F.col("newest")).select("line", "file")
