"""Sources and sinks: typed CSV and Parquet tables, WAV files, and wide or narrow result files."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of the tables that sessions consist of.
SCHEMAS = {
    "events": "session_id string, event_name string, tick bigint, actor string, dmg int, hitgroup int, headshot boolean, weapon string",
    "signal": "session_id string, name string, idx bigint, time_s double, value double",
    "audio_kills": "kill_n int, time_s double, energy double, confidence double",
    "count_kills": "kill_n int, video_s double, demo_s double, signal string",
    "fused_kills": "kill_n int, video_s double, demo_s double, ocr_video_s double, refinement_s double, signal string",
    "timeline": "frame_n bigint, time_s double, label int, confirmed_state int",
    "transitions": "time_s double, from_count int, to_count int, delta int, direction string, multi_step boolean",
    "labels": "frame_n bigint, time_s double, patch_path string, agent_label double, agent_confidence string, agent_notes string",
    "engagements": "engagement_id int, kill_tick bigint, kill_time_s double, engagement_start_s double, ttff_ms double, ttk_ms double, total_duration_ms double, shots_fired int, shots_hit int, shots_missed int, "
    "hit_rate double, headshot boolean, damage_dealt int, weapon string, hit_sequence string, inter_engagement_gap_ms double",
}
EVENT_KINDS = ("weapon_fire", "player_hurt", "player_death")


def read_csv(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, by a schema of SCHEMAS or an own one; an empty field is null."""
    return spark.read.schema(schema or SCHEMAS[kind]).option("header", True).csv(path)


def read_events(spark: SparkSession, path: str, kinds: tuple[str, ...] = EVENT_KINDS) -> DataFrame:
    """Event rows of the wanted kinds; the filter reaches the Parquet scan."""
    return spark.read.schema(SCHEMAS["events"]).parquet(path).where(F.col("event_name").isin(*kinds))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for results of report size, as one task writes it; large ones go to write_parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet files, as many as there are tasks; by: columns that become folders."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_clustered(df: DataFrame, path: str, by: tuple[str, ...] = ("session_id",), time: str = "time_s", files: int = 8, row_group_bytes: int = 8 << 20) -> None:
    """Parquet files sorted by key and time, each of a range of its own, in row groups so small that their bounds tell which a time slice needs."""
    ordered = df.repartitionByRange(files, *by, time).sortWithinPartitions(*by, time)
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", 2000).parquet(path)


def read_slice(spark: SparkSession, path: str, key: dict[str, object], low: object, high: object, time: str = "time_s") -> DataFrame:
    """Rows of one key with low <= time < high; of write_clustered() files, whatever does not overlap the slice is skipped unread."""
    df = spark.read.parquet(path)
    for name, wanted in key.items():
        df = df.where(F.col(name) == F.lit(wanted))
    return df.where((F.col(time) >= F.lit(low)) & (F.col(time) < F.lit(high)))


def read_at(spark: SparkSession, path: str, key: dict[str, object], at: float, reach: float = 1.0, time: str = "time_s") -> DataFrame:
    """The last row of one key at or before a time (rows of that time: all), empty without one.

    Slices that end there are read, each eight times as long as the one before, until one has a row; so a row is found by bounds,
    not by reading all before it.
    """
    first = read_slice(spark, path, key, -float("inf"), float("inf"), time).agg(F.min(time)).first()[0]  # from the files' statistics where Spark pushes the aggregate, else one column
    end = math.nextafter(at, math.inf)
    while True:
        rows = read_slice(spark, path, key, at - reach, end, time)
        latest = rows.agg(F.max(time)).first()[0]
        if latest is not None or first is None or at - reach <= first:
            return rows.where(F.col(time) == F.lit(latest))
        reach *= 8


def truth_times(df: DataFrame, preferred: str = "kill_time_s", fallback: str = "engagement_start_s") -> DataFrame:
    """time_s of a truth table: the preferred column if the table has it, else the fallback; nulls go."""
    name = preferred if preferred in df.columns else fallback
    return df.where(F.col(name).isNotNull()).withColumn("time_s", F.col(name).cast("double"))


def with_confidence(df: DataFrame, default: float = 1.0) -> DataFrame:
    return df if "confidence" in df.columns else df.withColumn("confidence", F.lit(default))


def probe_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of the names that is a column."""
    return next((n for n in names if n in df.columns), None)


def read_wav(spark: SparkSession, path: str, chunk: int = 44100) -> DataFrame:
    """session_id (file), chunk_no, rate, samples (mono, -1 to 1) of 16-bit WAV files, in chunks of so many samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with wave.open(io.BytesIO(content)) as sound:
                    raw = np.frombuffer(sound.readframes(sound.getnframes()), "<i2").reshape(-1, sound.getnchannels())
                    rate = sound.getframerate()
                mono = (raw.mean(axis=1) / 32768).astype(np.float32)
                for n, start in enumerate(range(0, len(mono), chunk)):
                    part = mono[start : start + chunk]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int32()), pa.array([rate], pa.int32()), pa.array([part], pa.list_(pa.float32()))], ["session_id", "chunk_no", "rate", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "session_id string, chunk_no int, rate int, samples array<float>")
