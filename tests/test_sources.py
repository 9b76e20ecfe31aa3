"""Files in and out."""

import wave

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from tidemark.sources import sound, tables


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 2.0, 1.1), (2, 1.5, None, 1.03)], tables.SCHEMAS["audio_kills"])
    tables.write_csv(df, f"file://{tmp_path}/out")
    back = tables.read_csv(spark, f"file://{tmp_path}/out", "audio_kills")
    assert sorted(map(tuple, back.collect())) == [(1, 0.5, 2.0, 1.1), (2, 1.5, None, 1.03)]


def test_truth_column_falls_back(spark):
    df = spark.createDataFrame([(2.0,), (None,)], "engagement_start_s double")
    assert [r["time_s"] for r in tables.truth_times(df).collect()] == [2.0]
    assert tables.with_confidence(df).first()["confidence"] == 1.0
    assert tables.probe_column(df, ("x", "engagement_start_s")) == "engagement_start_s"


def test_events_are_filtered(spark, tmp_path):
    rows = [("s", "weapon_fire", 1, "a", None, None, None, None), ("s", "round_end", 2, "a", None, None, None, None)]
    spark.createDataFrame(rows, tables.SCHEMAS["events"]).write.parquet(f"file://{tmp_path}/e")
    df = tables.read_events(spark, f"file://{tmp_path}/e")
    assert [r["tick"] for r in df.collect()] == [1]
    assert "PushedFilters: [In(event_name" in df._jdf.queryExecution().toString()


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(2)
        out.setframerate(8000)
        out.writeframes(np.array([[16384, 0]] * 100, "<i2").tobytes())
    rows = tables.read_wav(spark, f"file://{tmp_path}/*.wav", 64).orderBy("chunk_no").collect()
    assert [len(r["samples"]) for r in rows] == [64, 36]
    assert rows[0]["samples"][0] == 0.25


def rows_scanned(df):
    """Rows that a query's scan gave, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_a_slice_reads_the_row_groups_it_needs(spark, tmp_path):
    n = 200_000
    frames = spark.range(n).selectExpr("concat('s', id % 4) as session_id", "cast(id div 4 as double) as time_s", "hash(id) as value", "uuid() as more")
    path = f"file://{tmp_path}/frames"
    tables.write_clustered(frames, path, files=4, row_group_bytes=1 << 18)
    found = tables.read_slice(spark, path, {"session_id": "s2"}, 1000.0, 1100.0)
    assert found.count() == 100
    assert 100 <= rows_scanned(found) <= n / 20
    assert rows_scanned(spark.read.parquet(path)) == n
    for at, wanted in ((1000.5, 1000.0), (0.0, 0.0), (49_999.0, 49_999.0), (10.0**6, 49_999.0)):
        assert [r["time_s"] for r in tables.read_at(spark, path, {"session_id": "s2"}, at).collect()] == [wanted]
    assert tables.read_at(spark, path, {"session_id": "s2"}, -1.0).collect() == []
    assert tables.read_at(spark, path, {"session_id": "none"}, 5.0).collect() == []


def test_parquet_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "session_id string, n int, x double")
    for by in ((), ("session_id",)):
        tables.write_parquet(df, f"file://{tmp_path}/out", by)
        assert sorted(map(str, spark.read.parquet(f"file://{tmp_path}/out").select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["session_id=a", "session_id=b"]


def test_missing_input_is_an_error(spark, tmp_path):
    for read in (lambda p: tables.read_csv(spark, p, "audio_kills"), lambda p: tables.read_events(spark, p), lambda p: tables.read_wav(spark, p)):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read(f"file://{tmp_path}/nothing").collect()


def written(path, values, rate=8000, width=2, channels=1):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(values)


def test_wav_by_byte_ranges(spark, tmp_path):
    rng = np.random.default_rng(2)
    one, two = rng.integers(-(2**15), 2**15, (100_000, 2)).astype("<i2"), rng.integers(-(2**15), 2**15, 777).astype("<i2")
    written(tmp_path / "a.wav", one.tobytes(), channels=2)
    written(tmp_path / "b.wav", two.tobytes())
    written(tmp_path / "c.wav", b"")
    spark.dataSource.register(sound.WavSource)
    df = spark.read.format("wav").option("chunk", 1000).option("rangeBytes", 16_000).load(f"{tmp_path}/*.wav")
    assert df.rdd.getNumPartitions() >= 25  # four chunks a task of the first file
    whole = tables.read_wav(spark, f"file://{tmp_path}/*.wav", 1000)
    key = lambda r: (r["session_id"].rpartition("/")[2], r["chunk_no"], r["rate"], r["samples"])
    assert sorted(map(key, df.collect())) == sorted(map(key, whole.collect()))
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("wav").load(f"{tmp_path}/nothing.wav").collect()


def test_kinds_of_samples(tmp_path):
    values = np.array([-1.0, -0.5, 0.0, 0.5])
    for width, raw in ((1, (values * 128 + 128).astype(np.uint8).tobytes()), (2, (values * 2**15).astype("<i2").tobytes()), (4, (values * 2**31).astype("<i4").tobytes())):
        written(tmp_path / "x.wav", raw, width=width)
        of = sound.header(str(tmp_path / "x.wav"))
        assert (of.bits, of.size) == (8 * width, 4 * width) and sound.mono(raw, of).tolist() == values.tolist()
    three = b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in values)
    assert sound.mono(three, sound.Header(sound.PCM, 1, 8000, 24, 0, 12)).tolist() == values.tolist()
    assert sound.mono(values.astype("<f4").tobytes(), sound.Header(sound.FLOAT, 2, 8000, 32, 0, 16)).tolist() == [-0.75, 0.25]
    for text in (b"", b"RIFF....WAVE", b"no sound at all"):
        (tmp_path / "y.wav").write_bytes(text)
        with pytest.raises(ValueError):
            sound.header(str(tmp_path / "y.wav"))
