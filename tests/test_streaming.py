"""Streams in many micro-batches, with late rows and restarts, against all rows in time order."""

import random

from pyspark.sql import functions as F

from tidemark.plans import catalogue
from tidemark.streaming import live


def run(spark, stream, path, name):
    """Runs a stream over what its source has now, from where it stopped; the rows it has written so far, and what its state holds."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start(f"{path}/{name}")
    query.awaitTermination()
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{path}/{name}").collect())), held, dropped


def add(spark, path, number, rows):
    made = spark.createDataFrame(rows, "session_id string, t long, label int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    made.coalesce(1).write.parquet(f"{path}/rows/batch={number}")


def source(spark, path):
    return spark.readStream.schema("session_id string, label int, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def looped(walk, rows):
    state, made = walk.start, []
    for t, x in sorted(rows, key=lambda r: r[0]):
        state, found = walk.step(state, float(t), float("nan") if x is None else float(x))
        made += found
    return made


def test_late_rows_restart_and_eviction(spark, tmp_path):
    """Rows come up to 20 seconds late, the stream stops in between, and a session ends; the delay is 30 seconds."""
    path, rng = f"file://{tmp_path}", random.Random(3)
    rows = [(s, t, rng.choice([None, 1, 1, 2, 3])) for s in ("a", "b") for t in range(5000, 5300, 3)] + [("ended", t, 1 + t // 4 % 2) for t in range(5000, 5060, 2)]
    rows.sort(key=lambda r: (r[1] + rng.randrange(20), r))
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    for n, part in enumerate(parts[: len(parts) // 2]):
        add(spark, path, n, part)

    def stream(walk):
        return live.live_in_order(source(spark, path), walk, "30 seconds", 60.0, "label")

    walks = {"dedup": live.Dedup(7.0), "delta": live.Delta(), "changes": live.Transitions(2, 3)}
    before = {name: run(spark, stream(walk), path, name)[0] for name, walk in walks.items()}
    for n, part in enumerate(parts[len(parts) // 2 :], len(parts)):
        add(spark, path, n, part)
    add(spark, path, 1000, [("last", 6000, 1)])  # carries the watermark beyond all others
    add(spark, path, 1001, [("last", 6001, 1), ("a", 5005, 9)])  # a row far too late
    for name, walk in walks.items():
        made, held, dropped = run(spark, stream(walk), path, name)
        known = [(s, *row) for s in ("a", "b", "ended") for row in looped(walk, [(t, x) for k, t, x in rows if k == s])]
        assert [str(r) for r in made if r[0] != "last"] == [str(r).replace("nan", "None") for r in sorted(known)]
        assert set(map(str, before[name])) < set(map(str, made))
        assert dropped == 1 and held[-1] == 1 and max(held) <= 4  # what is left is the last session's state


def test_last_shot_in_batches(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [("a", t, kind) for t, kind in ((10, 0), (12, 0), (14, 1), (30, 1), (31, 0), (33, 1), (33, 0), (200, 1), (400, 0), (401, 1))]
    for n in range(0, len(rows), 2):
        add(spark, path, n, rows[n : n + 2])
    add(spark, path, 100, [("z", 1000, 0), ("z", 1000, 1)])
    of = lambda kind: source(spark, path).where(F.col("label") == kind).select("session_id", "ts")
    made, _, _ = run(spark, live.live_last_shot(of(1), of(0), "5 seconds", "20 seconds"), path, "fused")
    assert [(int(k.timestamp()), int(f.timestamp())) for s, k, f in made if s == "a"] == [(14, 12), (30, 30), (33, 33), (200, 200), (401, 400)]


def test_patches_across_batches(spark, tmp_path):
    path = f"{tmp_path}/patches"
    patches = [[1.0, 2.0], [3.0, 2.0], None, [3.0, 6.0], [1.0], [2.0]]
    for n, patch in enumerate(patches):
        spark.createDataFrame([("s", float(n), patch)], "session_id string, time_s double, patch array<double>").coalesce(1).write.parquet(f"{path}/batch={n}")
    frames = spark.readStream.schema("session_id string, time_s double, patch array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    made, _, _ = run(spark, live.live_patch_delta(frames), f"file://{tmp_path}", "delta")
    assert made == [("s", 0.0, None), ("s", 1.0, 1.0), ("s", 3.0, 2.0), ("s", 4.0, None), ("s", 5.0, 1.0)]


def test_streams_of_tables_in_parts(spark, tmp_path):
    """Tables that are folders of part files give what they give as single files."""
    single, parts = "/root/testdata/sf0.001", f"{tmp_path}/parts"
    for name in ("events", "embeddings"):
        spark.read.parquet(f"{single}/{name}.parquet").repartition(3).write.parquet(f"{parts}/{name}.parquet")
    for name in ("stream_patches", "stream_delta"):
        of_single, of_parts = (sorted(map(str, catalogue.queries()[name](spark, sf).collect())) for sf in (single, parts))
        assert of_single and of_parts == of_single
