"""Streams in append mode, file by file in a known order: what is late, what is released, and that it is released once."""

import datetime as dt

from pyspark.sql import functions as F

from umbra.sources import io
from umbra.streaming import ops

SCHEMA = "event_id long, ts timestamp, u long, g string"


def feed(spark, tmp_path, *batches):
    """A stream of one file a batch, in order; times are minutes of one day."""
    import os

    day = dt.datetime(2024, 1, 1)
    for i, rows in enumerate(batches):
        at = tmp_path / f"in{i}"
        spark.createDataFrame([(e, day + dt.timedelta(minutes=m), u, g) for e, m, u, g in rows], SCHEMA).coalesce(1).write.parquet(str(at))
        part = next(at.glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    return io.read_stream(spark, str(tmp_path / "in"), SCHEMA, maxFilesPerTrigger=1)


def run(spark, tmp_path, df, rocksdb=False):
    out = str(tmp_path / "out")
    io.release_stream(df, out, str(tmp_path / "state"), rocksdb=rocksdb)
    return [tuple(r) for r in spark.read.schema(df.schema).parquet(out).select(*df.columns).collect()]


#: Rows are late by the watermark before the last batch, so one batch lies between what moves it and what comes late.
LATE = ([(1, 10, 1, "a"), (2, 70, 1, "a")], [(3, 300, 1, "a")], [(7, 302, 1, "a")], [(4, 15, 2, "a"), (5, 290, 2, "a")], [(6, 600, 1, "a")])


def minutes(rows):
    return sorted((int((a - dt.datetime(2024, 1, 1)).total_seconds() // 60), *rest) for a, _, *rest in rows)


def test_tumbling_and_sliding_windows_drop_late_rows(spark, tmp_path):
    got = run(spark, tmp_path, ops.windowed_counts(feed(spark, tmp_path, *LATE), "ts", "1 hour"))
    assert minutes(got) == [(0, 1), (60, 1), (240, 1), (300, 2)]  # event 4 came after its window was closed, event 5 in time


def test_sliding_windows_late(spark, tmp_path):
    got = run(spark, tmp_path, ops.windowed_counts(feed(spark, tmp_path, *LATE), "ts", "2 hours", "1 hour"))
    assert minutes(got) == [(-60, 1), (0, 2), (60, 1), (180, 1), (240, 3), (300, 2)]


def test_sessions_late(spark, tmp_path):
    got = run(spark, tmp_path, ops.windowed_counts(feed(spark, tmp_path, *LATE), "ts", "", gap="30 minutes", by=("u",)))
    assert minutes(got) == [(10, 1, 1), (70, 1, 1), (290, 2, 1), (300, 1, 2)]


def test_dedup_forgets_behind_the_watermark(spark, tmp_path):
    s = feed(spark, tmp_path, [(1, 10, 1, "a"), (1, 11, 1, "a")], [(1, 20, 1, "a"), (2, 300, 1, "a")], [(4, 305, 1, "a")], [(2, 310, 1, "a"), (3, 5, 1, "a")])
    assert sorted(r[0] for r in run(spark, tmp_path, ops.dedup(s, "event_id", "ts"))) == [1, 2, 4]


def test_k_anonymity_suppresses_after_max_delay(spark, tmp_path):
    """Class a has three units within an hour; b has them only over a longer time, until 600; c never."""
    rows = ([(1, 0, 1, "a"), (2, 0, 1, "b"), (3, 0, 1, "c")], [(4, 30, 2, "a"), (5, 200, 2, "b")], [(6, 40, 3, "a"), (7, 600, 3, "b"), (8, 601, 4, "b"), (9, 602, 5, "b")], [(10, 900, 1, "a"), (11, 900, 1, "b")], [(12, 2000, 9, "z")])
    got = run(spark, tmp_path, ops.stream_k_anonymize(feed(spark, tmp_path, *rows), ["g"], "u", 3, "ts", "1 hour"), True)
    assert sorted(r[0] for r in got) == [1, 4, 6, 7, 8, 9, 10, 11]


def test_continual_counts_are_released_once(spark, tmp_path):
    """Steps of an hour: each once, as the watermark passes; no release covers a step that another one released already; late rows are not counted."""
    rows = ([(1, 10, 1, "a"), (2, 70, 1, "a")], [(3, 200, 1, "a")], [(7, 205, 1, "a")], [(4, 15, 1, "a"), (5, 210, 1, "a")], [(6, 900, 1, "a")])
    still = lambda key, level, index: 0.5 + 1e-9
    got = run(spark, tmp_path, ops.continual_count(feed(spark, tmp_path, *rows), "g", "ts", "2024-01-01", "1 hour", 24, 1.0, noise=still), True)
    assert [(s, round(n)) for _, s, n in sorted(got)] == [(0, 1), (1, 2), (2, 2), (3, 5)] + [(s, 5) for s in range(4, 14)]


def test_steps_outside_the_horizon_are_a_side_output(spark, tmp_path):
    """Null and outside times stop nothing: they are left out of the counts and come out by their reason."""
    rows = ([(1, 10, 1, "a"), (2, -5, 1, "a")], [(3, 70, 1, "a"), (4, 5000, 1, "a")], [(5, 6000, 1, "a")])
    s = feed(spark, tmp_path, *rows).withColumn("ts", F.when(F.col("event_id") != 5, F.col("ts")))
    still = lambda key, level, index: 0.5 + 1e-9
    got = run(spark, tmp_path, ops.continual_count(s, "g", "ts", "2024-01-01", "1 hour", 3, 1.0, noise=still), True)
    assert [(s, round(n)) for _, s, n in sorted(got)] == [(0, 1), (1, 2), (2, 2)]
    bad = ops.outside(s, "ts", "2024-01-01", "1 hour", 3).select("event_id", "reason")
    io.release_stream(bad, str(tmp_path / "bad"), str(tmp_path / "bad-state"))
    assert sorted((r["event_id"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [(2, "early"), (4, "late"), (5, "null")]


def test_continual_counts_see_a_row_for_each_step(spark, tmp_path, capfd):
    """The Python state gets counts, not events: the windowed aggregate comes before it in one query."""
    rows = ([(i, 10 + i % 40, 1, "a") for i in range(200)], [(900, 500, 1, "a")], [(901, 600, 1, "a")])
    df = ops.continual_count(feed(spark, tmp_path, *rows), "g", "ts", "2024-01-01", "1 hour", 24, 1.0)
    q = io.release_stream(df, str(tmp_path / "out"), str(tmp_path / "state"), rocksdb=True)
    names = [[s["operatorName"] for s in p["stateOperators"]] for p in q.recentProgress if p["stateOperators"]]
    assert names and all(n[0].startswith("transformWithState") and n[1] == "stateStoreSave" for n in names)
    q.explain(True)
    assert capfd.readouterr() is not None


def test_held_rows_are_appended(spark, tmp_path):
    """Rows of several batches, with nulls, come out once their class opens, as they went in."""
    rows = ([(1, 0, 1, "a"), (None, 1, None, "a")], [(2, 2, 2, "a")], [(3, 3, 3, "a"), (4, 3, 1, None)], [(5, 900, 9, "a")])
    got = run(spark, tmp_path, ops.stream_k_anonymize(feed(spark, tmp_path, *rows), ["g"], "u", 3, "ts", "1 hour"), True)
    assert sorted((r[0] is None, r[0] or 0, r[2]) for r in got) == [(False, 1, 1), (False, 2, 2), (False, 3, 3), (False, 5, 9), (True, 0, None)]


def test_update_mode_corrects_and_repeats_nothing(spark, tmp_path):
    """A late row, within the watermark, corrects a window that was written before; retried batches change nothing."""
    rows = ([(1, 10, 1, "a"), (2, 70, 1, "a")], [(3, 75, 1, "a")], [(4, 15, 2, "a"), (5, 130, 2, None)], [(6, 80, 1, "a")])
    counts = ops.windowed_counts(feed(spark, tmp_path, *rows), "ts", "1 hour", watermark="1 day", by=("g",))
    keys = ["window_start", "window_end", "g"]

    def state(upto=None):
        rows = io.latest(spark, str(tmp_path / "out"), counts.schema, keys)
        return minutes([tuple(r) for r in rows.collect()])

    io.release_stream(counts, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    want = [(0, "a", 2), (60, "a", 3), (120, None, 1)]
    assert sorted(state(), key=lambda r: r[0]) == want
    first = spark.read.parquet(str(tmp_path / "out" / "batch=0")).where("n = 1").count()
    assert first == 2  # the earlier result that was corrected
    import shutil

    shutil.rmtree(tmp_path / "state")
    io.release_stream(counts, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    assert sorted(state(), key=lambda r: r[0]) == want


def test_a_retried_batch_repeats_no_row(spark, tmp_path):
    s = feed(spark, tmp_path, *LATE)
    assert len(run(spark, tmp_path, s)) == 7
    import shutil

    shutil.rmtree(tmp_path / "state")  # all batches are tried again
    assert len(run(spark, tmp_path, s)) == 7
