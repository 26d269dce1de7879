"""Streams give what the batch gives on the same files."""

from pyspark.sql import functions as F

from saunter.operators import paths as P
from saunter.operators import stats as S
from saunter.sources import trials
from saunter.sources.schema import schema
from saunter.streaming import live
from tests.test_operators import walk
from tests.test_sources import ROW1, SURFACE


def test_summary_as_files_land(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("\n".join([SURFACE, *(ROW1.replace("123.45", f"{100 + 7 * k + j}.00") for j in range(4))]) + "\n")
    stream = live.trial_stream(spark, str(tmp_path), files_per_trigger=1)
    got = live.run_available(live.live_summary(stream, ["mu", "surface"]), "t_live", "complete", str(tmp_path / "_ck")).collect()
    want = S.cond_summary(trials.read_trials(spark, f"{tmp_path}/*.csv"), ["mu", "surface"]).collect()
    assert len(got) == len(want) == 1 and all(abs(got[0][c] - want[0][c]) < 1e-9 for c in ("n", "mean", "std", "sem"))


def test_passage_with_late_steps(spark, tmp_path):
    steps = walk(spark, 120, 5)
    half = F.col("step") % 2
    for k in (1, 0):  # the odd steps land after the even ones
        steps.where(half == (1 - k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    centre, radius, side = (8.0, 8.0, 8.0), 6.0, 32.0
    out = live.first_passage_stream(stream, centre, radius, side, 3, 0.2, timeout_ms=None)
    got = live.run_available(out, "t_passage", "append", str(tmp_path / "ck")).collect()
    hits = P.hits_of_ball(P.wrapped_position(steps, side, ["trial_id", "walker_id"]), centre, radius, side)
    want = P.first_passage(hits, 3, 0.2, ["trial_id", "walker_id"]).collect()
    key = lambda r: (r["trial_id"], r["walker_id"], r["step"], r["touch_no"], round(r["time"], 6))
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_appended_trials(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"{SURFACE}\n{ROW1}\n")
    for _ in range(2):
        live.append_trials(live.trial_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.schema(schema("surface")).parquet(str(tmp_path / "out")).count() == 1


def test_passage_query_keeps_its_rows_in_files(spark):
    from saunter.plans.queries import QUERIES

    found = QUERIES["live_passage"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and found.inputFiles() and all("live_passage-" in f for f in found.inputFiles())


def _walk_files(spark, steps, folder, cuts):
    for a, b in cuts:
        steps.where(f"step > {a} and step <= {b}").coalesce(1).write.mode("append").parquet(folder)


def test_state_of_finished_walkers_goes(spark, tmp_path):
    """Of finished walkers a mark is left, no step waits, and a finished walker that sends all steps again isn't found twice."""
    steps, folder = walk(spark, 60, 5), str(tmp_path / "in")
    _walk_files(spark, steps, folder, [(20, 60), (0, 20), (0, 60)])
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = live.drain_to_parquet(live.first_passage_stream(stream, (8.0, 8.0, 8.0), 20.0, 32.0, 1, 0.0, timeout_ms=None), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert found.count() == found.select("walker_id").distinct().count() == 5
    left = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", name).load().count()
    assert left("at") == 0 and left("ended") == 5


def test_walker_that_times_out_does_not_begin_again(spark, tmp_path):
    import time

    steps, folder = walk(spark, 40, 1), str(tmp_path / "in")
    _walk_files(spark, steps, folder, [(1, 5)])
    stream = spark.readStream.schema(steps.schema).parquet(folder)
    with live.state_store(spark):
        q = live.first_passage_stream(stream, (5.0, 5.0, 5.0), 30.0, 32.0, 1, 1.0, timeout_ms=1500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    read = lambda: sum(p["numInputRows"] for p in q.recentProgress)
    left = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", name).load().count()

    def wait(until) -> bool:
        end = time.time() + 40
        while not (done := until()) and time.time() < end:
            time.sleep(0.5)
        return done

    try:
        assert wait(lambda: read() == 4) and wait(lambda: left("at") == 0) and left("ended") == 1
        _walk_files(spark, steps, folder, [(0, 40)])  # any first step would be a touch
        assert wait(lambda: read() == 44)
    finally:
        q.stop()
    assert spark.read.schema(live.PASSAGE).parquet(str(tmp_path / "out")).count() == 0


def test_file_that_comes_twice_counts_once(spark, tmp_path):
    folder, path, ck = (str(tmp_path / x) for x in ("in", "table", "ck"))
    (tmp_path / "in").mkdir()
    text = lambda k: "\n".join([SURFACE, *(ROW1.replace("123.45", f"{100 + k + j}.00") for j in range(3)), ROW1, ROW1]) + "\n"
    (tmp_path / "in" / "a.csv").write_text(text(0))
    live.append_files(spark, folder, path, ck).awaitTermination()
    (tmp_path / "in" / "again.csv").write_text(text(0))
    (tmp_path / "in" / "b.csv").write_text(text(7))
    live.append_files(spark, folder, path, ck).awaitTermination()
    got = spark.read.parquet(path)
    assert got.count() == 10 and got.select(live.FILE).distinct().count() == 2
    live.append_files(spark, folder, path, ck + "-lost").awaitTermination()  # all batches once more
    assert spark.read.parquet(path).count() == 10
    want = trials.read_trials(spark, f"{folder}/a.csv", f"{folder}/b.csv")
    same = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))
    assert same(spark.read.parquet(path)) == same(want)
    live.compact(spark, path, str(tmp_path / "less"))
    assert same(spark.read.parquet(str(tmp_path / "less"))) == same(want)


def test_content_that_is_there_is_not_written_again(spark, tmp_path):
    """All batches once more: the files of the table stay the ones that were there, and a new content beside them is added."""
    folder, path, ck = (str(tmp_path / x) for x in ("in", "table", "ck"))
    (tmp_path / "in").mkdir()
    text = lambda k: "\n".join([SURFACE, *(ROW1.replace("123.45", f"{100 + k + j}.00") for j in range(3))]) + "\n"
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(text(10 * k))
    live.append_files(spark, folder, path, ck, files_per_trigger=2).awaitTermination()
    before = sorted(spark.read.parquet(path).inputFiles())
    assert len(before) == 3
    live.append_files(spark, folder, path, ck + "-lost").awaitTermination()
    assert sorted(spark.read.parquet(path).inputFiles()) == before
    (tmp_path / "in" / "3.csv").write_text(text(30))
    live.append_files(spark, folder, path, ck + "-lost").awaitTermination()
    after = sorted(spark.read.parquet(path).inputFiles())
    assert len(after) == 4 and set(before) < set(after) and spark.read.parquet(path).count() == 12
