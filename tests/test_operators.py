"""Ratios, summaries, levels and trajectories: properties and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from saunter.operators import levels as L
from saunter.operators import normalize as N
from saunter.operators import paths as P
from saunter.operators import stats as S
from saunter.plans import series as J

COLS = "mu double, surface double, TargetShape string, n_walkers int, detection_time double"
ROWS = [(1.0, 120.0, "Ball", 1, 10.0), (1.0, 120.0, "Ball", 1, 30.0), (2.0, 120.0, "Ball", 1, 40.0), (1.0, 120.0, "Line", 1, 5.0), (2.0, 60.0, "Line", 1, float("nan")), (None, 60.0, "Line", 1, 1.0)]


@pytest.fixture
def trials(spark):
    return spark.createDataFrame(ROWS, COLS)


def test_means_skip_nan_and_null_keys(trials):
    got = {(r["mu"], r["surface"], r["TargetShape"]): r["detection_time"] for r in S.cond_mean(trials, S.BASE_KEYS).collect()}
    assert got == {(1.0, 120.0, "Ball"): 20.0, (2.0, 120.0, "Ball"): 40.0, (1.0, 120.0, "Line"): 5.0, (2.0, 60.0, "Line"): None}
    assert S.cond_mean(trials, ["mu"], drop_null_keys=False).count() == 3


def test_named_aggregates(trials):
    with pytest.raises(ValueError, match="mode"):
        S.cond_agg(trials, ["mu"], "mode")
    with pytest.raises(ValueError, match="missing"):
        S.cond_agg(trials, ["nothing"])
    a, b = (S.cond_median(trials, ["TargetShape"], approx=x).where("TargetShape = 'Ball'").first()["detection_time"] for x in (False, True))
    assert a == 30 and b == 30


def test_exact_medians_are_those_of_spark(spark):
    r = random.Random(4)
    rows = [(k, None if r.random() < 0.1 else r.choice([r.uniform(-5, 5), 1.0, 1e300, -1e300, float("nan"), 0.5])) for k in ["a", "b", None] for _ in range(301)]
    rows += [("one", 3.0), ("same", 2.0), ("same", 2.0), ("nothing", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    v = F.when(~F.isnan("v"), F.col("v"))
    want = {x["k"]: x["m"] for x in df.groupBy("k").agg(F.median(v).alias("m")).collect()}
    assert {x["k"]: x["m"] for x in S.grouped_median(df, ["k"], v, "m").collect()} == want
    assert S.cond_median(df, ["k"], "v", drop_null_keys=False).count() == len(want)


def test_summary_of_one_value(trials):
    row = S.cond_summary(trials.where("mu = 2 and TargetShape = 'Ball'"), ["mu"]).first()
    assert (row["n"], row["mean"], row["std"], row["sem"]) == (1, 40.0, 0.0, 0.0)


def test_ratio_at_the_baseline_is_one(trials):
    means = S.cond_mean(trials, S.BASE_KEYS)
    got = N.ratio_to_baseline(means, ["surface", "TargetShape", "n_walkers"]).collect()
    assert {(r["mu"], r["TargetShape"]): r["ratio"] for r in got} == {(1.0, "Ball"): 0.5, (2.0, "Ball"): 1.0, (2.0, "Line"): None}
    with pytest.raises(ValueError, match="baseline"):
        N.ratio_below_baseline(means, ["surface"], [1.0])


def test_category_ratios_are_inverse(spark):
    rows = [(1.0, "Ball_no_boundary", 10.0, 6.0), (1.0, "Line", 10.0, 3.0), (1.0, "Line", 20.0, 5.0)]
    df = spark.createDataFrame(rows, "mu double, TargetShape string, surface double, detection_time double")
    ab, ba = N.ratio_between(df, "Ball_no_boundary", "Line", ["mu"], "surface").collect(), N.ratio_between(df, "Line", "Ball_no_boundary", ["mu"], "surface").collect()
    assert len(ab) == len(ba) == 1 and ab[0]["ratio"] * ba[0]["ratio"] == 1 and ab[0]["surface"] == 12


def test_errors_of_zero_baselines(spark):
    rows = [("a", 1.0, 2, 4.0, 1.0, 1.0), ("a", 2.0, 2, 0.0, 1.0, 1.0), ("b", 1.0, 2, 4.0, 1.0, 1.0), ("b", 2.0, 2, 2.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, mu double, n long, mean double, std double, sem double")
    zero = {(r["k"], r["mu"]): (r["ratio"], r["ratio_err"]) for r in N.ratio_with_error(df, ["k"]).collect()}
    assert zero[("a", 1.0)] == (None, 0.0) and zero[("b", 2.0)] == (1.0, pytest.approx(2**0.5 / 2))
    assert {r["k"] for r in N.ratio_with_error(df, ["k"], on_bad="skip").collect()} == {"b"}
    with pytest.raises(ValueError):
        N.ratio_with_error(df, ["k"], on_bad="x")


def test_nearest_level_prefers_the_smaller(spark):
    df = spark.createDataFrame([("a", 1.9, 1.0), ("a", 2.1, 2.0)], "k string, mu double, mean double")
    assert N.nearest_baseline(df, ["k"]).first()["base_level"] in (1.9, 2.1)
    df = spark.createDataFrame([("a", 1.5, 1.0), ("a", 2.5, 2.0)], "k string, mu double, mean double")
    assert N.nearest_baseline(df, ["k"]).first()["base_level"] == 1.5


def test_slices(spark, trials):
    assert S.slice_eq(trials, {"mu": 1.0, "surface": None}).count() == 3
    assert S.slice_in(trials, "surface", None).count() == 6 and S.slice_in(trials, "surface", range(200)).count() == 6
    assert S.slice_in(trials, "surface", [float(x) for x in range(61, 5000)]).count() == 4
    assert S.large_surfaces(trials).count() == 4 and S.large_surfaces(trials, [60.0]).count() == 2
    assert S.group_keys({"n_volume": 1, "mu": 2, "x": None}) == [*S.BASE_KEYS, "n_volume"]
    empty = trials.where("mu > 9")
    assert S.checked(empty).columns == trials.columns
    with pytest.raises(ValueError):
        S.checked(empty, strict=True)


def test_levels_and_facets(spark, trials):
    assert [r[0] for r in S.levels(trials, "surface").collect()] == [60.0, 120.0]
    assert [r[0] for r in N.common_levels(trials, trials.where("mu = 1"), "surface").collect()] == [120.0]
    assert [r[0] for r in N.all_levels("surface", trials, trials).collect()] == [60.0, 120.0]
    assert {(r["surface"], r["facet_no"]) for r in L.facet_series(trials, "surface", 1).collect()} == {(60.0, 0)}
    grid = L.facet_grid(trials, "surface", [120.0, 7.0, 60.0], 2).select("surface", "grid_row", "grid_col", "mu").collect()
    assert {(r["surface"], r["grid_row"], r["grid_col"]) for r in grid} == {(120.0, 0, 0), (7.0, 0, 1), (60.0, 1, 0)} and any(r["surface"] == 7 and r["mu"] is None for r in grid)
    assert {(r["TargetShape"], r["style"]) for r in L.style_index(trials, "TargetShape", 1).collect()} == {("Ball", 0), ("Line", 0)}
    assert L.first_rows(trials, 1, F.desc("detection_time")).count() == 1
    assert S.axis_range(trials.where("mu = 1"), "detection_time").first().asDict() == {"axis_min": 3.75, "axis_max": 31.25}


def test_series_of_nothing(trials):
    assert J.ratio_vs_mu(trials, 9).count() == 0 and J.time_vs_mu(trials, 9).columns == ["facet", "series", "x", "y"]
    with pytest.raises(ValueError, match="missing"):
        J.time_vs_delta(trials, [2.0], [50])
    with pytest.raises(ValueError, match="missing"):
        J.ball_ratio_vs_size(trials, 1, 1, 0, 1, [1.0])


STEP = "trial_id long, walker_id long, step int, l double, theta double, phi double, x0 double, y0 double, z0 double, u double"


def walk(spark, n=500, walkers=3):
    return spark.range(n * walkers).select((F.col("id") % walkers % 2).alias("trial_id"), (F.col("id") % walkers).alias("walker_id"), (F.floor(F.col("id") / walkers) + 1).cast("int").alias("step"),
                                           ((F.col("id") * 7919 % 97) / 10.0).alias("l"), (F.col("id") * 31 % 628 / 100.0).alias("theta"), (F.col("id") * 17 % 314 / 100.0).alias("phi"),
                                           *(F.lit(5.0).alias(c) for c in ("x0", "y0", "z0")), (F.col("id") * 13 % 100 / 100.0).alias("u"))


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_chunked_prefix_sum(spark, chunk):
    steps = walk(spark)
    both = P.prefix_sum(P.path_length(steps), ["walker_id"], "step", "l", chunk).select(F.max(F.abs(F.col("running") - F.col("time")))).first()[0]
    assert both < 1e-8


def test_positions_in_chunks(spark):
    steps = walk(spark)
    one, many = (P.wrapped_position(steps, 16.0, chunk=c).select("walker_id", "step", *(F.col(a).alias(a + str(c)) for a in ("time", "x", "y", "z"))) for c in (1000, 9))
    both = one.join(many, ["walker_id", "step"])
    far = F.greatest(*(F.least(F.abs(F.col(f"{a}1000") - F.col(f"{a}9")), 16 - F.abs(F.col(f"{a}1000") - F.col(f"{a}9"))) for a in "xyz"), F.abs(F.col("time1000") - F.col("time9")))
    assert both.count() == 1500 and both.select(F.max(far)).first()[0] < 1e-8


def test_passage_rules(spark):
    rows = [(1, 1, s, float(s), u) for s, u in ((1, 0.9), (2, 0.1), (3, 0.9))] + [(1, 2, 5, 0.5, 0.9)]
    hits = spark.createDataFrame(rows, "trial_id long, walker_id long, step int, time double, u double")
    end = lambda m, p: {r["walker_id"]: (r["step"], r["touch_no"]) for r in P.first_passage(hits, m, p).collect()}
    assert end(1, 0.0) == {1: (1, 1), 2: (5, 1)} == end(0, 0.0)
    assert end(3, 0.5) == {1: (2, 2)} and end(3, 0.0) == {1: (3, 3)} and end(9, 0.0) == {}
    first = P.first_passage(hits, 1, 0.0, ["trial_id", "walker_id"])
    assert P.earliest_walker(first).first()["walker_id"] == 2
    walkers = spark.createDataFrame([(1, 1, 3.0), (1, 2, 0.5), (1, 3, 0.4), (2, 4, 9.0)], "trial_id long, walker_id long, time double")
    assert {r["trial_id"]: r["complete"] for r in P.trial_complete(walkers, first).collect()} == {1: False, 2: False}
    got = {r["walker_id"]: (r["first_touch_steps"], r["second_touch_steps"]) for r in P.touch_steps(walkers, hits).collect()}
    assert got == {1: (1, 2), 2: (5, -1), 3: (-1, -1), 4: (-1, -1)}


HEAVY = {
    "outlier": lambda r, k: 1e15 if k == 7 else r.uniform(0, 1000),
    "power": lambda r, k: r.paretovariate(0.05),
    "ties": lambda r, k: r.choice([1.0, 2.0, 2.0, r.uniform(0, 3)]),
    "one value": lambda r, k: 5.0,
    "two values": lambda r, k: float(k % 2),
}


@pytest.mark.parametrize("n", [20_000, 20_001])
def test_medians_of_large_groups(spark, monkeypatch, n):
    """Heavy tails, ties and nulls, narrowed several times, against sorting; small groups beside large ones."""
    import statistics

    from saunter.operators import medians

    monkeypatch.setattr(medians, "SMALL", 40)
    r = random.Random(n)
    rows = [(name, f(r, k)) for name, f in HEAVY.items() for k in range(n)]
    rows += [(None, v) for _, v in rows[:n]] + [("small", 1.0), ("small", 4.0), ("nothing", None)] + [("outlier", None)] * 50
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    want = {k: statistics.median([v for x, v in rows if x == k and v is not None] or [0]) for k in {x for x, _ in rows}} | {"nothing": None}
    assert {x["k"]: x["m"] for x in S.grouped_median(df, ["k"], F.col("v"), "m").collect()} == want
    assert S.grouped_median(df.where("k = 'power'"), [], F.col("v"), "m").first()["m"] == want["power"]
    # One step leaves under a hundredth of a group's rows, but for rows of one value.
    monkeypatch.setattr(medians, "SMALL", n // 100)
    sizes = df.groupBy("k").agg(F.count("v").alias("_n")).where(f"_n > {n // 100}")
    state = {x["k"]: x for x in medians.narrowed(df.select("k", F.col("v").alias("_v")), ["k"], sizes).collect()}
    assert all(state[k]["_inner"] < n / 100 for k in HEAVY) and all(state[k]["_held"] < n / 100 for k in ("outlier", "power"))


def test_outlier_of_a_million(spark):
    """The middle of a million values and one far away is small after one step."""
    from saunter.operators import medians

    rows = spark.range(1_000_001).select(F.lit("a").alias("k"), F.when(F.col("id") == 5, 1e15).otherwise(F.col("id") * 7919 % 1000003 / 10.0).alias("_v"))
    state = medians.narrowed(rows, ["k"], rows.groupBy("k").agg(F.count("_v").alias("_n"))).collect()
    assert len(state) == 1 and state[0]["_held"] < 10_000
    assert S.grouped_median(rows, ["k"], F.col("_v"), "m").first()["m"] == rows.select(F.median("_v")).first()[0]


@pytest.mark.parametrize("chunk", [1, 4, 10**6])
def test_touches_in_chunks(spark, chunk):
    """A walker with most steps, ties told apart by the target, and numbers that a window over the whole walker gives."""
    from pyspark.sql import Window

    hits = spark.range(400).select(F.when(F.col("id") % 4 < 3, 1).otherwise(F.col("id")).alias("walker_id"), (F.col("id") * 7 % 100).cast("int").alias("step"), F.col("id").alias("target_no"), F.lit(1.0).alias("time"), F.lit(0.9).alias("u"))
    want = hits.withColumn("n", F.row_number().over(Window.partitionBy("walker_id").orderBy("step", "target_no")))
    got = P.touches(hits, order=("step", "target_no"), chunk=chunk)
    assert got.schema["touch_no"].dataType.simpleString() == "int"
    assert sorted(got.select("walker_id", "target_no", "touch_no").collect()) == sorted(want.select("walker_id", "target_no", "n").collect())
    end = P.first_passage(hits, 30, 0.0, order=("step", "target_no"), carry=("target_no",), chunk=chunk).collect()
    assert [(r["walker_id"], r["touch_no"], r["target_no"]) for r in end] == [(1, 30, want.where("walker_id = 1 and n = 30").first()["target_no"])]
