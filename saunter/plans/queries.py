"""The queries over the given tables, and the same results in SQL.

`lineitem` plays the trial table, `events` the steps and the points, `part` the targets;
the views are SQL that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saunter.functions import exprs as X
from saunter.operators import grid as G
from saunter.operators import levels as L
from saunter.operators import normalize as N
from saunter.operators import paths as P
from saunter.operators import space
from saunter.operators import stats as S
from saunter.plans import series as J
from saunter.sources.folders import shared_dir
from saunter.sources.trials import trial_text, union_trials

STEP = "CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT)"
VIEWS = {
    "trials": ("lineitem", """
        SELECT l_orderkey, 1 AS n_walkers, CAST(134217728 AS DOUBLE) AS n_volume, ROUND(1 + 20 * l_discount, 1) AS mu, 256 AS lmax,
               CAST(60 * l_linenumber AS DOUBLE) AS surface, CAST(2 * l_linenumber AS DOUBLE) AS D,
               CASE l_returnflag WHEN 'A' THEN 'Ball_no_boundary' WHEN 'N' THEN 'Line' ELSE 'Disk' END AS TargetShape,
               1 AS n_targets, CAST(0 AS DOUBLE) AS fixed_target_dist, l_extendedprice AS detection_time,
               CAST(CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.5 END AS DOUBLE) AS probability, ROUND(10 * l_tax, 1) AS delta,
               1 AS surface_selector, 0 AS delta_selector, CAST(l_quantity AS INT) AS first_touch_steps, -1 AS second_touch_steps
        FROM {lineitem}"""),
    "steps": ("events", f"""
        SELECT user_id % 10 AS trial_id, user_id AS walker_id, {STEP} AS step,
               value / 10 AS l, 2 * PI() * (event_id % 360) / CAST(360 AS DOUBLE) AS theta, PI() * ((event_id * 7) % 180) / CAST(180 AS DOUBLE) AS phi,
               CAST((user_id * 37) % 128 AS DOUBLE) AS x0, CAST((user_id * 53) % 128 AS DOUBLE) AS y0, CAST((user_id * 71) % 128 AS DOUBLE) AS z0,
               ((event_id * 7919) % 10007) / CAST(10007 AS DOUBLE) AS u
        FROM {{events}}"""),
    "points": ("events", """
        SELECT event_id, 37 * value - 512 * FLOOR(37 * value / 512) AS x,
               (101 * value + user_id) - 512 * FLOOR((101 * value + user_id) / 512) AS y, CAST(event_id * 137 % 5120 AS DOUBLE) / 10 AS z
        FROM {events}"""),
    "targets": ("part", """
        SELECT p_partkey AS target_id, 1.7E0 * p_retailprice - 512 * FLOOR(1.7E0 * p_retailprice / 512) AS x, CAST(93 * p_size % 5120 AS DOUBLE) / 10 AS y,
               CAST(111 * p_partkey % 5120 AS DOUBLE) / 10 AS z, CAST(20 + p_size AS DOUBLE) AS D,
               CASE p_partkey % 6 WHEN 0 THEN 'Ball' WHEN 1 THEN 'Line' WHEN 2 THEN 'Disk' WHEN 3 THEN 'Square'
                    WHEN 4 THEN 'Ball_boundary' ELSE 'Ball_no_boundary' END AS TargetShape, 0.5E0 AS delta
        FROM {part}"""),
    "other_targets": ("part", """
        SELECT p_partkey AS target_id, 1.7E0 * p_retailprice - 512 * FLOOR(1.7E0 * p_retailprice / 512) AS x, CAST(93 * p_size % 5120 AS DOUBLE) / 10 AS y,
               CAST(111 * p_partkey % 5120 AS DOUBLE) / 10 AS z, CAST(CASE WHEN p_partkey % 4 < 2 THEN p_size ELSE 400 * p_size END AS DOUBLE) AS D,
               CASE p_partkey % 4 WHEN 0 THEN '3Line' WHEN 1 THEN '3Line_convex_hull' WHEN 2 THEN '2D_rectangle' ELSE 'prism_with_elongation' END AS TargetShape, 0.5E0 AS delta
        FROM {part}"""),
    "mixed_targets": ("part", """
        SELECT p_partkey AS target_id, 1.7E0 * p_retailprice - 512 * FLOOR(1.7E0 * p_retailprice / 512) AS x, CAST(CASE WHEN p_partkey % 11 > 0 THEN 93 * p_size % 5120 END AS DOUBLE) / 10 AS y,
               CAST(111 * p_partkey % 5120 AS DOUBLE) / 10 AS z, CAST(CASE WHEN p_partkey % 13 > 0 THEN 20 + p_size END AS DOUBLE) AS D,
               CASE p_partkey % 5 WHEN 0 THEN 'Ball' WHEN 1 THEN '2D_rectangle' WHEN 2 THEN p_brand WHEN 3 THEN 'prism_with_elongation' END AS TargetShape,
               CAST(CASE WHEN p_partkey % 7 > 0 THEN 0.5 END AS DOUBLE) AS delta
        FROM {part}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if STEP in sql:  # the same numbers, made a walker's day at a time
        rows = P.ordinals(rows, ["user_id"], ["ts", "event_id"], "_step", of=F.unix_date(F.to_date("ts")))
        sql = sql.replace(STEP, "_step")
    return spark.sql(sql, **{table: rows})


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1].format(**{VIEWS[n][0]: VIEWS[n][0]})})" for n in names)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ("trials",)):
    """Registers a function of (view...) as a query; ``sql`` follows the views' WITH clause."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLES[name] = f"{_with(*views)}{',' if sql.lstrip().startswith('AND_WITH') else ''} {sql.lstrip().removeprefix('AND_WITH')}"
        return f
    return add


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Floating columns rounded, so that the order of sums doesn't show."""
    return df.select(*(F.round(c, other.get(c, places)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


MEANS = "AND_WITH m AS (SELECT mu, surface, TargetShape, n_walkers, AVG(detection_time) AS t FROM trials WHERE n_walkers = 1 AND surface > 100 GROUP BY ALL)"


@query("slice_mean", "SELECT mu, surface, TargetShape, n_walkers, probability, ROUND(AVG(detection_time), 4) AS detection_time FROM trials WHERE probability = 0.5 AND surface > 100 GROUP BY ALL")
def slice_mean(trials):
    fixed = {"probability": 0.5, "n_targets": None}
    return rounded(S.cond_mean(S.large_surfaces(S.slice_eq(trials, fixed)), S.group_keys(fixed)), 4)


@query("slice_median", "SELECT mu, TargetShape, surface, MEDIAN(detection_time) AS detection_time FROM trials WHERE surface IN (120, 240, 360) GROUP BY ALL")
def slice_median(trials):
    return S.cond_median(S.slice_in(trials, "surface", [120, 240, 360]), ["mu", "TargetShape", "surface"])


@query("cond_summary", """SELECT delta, mu, COUNT(*) AS n, ROUND(AVG(detection_time), 4) AS mean,
       ROUND(CASE WHEN COUNT(*) = 1 THEN 0 ELSE STDDEV_SAMP(detection_time) END, 4) AS std,
       ROUND(CASE WHEN COUNT(*) = 1 THEN 0 ELSE STDDEV_SAMP(detection_time) END / SQRT(COUNT(*)), 4) AS sem FROM trials GROUP BY delta, mu""")
def cond_summary(trials):
    return rounded(S.cond_summary(trials, ["delta", "mu"]), 4)


@query("ratio_to_baseline", MEANS + " SELECT m.surface, m.TargetShape, m.n_walkers, m.mu, ROUND(m.t, 4) AS detection_time, ROUND(m.t / b.t, 6) AS ratio FROM m JOIN m b ON b.mu = 2 AND m.surface = b.surface AND m.TargetShape = b.TargetShape AND m.n_walkers = b.n_walkers")
def ratio_to_baseline(trials):
    means = S.cond_mean(S.large_surfaces(S.slice_eq(trials, {"n_walkers": 1})), S.BASE_KEYS)
    return rounded(N.ratio_to_baseline(means, ["surface", "TargetShape", "n_walkers"]), 6, detection_time=4)


@query("ratio_below_baseline", MEANS + " SELECT m.surface, m.TargetShape, m.n_walkers, m.mu, ROUND(m.t, 4) AS detection_time, ROUND(m.t / b.t, 6) AS ratio FROM m JOIN m b ON b.mu = 2 AND m.surface = b.surface AND m.TargetShape = b.TargetShape AND m.n_walkers = b.n_walkers WHERE m.mu IN (1.0, 1.4, 1.8)")
def ratio_below_baseline(trials):
    means = S.cond_mean(S.large_surfaces(S.slice_eq(trials, {"n_walkers": 1})), S.BASE_KEYS)
    return rounded(N.ratio_below_baseline(means, ["surface", "TargetShape", "n_walkers"], [1.0, 1.4, 1.8, 2.0]), 6, detection_time=4)


SUMMARY = """AND_WITH s AS (SELECT delta, mu, COUNT(*) AS n, AVG(detection_time) AS mean, CASE WHEN COUNT(*) = 1 THEN 0 ELSE STDDEV_SAMP(detection_time) END AS std FROM trials GROUP BY delta, mu),
    e AS (SELECT *, std / SQRT(n) AS sem FROM s),
    b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY delta ORDER BY ABS(mu - 2.05), mu) AS nth FROM e)"""


@query("nearest_baseline", SUMMARY + " SELECT delta, mu AS base_level, ROUND(mean, 4) AS base_value FROM b WHERE nth = 1")
def nearest_baseline(trials):
    return rounded(N.nearest_baseline(S.cond_summary(trials, ["delta", "mu"]), ["delta"], target=2.05), 4)


@query("ratio_with_error", SUMMARY + """ SELECT e.delta, e.mu, e.n, ROUND(e.mean, 4) AS mean, ROUND(e.std, 4) AS std, ROUND(e.sem, 4) AS sem, ROUND(e.mean / b.mean, 6) AS ratio,
    ROUND(COALESCE(e.mean / b.mean * SQRT(POW(e.sem / e.mean, 2) + POW(b.sem / b.mean, 2)), 0), 6) AS ratio_err FROM e JOIN b ON e.delta = b.delta AND b.nth = 1""")
def ratio_with_error(trials):
    return rounded(N.ratio_with_error(S.cond_summary(trials, ["delta", "mu"]), ["delta"], target=2.05), 6, mean=4, std=4, sem=4)


@query("validation_summary", SUMMARY.replace("2.05", "2.0") + """ SELECT e.delta, e.mu, e.n, ROUND(e.mean, 4) AS mean, ROUND(e.std, 4) AS std, ROUND(e.sem, 4) AS sem, ROUND(e.mean / b.mean, 6) AS ratio,
    ROUND(e.mean / b.mean * SQRT(POW(e.sem / e.mean, 2) + POW(b.sem / b.mean, 2)), 6) AS ratio_err FROM e JOIN b ON e.delta = b.delta AND b.nth = 1 WHERE b.mean <> 0""")
def validation_summary(trials):
    return rounded(J.validation_summary(trials, on_bad="skip"), 6, mean=4, std=4, sem=4)


@query("category_ratio_aligned", """AND_WITH g AS (SELECT mu, TargetShape, surface, MEDIAN(detection_time) AS t FROM trials GROUP BY ALL)
    SELECT a.mu, a.surface + 2 AS surface, a.t AS a_detection_time, b.t AS b_detection_time, ROUND(a.t / b.t, 6) AS ratio,
           ROUND(6 * SQRT(PI()) * ((a.surface + 2) / 2 - 2 * PI() / 3) / POW(a.surface + 2, 1.5), 6) AS theory
    FROM g a JOIN g b ON a.TargetShape = 'Ball_no_boundary' AND b.TargetShape = 'Line' AND a.mu = b.mu AND a.surface = b.surface""")
def category_ratio_aligned(trials):
    medians = S.cond_median(trials, ["mu", "TargetShape", "surface"])
    out = N.ratio_between(medians, "Ball_no_boundary", "Line", ["mu"], "surface")
    return out.withColumn("theory", F.round(X.volume_ratio("surface"), 6)).withColumn("ratio", F.round("ratio", 6))


@query("common_levels", "SELECT surface FROM trials WHERE TargetShape = 'Line' AND mu = 2 INTERSECT SELECT surface FROM trials WHERE TargetShape = 'Disk' AND mu = 1")
def common_levels(trials):
    return N.common_levels(S.slice_eq(trials, {"TargetShape": "Line", "mu": 2.0}), S.slice_eq(trials, {"TargetShape": "Disk", "mu": 1.0}), "surface")


@query("in_keys", "SELECT mu, COUNT(*) AS n, ROUND(SUM(detection_time), 2) AS total FROM trials WHERE (surface, delta) IN (SELECT surface, delta FROM trials WHERE probability = 0.5 AND delta < 0.3 AND surface <= 120) GROUP BY mu")
def in_keys(trials):
    keys = S.slice_eq(trials, {"probability": 0.5}).where("delta < 0.3 and surface <= 120").select("surface", "delta").distinct()
    return N.in_keys(trials, keys).groupBy("mu").agg(F.count("*").alias("n"), F.round(F.sum("detection_time"), 2).alias("total"))


@query("elongation_ratio_median", """AND_WITH g AS (SELECT surface, TargetShape, delta, mu, AVG(detection_time) AS t FROM trials WHERE mu IN (1.0, 1.2, 1.6, 2.0) AND surface IN (60, 180, 420) GROUP BY ALL),
    r AS (SELECT m.surface, m.mu, POW(SQRT(m.surface), m.delta) AS x, m.t / b.t AS ratio FROM g m JOIN g b ON b.mu = 2 AND m.mu < 2 AND m.surface = b.surface AND m.TargetShape = b.TargetShape AND m.delta = b.delta),
    k AS (SELECT surface, mu, x, MEDIAN(ratio) AS y FROM r GROUP BY ALL),
    f AS (SELECT * FROM (VALUES (0, 420.0), (1, 60.0), (2, 180.0), (3, 999.0)) v(facet_no, facet))
    SELECT facet_no, CAST(facet_no // 3 AS INT) AS grid_row, CAST(facet_no % 3 AS INT) AS grid_col, CAST(facet AS DOUBLE) AS facet, mu AS series, ROUND(x, 6) AS x, ROUND(y, 6) AS y FROM f LEFT JOIN k ON k.surface = f.facet""")
def elongation_ratio_median(trials):
    return rounded(J.ratio_vs_elongation(trials, [1.0, 1.2, 1.6, 2.0], [420, 60, 180, 999], group_cols=["surface", "TargetShape", "delta"]))


@query("elongation_wide_keys", """AND_WITH g AS (SELECT n_walkers, n_volume, lmax, surface, TargetShape, n_targets, fixed_target_dist, probability, surface_selector, first_touch_steps,
        second_touch_steps, delta_selector, delta, mu, MEDIAN(detection_time) AS t FROM trials WHERE mu IN (1.4, 2.0) AND surface IN (60, 120) GROUP BY ALL),
    r AS (SELECT m.surface, m.mu, POW(SQRT(m.surface), m.delta) AS x, m.t / b.t AS ratio FROM g m JOIN g b ON b.mu = 2 AND m.mu < 2 AND m.surface = b.surface AND m.TargetShape = b.TargetShape
          AND m.delta = b.delta AND m.probability = b.probability AND m.first_touch_steps = b.first_touch_steps),
    k AS (SELECT surface, mu, x, MEDIAN(ratio) AS y FROM r GROUP BY ALL), f AS (SELECT * FROM (VALUES (0, 60.0), (1, 120.0)) v(facet_no, facet))
    SELECT facet_no, 0 AS grid_row, CAST(facet_no % 3 AS INT) AS grid_col, CAST(facet AS DOUBLE) AS facet, mu AS series, ROUND(x, 6) AS x, ROUND(y, 6) AS y FROM f LEFT JOIN k ON k.surface = f.facet""")
def elongation_wide_keys(trials):
    return rounded(J.ratio_vs_elongation(trials, [1.4, 2.0], [60, 120], agg="median"))


MUS = [round(1 + 0.2 * k, 1) for k in range(11)]


@query("ratio_matrix_wide", SUMMARY.replace("2.05", "2.0") + " SELECT e.delta, " + ", ".join(f'ROUND(MAX(CASE WHEN e.mu = {m} THEN e.mean / b.mean END), 6) AS "mu_{m}"' for m in MUS) + " FROM e JOIN b ON e.delta = b.delta AND b.nth = 1 GROUP BY e.delta")
def ratio_matrix_wide(trials):
    wide = N.ratio_matrix(J.validation_summary(trials), MUS)
    return wide.select("delta", *(F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns if c != "delta"))


@query("series_time_vs_surface", """AND_WITH m AS (SELECT TargetShape, surface, AVG(detection_time) AS t FROM trials WHERE mu = 2 AND n_volume = 134217728 AND probability = 0.5 AND n_targets = 1 AND n_walkers = 1 GROUP BY ALL)
    SELECT CAST(NULL AS VARCHAR) AS facet, TargetShape AS series, surface AS x, ROUND(t, 4) AS y FROM m UNION ALL SELECT NULL, 'theory', surface, ROUND(2 * 134217728 / surface, 4) FROM (SELECT DISTINCT surface FROM m)""")
def series_time_vs_surface(trials):
    return rounded(J.time_vs_surface(trials, 2.0, 134217728.0, 0.5, 1, 1), 4)


LABEL = "CASE m.TargetShape WHEN 'Ball_no_boundary' THEN 'Ball' ELSE m.TargetShape END || ' ' || CAST(CAST(m.surface AS BIGINT) AS VARCHAR)"
BY_MU = "AND_WITH m AS (SELECT mu, surface, TargetShape, AVG(detection_time) AS t FROM trials WHERE n_walkers = 1 AND probability = 1 AND TargetShape IN ('Ball_no_boundary', 'Line') AND {} GROUP BY ALL)"


@query("series_ratio_vs_mu", BY_MU.format("surface IN (120, 300)") + f" SELECT CAST(NULL AS VARCHAR) AS facet, {LABEL} AS series, m.mu AS x, ROUND(m.t / b.t, 6) AS y FROM m JOIN m b ON b.mu = 2 AND b.surface = m.surface AND b.TargetShape = m.TargetShape")
def series_ratio_vs_mu(trials):
    return rounded(J.ratio_vs_mu(trials, 1, probability=1.0, shapes=["Ball_no_boundary", "Line"], surfaces=[120, 300]))


@query("series_time_vs_mu", BY_MU.format("surface > 100") + f" SELECT CAST(NULL AS VARCHAR) AS facet, {LABEL} AS series, m.mu AS x, ROUND(m.t, 4) AS y FROM m")
def series_time_vs_mu(trials):
    return rounded(J.time_vs_mu(trials, 1, probability=1.0, shapes=["Ball_no_boundary", "Line"]), 4)


@query("series_ball_ratio_vs_size", """AND_WITH g AS (SELECT mu, TargetShape, surface, D, MEDIAN(detection_time) AS t FROM trials WHERE n_walkers = 1 AND n_targets = 1 AND fixed_target_dist = 0 AND probability = 0.5 AND mu IN (1.0, 2.0, 3.0) GROUP BY ALL),
    r AS (SELECT a.mu, a.surface + 2 AS x, a.t / b.t AS ratio FROM g a JOIN g b ON a.TargetShape = 'Ball_no_boundary' AND b.TargetShape = 'Line' AND a.mu = b.mu AND a.surface = b.surface)
    SELECT CAST(NULL AS VARCHAR) AS facet, 'mu=' || CAST(CAST(mu AS DECIMAL(3, 1)) AS VARCHAR) AS series, x, ROUND(ratio, 6) AS y FROM r
    UNION ALL SELECT NULL, 'theory', x, ROUND(6 * SQRT(PI()) * (x / 2 - 2 * PI() / 3) / POW(x, 1.5), 6) FROM r WHERE mu = 2""")
def series_ball_ratio_vs_size(trials):
    return rounded(J.ball_ratio_vs_size(trials, 1, 1, 0.0, 0.5, [1.0, 2.0, 3.0], "Line", "surface"))


@query("series_time_vs_delta", """AND_WITH g AS (SELECT mu, delta, D, AVG(detection_time) AS t FROM trials WHERE mu IN (2.0, 2.4, 3.0) AND D IN (2, 4, 6, 8, 10, 12) GROUP BY ALL), k AS (SELECT *, DENSE_RANK() OVER (ORDER BY D) AS r FROM g)
    SELECT CAST(CAST(D AS DECIMAL(5, 1)) AS VARCHAR) AS facet, 'mu=' || CAST(CAST(mu AS DECIMAL(3, 1)) AS VARCHAR) AS series, delta AS x, ROUND(t, 4) AS y FROM k WHERE r <= 4""")
def series_time_vs_delta(trials):
    return rounded(J.time_vs_delta(trials, [2.0, 2.4, 3.0], [2, 4, 6, 8, 10, 12]), 4)


@query("axis_range", """AND_WITH g AS (SELECT mu, TargetShape, surface, MEDIAN(detection_time) AS t FROM trials GROUP BY ALL), e AS (SELECT MIN(t) AS lo, MAX(t) AS hi FROM g)
    SELECT ROUND(lo - 0.05 * (hi - lo), 4) AS axis_min, ROUND(hi + 0.05 * (hi - lo), 4) AS axis_max FROM e""")
def axis_range(trials):
    return rounded(S.axis_range(S.cond_median(trials, ["mu", "TargetShape", "surface"]), "detection_time"), 4)


@query("facet_and_style", """AND_WITH g AS (SELECT TargetShape, surface, COUNT(*) AS n FROM trials GROUP BY ALL)
    SELECT TargetShape, surface, n, facet_no, CAST(s % 2 AS INT) AS style FROM (SELECT *, CAST(DENSE_RANK() OVER (ORDER BY surface) - 1 AS INT) AS facet_no, DENSE_RANK() OVER (ORDER BY TargetShape) - 1 AS s FROM g) WHERE facet_no < 4""")
def facet_and_style(trials):
    counts = trials.groupBy("TargetShape", "surface").agg(F.count("*").alias("n"))
    return L.style_index(L.facet_series(counts, "surface"), "TargetShape", 2)


@query("key_profile", "SELECT 'TargetShape' AS key, TargetShape AS level, COUNT(*) AS n FROM trials GROUP BY TargetShape UNION ALL SELECT 'n_targets', CAST(n_targets AS VARCHAR), COUNT(*) FROM trials GROUP BY n_targets UNION ALL SELECT 'first_touch_steps', CAST(first_touch_steps AS VARCHAR), COUNT(*) FROM trials GROUP BY first_touch_steps")
def key_profile(trials):
    return S.key_profile(trials, ["TargetShape", "n_targets", "first_touch_steps"])


@query("levels_of_category", "SELECT DISTINCT surface FROM trials WHERE TargetShape = 'Disk'")
def levels_of_category(trials):
    return S.levels(trials, "surface", {"TargetShape": "Disk"})


@query("first_rows", "SELECT l_orderkey, detection_time, mu FROM trials ORDER BY detection_time DESC, l_orderkey, mu LIMIT 25")
def first_rows(trials):
    return L.first_rows(trials.select("l_orderkey", "detection_time", "mu"), 25, F.desc("detection_time"), "l_orderkey", "mu")


@query("fixed_decimal_text", """SELECT printf('%.1f', mu) AS mu, printf('%.0f', n_volume) AS n_volume, printf('%.2f', surface) AS surface, CAST(n_targets AS VARCHAR) AS n_targets, COUNT(*) AS n FROM trials GROUP BY ALL""")
def fixed_decimal_text(trials):
    return trial_text(trials, "surface").groupBy("mu", "n_volume", "surface", "n_targets").agg(F.count("*").alias("n"))


def _grid(trials: DataFrame) -> DataFrame:
    """A grid whose lists are the levels that occur, beside levels that don't."""
    return trials.groupBy("TargetShape").agg(F.sort_array(F.collect_set("mu")).alias("range_mu"), F.sort_array(F.collect_set("surface")).alias("range_diam")).select(
        F.col("TargetShape").alias("experiment"), F.array(F.col("TargetShape"), F.lit("")).alias("list_shapes"), F.col("range_mu").alias("rangemu_LevyDistrib"),
        F.concat("range_diam", F.array(F.lit(3e5))).alias("range_diam"), F.array(F.lit(512)).alias("range_side"), F.array(F.lit(1)).alias("range_ntargets"), F.array(F.lit(1)).alias("range_nwalkers"),
        F.array(F.lit(0.5), F.lit(1.0)).alias("range_probability"), F.array(F.lit(0.5)).alias("range_delta"), F.lit(256.0).alias("l_max"), F.lit(1).alias("surface_selector"), F.lit(0).alias("delta_selector"), F.lit(30).alias("num_runs"))


D_SQL = """CASE WHEN shape = 'Ball_no_boundary' THEN SQRT(surface / PI()) WHEN shape = 'Line' THEN surface / (2 * PI()) - 2 WHEN shape = 'Disk' THEN SQRT(4 * PI() * PI() + 2 * surface) - 2 * PI() ELSE -1 END"""
GRID_SQL = f"""AND_WITH ex AS (SELECT DISTINCT TargetShape AS experiment FROM trials),
    mus AS (SELECT DISTINCT TargetShape AS experiment, mu FROM trials), su AS (SELECT DISTINCT TargetShape AS experiment, surface FROM trials UNION SELECT experiment, 3e5 FROM ex),
    c0 AS (SELECT experiment, mu, shape, surface, probability FROM ex JOIN mus USING (experiment) JOIN su USING (experiment), (SELECT DISTINCT TargetShape AS s FROM trials UNION SELECT '') v(shape), (VALUES (0.5), (1.0)) p(probability) WHERE shape IN (experiment, '')),
    c AS (SELECT *, {D_SQL} AS D FROM c0)"""


@query("grid_cells", GRID_SQL + " SELECT experiment, COUNT(*) AS cells, CAST(SUM(CASE WHEN D >= 1 AND D <= 512 THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(SUM(CASE WHEN D >= 1 AND D <= 512 THEN 30 ELSE 0 END) AS BIGINT) AS expected_rows FROM c GROUP BY experiment")
def grid_cells(trials):
    return G.cell_counts(G.surface_cells(_grid(trials)))


@query("grid_expand", GRID_SQL + " SELECT experiment, mu, surface, ROUND(D, 6) AS D, run FROM c, (SELECT CAST(unnest(range(1, 31)) AS INT) AS run) WHERE D >= 1 AND D <= 512 AND probability = 0.5")
def grid_expand(trials):
    cells = G.valid_cells(G.surface_cells(_grid(trials))).where("probability = 0.5")
    return rounded(G.expand_grid(cells).select("experiment", "mu", "surface", "D", "run"))


@query("grid_coverage", GRID_SQL + """, t AS (SELECT mu, surface, TargetShape, CAST(probability AS DOUBLE) AS probability, COUNT(*) AS n FROM trials GROUP BY ALL)
    SELECT c.mu, c.surface, shape AS TargetShape, CAST(c.probability AS DOUBLE) AS probability, CAST(30 AS BIGINT) AS expected, COALESCE(n, 0) AS actual, GREATEST(30 - COALESCE(n, 0), 0) AS missing, ROUND(100.0 * COALESCE(n, 0) / 30, 6) AS pct
    FROM c LEFT JOIN t ON c.mu = t.mu AND c.surface = t.surface AND c.shape = t.TargetShape AND c.probability = t.probability WHERE D >= 1 AND D <= 512""")
def grid_coverage(trials):
    cells = G.valid_cells(G.surface_cells(_grid(trials)))
    on = ["mu", "surface", "TargetShape", "probability"]
    return rounded(G.grid_coverage(cells, trials, on).select(*on, "expected", "actual", "missing", "pct"))


@query("grid_cell_results", GRID_SQL + """, t AS (SELECT mu, surface, TargetShape, AVG(detection_time) AS m FROM trials GROUP BY ALL)
    SELECT c.mu, c.surface, shape AS TargetShape, ROUND(CASE WHEN D >= 1 AND D <= 512 THEN m END, 4) AS mean FROM c LEFT JOIN t ON c.mu = t.mu AND c.surface = t.surface AND c.shape = t.TargetShape WHERE c.probability = 0.5""")
def grid_cell_results(trials):
    cells = G.surface_cells(_grid(trials)).where("probability = 0.5")
    means = S.cond_mean(trials, ["mu", "surface", "TargetShape"], name="mean")
    return rounded(G.cell_results(cells, means, ["mu", "surface", "TargetShape"], keep_invalid=True).select("mu", "surface", "TargetShape", "mean"), 4)


def union_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    other = orders.select(F.lit("Disk").alias("TargetShape"), (F.col("o_orderkey") % 7).cast("double").alias("DiskDiameter"), F.col("o_totalprice").alias("detection_time"))
    both = union_trials(view(spark, sf_dir, "trials"), other)
    return both.groupBy("TargetShape").agg(F.count("*").alias("n"), F.count("surface").alias("with_surface"), F.count("DiskDiameter").alias("with_disk"), F.round(F.avg("detection_time"), 4).alias("mean"))


QUERIES["union_variants"] = union_variants
ORACLES["union_variants"] = _with("trials") + """ SELECT TargetShape, COUNT(*) AS n, COUNT(surface) AS with_surface, COUNT(DiskDiameter) AS with_disk, ROUND(AVG(t), 4) AS mean FROM (
        SELECT TargetShape, surface, NULL AS DiskDiameter, detection_time AS t FROM trials
        UNION ALL SELECT 'Disk', NULL, CAST(o_orderkey % 7 AS DOUBLE), o_totalprice FROM orders) GROUP BY TargetShape"""


@query("diameter_table", """SELECT target_id, TargetShape,
    ROUND(CASE WHEN TargetShape IN ('Ball', 'Ball_boundary') THEN SQRT(100 * D / PI()) - 2 WHEN TargetShape = 'Ball_no_boundary' THEN SQRT(100 * D / PI()) WHEN TargetShape = 'Line' THEN 100 * D / (2 * PI()) - 2
               WHEN TargetShape = 'Disk' THEN SQRT(4 * PI() * PI() + 200 * D) - 2 * PI() ELSE -1 END, 6) AS by_surface,
    ROUND(CASE WHEN TargetShape IN ('Ball', 'Ball_boundary', 'Disk') THEN 2 * SQRT(100 * D / PI()) - 2 WHEN TargetShape = 'Ball_no_boundary' THEN 2 * SQRT(100 * D / PI()) WHEN TargetShape = 'Line' THEN (100 * D - PI()) / 2 ELSE -1 END, 6) AS by_projection,
    ROUND(CASE WHEN D <= 0 THEN -1 WHEN TargetShape = 'Ball' THEN CBRT(6 * D / PI()) WHEN TargetShape = 'Disk' THEN SQRT(4 * D / PI()) WHEN TargetShape = 'Line' THEN D ELSE -1 END, 6) AS by_measure,
    ROUND((SQRT(100 * D / PI()) - 2) / 2 + 1, 6) AS radius FROM targets""", ("targets",))
def diameter_table(targets):
    s = F.col("D") * 100
    return rounded(targets.select("target_id", "TargetShape", X.diameter(F.lit(1), s, "TargetShape").alias("by_surface"), X.diameter(F.lit(2), s, "TargetShape").alias("by_projection"),
                                  X.diameter_from_measure("D", "TargetShape").alias("by_measure"), X.detection_radius(s).alias("radius")))


NORM = "CASE WHEN mu = 1 THEN 1 / (1 + LN(lmax)) ELSE 1 / (1 - (POW(lmax, 1 - mu) - 1) / (mu - 1)) END"


@query("step_law_table", f"""AND_WITH g AS (SELECT mu, lmax, AVG(delta) AS d, {NORM} AS a FROM trials GROUP BY mu, lmax)
    SELECT mu, ROUND(a, 8) AS norm, ROUND(CASE WHEN mu = 2 THEN a / 2 + a * LN(lmax) ELSE a / 2 + a / (2 - mu) * (POW(lmax, 2 - mu) - 1) END, 8) AS mean,
           ROUND(CASE WHEN mu = 1 THEN EXP((1 - a) / a * 0.5) ELSE POW((1 - a) / a * (1 - mu) * 0.5 + 1, 1 / (1 - mu)) END, 8) AS median_tail, CAST(ROUND((mu - 1) / 0.2) AS INT) AS mu_index FROM g""")
def step_law_table(trials):
    g = trials.select("mu", "lmax").distinct()
    return g.select("mu", F.round(X.step_law_norm("mu", "lmax"), 8).alias("norm"), F.round(X.step_law_mean("mu", "lmax"), 8).alias("mean"),
                    F.round(X.step_law_quantile(F.lit(0.95), F.lit(0.5), "mu", "lmax"), 8).alias("median_tail"), X.mu_index("mu").alias("mu_index"))


@query("moment_check", f"""AND_WITH q AS (SELECT mu, lmax, {NORM} AS a, (first_touch_steps * 7919 % 10007) / CAST(10007 AS DOUBLE) AS toss, (l_orderkey * 104729 % 10007) / CAST(10007 AS DOUBLE) AS u FROM trials),
    d AS (SELECT mu, lmax, a, CASE WHEN toss <= a THEN u WHEN mu = 1 THEN EXP((1 - a) / a * u) ELSE POW(GREATEST((1 - a) / a * (1 - mu) * u + 1, 0), 1 / (1 - mu)) END AS l FROM q),
    e AS (SELECT mu, lmax, COUNT(*) AS n, AVG(LEAST(l, lmax)) AS mean, ANY_VALUE(CASE WHEN mu = 2 THEN a / 2 + a * LN(lmax) ELSE a / 2 + a / (2 - mu) * (POW(lmax, 2 - mu) - 1) END) AS expected FROM d GROUP BY mu, lmax)
    SELECT mu, lmax, n, ROUND(mean, 6) AS mean, ROUND(expected, 6) AS expected, ROUND(ABS(mean - expected), 6) AS abs_error, ROUND(ABS(mean - expected) / expected, 6) AS rel_error FROM e""")
def moment_check(trials):
    drawn = trials.withColumn("toss", (F.col("first_touch_steps") * 7919 % 10007) / F.lit(10007.0)).withColumn("u", (F.col("l_orderkey") * 104729 % 10007) / F.lit(10007.0))
    return rounded(S.moment_check(drawn.withColumn("l", X.clamp_step(X.step_law_quantile("toss", "u", "mu", "lmax"), "lmax"))))


DELTAS = ", ".join(f"LEAST(ABS(p.{a} - t.{a}), 512 - ABS(p.{a} - t.{a})) AS d{a}" for a in "xyz")


@query("torus_pairs", f"AND_WITH d AS (SELECT event_id, target_id, {DELTAS} FROM points p, targets t) SELECT event_id, target_id, ROUND(dx * dx + dy * dy + dz * dz, 4) AS dist2 FROM d WHERE dx * dx + dy * dy + dz * dz <= 256", ("points", "targets"))
def torus_pairs(points, targets):
    return rounded(space.torus_join(points, targets.select("target_id", "x", "y", "z"), 16.0, 512.0).select("event_id", "target_id", "dist2"), 4)


@query("region_hits", f"""AND_WITH d AS (SELECT event_id, target_id, TargetShape, D, p.y AS py, t.y AS ty, {DELTAS} FROM points p, targets t),
    e AS (SELECT *, SQRT(dx * dx + dy * dy + dz * dz) AS dist, SQRT(dx * dx + dz * dz + POW(py - GREATEST(ty - D / 2, LEAST(py, ty + D / 2)), 2)) AS capsule FROM d)
    SELECT event_id, target_id, TargetShape FROM e WHERE CASE TargetShape WHEN 'Ball' THEN dist <= D / 2 + 1 WHEN 'Line' THEN capsule <= 1 WHEN 'Square' THEN dx < D / 2 + 1 AND dy < D / 2 + 1 AND dz < D / 2 + 1
        WHEN 'Disk' THEN SQRT(dx * dx + dy * dy) <= D / 2 + 1 AND dz <= 1 WHEN 'Ball_boundary' THEN dist >= D / 2 AND dist <= D / 2 + 1 ELSE dist <= D / 2 END""", ("points", "targets"))
def region_hits(points, targets):
    return space.region_hits(points, targets, 512.0).select("event_id", "target_id", "TargetShape")


@query("region_hits_other_shapes", f"""AND_WITH d AS (SELECT event_id, target_id, TargetShape, D, delta, p.x AS px, p.y AS py, p.z AS pz, {DELTAS} FROM points p, other_targets t)
    SELECT event_id, target_id, TargetShape FROM d WHERE CASE TargetShape
        WHEN '3Line' THEN (dx * dx + dy * dy <= 1 AND dz <= D + 1) OR (dx * dx + dz * dz <= 1 AND dy <= D + 1) OR (dy * dy + dz * dz <= 1 AND dx <= D + 1)
        WHEN '3Line_convex_hull' THEN dx + dy + dz <= D + 1 WHEN '2D_rectangle' THEN dx < POW(D, delta) / 2 AND dy < POW(D, 1 - delta) / 2 AND dz < 1
        ELSE GREATEST(ABS(px), ABS(py)) < (SQRT(D) + 2) / 2 AND ABS(pz) < (POW((SQRT(D) + 2) / 2, delta) + 2) / 2 END""", ("points", "other_targets"))
def region_hits_other_shapes(points, targets):
    return space.region_hits(points, targets, 512.0).select("event_id", "target_id", "TargetShape")


@query("plane_distances", "SELECT event_id, ROUND(SQRT(POW(LEAST(ABS(x - 64), 512 - ABS(x - 64)), 2) + POW(LEAST(ABS(y - 448), 512 - ABS(y - 448)), 2)), 4) AS dist FROM points WHERE event_id % 3 = 0", ("points",))
def plane_distances(points):
    return points.where("event_id % 3 = 0").select("event_id", F.round(X.torus_dist(("x", "y"), (F.lit(64.0), F.lit(448.0)), 512), 4).alias("dist"))


PLACED = """AND_WITH w AS (SELECT *, SUM(l) OVER o AS time, SUM(l * SIN(phi) * COS(theta)) OVER o AS sx, SUM(l * SIN(phi) * SIN(theta)) OVER o AS sy, SUM(l * COS(phi)) OVER o AS sz
        FROM steps WINDOW o AS (PARTITION BY walker_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
    pos AS (SELECT trial_id, walker_id, step, u, time, x0 + sx - 128 * FLOOR((x0 + sx) / 128) AS x, y0 + sy - 128 * FLOOR((y0 + sy) / 128) AS y, z0 + sz - 128 * FLOOR((z0 + sz) / 128) AS z FROM w),
    hit AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY walker_id ORDER BY step) AS touch_no FROM pos WHERE POW(LEAST(ABS(x - 64), 128 - ABS(x - 64)), 2) + POW(LEAST(ABS(y - 64), 128 - ABS(y - 64)), 2) + POW(LEAST(ABS(z - 64), 128 - ABS(z - 64)), 2) <= 400),
    fin AS (SELECT trial_id, walker_id, step, CAST(touch_no AS INT) AS touch_no, time FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY walker_id ORDER BY step) AS k FROM hit WHERE touch_no >= 2 OR u <= 0.5) WHERE k = 1)"""
CENTRE, RADIUS, SIDE = (64.0, 64.0, 64.0), 20.0, 128.0


def _hits(steps: DataFrame) -> DataFrame:
    return P.hits_of_ball(P.wrapped_position(steps, SIDE), CENTRE, RADIUS, SIDE)


def _passages(steps: DataFrame) -> DataFrame:
    return P.first_passage(_hits(steps), 2, 0.5, ["trial_id", "walker_id"])


@query("path_length", PLACED + " SELECT walker_id, step, ROUND(time, 6) AS time FROM w", ("steps",))
def path_length(steps):
    return rounded(P.path_length(steps).select("walker_id", "step", "time"))


#: Positions are often short decimals: this moves them off the edges of rounding on either side.
OFF_EDGE = 0.0000123


#: A sum that ends on the cube's edge is 0 or just under 128 by its last bits: both are the place 0, also once rounded.
@query("wrapped_position", PLACED + f""", r AS (SELECT walker_id, step, ROUND(x + {OFF_EDGE}, 4) AS x, ROUND(y + {OFF_EDGE}, 4) AS y, ROUND(z + {OFF_EDGE}, 4) AS z FROM pos)
    SELECT walker_id, step, x - 128 * FLOOR(x / 128) AS x, y - 128 * FLOOR(y / 128) AS y, z - 128 * FLOOR(z / 128) AS z FROM r""", ("steps",))
def wrapped_position(steps):
    placed = P.wrapped_position(steps, SIDE)
    return placed.select("walker_id", "step", *(X.wrap(F.round(F.col(a) + OFF_EDGE, 4), SIDE).alias(a) for a in "xyz"))


@query("touches", PLACED + """ SELECT s.walker_id, COALESCE(MIN(CASE WHEN touch_no = 1 THEN h.step END), -1) AS first_touch_steps, COALESCE(MIN(CASE WHEN touch_no = 2 THEN h.step END), -1) AS second_touch_steps
    FROM (SELECT DISTINCT walker_id FROM steps) s LEFT JOIN hit h USING (walker_id) GROUP BY s.walker_id""", ("steps",))
def touches(steps):
    return P.touch_steps(steps, _hits(steps))


@query("first_passage", PLACED + " SELECT trial_id, walker_id, step, touch_no, ROUND(time, 6) AS time FROM fin", ("steps",))
def first_passage(steps):
    return rounded(_passages(steps))


@query("earliest_walker", PLACED + " SELECT trial_id, walker_id, step, touch_no, ROUND(time, 6) AS time FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY trial_id ORDER BY time, walker_id) AS k FROM fin) WHERE k = 1", ("steps",))
def earliest_walker(steps):
    return rounded(P.earliest_walker(_passages(steps)))


@query("trial_complete", PLACED + """, tot AS (SELECT trial_id, walker_id, SUM(l) AS time FROM steps GROUP BY ALL), best AS (SELECT trial_id, MIN(time) AS b FROM fin GROUP BY trial_id)
    SELECT t.trial_id, COUNT(*) AS walkers, ROUND(MIN(b), 6) AS best_time, BOOL_AND(f.walker_id IS NOT NULL OR COALESCE(t.time >= b, FALSE)) AS complete
    FROM tot t LEFT JOIN fin f USING (trial_id, walker_id) LEFT JOIN best USING (trial_id) GROUP BY t.trial_id""", ("steps",))
def trial_complete(steps):
    totals = steps.groupBy("trial_id", "walker_id").agg(F.sum("l").alias("time"))
    return rounded(P.trial_complete(totals, _passages(steps)))


@query("multi_target_touches", PLACED + """, tg AS (SELECT * FROM (VALUES (1, 64.0), (2, 80.0)) v(target_no, c)),
    mh AS (SELECT walker_id, step, target_no, ROW_NUMBER() OVER (PARTITION BY walker_id ORDER BY step, target_no) AS touch_no FROM pos, tg WHERE POW(LEAST(ABS(x - c), 128 - ABS(x - c)), 2) + POW(LEAST(ABS(y - c), 128 - ABS(y - c)), 2) + POW(LEAST(ABS(z - c), 128 - ABS(z - c)), 2) <= 900)
    SELECT walker_id, step, target_no, CAST(touch_no AS INT) AS touch_no FROM mh""", ("steps",))
def multi_target_touches(steps):
    placed = P.wrapped_position(steps, SIDE)
    hits = [P.hits_of_ball(placed, (c,) * 3, 30.0, SIDE).withColumn("target_no", F.lit(k)) for k, c in ((1, 64.0), (2, 80.0))]
    return P.touches(hits[0].unionByName(hits[1]), order=("step", "target_no")).select("walker_id", "step", "target_no", "touch_no")


@query("prefix_sum_chunked", PLACED + " SELECT walker_id, step, ROUND(time, 6) AS running FROM w", ("steps",))
def prefix_sum_chunked(steps):
    return rounded(P.prefix_sum(steps, ["walker_id"], "step", "l", chunk=16).select("walker_id", "step", "running"))


#: A placement of this kind is a plain sum: rounding edges are moved as for positions.
@query("offset_placements", f"""SELECT walker_id, step, CAST(7 + 1000 * trial_id + walker_id AS BIGINT) AS seed, CAST(ROUND(CBRT(l * l * 1000)) AS INT) AS side, ROUND(POW(CAST(step AS DOUBLE), 3), 1) AS volume,
    ROUND(p - 128 * FLOOR(p / 128) + {OFF_EDGE}, 4) AS x, ROUND(q - 128 * FLOOR(q / 128) + {OFF_EDGE}, 4) AS y, ROUND(r - 128 * FLOOR(r / 128) + {OFF_EDGE}, 4) AS z
    FROM (SELECT *, 64 + 40 * l * SIN(phi) * COS(theta) AS p, 64 + 40 * l * SIN(phi) * SIN(theta) AS q, 64 + 40 * l * COS(phi) AS r FROM steps)""", ("steps",))
def offset_placements(steps):
    place = X.offset_placement(F.col("l") * 40, "theta", "phi", F.lit(128))
    return steps.select("walker_id", "step", X.cell_seed(F.lit(7), "trial_id", "walker_id").cast("long").alias("seed"), X.side_from_volume(F.col("l") * F.col("l") * 1000).alias("side"),
                        F.round(X.volume_from_side("step"), 1).alias("volume"), *(F.round(c + OFF_EDGE, 4).alias(a) for a, c in zip("xyz", place)))


@query("multi_target_passage", PLACED + """, tg AS (SELECT * FROM (VALUES (1, 64.0), (2, 80.0)) v(target_no, c)),
    mh AS (SELECT walker_id, step, target_no, time, u, ROW_NUMBER() OVER (PARTITION BY walker_id ORDER BY step, target_no) AS touch_no FROM pos, tg WHERE POW(LEAST(ABS(x - c), 128 - ABS(x - c)), 2) + POW(LEAST(ABS(y - c), 128 - ABS(y - c)), 2) + POW(LEAST(ABS(z - c), 128 - ABS(z - c)), 2) <= 900)
    SELECT walker_id, step, CAST(touch_no AS INT) AS touch_no, target_no, ROUND(time, 6) AS time FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY walker_id ORDER BY step, target_no) AS k FROM mh WHERE touch_no >= 3 OR u <= 0.2) WHERE k = 1""", ("steps",))
def multi_target_passage(steps):
    placed = P.wrapped_position(steps, SIDE)
    hits = [P.hits_of_ball(placed, (c,) * 3, 30.0, SIDE).withColumn("target_no", F.lit(k)) for k, c in ((1, 64.0), (2, 80.0))]
    return rounded(P.first_passage(hits[0].unionByName(hits[1]), 3, 0.2, order=("step", "target_no"), carry=("target_no", "time")))


REASONS = """CASE WHEN TargetShape IS NULL THEN 'unknown shape: null' WHEN TargetShape NOT IN ('Ball', '2D_rectangle', 'prism_with_elongation') THEN 'unknown shape: ' || TargetShape
    WHEN D IS NULL OR (TargetShape <> 'Ball' AND delta IS NULL) THEN 'missing size' WHEN TargetShape <> 'prism_with_elongation' AND y IS NULL THEN 'missing place' END"""


@query("region_rejects", f"SELECT * FROM (SELECT target_id, TargetShape, {REASONS} AS reason FROM mixed_targets) WHERE reason IS NOT NULL", ("mixed_targets",))
def region_rejects(targets):
    return space.split_targets(targets)[1].select("target_id", "TargetShape", "reason")


@query("region_hits_of_known", f"""AND_WITH good AS (SELECT * FROM mixed_targets WHERE ({REASONS}) IS NULL),
    d AS (SELECT event_id, target_id, TargetShape, D, delta, p.x AS px, p.y AS py, p.z AS pz, {DELTAS} FROM points p, good t)
    SELECT event_id, target_id, TargetShape FROM d WHERE CASE TargetShape WHEN 'Ball' THEN SQRT(dx * dx + dy * dy + dz * dz) <= D / 2 + 1
        WHEN '2D_rectangle' THEN dx < POW(D, delta) / 2 AND dy < POW(D, 1 - delta) / 2 AND dz < 1
        ELSE GREATEST(ABS(px), ABS(py)) < (SQRT(D) + 2) / 2 AND ABS(pz) < (POW((SQRT(D) + 2) / 2, delta) + 2) / 2 END""", ("points", "mixed_targets"))
def region_hits_of_known(points, targets):
    return space.region_hits(points, space.split_targets(targets)[0], 512.0).select("event_id", "target_id", "TargetShape")


@query("curves_by_row", """AND_WITH k AS (SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 'Disk' WHEN 1 THEN 'Line_area' WHEN 2 THEN 'Line_volume' WHEN 3 THEN TargetShape END AS kind FROM trials),
    c AS (SELECT kind, surface, CASE kind WHEN 'Disk' THEN 1 WHEN 'Line_area' THEN (PI() + 2 * D) / (D * D) WHEN 'Line_volume' THEN 6 * SQRT(PI()) * (surface / 2 - 2 * PI() / 3) / POW(surface, 1.5) END AS y,
          CASE WHEN kind IS NULL THEN 'no curve: null' WHEN kind NOT IN ('Disk', 'Line_area', 'Line_volume') THEN 'no curve: ' || kind END AS reason FROM k)
    SELECT kind, surface, reason, COUNT(*) AS n, ROUND(MAX(y), 6) AS y FROM c GROUP BY kind, surface, reason""")
def curves_by_row(trials):
    part = F.col("l_orderkey") % 5
    named = trials.withColumn("kind", F.when(part == 0, "Disk").when(part == 1, "Line_area").when(part == 2, "Line_volume").when(part == 3, F.col("TargetShape")))
    reason = F.when(~X.known_curve("kind"), F.concat(F.lit("no curve: "), F.coalesce("kind", F.lit("null"))))
    told = named.select("kind", "surface", reason.alias("reason"), X.curve_by_row("kind", "surface", "D", "D").alias("y"))
    return rounded(told.groupBy("kind", "surface", "reason").agg(F.count("*").alias("n"), F.max("y").alias("y")))


@query("volume_grid", """AND_WITH ex AS (SELECT DISTINCT TargetShape AS experiment FROM trials), mus AS (SELECT DISTINCT mu FROM trials), ds AS (SELECT DISTINCT surface AS d FROM trials),
    c AS (SELECT experiment, mu, d AS DiskDiameter, shape AS TargetShape, CASE WHEN shape = 'Disk' THEN d WHEN shape = 'Ball_no_boundary' THEN CBRT(6 * (4 * PI() + 2 * PI() * d) / PI()) END AS D
          FROM ex, mus, ds, (SELECT experiment AS shape FROM ex) v)
    SELECT experiment, mu, DiskDiameter, TargetShape, ROUND(D, 6) AS D, 256 AS lmax, ROUND(POW(512.0, 3), 1) AS n_volume FROM c WHERE D IS NOT NULL""")
def volume_grid(trials):
    levels = trials.agg(F.collect_set("mu").alias("rangemu_LevyDistrib"), F.collect_set("surface").alias("range_disk_diameter"), F.collect_set("TargetShape").alias("list_shapes"))
    params = levels.withColumn("experiment", F.explode("list_shapes")).withColumns({"range_side": F.array(F.lit(512)), "range_ntargets": F.array(F.lit(1)), "range_nwalkers": F.array(F.lit(1)), "reference_shape": F.lit("Disk")})
    return rounded(G.volume_cells(params).select("experiment", "mu", "DiskDiameter", "TargetShape", "D", "lmax", "n_volume"))


SIZED = """AND_WITH g AS (SELECT mu, TargetShape, surface AS size, D, MEDIAN(detection_time) AS t FROM trials WHERE n_walkers = 1 AND n_targets = 1 AND fixed_target_dist = 0 AND probability = 1 AND mu IN (1.0, 2.0) GROUP BY ALL),
    r AS (SELECT a.mu, a.size + 2 AS x, a.t / b.t AS ratio, a.D AS da, b.D AS db FROM g a JOIN g b ON a.TargetShape = 'Ball_no_boundary' AND b.TargetShape = '{}' AND a.mu = b.mu AND a.size = b.size)
    SELECT CAST(NULL AS VARCHAR) AS facet, 'mu=' || CAST(CAST(mu AS DECIMAL(3, 1)) AS VARCHAR) AS series, x, ROUND(ratio, 6) AS y FROM r UNION ALL SELECT NULL, 'theory', x, {} FROM r WHERE mu = 2"""


@query("series_ball_vs_disk", SIZED.format("Disk", "1.0"))
def series_ball_vs_disk(trials):
    return rounded(J.ball_ratio_vs_size(trials.withColumn("DiskDiameter", F.col("surface")), 1, 1, 0.0, 1.0, [1.0, 2.0]))


@query("series_ball_vs_line_area", SIZED.format("Line", "ROUND((PI() + 2 * db) / (da * da), 6)"))
def series_ball_vs_line_area(trials):
    return rounded(J.ball_ratio_vs_size(trials.withColumn("DiskDiameter", F.col("surface")), 1, 1, 0.0, 1.0, [1.0, 2.0], "Line"))


@query("empty_slice", "SELECT mu, surface, TargetShape, n_walkers, AVG(detection_time) AS detection_time FROM trials WHERE mu = 9.5 GROUP BY mu, surface, TargetShape, n_walkers")
def empty_slice(trials):
    return S.cond_mean(S.checked(S.slice_eq(trials, {"mu": 9.5})), S.BASE_KEYS)


@query("surface_exponents", "SELECT CAST(FLOOR(LOG2(surface)) AS INT) AS exponent, CASE TargetShape WHEN 'Ball_no_boundary' THEN 'Ball' ELSE TargetShape END AS label, COUNT(*) AS n FROM trials GROUP BY ALL")
def surface_exponents(trials):
    return trials.groupBy(X.surface_exponent("surface").alias("exponent"), X.shape_label("TargetShape").alias("label")).agg(F.count("*").alias("n"))


def live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running summary over a stream of the trial table's file, drained."""
    import uuid

    from saunter.streaming import live

    batch = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/lineitem.parquet*")
    trials = spark.sql(VIEWS["trials"][1], lineitem=stream)
    name = f"live_summary_{uuid.uuid4().hex}"
    return rounded(live.run_available(live.live_summary(trials, ["delta", "mu"]), name, "complete", shared_dir(spark, name)), 4)


def live_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful passage detector over a stream of steps, drained."""
    from saunter.streaming import live

    path = shared_dir(spark, "live_passage")
    view(spark, sf_dir, "steps").write.parquet(f"{path}/steps")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/steps").schema).parquet(f"{path}/steps")
    return rounded(live.drain_to_parquet(live.first_passage_stream(stream, CENTRE, RADIUS, SIDE, 2, 0.5, timeout_ms=None), f"{path}/found", f"{path}/checkpoint"))


QUERIES |= {"live_summary": live_summary, "live_passage": live_passage}
ORACLES["live_summary"] = ORACLES["cond_summary"]
ORACLES["live_passage"] = ORACLES["first_passage"]
