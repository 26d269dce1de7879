"""Golden rows of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from saunter.functions import exprs as X


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("mu,norm,mean", [(1.0, 0.15278425, 39.036375), (1.4, 0.30979386, 14.022105), (2.0, 0.50097847, 3.028504), (2.6, 0.61541781, 1.296586), (3.0, 0.66667006, 0.997401)])
def test_step_law(spark, mu, norm, mean):
    assert value(spark, X.step_law_norm(F.lit(mu), F.lit(256))) == pytest.approx(norm, abs=1e-7)
    assert value(spark, X.step_law_mean(F.lit(mu), F.lit(256))) == pytest.approx(mean, abs=1e-5)


@pytest.mark.parametrize("toss,u,mu,want", [(0.1, 0.25, 2.0, 0.25), (0.9, 0.0, 2.0, 1.0), (0.9, 0.5, 2.0, 1.992218), (0.9, 1.0, 2.0, 256.0), (0.9, 0.5, 1.0, 16.0), (0.9, 1.0, 1.0, 256.0), (0.9, 0.5, 3.0, 1.414203)])
def test_quantile(spark, toss, u, mu, want):
    assert value(spark, X.step_law_quantile(F.lit(toss), F.lit(u), F.lit(mu), F.lit(256))) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("mu", [1.0, 1.6, 2.0, 3.0])
def test_quantile_grows(spark, mu):
    q = X.step_law_quantile(F.lit(0.99), F.col("id") / 100.0, F.lit(mu), F.lit(256))
    got = [r["q"] for r in spark.range(101).orderBy("id").select(q.alias("q")).collect()]
    assert got == sorted(got) and got[0] == pytest.approx(1) and got[-1] == pytest.approx(256)


@pytest.mark.parametrize("s,shape,want", [(480, "Ball", 10.3608), (480, "Ball_boundary", 10.3608), (480, "Ball_no_boundary", 12.3608), (480, "Line", 74.3944), (480, "Disk", 25.3313), (480, "Cone", -1),
                                          (8000, "Ball", 48.4627), (8000, "Line", 1271.2395), (8000, "Disk", 120.3639)])
def test_diameter_from_surface(spark, s, shape, want):
    assert value(spark, X.diameter_from_surface(F.lit(float(s)), F.lit(shape))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("shape,want", [("Ball", 22.7215), ("Disk", 22.7215), ("Ball_no_boundary", 24.7215), ("Line", 238.4292), ("Cone", -1)])
def test_diameter_from_projection(spark, shape, want):
    assert value(spark, X.diameter_from_projected_surface(F.lit(480.0), F.lit(shape))) == pytest.approx(want, abs=1e-4)
    assert value(spark, X.diameter(F.lit(2), F.lit(480.0), F.lit(shape))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("d,want", [(10, 5.2415), (100, 10.6970), (500, 18.1954)])
def test_fixed_volume_ball(spark, d, want):
    assert value(spark, X.diameter_fixed_volume(F.lit(float(d)), F.lit("Ball_no_boundary"))) == pytest.approx(want, abs=1e-4)
    assert value(spark, X.diameter_fixed_volume(F.lit(float(d)), F.lit("Disk"))) == d
    assert value(spark, X.diameter_fixed_volume(F.lit(float(d)), F.lit("Line"))) is None


def test_measure(spark):
    assert value(spark, X.diameter_from_measure(F.lit(0.0), F.lit("Ball"))) == -1
    assert value(spark, X.diameter_from_measure(F.lit(9.0), F.lit("Line"))) == 9
    assert value(spark, X.diameter_from_measure(F.lit(math.pi), F.lit("Disk"))) == pytest.approx(2)


@pytest.mark.parametrize("a,b,want", [(1, 511, 2), (0, 256, 256), (10, 10, 0)])
def test_torus_delta(spark, a, b, want):
    assert value(spark, X.torus_delta(F.lit(float(a)), F.lit(float(b)), F.lit(512.0))) == want


@pytest.mark.parametrize("x,want", [(-1.5, 510.5), (512.0, 0), (1025.0, 1)])
def test_wrap(spark, x, want):
    assert value(spark, X.wrap(F.lit(x), 512)) == want


def test_torus_distance_bounds(spark):
    p, q = [F.col("id") * k % 512 for k in (37, 101, 7)], [F.col("id") * k % 512 for k in (53, 11, 201)]
    d, e = X.torus_dist(p, q, F.lit(512)), X.torus_dist(q, p, F.lit(512))
    rows = spark.range(500).select(d.alias("d"), e.alias("e")).collect()
    assert all(r["d"] == r["e"] <= 512 * math.sqrt(3) / 2 for r in rows)


def test_curves_and_labels(spark):
    line, ball = 10.0, math.sqrt(10.0 + math.pi / 2 + 7.153981633974483)
    assert value(spark, X.area_ratio(F.lit(line), F.lit(ball))) == pytest.approx((math.pi + 20) / ball**2)
    assert value(spark, X.volume_ratio(F.lit(62.0))) == pytest.approx(0.6296812, abs=1e-6)
    assert value(spark, X.volume_ratio(F.lit(482.0))) == pytest.approx(0.2400944, abs=1e-6)
    with pytest.raises(ValueError):
        X.reference_curve("Cone", F.lit(1.0))
    assert value(spark, X.shape_label(F.lit("Ball_boundary"))) == "Boundary"
    assert value(spark, X.surface_exponent(F.lit(512.0))) == 9
    assert value(spark, X.fixed(F.lit(1.0), 8)) == "1.00000000"
    assert value(spark, X.cell_seed(F.lit(7), F.lit(2), F.lit(3))) == 2010
    assert value(spark, X.clean(F.lit(float("nan")))) is None and value(spark, X.clean(F.lit(float("inf")))) is None
    assert value(spark, X.side_from_volume(F.lit(134217728.0))) == 512
    assert value(spark, X.volume_from_side(F.lit(512))) == 134217728.0
    x, y, z = (value(spark, c) for c in X.offset_placement(F.lit(10.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(128)))
    assert (x, y, z) == pytest.approx((74, 64, 64))
