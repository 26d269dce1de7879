"""Scalar functions as Column expressions: step law, diameters, periodic space, labels, formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clean(x) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# Step law: density a on [0, 1], then a * l^-mu up to lmax.

def step_law_norm(mu, lmax) -> Column:
    """The constant a that makes the step law a density."""
    mu, lmax = _c(mu), _c(lmax)
    tail = F.when(mu == 1, F.log(lmax)).otherwise(-F.try_divide(F.pow(lmax, 1 - mu) - 1, mu - 1))
    return F.try_divide(F.lit(1.0), 1 + tail)


def step_law_quantile(toss, u, mu, lmax) -> Column:
    """Step length from two uniform numbers: ``toss`` picks the flat part or the tail, ``u`` the place in it."""
    toss, u, mu, lmax = map(_c, (toss, u, mu, lmax))
    a = step_law_norm(mu, lmax)
    grow = F.try_divide(1 - a, a) * u
    power = F.when(mu != 1, F.pow(F.greatest((1 - mu) * grow + 1, F.lit(0.0)), F.try_divide(F.lit(1.0), 1 - mu)))
    return F.when(toss <= a, u).when(mu == 1, F.exp(grow)).otherwise(power)


def step_law_mean(mu, lmax) -> Column:
    mu, lmax = _c(mu), _c(lmax)
    a = step_law_norm(mu, lmax)
    tail = F.when(mu == 2, F.log(lmax)).otherwise(F.try_divide(F.pow(lmax, 2 - mu) - 1, 2 - mu))
    return a / 2 + a * tail


def clamp_step(l, lmax) -> Column:
    return F.least(_c(l), _c(lmax))


# Diameters. Shapes that a formula doesn't know have diameter -1, which every validity rule rejects.

def _by_shape(shape, table: dict[tuple[str, ...], Column]) -> Column:
    out = None
    for names, value in table.items():
        cond = _c(shape).isin(*names)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(-1.0))


def diameter_from_surface(s, shape) -> Column:
    s = _c(s)
    ball = F.sqrt(s / PI)
    return _by_shape(shape, {("Ball", "Ball_boundary"): ball - 2, ("Ball_no_boundary",): ball, ("Line",): s / (2 * PI) - 2,
                             ("Disk",): F.sqrt(4 * PI * PI + 2 * s) - 2 * PI})


def diameter_from_projected_surface(s, shape) -> Column:
    s = _c(s)
    ball = 2 * F.sqrt(s / PI)
    return _by_shape(shape, {("Ball", "Ball_boundary", "Disk"): ball - 2, ("Ball_no_boundary",): ball, ("Line",): (s - PI) / 2})


def diameter_from_measure(v, shape) -> Column:
    """From volume (Ball), area (Disk) or length (Line)."""
    v = _c(v)
    known = _by_shape(shape, {("Ball",): F.cbrt(6 * v / PI), ("Disk",): F.sqrt(4 * v / PI), ("Line",): v.cast("double")})
    return F.when(v <= 0, F.lit(-1.0)).otherwise(known)


def diameter(selector, value, shape) -> Column:
    """Selector 1: ``value`` is a surface; 2: a projected surface; otherwise the diameter itself."""
    selector = _c(selector)
    return (F.when(selector == 1, diameter_from_surface(value, shape)).when(selector == 2, diameter_from_projected_surface(value, shape))
            .otherwise(_c(value).cast("double")))


def diameter_fixed_volume(disk_diameter, shape, reference_shape="Disk") -> Column:
    """Null for shapes that a fixed-volume grid doesn't run."""
    d, shape = _c(disk_diameter), _c(shape)
    ball = diameter_from_measure(4 * PI + 2 * PI * d, F.lit("Ball"))
    return F.when(shape == _c(F.lit(reference_shape)), d.cast("double")).when(shape == "Ball_no_boundary", ball)


def detection_radius(surface) -> Column:
    return (F.sqrt(_c(surface) / PI) - 2) / 2 + 1


def side_from_volume(v) -> Column:
    return F.round(F.cbrt(_c(v))).cast("int")


def volume_from_side(side) -> Column:
    return F.pow(_c(side).cast("double"), F.lit(3.0))


# Periodic space.

def torus_delta(a, b, side) -> Column:
    d = F.abs(_c(a) - _c(b))
    return F.least(d, _c(side) - d)


def torus_dist2(p, q, side) -> Column:
    """Squared distance of two points, each given as two or three columns."""
    out = None
    for a, b in zip(p, q):
        d = torus_delta(a, b, side)
        out = d * d if out is None else out + d * d
    return out


def torus_dist(p, q, side) -> Column:
    return F.sqrt(torus_dist2(p, q, side))


def direction(theta, phi) -> tuple[Column, Column, Column]:
    theta, phi = _c(theta), _c(phi)
    return F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)


def wrap(x, side) -> Column:
    return F.pmod(_c(x), _c(side).cast("double"))


def offset_placement(distance, theta, phi, side) -> tuple[Column, Column, Column]:
    """A point at ``distance`` from the centre of the cube, wrapped."""
    return tuple(wrap(_c(side) / 2 + _c(distance) * d, side) for d in direction(theta, phi))


# Keys, labels and formats.

def mu_index(mu) -> Column:
    return F.round((_c(mu) - 1) / 0.2).cast("int")


def cell_seed(seed, i, j) -> Column:
    return _c(seed) + 1000 * _c(i) + _c(j)


def fixed(x, decimals: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{decimals}f", _c(x).cast("double"))


def shape_label(shape) -> Column:
    shape = _c(shape)
    return F.when(shape == "Ball_boundary", "Boundary").when(shape == "Ball_no_boundary", "Ball").otherwise(shape)


def surface_exponent(s) -> Column:
    return F.floor(F.log2(_c(s).cast("double"))).cast("int")


# Reference curves.

def theory_time(volume, surface) -> Column:
    """Detection time in theory: twice the volume over the surface."""
    return F.try_divide(2 * _c(volume), _c(surface))


def area_ratio(d_line, d_ball) -> Column:
    return F.try_divide(PI + 2 * _c(d_line), _c(d_ball) * _c(d_ball))


def volume_ratio(shifted) -> Column:
    """``shifted``: the size, already moved by the alignment of the two shapes."""
    x = _c(shifted)
    return F.try_divide(6 * math.sqrt(PI) * (x / 2 - 2 * PI / 3), F.pow(x, F.lit(1.5)))


CURVES = {"Disk": lambda size, d_line, d_ball: F.lit(1.0), "Line_area": lambda size, d_line, d_ball: area_ratio(d_line, d_ball), "Line_volume": lambda size, d_line, d_ball: volume_ratio(size)}


def known_curve(kind) -> Column:
    """Whether a row names a curve that there is."""
    return F.coalesce(_c(kind).isin(*CURVES), F.lit(False))


def curve_by_row(kind, size, d_line, d_ball) -> Column:
    """`reference_curve` where each row names its own; null for one that there isn't."""
    kind = _c(kind)
    return F.coalesce(*(F.when(kind == name, curve(_c(size), _c(d_line), _c(d_ball))) for name, curve in CURVES.items()))


def reference_curve(kind: str, size, d_line=None, d_ball=None) -> Column:
    """The expected ratio of a ball to the reference shape."""
    if kind not in CURVES:
        raise ValueError(f"no curve for reference {kind!r}; known: {sorted(CURVES)}")
    return CURVES[kind](size, d_line, d_ball)
