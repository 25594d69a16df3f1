"""Column expressions for vectors, rotations and cameras; no Python per row.

A vector is struct<x,y,z>, a rotation the unit quaternion struct<w,x,y,z>, a
pose is camera to world: p_world = rotate(q, p_camera) + t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with the column worked out once per row, whatever is read of it: no
    later filter or projection copies its expression (a plain column would be put
    in their place by the optimiser)."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def _named(**parts: Column) -> Column:
    """A struct that remembers its fields' expressions, so that taking a field of
    it again does not copy the whole struct into the plan."""
    out = F.struct(*(c.alias(k) for k, c in parts.items()))
    out.__dict__["_parts"] = parts
    return out


def _part(a: Column, name: str) -> Column:
    parts = a.__dict__.get("_parts")
    return parts[name] if parts else a[name]


def _listed(*items: Column) -> Column:
    """The same for an array."""
    out = F.array(*items)
    out.__dict__["_items"] = items
    return out


def _item(a: Column, k: int) -> Column:
    items = a.__dict__.get("_items")
    return items[k] if items else a[k]


def vec(x, y, z) -> Column:
    return _named(**{k: v if isinstance(v, Column) else F.lit(v) for k, v in (("x", x), ("y", y), ("z", z))})


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return _named(w=w, x=x, y=y, z=z)


def add(a: Column, b: Column) -> Column:
    return vec(_part(a, "x") + _part(b, "x"), _part(a, "y") + _part(b, "y"), _part(a, "z") + _part(b, "z"))


def sub(a: Column, b: Column) -> Column:
    return vec(_part(a, "x") - _part(b, "x"), _part(a, "y") - _part(b, "y"), _part(a, "z") - _part(b, "z"))


def scale(a: Column, s: Column) -> Column:
    return vec(_part(a, "x") * s, _part(a, "y") * s, _part(a, "z") * s)


def dot(a: Column, b: Column) -> Column:
    return _part(a, "x") * _part(b, "x") + _part(a, "y") * _part(b, "y") + _part(a, "z") * _part(b, "z")


def cross(a: Column, b: Column) -> Column:
    return vec(_part(a, "y") * _part(b, "z") - _part(a, "z") * _part(b, "y"), _part(a, "z") * _part(b, "x") - _part(a, "x") * _part(b, "z"), _part(a, "x") * _part(b, "y") - _part(a, "y") * _part(b, "x"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return scale(a, 1 / norm(a))


def conjugate(q: Column) -> Column:
    return quat(_part(q, "w"), -_part(q, "x"), -_part(q, "y"), -_part(q, "z"))


def multiply(a: Column, b: Column) -> Column:
    return quat(
        _part(a, "w") * _part(b, "w") - _part(a, "x") * _part(b, "x") - _part(a, "y") * _part(b, "y") - _part(a, "z") * _part(b, "z"),
        _part(a, "w") * _part(b, "x") + _part(a, "x") * _part(b, "w") + _part(a, "y") * _part(b, "z") - _part(a, "z") * _part(b, "y"),
        _part(a, "w") * _part(b, "y") - _part(a, "x") * _part(b, "z") + _part(a, "y") * _part(b, "w") + _part(a, "z") * _part(b, "x"),
        _part(a, "w") * _part(b, "z") + _part(a, "x") * _part(b, "y") - _part(a, "y") * _part(b, "x") + _part(a, "z") * _part(b, "w"))


def rotate(q: Column, v: Column) -> Column:
    """v + 2 w (r x v) + 2 r x (r x v), r the vector part of q."""
    r = vec(_part(q, "x"), _part(q, "y"), _part(q, "z"))
    c = cross(r, v)
    return add(add(v, scale(c, 2 * _part(q, "w"))), scale(cross(r, c), F.lit(2.0)))


def canonical(q: Column) -> Column:
    s = F.when(_part(q, "w") < 0, -1.0).otherwise(1.0)
    return quat(_part(q, "w") * s, _part(q, "x") * s, _part(q, "y") * s, _part(q, "z") * s)


def matrix(q: Column) -> Column:
    """Row-major 3x3 rotation matrix as array<double>."""
    w, x, y, z = _part(q, "w"), _part(q, "x"), _part(q, "y"), _part(q, "z")
    return _listed(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def rotation_angle(a: Column, b: Column) -> Column:
    """Degrees between two rotations; null if either is null."""
    return turn_angle(multiply(conjugate(a), b))


def turn_angle(d: Column) -> Column:
    """Degrees by which a rotation turns."""
    return F.degrees(2 * F.atan2(norm(vec(_part(d, "x"), _part(d, "y"), _part(d, "z"))), F.abs(_part(d, "w"))))


def direction_angle(a: Column, b: Column) -> Column:
    """Degrees between two directions, the cosine clipped to [-1, 1]."""
    c = dot(a, b) / (norm(a) * norm(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def to_camera(q: Column, t: Column, p: Column) -> Column:
    return rotate(conjugate(q), sub(p, t))


def project(model: Column, params: Column, p: Column) -> Column:
    """Pixel struct<u,v> of a point in camera coordinates, null behind it.

    PINHOLE fx fy cx cy; RADIAL f cx cy k1 k2; SIMPLE_RADIAL f cx cy k1;
    OPENCV fx fy cx cy k1 k2 p1 p2; OPENCV_FISHEYE fx fy cx cy k1 k2 k3 k4.
    """
    x, y = _part(p, "x") / _part(p, "z"), _part(p, "y") / _part(p, "z")
    r2 = x * x + y * y
    g = lambda i: F.get(params, F.lit(i))
    uv = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    radial = 1 + g(3) * r2 + F.coalesce(g(4), F.lit(0.0)) * r2 * r2
    bend = 1 + g(4) * r2 + g(5) * r2 * r2
    bx = x * bend + 2 * g(6) * x * y + g(7) * (r2 + 2 * x * x)
    by = y * bend + g(6) * (r2 + 2 * y * y) + 2 * g(7) * x * y
    r = F.sqrt(r2)
    th = F.atan(r)
    t2 = th * th
    d = F.when(r > 1e-12, th * (1 + t2 * (g(4) + t2 * (g(5) + t2 * (g(6) + t2 * g(7))))) / r).otherwise(1.0)
    return F.when(_part(p, "z") > 0, (
        F.when(model == "PINHOLE", uv(g(0) * x + g(2), g(1) * y + g(3)))
        .when(model.isin("RADIAL", "SIMPLE_RADIAL"), uv(g(0) * radial * x + g(1), g(0) * radial * y + g(2)))
        .when(model == "OPENCV", uv(g(0) * bx + g(2), g(1) * by + g(3)))
        .when(model == "OPENCV_FISHEYE", uv(g(0) * d * x + g(2), g(1) * d * y + g(3)))))


def pixel_ray(params: Column, u: Column, v: Column) -> Column:
    """Unit ray of a pixel of a pinhole camera (fx fy cx cy)."""
    p = lambda k: _item(params, k)
    return unit(vec((u - p(2)) / p(0), (v - p(3)) / p(1), F.lit(1.0)))


def spherical(p: Column) -> Column:
    """radius, polar angle from z, azimuth."""
    r = norm(p)
    return _named(r=r, theta=F.acos(_part(p, "z") / r), phi=F.atan2(_part(p, "y"), _part(p, "x")))


def from_spherical(s: Column) -> Column:
    return vec(_part(s, "r") * F.sin(_part(s, "theta")) * F.cos(_part(s, "phi")), _part(s, "r") * F.sin(_part(s, "theta")) * F.sin(_part(s, "phi")), _part(s, "r") * F.cos(_part(s, "theta")))


def line_of(f: Column, u: Column, v: Column) -> Column:
    """Epipolar line F x of a pixel; f is row-major array<double> of nine."""
    row = lambda k: _item(f, 3 * k) * u + _item(f, 3 * k + 1) * v + _item(f, 3 * k + 2)
    return vec(row(0), row(1), row(2))


def transposed(m: Column) -> Column:
    return _listed(*(_item(m, i) for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)))


def epipolar_residual(f: Column, u1, v1, u2, v2) -> Column:
    return dot(vec(u2, v2, F.lit(1.0)), line_of(f, u1, v1))


def epipolar_sed(f: Column, u1, v1, u2, v2) -> Column:
    """Symmetric squared distance to the two epipolar lines."""
    a, b = line_of(f, u1, v1), line_of(transposed(f), u2, v2)
    e = epipolar_residual(f, u1, v1, u2, v2)
    return e * e * (1 / (_part(a, "x") * _part(a, "x") + _part(a, "y") * _part(a, "y")) + 1 / (_part(b, "x") * _part(b, "x") + _part(b, "y") * _part(b, "y")))


def epipolar_sampson(f: Column, u1, v1, u2, v2) -> Column:
    a, b = line_of(f, u1, v1), line_of(transposed(f), u2, v2)
    e = epipolar_residual(f, u1, v1, u2, v2)
    return e * e / (_part(a, "x") * _part(a, "x") + _part(a, "y") * _part(a, "y") + _part(b, "x") * _part(b, "x") + _part(b, "y") * _part(b, "y"))


def essential(q: Column, t: Column) -> Column:
    """[t]x R, row-major, for x2 = R x1 + t."""
    r = matrix(q)
    rows = []
    for a, b, ta, tb in ((2, 1, "y", "z"), (0, 2, "z", "x"), (1, 0, "x", "y")):
        rows += [_part(t, ta) * _item(r, 3 * a + c) - _part(t, tb) * _item(r, 3 * b + c) for c in range(3)]
    return _listed(*rows)


def fundamental(e: Column, k1: Column, k2: Column) -> Column:
    """K2^-T E K1^-1 for pinhole parameters fx fy cx cy."""
    k = lambda n, i: _item((k1, k2)[n - 1], i)

    def right(row):
        a, b, c = row
        return [a / k(1, 0), b / k(1, 1), c - a * k(1, 2) / k(1, 0) - b * k(1, 3) / k(1, 1)]

    m = [right([_item(e, 3 * i + j) for j in range(3)]) for i in range(3)]
    top = [x / k(2, 0) for x in m[0]]
    mid = [x / k(2, 1) for x in m[1]]
    low = [z - x * k(2, 2) / k(2, 0) - y * k(2, 3) / k(2, 1) for x, y, z in zip(m[0], m[1], m[2])]
    return _listed(*top, *mid, *low)


def piecewise_gaussian(angle: Column, center: float = 5.0, narrow: float = 1.0, wide: float = 10.0) -> Column:
    """Score of a triangulation angle: narrow below the centre, wide above."""
    d = angle - center
    return F.when(angle <= center, F.exp(-d * d / (2 * narrow**2))).otherwise(F.exp(-d * d / (2 * wide**2)))


def root_normalise(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.transform(v, lambda x: F.sqrt(x / total))


def patch_cell(u: Column, v: Column, width: float, height: float, side: int) -> Column:
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(side - 1), c.cast("int")))
    return clamp(F.floor(v * side / height)) * side + clamp(F.floor(u * side / width))


def is_rotation(m: Column, eps: float = 1e-6) -> Column:
    """Row-major nine numbers with R R^T = I and determinant 1."""
    row = lambda i: vec(*(_item(m, 3 * i + j) for j in range(3)))
    ok = F.abs(dot(row(0), cross(row(1), row(2))) - 1) < eps
    for i in range(3):
        for j in range(i, 3):
            ok = ok & (F.abs(dot(row(i), row(j)) - float(i == j)) < eps)
    return ok


def readable_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
