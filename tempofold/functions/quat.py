"""Vectors and quaternions (x, y, z, w) as column parts and struct columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F


Parts = Mapping[str, Column]  # x, y, z and maybe w; a struct column works in its place


def vec(x, y, z) -> Parts:
    return {"x": x, "y": y, "z": z}


def quat(x, y, z, w) -> Parts:
    return {"x": x, "y": y, "z": z, "w": w}


def pack(p: Parts) -> Column:
    """Parts as one struct column. Arithmetic stays on parts: nested structs would
    repeat the whole expression once per field."""
    return F.struct(*[c.alias(f) for f, c in p.items()])


def fields(names: str, prefix: str = "") -> Parts:
    """Parts from columns named prefix + x, y, ..."""
    return {f: F.col(prefix + f) for f in names}


def from_array(a: Column, n: int = 3) -> Parts:
    return dict(zip("xyzw", [F.get(a, F.lit(i)).cast("double") for i in range(n)]))


def add(a, b) -> Parts:
    return {f: a[f] + b[f] for f in "xyz"}


def sub(a, b) -> Parts:
    return {f: a[f] - b[f] for f in "xyz"}


def dot(a, b) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a, b) -> Parts:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def conj(q) -> Parts:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


def mul(a, b) -> Parts:
    """Hamilton product: the scalar part and the vector part of a * b."""
    v = add(add(_scale(b, a["w"]), _scale(a, b["w"])), cross(a, b))
    return {**v, "w": a["w"] * b["w"] - dot(a, b)}


def _scale(a, k: Column) -> Parts:
    return {f: a[f] * k for f in "xyz"}


def rotate(q, v) -> Parts:
    """v turned by unit q: v + 2w (u x v) + 2 u x (u x v), u the vector part."""
    uv = cross(q, v)
    return add(v, add(_scale(uv, 2 * q["w"]), _scale(cross(q, uv), F.lit(2.0))))


def normalise(q) -> Parts:
    n = F.sqrt(dot(q, q) + q["w"] * q["w"])
    return {f: q[f] / n for f in "xyzw"}


def rounded(s, names: str, places: int = 6) -> Column:
    return F.struct(*[F.bround(s[f], places).alias(f) for f in names])


def angle_deg(a, b) -> Column:
    """Rotation angle between two unit quaternions."""
    d = F.least(F.lit(1.0), F.abs(dot(a, b) + a["w"] * b["w"]))
    return F.degrees(2 * F.acos(d))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slerp(a, b, u: Column) -> Column:
    """Spherical blend along the short arc as a struct; near-parallel ends blend linearly."""
    four = lambda p, q: dot(p, q) + p["w"] * q["w"]

    def weights(e):
        d, turn = F.least(F.lit(1.0), F.abs(e["d"])), e["u"]
        th, flat = F.acos(d), d > 0.9995
        ka = F.when(flat, 1 - turn).otherwise(F.sin((1 - turn) * th) / F.sin(th))
        kb = F.when(flat, turn).otherwise(F.sin(turn * th) / F.sin(th)) * F.when(e["d"] < 0, -1.0).otherwise(1.0)
        return F.struct(e["a"].alias("a"), e["b"].alias("b"), ka.alias("ka"), kb.alias("kb"))

    def blend(e):
        return F.struct(*[(e["ka"] * e["a"][f] + e["kb"] * e["b"][f]).alias(f) for f in "xyzw"])

    ends = F.struct(pack({f: a[f] for f in "xyzw"}).alias("a"), pack({f: b[f] for f in "xyzw"}).alias("b"), u.alias("u"), four(a, b).alias("d"))
    return let(ends, lambda e: let(weights(e), lambda w: let(blend(w), lambda q: pack(normalise(q)))))


def plane_distance(p, origin, normal) -> Column:
    return dot(sub(p, origin), normal)


def flattest(m) -> Column:
    """Unit vector, y not negative, along which a symmetric 3x3 matrix (xx, yy, zz, xy, xz, yz) is least: its smallest eigenvector.

    The smallest eigenvalue has a closed form by cosines; the vector is the longest cross product of two
    rows of the matrix less it. Where that leaves one row (points on a line) it is the upright nearest
    to +Y, and +Y itself where nothing is left (one point).
    """
    def shifted(e):
        q = (e["xx"] + e["yy"] + e["zz"]) / 3
        off = e["xy"] * e["xy"] + e["xz"] * e["xz"] + e["yz"] * e["yz"]
        p = F.sqrt(((e["xx"] - q) * (e["xx"] - q) + (e["yy"] - q) * (e["yy"] - q) + (e["zz"] - q) * (e["zz"] - q) + 2 * off) / 6)
        return F.struct(*[e[f].alias(f) for f in ("xx", "yy", "zz", "xy", "xz", "yz")], q.alias("q"), p.alias("p"))

    def least(e):
        a, b, c = e["xx"] - e["q"], e["yy"] - e["q"], e["zz"] - e["q"]
        det = a * (b * c - e["yz"] * e["yz"]) - e["xy"] * (e["xy"] * c - e["yz"] * e["xz"]) + e["xz"] * (e["xy"] * e["yz"] - b * e["xz"])
        r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * e["p"] * e["p"] * e["p"])))
        low = F.when(e["p"] > 0, e["q"] + 2 * e["p"] * F.cos(F.acos(r) / 3 + 2 * math.pi / 3)).otherwise(e["q"])
        rows = [vec(e["xx"] - low, e["xy"], e["xz"]), vec(e["xy"], e["yy"] - low, e["yz"]), vec(e["xz"], e["yz"], e["zz"] - low)]
        crosses = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        longest = lambda vs: F.array_max(F.array(*[F.struct(norm(v).alias("n"), pack(v).alias("v")) for v in vs]))
        return F.struct(longest(crosses).alias("c"), longest(rows).alias("r"), e["p"].alias("p"))

    def chosen(e):
        d = {f: e["r"]["v"][f] / e["r"]["n"] for f in "xyz"}
        upright = vec(-d["y"] * d["x"], 1 - d["y"] * d["y"], -d["y"] * d["z"])
        flat = F.when(e["c"]["n"] > 1e-12 * e["p"] * e["p"], e["c"]["v"]).when((e["p"] > 0) & (norm(upright) > 1e-9), pack(upright))
        return F.coalesce(flat, F.when(e["p"] > 0, pack(vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))), pack(vec(F.lit(0.0), F.lit(1.0), F.lit(0.0))))

    def unit(v):
        k = F.when(v["y"] < 0, -1.0).otherwise(1.0) / norm(v)
        return pack({f: v[f] * k for f in "xyz"})

    start = F.struct(*[m[f].alias(f) for f in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return let(start, lambda e: let(shifted(e), lambda e: let(least(e), lambda e: let(chosen(e), unit))))


def tilt_deg(normal) -> Column:
    """Angle between a unit normal and +Y."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), normal["y"]))))


def to_frame(camera: Column, p) -> Column:
    """Pinhole projection to pixels; null behind the camera.

    ``camera`` has fx, fy, cx, cy and ``m``, the column-major camera-to-world
    matrix as 16 doubles. The camera looks down its own -Z.
    """
    m = [F.get(camera["m"], F.lit(i)) for i in range(16)]
    d = sub(p, vec(m[12], m[13], m[14]))
    cam = vec(*[dot(vec(m[4 * i], m[4 * i + 1], m[4 * i + 2]), d) for i in range(3)])
    depth = -cam["z"]
    return F.when(depth > 1e-6, F.struct((camera["cx"] + camera["fx"] * cam["x"] / depth).alias("x"),
                                         (camera["cy"] - camera["fy"] * cam["y"] / depth).alias("y")))


def to_frame_norm(camera: Column, p) -> Column:
    """Projection in [0,1] of the reference frame (``w``, ``h`` in ``camera``)."""
    uv = to_frame(camera, p)
    return F.when(uv.isNotNull(), F.struct((uv["x"] / camera["w"]).alias("x"), (uv["y"] / camera["h"]).alias("y")))


def box_to_frame(camera: Column, lo, hi) -> Column:
    """Frame rectangle around a world box's eight corners; null if any is behind the camera."""
    corners = [to_frame_norm(camera, vec(*[(hi if c >> i & 1 else lo)[f] for i, f in enumerate("xyz")]))
               for c in range(8)]
    pts = F.array(*corners)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    ok = F.forall(pts, lambda p: p.isNotNull())
    x0, y0 = F.array_min(xs), F.array_min(ys)
    return F.when(ok, F.struct(x0.alias("x"), y0.alias("y"), (F.array_max(xs) - x0).alias("width"),
                               (F.array_max(ys) - y0).alias("height")))
