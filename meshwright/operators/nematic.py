"""Orientational order of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import angle

AXES = "xyz"


def orientations(edges: DataFrame) -> DataFrame:
    """(eid, x, y, z): first point less last; the missing axis of planar points is 0."""
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    gap = lambda f: (first[f] - last[f]).cast("double")
    return edges.select("eid", gap("z").alias("x"), gap("r").alias("y"), gap("c").alias("z"))


def angles(vectors: DataFrame) -> DataFrame:
    """``vectors`` (y, z, x being the missing axis) with their direction in the plane, ``angle``; vectors out of the plane are an error."""
    if not vectors.where("x <> 0").isEmpty():
        raise TypeError("angles are those of planar graphs")
    return vectors.withColumn("angle", angle(F.col("y"), F.col("z")))


def tensor(vectors: DataFrame) -> DataFrame:
    """One row of qxx, qyy, qzz, qxy, qxz, qyz: mean of 3/2 u u - 1/2 over vectors that are not zero."""
    norm = F.sqrt(sum((F.col(a) * F.col(a) for a in "yz"), F.col("x") * F.col("x")))
    unit = vectors.withColumn("n", norm).where("n > 0").select(*((F.col(a) / F.col("n")).alias(a) for a in AXES))
    return unit.agg(*((1.5 * F.avg(F.col(a) * F.col(b)) - (0.5 if a == b else 0.0)).alias(f"q{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")))


def largest_eigenvalue(q: dict[str, Column]) -> Column:
    """Of a traceless symmetric 3 by 3 matrix, in closed form."""
    square = q["xx"] ** 2 + q["yy"] ** 2 + q["zz"] ** 2 + 2 * (q["xy"] ** 2 + q["xz"] ** 2 + q["yz"] ** 2)
    p = F.sqrt(square / 6)
    det = (q["xx"] * (q["yy"] * q["zz"] - q["yz"] ** 2) - q["xy"] * (q["xy"] * q["zz"] - q["yz"] * q["xz"]) + q["xz"] * (q["xy"] * q["yz"] - q["yy"] * q["xz"]))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))
    return F.when(p > 0, 2 * p * F.cos(F.acos(r) / 3)).otherwise(0.0)


def order_parameter(vectors: DataFrame) -> DataFrame:
    """One row: the tensor, its largest eigenvalue, and the director (its first component that is not 0 is positive)."""
    t = tensor(vectors)
    c = {k: F.col(f"q{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    out = t.withColumn("nematic_order", largest_eigenvalue(c))
    # a row of the adjugate of Q - lambda is an eigenvector; the longest of three is taken
    e = F.col("nematic_order")
    a, b, d = c["xx"] - e, c["yy"] - e, c["zz"] - e
    rows = [(b * d - c["yz"] ** 2, c["xz"] * c["yz"] - c["xy"] * d, c["xy"] * c["yz"] - b * c["xz"]),
            (c["xz"] * c["yz"] - c["xy"] * d, a * d - c["xz"] ** 2, c["xy"] * c["xz"] - a * c["yz"]),
            (c["xy"] * c["yz"] - b * c["xz"], c["xy"] * c["xz"] - a * c["yz"], a * b - c["xy"] ** 2)]
    struct = lambda v: F.struct(F.sqrt(v[0] ** 2 + v[1] ** 2 + v[2] ** 2).alias("n"), *(x.alias(f"d{k}") for x, k in zip(v, AXES, strict=True)))
    out = out.withColumn("v", F.greatest(*(struct(v) for v in rows)))
    eps = 1e-9
    sign = F.when(F.col("v.dx") > eps, 1).when(F.col("v.dx") < -eps, -1).when(F.col("v.dy") > eps, 1).when(F.col("v.dy") < -eps, -1).when(F.col("v.dz") < 0, -1).otherwise(1)
    return out.select(*t.columns, "nematic_order", *(F.when(F.col("v.n") > 0, sign * F.col(f"v.d{k}") / F.col("v.n")).alias(f"director_{k}") for k in AXES))
