"""Scalar functions of one, two or three values, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def trunc(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")


UNARY: dict[str, Callable[[Column], Column]] = {
    "negate": lambda v: -v,
    "square": lambda v: v * v,
    "round": F.round,
    "rint": F.rint,
    "ceil": lambda v: F.ceil(v).cast("double"),
    "floor": lambda v: F.floor(v).cast("double"),
    "trunc": trunc,
    "sqrt": F.sqrt,
    "rsqrt": lambda v: F.try_divide(F.lit(1.0), F.sqrt(v)),
    "exp": F.exp,
    "log": F.log,
    "log10": F.log10,
    "log1p": F.log1p,
    "abs": F.abs,
    "cos": F.cos,
    "sin": F.sin,
    "tan": F.tan,
    "acos": F.acos,
    "asin": F.asin,
    "atan": F.atan,
    "cosh": F.cosh,
    "sinh": F.sinh,
    "tanh": F.tanh,
    "acosh": F.acosh,
    "asinh": F.asinh,
    "atanh": F.atanh,
    "sinc": lambda v: F.when(v == 0, 1.0).otherwise(F.sin(v) / F.when(v != 0, v)),
    "signbit": lambda v: (v < 0).cast("double"),
    "rad2deg": F.degrees,
    "deg2rad": F.radians,
    "one_minus": lambda v: 1 - v,
    "inverse": lambda v: F.try_divide(F.lit(1.0), v),
    "abs_one_log": lambda v: F.log(1 + F.abs(v)),
    "one_log": lambda v: F.log(1 + v),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": F.try_divide,
    "modulo": lambda a, b: a % F.when(b != 0, b),
    "min": F.least,
    "max": F.greatest,
    "pow": F.pow,
    "hypot": F.hypot,
    "copysign": lambda a, b: F.when(b < 0, -F.abs(a)).otherwise(F.abs(a)),
    "distance_squared": lambda a, b: (a - b) * (a - b),
    "divide_safe": lambda a, b: F.when(F.abs(b) < EPSILON, 0.0).otherwise(F.try_divide(a, b)),
}

TERNARY: dict[str, Callable[[Column, Column, Column], Column]] = {
    "clamp": lambda v, lo, hi: F.least(F.greatest(v, lo), hi),
    "fma": lambda a, b, c: a * b + c,
    "plus_multiply": lambda a, b, c: (a + b) * c,
    "minus_multiply": lambda a, b, c: (a - b) * c,
    "plus_divide": lambda a, b, c: F.try_divide(a + b, c),
    "minus_divide": lambda a, b, c: F.try_divide(a - b, c),
    "multiply_plus": lambda a, b, c: a * b + c,
    "divide_multiply": lambda a, b, c: F.try_divide(a, b) * c,
    "divide_epsilon": lambda a, b, eps: F.try_divide(a, b + eps),
}

PREDICATES: dict[str, Callable[..., Column]] = {
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "less": lambda a, b: a < b,
    "less_equal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b,
    "and": lambda a, b: (a != 0) & (b != 0),
    "or": lambda a, b: (a != 0) | (b != 0),
    "within": lambda v, lo, hi: (v > lo) & (v < hi),
    "within_equal": lambda v, lo, hi: v.between(lo, hi),
    "is_nan": F.isnan,
    "is_inf": lambda v: F.abs(v) == float("inf"),
    "is_finite": lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")),
    "is_zero": lambda v: v == 0,
}


def zip_stacks(left: DataFrame, right: DataFrame, into: str = "r") -> DataFrame:
    """Pixels of two stacks side by side, as v and `into`."""
    keys = ["image_id", "z", "y", "x"]
    return left.join(right.select(*keys, F.col("v").alias(into)), keys)


#: Complex values are two columns; each function takes (re, im) pairs and returns one.
def conjugate(re: Column, im: Column) -> tuple[Column, Column]:
    return re, -im


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(power(re, im))


def times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def times_conjugate(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return times(a, conjugate(*b))
