"""What the queries share: the test stacks made from the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import stack_to_pixels
from ..sources.stacks import as_stack

SHAPE = (1, 8, 8)
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 images with their label."""
    return as_stack(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", SHAPE, ("label",))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack_to_pixels(stack(spark, sf_dir))


def r6(c: Column | str) -> Column:
    """Rounded for comparing, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


#: WITH clause: px(image_id, label, z, y, x, v).
PX = """with px as (
  select cast(vec_id as bigint) as image_id, label, cast(0 as bigint) as z, cast((i - 1) // 8 as bigint) as y,
    cast((i - 1) % 8 as bigint) as x, cast(e as double) as v
  from (select vec_id, label, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from embeddings)
)"""


def s6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"
