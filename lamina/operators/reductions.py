"""Reductions of pixels over any axes, and what is built on them.

`keys` are the columns that stay: ("image_id",) reduces each image, ("y", "x") over the images, () everything.
All are partial aggregations, so a shuffle moves one row per task and group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from ..model import Shape, exploded
from ..sources.shared import written
from .dense import arrays, dense
from .generators import iwise
from .tiles import in_batches

V = "v"


def _sum2() -> Column:
    return F.sum(F.col(V) * F.col(V))


def _variance(ddof: int) -> Column:
    return F.var_pop(V) if ddof == 0 else F.var_samp(V)


AGGREGATES = {
    "min": lambda: F.min(V),
    "max": lambda: F.max(V),
    "sum": lambda: F.sum(V),
    "mean": lambda: F.avg(V),
    "l2_norm": lambda: F.sqrt(_sum2()),
    "variance": lambda: _variance(0),
    "variance_1": lambda: _variance(1),
    "stddev": lambda: F.sqrt(_variance(0)),
    "stddev_1": lambda: F.sqrt(_variance(1)),
    "mean_l2_norm": lambda: F.sqrt(F.greatest(F.lit(0.0), _variance(0) * F.count(V))),
    "median": lambda: F.median(V),
}


def reduce(pixels: DataFrame, keys: Iterable[str], *names: str) -> DataFrame:
    """One column for each name of AGGREGATES; mean_l2_norm is the norm about the mean."""
    return pixels.groupBy(*keys).agg(*[AGGREGATES[n]().alias(n) for n in names])


#: Exponents that share a bin of exact sums, and bits of a value's lower half there.
BIN, HALF = 8, 30


def _scaled(v: Column, n: Column) -> Column:
    """v * 2**n, in two steps that are exact where v and the result are ordinary numbers."""
    half = F.floor(n / 2)
    return v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), n - half)


def _rounded(entries: list, n: int) -> tuple[float, float]:
    """Sum and mean of sums per bin (bin, high, low), each rounded once."""
    least = min((e["bin"] for e in entries), default=0)
    whole = sum(((int(e["high"]) << HALF) + int(e["low"])) << (e["bin"] - least) * BIN for e in entries)
    above, below = 1 << max(0, least * BIN), 1 << max(0, -least * BIN)

    def quotient(by: int) -> float:
        try:
            return whole * above / (below * by)  # of integers: rounded once
        except OverflowError:
            return math.copysign(math.inf, whole)

    return quotient(1), quotient(n)


def reduce_accurate(pixels: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Sum and mean of each group, rounded once, at the end: the result is the same for any order and partitioning.

    A value is a whole number of units of its bin, a power of two near its last bit; the units are added up in two halves, as longs in
    each task and as decimals over tasks, so partial sums are exact and a group of any size is a few hundred rows a task at most.
    NaN and infinities make what they make in a plain sum."""
    keys = list(keys)
    v, task = F.col(V).cast("double"), F.spark_partition_id()
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    unit = F.when(odd | (v == 0), None).otherwise(F.floor((F.floor(F.log2(F.abs(v))) - 54) / BIN))
    units = _scaled(v, -BIN * F.col("_bin"))
    high = F.floor(units / float(1 << HALF))
    rows = pixels.filter(F.col(V).isNotNull()).select(*keys, V, unit.alias("_bin"), F.when(odd, v).alias("_odd"), task.alias("_task"))
    halves = rows.withColumn("_high", high).withColumn("_low", (units - F.col("_high") * float(1 << HALF)).cast("long"))
    own = halves.groupBy(*keys, "_bin", "_task").agg(F.sum("_high").alias("_high"), F.sum("_low").alias("_low"), F.sum("_odd").alias("_odd"), F.count("*").alias("_n"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(28, 0)")).alias(c)
    bins = own.groupBy(*keys, "_bin").agg(wide("_high"), wide("_low"), F.sum("_odd").alias("_odd"), F.sum("_n").alias("_n"))
    entry = F.when(F.col("_bin").isNotNull(), F.struct(F.col("_bin").alias("bin"), F.col("_high").alias("high"), F.col("_low").alias("low")))
    held = bins.groupBy(*keys).agg(F.collect_list(entry).alias("_entries"), F.sum("_odd").alias("_odd"), F.sum("_n").alias("_n"))

    @F.pandas_udf("sum double, mean double")
    def finish(entries: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_rounded(e, int(k)) for e, k in zip(entries, n, strict=True)], columns=["sum", "mean"])

    done = held.withColumn("_s", finish("_entries", "_n"))
    return done.select(*keys, *[F.coalesce("_odd", f"_s.{c}").alias(c) for c in ("sum", "mean")])


#: Splitters of a round, rows of a group that are sorted in one task, and groups whose bounds are sent to all tasks.
SPLITTERS, SORTED_ROWS, SENT_GROUPS = 256, 10_000, 100_000


def median_selected(pixels: DataFrame, keys: Iterable[str]) -> DataFrame:
    """keys, median: as F.median, for groups of any size.

    Each round takes approximate quantiles of every group (a bounded sketch) and keeps what lies between the two around the
    middle; exact counts say how many values lie below. What is left of a group shrinks about 50 times a round, until few enough
    values are left to sort or all are equal. Rounds are written to the shared folder."""
    keys = list(keys)
    v = F.col(V)
    typed = pixels.select(*keys, v.cast("double").alias(V)).filter(v.isNotNull())
    sizes = typed.groupBy(*keys).agg(F.count("*").alias("_n"))
    left = written(sizes.select(*keys, "_n", F.floor((F.col("_n") - 1) / 2).alias("_low"), F.floor(F.col("_n") / 2).alias("_high")).filter("_n > 0"))
    rows, found = typed, []
    while True:
        small = left.filter(F.col("_n") <= SORTED_ROWS)
        large = left.filter(F.col("_n") > SORTED_ROWS)
        values = F.sort_array(F.collect_list(V))
        sorted_ = _beside(rows, small, keys).groupBy(*keys, "_low", "_high").agg(values.alias("_v"))
        at = lambda c: F.element_at("_v", (F.col(c) + 1).cast("int"))
        found.append(sorted_.select(*keys, ((at("_low") + at("_high")) / 2).alias("median")))
        if large.isEmpty():
            break
        shares = [k / SPLITTERS for k in range(SPLITTERS + 1)]
        cuts = _beside(rows, large, keys).groupBy(*keys, "_n", "_low", "_high").agg(F.percentile_approx(V, shares, 20 * SPLITTERS).alias("_cuts"))
        near = lambda c, by: F.greatest(F.lit(1), F.least(F.lit(SPLITTERS + 1), F.floor(F.col(c) * SPLITTERS / F.col("_n")) + by)).cast("int")
        bounds = written(cuts.select(*keys, "_n", "_low", "_high", F.element_at("_cuts", near("_low", -1)).alias("_from"), F.element_at("_cuts", near("_high", 4)).alias("_to")))
        held = _beside(rows, bounds, keys)
        inside = F.col(V).between(F.col("_from"), F.col("_to"))
        counts = written(held.groupBy(*keys, "_n", "_low", "_high", "_from", "_to").agg(F.sum((v < F.col("_from")).cast("long")).alias("_below"), F.sum(inside.cast("long")).alias("_in")))
        ranked = counts.select(*keys, "_from", "_to", F.col("_in").alias("_n"), *[(F.col(c) - F.col("_below")).alias(c) for c in ("_low", "_high")])
        equal = ranked.filter(F.col("_from") == F.col("_to"))
        found.append(equal.select(*keys, F.col("_from").alias("median")))
        rows = written(held.filter(inside & (F.col("_from") < F.col("_to"))).select(*keys, V))
        left = ranked.filter(F.col("_from") < F.col("_to")).select(*keys, "_n", "_low", "_high")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what is known of their group, without those of no group. groups are numbers a group; few of them are sent."""
    few = F.broadcast(groups) if groups.count() <= SENT_GROUPS else groups
    if not keys:
        return rows.crossJoin(few)  # one row at most
    right = few.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    same = [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(right, same).drop(*[f"_k{i}" for i in range(len(keys))])


def argument(pixels: DataFrame, keys: Iterable[str], place: Column, largest: bool = True) -> DataFrame:
    """value and place of the extreme; of equal ones the least place."""
    best = F.max(F.struct(F.col(V), (-place).alias("p"))) if largest else F.min(F.struct(F.col(V), place.alias("p")))
    found = pixels.groupBy(*keys).agg(best.alias("best"))
    return found.select(*keys, F.col("best.v").alias("value"), (-F.col("best.p") if largest else F.col("best.p")).alias("place"))


def compare(zipped: DataFrame, keys: Iterable[str]) -> DataFrame:
    """rmsd, dot and all_equal of two stacks side by side (v and r)."""
    d = F.col(V) - F.col("r")
    return zipped.groupBy(*keys).agg(
        F.sqrt(F.avg(d * d)).alias("rmsd"), F.sum(F.col(V) * F.col("r")).alias("dot"), F.bool_and(F.col(V) == F.col("r")).alias("all_equal")
    )


NORMALIZED = {
    "min_max": lambda v, s: F.try_divide(v - s["min"], s["max"] - s["min"]),
    "mean_std": lambda v, s: F.try_divide(v - s["mean"], s["stddev"]),
    "l2": lambda v, s: F.try_divide(v, s["l2_norm"]),
    "mean_l2": lambda v, s: F.try_divide(v - s["mean"], s["mean_l2_norm"]),
}
STATISTICS = {"min_max": ("min", "max"), "mean_std": ("mean", "stddev"), "l2": ("l2_norm",), "mean_l2": ("mean", "mean_l2_norm")}


def normalize(pixels: DataFrame, mode: str, keys: Iterable[str] = ("image_id",)) -> DataFrame:
    """pixels with v normalized over the groups of keys; null where a group has no spread.

    The statistics are aggregated first and joined back, so a group of any size is never gathered.
    """
    keys = list(keys)
    stats = reduce(pixels, keys, *STATISTICS[mode])
    joined = pixels.join(stats, keys) if keys else pixels.crossJoin(F.broadcast(stats))  # one row
    value = NORMALIZED[mode](F.col(V), {n: F.col(n) for n in STATISTICS[mode]})
    return joined.withColumn(V, value).select(*pixels.columns)


def normalize_dense(stack: DataFrame, mode: str) -> DataFrame:
    """Each image of a stack normalized, within its row: no shuffle. Null values where an image has no spread."""

    def one(v: np.ndarray) -> np.ndarray:
        low = v.min() if mode == "min_max" else 0.0 if mode == "l2" else v.mean()
        width = {
            "min_max": lambda: v.max() - v.min(),
            "mean_std": v.std,
            "l2": lambda: np.sqrt((v * v).sum()),
            "mean_l2": lambda: np.sqrt(((v - low) ** 2).sum()),
        }[mode]()
        return (v - low) / width if width else np.full(v.shape, np.nan)

    return dense(stack, one).withColumn("values", F.transform("values", lambda v: F.nanvl(v, F.lit(None).cast("double"))))


def histogram(pixels: DataFrame, n_bins: int, keys: Iterable[str] = ("image_id",)) -> DataFrame:
    """Counts per bin of values in [0, 1], bins without values included."""
    keys = list(keys)
    bin_of = F.least(F.greatest(F.round(F.col(V) * n_bins), F.lit(0.0)), F.lit(float(n_bins - 1))).cast("long")
    counts = pixels.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    every = exploded(pixels.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long")))))
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Rows and columns of a block of a matrix, and elements of products that a task makes at once.
BLOCK = 64
PRODUCTS = 1 << 19


def _blocks(matrix: DataFrame, row: str, column: str, names: tuple[str, str], block: int) -> DataFrame:
    """image_id, the block's place as `names`, entries: elements by their place in it."""
    place = F.col(row) % block * block + F.col(column) % block
    at = [F.floor(F.col(c) / block).cast("long").alias(n) for c, n in zip((row, column), names, strict=True)]
    placed = matrix.select("image_id", *at, F.struct(place.cast("long").alias("place"), F.col(V).cast("double").alias("v")).alias("e"))
    return placed.groupBy("image_id", *names).agg(F.collect_list("e").alias("entries"))


def matmul(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, transpose_a: bool = False, transpose_b: bool = False, block: int = BLOCK) -> DataFrame:
    """alpha * op(A) op(B) + beta * C per image; matrices are pixels with rows y and columns x. An element has a row where
    both matrices have elements of one inner index for it.

    Blocks of `block` rows and columns meet by their inner place and are multiplied in numpy; the products of equal place come to
    one task as a stream, which holds their sum."""
    row, inner = ("x", "y") if transpose_a else ("y", "x")
    inner_b, column = ("x", "y") if transpose_b else ("y", "x")
    left = exploded(_blocks(a, row, inner, ("m", "k"), block).withColumnRenamed("entries", "l"))
    right = exploded(_blocks(b, inner_b, column, ("k", "n"), block).withColumnRenamed("entries", "r"))
    key = ["image_id", "m", "n"]

    def dense_block(entries) -> tuple[np.ndarray, np.ndarray]:
        held, there = np.zeros((block, block)), np.zeros((block, block), bool)
        place = entries.values.field("place").to_numpy()
        held.ravel()[place], there.ravel()[place] = entries.values.field("v").to_numpy(zero_copy_only=False), True
        return held, there

    def product(x: np.ndarray, in_x: np.ndarray, y: np.ndarray, in_y: np.ndarray) -> np.ndarray:
        if np.isfinite(x).all() and np.isfinite(y).all():
            return x @ y
        out = np.zeros((block, block))  # what is absent is no zero to an infinite value
        for k in range(block):
            both = np.outer(in_x[:, k], in_y[k])
            with np.errstate(invalid="ignore"):
                out[both] += np.outer(x[:, k], y[k])[both]
        return out

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCTS // (block * block))
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                places, parts = [], []
                for l, r in zip(batch.column("l"), batch.column("r"), strict=True):
                    (x, in_x), (y, in_y) = dense_block(l), dense_block(r)
                    places.append(np.flatnonzero(in_x.astype(np.float32) @ in_y.astype(np.float32) > 0).astype(np.int32))
                    parts.append(product(x, in_x, y, in_y).ravel()[places[-1]])
                found = [pa.array(places, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *found], [*key, "place", "part"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, met = None, np.zeros(block * block), np.zeros(block * block, bool)

        def done() -> tuple[list, list[np.ndarray]]:
            place = np.flatnonzero(met)
            return [now[0]], [now[1] * block + place // block, now[2] * block + place % block, alpha * held[place]]

        def sums() -> Iterator[tuple[list, list[np.ndarray]]]:
            nonlocal now
            for batch in batches:
                ids = zip(*(batch.column(c).to_pylist() for c in key), strict=True)
                for at, place, part in zip(ids, arrays(batch, "place"), arrays(batch, "part"), strict=True):
                    if at != now:
                        if now is not None:
                            yield done()
                        now = at
                        held[:], met[:] = 0, False
                    held[place] += part
                    met[place] = True
            if now is not None:
                yield done()

        yield from in_batches(sums(), arrow)

    kind = a.schema["image_id"].dataType.simpleString()
    arrow = to_arrow_schema(a.select("image_id", F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"), F.lit(0.0).alias(V)).schema)
    products = left.join(right, ["image_id", "k"]).mapInArrow(multiply, f"image_id {kind}, m long, n long, place array<int>, part array<double>")
    out = products.repartition(*key).sortWithinPartitions(*key).mapInArrow(total, f"image_id {kind}, y long, x long, v double")
    if c is None or beta == 0:
        return out
    added = exploded(out).join(c.select("image_id", "y", "x", F.col(V).alias("c")), ["image_id", "y", "x"], "left")
    return added.select("image_id", "y", "x", (F.col(V) + beta * F.coalesce("c", F.lit(0.0))).alias(V))


def lstsq_quadratic(lines: DataFrame, keys: Iterable[str]) -> DataFrame:
    """a, b, c of the least-squares parabola a x^2 + b x + c through the points (x, v) of each group, from sums."""
    x, y = F.col("x").cast("double"), F.col(V)
    sums = lines.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(F.pow(x, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)],
        *[F.sum(y * F.pow(x, F.lit(k))).alias(f"t{k}") for k in (0, 1, 2)],
    )
    c = {k: F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}

    def det(p):
        return (
            p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1])
            - p[0][1] * (p[1][0] * p[2][2] - p[1][2] * p[2][0])
            + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0])
        )

    rows = [["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "n"]]
    right = ["t2", "t1", "t0"]
    whole = det([[c[e] for e in r] for r in rows])
    solved = [det([[c[right[i]] if j == k else c[e] for j, e in enumerate(r)] for i, r in enumerate(rows)]) for k in range(3)]
    return sums.filter("n >= 3").select(*keys, *[F.try_divide(s, whole).alias(n) for n, s in zip("abc", solved, strict=True)])


def sort_axis(pixels: DataFrame, axis: str = "x", ascending: bool = True) -> DataFrame:
    """Every line along the axis sorted: the index becomes the rank."""
    others = [k for k in ("image_id", "z", "y", "x") if k != axis]
    order = F.col(V).asc() if ascending else F.col(V).desc()
    return pixels.withColumn(axis, (F.row_number().over(W.partitionBy(*others).orderBy(order, axis)) - 1).cast("long"))


State = tuple[float, ...]


@dataclass(frozen=True)
class Reduction:
    """A user's reduction: accumulate adds an array of values to a state (numbers, as many as in init), join makes one state of two,
    post a number of the last one. join(init, s) must be s."""

    init: State
    accumulate: Callable[[State, np.ndarray], State]
    join: Callable[[State, State], State]
    post: Callable[[State], float]


#: Groups whose states a task holds, and tasks whose states are joined together in one step.
HELD_GROUPS, JOINED_TASKS = 50_000, 256


def reduce_axes_ewise(pixels: DataFrame, keys: Iterable[str], reduction: Reduction) -> DataFrame:
    """keys, value: a user's reduction of each group of pixels.

    Every task accumulates states of its own rows; the states of JOINED_TASKS tasks are joined, then those of the whole
    table, in the order of tasks. A group of any size is a state a task, and no task holds its values."""
    keys = list(keys)
    typed = pixels.select(*keys, F.col(V).cast("double").alias(V)).filter(F.col(V).isNotNull())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.select(*keys).schema)
    schema = f"{fields}{', ' if keys else ''}_task long, _state array<double>"

    def out(states: dict[tuple, State], task: int, types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in states], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(states), pa.int64()), pa.array([list(s) for s in states.values()], pa.list_(pa.float64()))], [*keys, "_task", "_state"])

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, types = TaskContext.get().partitionId(), []
        states: dict[tuple, State] = {}
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            values = batch.column(V).to_numpy(zero_copy_only=False)
            if keys:
                at = pa.table({**{k: batch.column(k) for k in keys}, "_at": np.arange(len(values))}).group_by(keys).aggregate([("_at", "list")])
                groups = zip(zip(*(at.column(k).to_pylist() for k in keys), strict=True), (values[np.asarray(x.values)] for x in at.column("_at_list")), strict=True)
            else:
                groups = [((), values)] if len(values) else []
            for key, own in groups:
                states[key] = reduction.accumulate(states.get(key, reduction.init), own)
            if len(states) > HELD_GROUPS:
                yield out(states, task, types)
                states = {}
        if states:
            yield out(states, task, types)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by keys and task, so the states to join follow each other."""
        at, state, done, types = None, reduction.init, {}, []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            named = zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * batch.num_rows
            for key, to, held in zip(named, batch.column("_to").to_pylist(), batch.column("_state").to_pylist(), strict=True):
                if at != (to, key):
                    if at is not None:
                        done.setdefault(at[0], {})[at[1]] = state
                    if sum(map(len, done.values())) >= HELD_GROUPS:
                        yield from (out(states, task, types) for task, states in done.items())
                        done = {}
                    at, state = (to, key), reduction.init
                state = reduction.join(state, tuple(held))
        if at is not None:
            done.setdefault(at[0], {})[at[1]] = state
        yield from (out(states, task, types) for task, states in done.items())

    @F.pandas_udf("double")
    def post(states: pd.Series) -> pd.Series:
        return pd.Series([float(reduction.post(tuple(s))) for s in states], dtype="float64")

    states = typed.mapInArrow(accumulate, schema)
    for to in (F.floor(F.col("_task") / JOINED_TASKS), F.lit(0)):
        dealt = states.withColumn("_to", to.cast("long")).repartition(*keys, "_to").sortWithinPartitions(*keys, "_to", "_task")
        states = dealt.mapInArrow(join, schema)
    return states.select(*keys, post("_state").alias("value"))


def reduce_ewise(stack: DataFrame, zero: Column, accumulate, finish=None) -> DataFrame:
    """A user's reduction of each image: accumulate(state, value), then finish(state); columns, within the row."""
    return stack.select("image_id", F.aggregate("values", zero, accumulate, finish).alias("value"))


def reduce_iwise(images: DataFrame, shape: Shape, keys: Iterable[str], value, **aggregates) -> DataFrame:
    """Reductions of a function of the index alone, value(batch, z, y, x), over all axes but `keys`: for each name its
    aggregate of a column. No pixels are read; images has `batch`."""
    made = iwise(images, shape, value)
    return made.groupBy(*keys).agg(*[f(F.col(V)).alias(name) for name, f in aggregates.items()])
