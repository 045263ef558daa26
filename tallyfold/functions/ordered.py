"""Sums and recurrences along an order within keys, where a key with most of the rows is no single task.

A key's rows are cut into spans (of time). What a span adds up to is one row; these rows are carried from span to
span, and within a span the order is walked from where the spans before it end. Keys may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.sources.scratch import settle, ship


def _meet(rows: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """rows with the other columns of the row of spans of their key and _span."""
    theirs = spans.select(*(F.col(k).alias(f"_of_{k}") for k in key), *(c for c in spans.columns if c not in key))
    same = [rows[k].eqNullSafe(theirs[f"_of_{k}"]) for k in key]
    return rows.join(theirs, same).drop(*(f"_of_{k}" for k in key))


def running_sums(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], span: Column) -> DataFrame:
    """rows with, for each of sums, its sum over the rows of the key that come before in the order; spans follow the order."""
    keys = [*key, "_span"]
    own = rows.withColumns({"_span": span} | {f"_v_{n}": v for n, v in sums.items()})
    totals = own.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    none = lambda n: F.lit(0).cast(own.schema[f"_v_{n}"].dataType)
    earlier = Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *(F.coalesce(F.sum(f"_t_{n}").over(earlier), none(n)).alias(f"_s_{n}") for n in sums))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), none(n))).alias(n) for n in sums]
    return _meet(own, starts, keys).select(*rows.columns, *before)


def prefix_maps(first: np.ndarray, scale: np.ndarray, shift: np.ndarray, carried: tuple = (1.0, 0.0)) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For each row the composition of the maps x -> scale * x + shift of the rows before it in its group, and that of all rows of the last group.

    shift has one value for each row, or a row of several, for several x of the same scale. first: which rows begin a group; carried: what came
    before the first row, if it begins none. Compositions are doubled in length, log2(rows) times.
    """
    n = len(first)
    a, b = np.concatenate([[carried[0]], scale[:-1]]), np.concatenate([np.broadcast_to(carried[1], shift[:1].shape), shift[:-1]])
    a[first], b[first] = 1.0, 0.0
    done = first.copy()
    done[0] = True
    step = 1
    while step < n and not done[step:].all():
        # rows whose composition doesn't reach the start of their group take in that of the row `step` before
        at = step + np.flatnonzero(~done[step:])
        b[at], a[at] = (a[at] * b[at - step].T).T + b[at], a[at] * a[at - step]
        done[at] = done[at - step]
        step *= 2
    return a, b, (scale[-1] * a[-1], scale[-1] * b[-1] + shift[-1])


def _walked(columns: list[str], n: int, schema: pa.Schema):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = (1.0, 0.0)
        for batch in batches:
            if batch.num_rows:
                first, scale, *shift = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_first", "_scale", *(f"_shift{i}" for i in range(n))))
                a, b, carried = prefix_maps(first.astype(bool), scale, np.stack(shift, axis=1), carried)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(a), *(pa.array(b[:, i].copy()) for i in range(n))], schema=schema)

    return walk


def _with_prefix(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """rows with _a and _b0 and so on, the composition of the maps of the rows before them in their key, for each of n shifts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    # the window leaves each key's rows together and in order
    sorted_ = rows.withColumn("_first", place == 1)
    out = T.StructType([*rows.schema, T.StructField("_a", T.DoubleType()), *(T.StructField(f"_b{i}", T.DoubleType()) for i in range(n))])
    return sorted_.mapInArrow(_walked(rows.columns, n, to_arrow_schema(out)), out)


def recurrence(rows: DataFrame, key: list[str], order: list[str], scale: Column, shifts: dict[str, Column], span: Column | None) -> DataFrame:
    """rows with, for each of shifts, its x = scale * (x of the row before, 0 for the first) + shift along the order within the key, and <name>_before, x of the row before.

    scale and shifts are doubles without nulls. Maps are composed, never divided by, so a scale of 0 starts anew and long products fade to 0.
    Without a span a key is walked whole, where all its rows are together, and nothing is joined.
    """
    ship(rows.sparkSession)
    keys, n = [*key, "_span"], len(shifts)
    spans = {} if span is None else {"_span": span}
    own = rows.withColumns(spans | {"_scale": scale.cast("double")} | {f"_shift{i}": s.cast("double") for i, s in enumerate(shifts.values())})
    value = {name: F.col("_scale") * F.col(f"{name}_before") + F.col(f"_shift{i}") for i, name in enumerate(shifts)}
    if span is None:
        found = _with_prefix(own, key, order, n).withColumns({f"{name}_before": F.col(f"_b{i}") for i, name in enumerate(shifts)})
        return found.select(*rows.columns, *(f"{name}_before" for name in shifts), *(v.alias(name) for name, v in value.items()))
    # read twice: for the spans' ends and for their rows
    inner = settle(_with_prefix(own, keys, order, n))
    end = [(F.col("_scale") * F.col("_a")).alias("_scale"), *((F.col("_scale") * F.col(f"_b{i}") + F.col(f"_shift{i}")).alias(f"_shift{i}") for i in range(n))]
    ends = inner.groupBy(*keys).agg(F.max_by(F.struct(*end), F.struct(*order)).alias("whole")).select(*keys, "whole.*")
    # all starts at 0, so what is left of a span's prefix is its shift
    starts = _with_prefix(ends, key, ["_span"], n).select(*keys, *(F.col(f"_b{i}").alias(f"_start{i}") for i in range(n)))
    before = {f"{name}_before": F.col("_a") * F.col(f"_start{i}") + F.col(f"_b{i}") for i, name in enumerate(shifts)}
    found = _meet(inner, starts, keys).withColumns(before)
    return found.select(*rows.columns, *before, *(v.alias(name) for name, v in value.items()))
